"""Word boundaries of a byte-level BPE without regular expressions.

Texts of a batch become one array of code points, then of character classes. A small automaton reads the
classes; because its transitions are functions on a handful of states they compose associatively, so the
state before every character follows from a parallel prefix scan: blocks compose their functions side by
side, the block functions are scanned by doubling, and a last sweep fills in the states. Emitting "a piece
starts here" is a table look-up on (state, class).

The pieces are those of the public pattern of the vocabulary: contractions 's 't 're 've 'm 'll 'd, runs of
letters, of digits or of other characters with at most one leading space, and white space that leaves its
last character to what follows.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

SEP = 0x110000  # stands between texts in the code point array; no character
LETTER, NUMBER, OTHER, SPACE, WHITE, BREAK = range(6)
#: classes as the automaton sees them, with one or two characters of look-ahead folded in
L, N, O, A1, A2, W_MID, S_LAST, W_LAST, X = range(9)
#: states: nothing open, letters, digits, others, one space that joins what follows, white space, contraction with 1 or 2 letters to come
Q0, QL, QN, QO, QS, QW, QC1, QC2 = range(8)
STATES, CLASSES, BLOCK = 8, 9, 64

# fixed values: the characters with the Unicode property White_Space
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def code_classes() -> np.ndarray:
    """Base class of every code point, SEP included."""
    t = np.full(SEP + 1, OTHER, np.uint8)
    for c in range(SEP):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            t[c] = LETTER
        elif k == "N":
            t[c] = NUMBER
    t[WHITE_SPACE] = WHITE
    t[0x20] = SPACE
    t[SEP] = BREAK
    return t


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a piece), both flat over state * CLASSES + class."""
    go = np.zeros((STATES, CLASSES), np.uint8)
    start = np.ones((STATES, CLASSES), bool)
    for cls, own in ((L, QL), (N, QN), (O, QO)):
        go[:, cls] = own
        start[[own, QS], cls] = False
    for cls, own in ((A1, QC1), (A2, QC2)):  # an apostrophe opens a contraction only where a piece starts
        go[:, cls] = own
        go[[QO, QS], cls] = QO
        start[[QO, QS], cls] = False
    go[QC2, L], start[QC2, L] = QC1, False
    go[QC1, L], start[QC1, L] = Q0, False
    go[:, W_MID] = QW
    start[QW, W_MID] = False
    go[:, S_LAST] = QS
    go[:, W_LAST] = Q0
    go[:, X] = Q0
    start[:, X] = False
    return go.ravel(), start.ravel()


def classes(points: np.ndarray) -> np.ndarray:
    """Automaton classes of an array of code points in which SEP ends every text."""
    base = code_classes()[points]
    nxt = np.append(base[1:], np.uint8(BREAK))
    out = np.array([L, N, O, W_MID, W_MID, X], np.uint8)[base]
    last = nxt <= OTHER
    out[(base == SPACE) & last] = S_LAST
    out[(base == WHITE) & last] = W_LAST
    at = np.flatnonzero(points == 0x27)
    if len(at):
        padded = np.append(points, [SEP, SEP]).astype(np.uint32)
        a, b = padded[at + 1], padded[at + 2]
        ch = lambda s: np.isin(a, [ord(c) for c in s])
        out[at[ch("stmd")]] = A1
        out[at[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = A2
    return out


def scan_starts(cls: np.ndarray) -> np.ndarray:
    """True where a piece starts, by an associative scan of transition functions."""
    go, start = automaton()
    n = len(cls)
    if n == 0:
        return np.zeros(0, bool)
    nb = -(-n // BLOCK)
    cols = np.full(nb * BLOCK, X, np.uint8)
    cols[:n] = cls
    cols = np.ascontiguousarray(cols.reshape(nb, BLOCK).T).astype(np.intp)
    # compose the functions of each block, all blocks side by side
    f = np.tile(np.arange(STATES, dtype=np.intp), (nb, 1))
    for j in range(BLOCK):
        f = go[f * CLASSES + cols[j][:, None]].astype(np.intp)
    # inclusive scan of the block functions by doubling
    step = 1
    while step < nb:
        g = f.copy()
        g[step:] = np.take_along_axis(f[step:], f[:-step], axis=1)
        f, step = g, step * 2
    state = np.zeros(nb, np.intp)
    state[1:] = f[:-1, Q0]
    out = np.empty((BLOCK, nb), bool)
    for j in range(BLOCK):
        at = state * CLASSES + cols[j]
        out[j] = start[at]
        state = go[at].astype(np.intp)
    return out.T.ravel()[:n]


def pieces(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts joined by one separator each, piece starts, piece ends, pieces per text); offsets are characters of the joined text."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(length + 1) - 1
    points[ends] = SEP
    s = np.flatnonzero(scan_starts(classes(points)))
    doc = np.searchsorted(ends, s)
    e = np.append(s[1:], len(points))[: len(s)]
    np.minimum(e, ends[doc], out=e)
    return joined, s, e, np.bincount(doc, minlength=len(texts))
