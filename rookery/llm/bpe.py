"""Encoding and decoding with a public byte-level BPE vocabulary, distributed over a corpus."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rookery.llm.pretokenize import pieces

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct pieces a worker remembers; the cache is emptied beyond it, which changes time but no result.
CACHE_PIECES = 400_000
#: Characters that one scan takes at once (a longer text is still scanned whole).
SCAN_CHARS = 1_000_000


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    """The vocabulary file: a line per token with its bytes in base64 and its rank, which is its id."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(2)
def ranks_of(vocabulary: bytes) -> dict[bytes, int]:
    out = {}
    for line in vocabulary.splitlines():
        if line:
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Token ids of one piece: the adjacent pair of lowest rank merges, leftmost first, until none is known.

    A heap over a linked list of parts, so that a piece of any length takes n log n steps.
    """
    if piece in ranks:
        return (ranks[piece],)
    n = len(piece)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        r, i, e = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != e:
            continue  # one of the two parts has grown or gone since
        alive[j] = False
        end[i], nxt[i] = e, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            r = ranks.get(piece[i : end[nxt[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        p = prv[i]
        if p >= 0:
            r = ranks.get(piece[p:e])
            if r is not None:
                heapq.heappush(heap, (r, p, e))
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])


class _Cache(dict):
    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@lru_cache(2)
def _cache(vocabulary: bytes) -> _Cache:
    return _Cache(ranks_of(vocabulary))


def encode_texts(texts: list[str | None], vocabulary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, ids per text); null and empty texts have none."""
    cache = _cache(vocabulary)
    texts = [t or "" for t in texts]
    flat: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SCAN_CHARS):
            size += len(texts[hi])
            hi += 1
        joined, s, e, per_text = pieces(texts[lo:hi])
        found = [cache[joined[a:b]] for a, b in zip(s.tolist(), e.tolist())]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat.append(np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())))
        text_of = np.repeat(np.arange(hi - lo), per_text)
        counts.append(np.bincount(text_of, weights=sizes, minlength=hi - lo).astype(np.int64))
        lo = hi
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(flat or empty).astype(np.int32), np.concatenate(counts or empty)


def decode_ids(ids: list[int], vocabulary: bytes) -> str:
    """The text of a list of ids; the inverse of encoding for any text."""
    back = _inverse(vocabulary)
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")


@lru_cache(2)
def _inverse(vocabulary: bytes) -> dict[int, bytes]:
    return {v: k for k, v in ranks_of(vocabulary).items()}


def token_ends(ids: np.ndarray, counts: np.ndarray, vocabulary: bytes) -> np.ndarray:
    """End of every token in bytes of its own text, aligned with ``ids``."""
    size = _sizes(vocabulary)[ids]
    total = np.cumsum(size)
    first = np.cumsum(counts) - counts
    before = np.where(first > 0, total[np.maximum(first, 1) - 1], 0) if len(total) else first
    return total - np.repeat(before, counts)


@lru_cache(2)
def _sizes(vocabulary: bytes) -> np.ndarray:
    r = ranks_of(vocabulary)
    out = np.zeros(max(r.values()) + 1, np.int64)
    for k, v in r.items():
        out[v] = len(k)
    return out


def _rows(key: str, text: str, vocabulary: bytes, make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            ids, counts = encode_texts(texts, vocabulary)
            yield pa.RecordBatch.from_arrays([b.column(0), *make(ids, counts)], names=[key, *make.names])

    return run


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: bytes, offsets: bool = False) -> DataFrame:
    """(key, ids[, ends]): token ids of every row's text, special tokens never produced.

    Null and empty texts give the empty list; text that looks like a special token is ordinary text; a text
    of any length is encoded whole. Repeated rows and ties give a row each. ``ends`` are the tokens' ends in
    bytes of the UTF-8 text, for decoding parts. Other columns are not read. No shuffle: one pass over the
    files, Arrow batches in and out.
    """
    code = "long" if dict(df.dtypes)[key] == "bigint" else dict(df.dtypes)[key]

    def make(ids: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
        at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        cols = [pa.ListArray.from_arrays(at, pa.array(ids, pa.int32()))]
        if offsets:
            cols.append(pa.ListArray.from_arrays(at, pa.array(token_ends(ids, counts, vocabulary).astype(np.int32), pa.int32())))
        return cols

    make.names = ["ids", "ends"] if offsets else ["ids"]
    schema = f"`{key}` {code}, ids array<int>" + (", ends array<int>" if offsets else "")
    return df.select(key, text).mapInArrow(_rows(key, text, vocabulary, make), schema)


def count_corpus(df: DataFrame, key: str, text: str, vocabulary: bytes) -> DataFrame:
    """(key, n_tokens): the number of tokens of every row's text; 0 for null and empty."""
    code = dict(df.dtypes)[key]

    def make(ids: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
        return [pa.array(counts, pa.int64())]

    make.names = ["n_tokens"]
    return df.select(key, text).mapInArrow(_rows(key, text, vocabulary, make), f"`{key}` {code}, n_tokens bigint")
