"""Subject areas of documents by labelling functions and a latent model of their accuracy.

1. A sentence lexicon is learned from a bounded sample of labelled documents: in each language, sentences
   belong to one of the document's subjects or to none, and expectation maximisation finds which words and
   word pairs speak for which subject. Learning inside a language keeps the words every text of a language
   shares from speaking for anything.
2. Labelling functions look at every document and subject and each cast a vote at one of a few levels, or
   abstain: lexicon (share of its sentences), section (share of lines and posts that deal with it), address
   (handles, hosts and channels it names), source (who publishes it, in which language), and the labels of
   curators and of the crowd where there are any.
3. A latent model with one unknown truth per document and subject learns the prior and, for each function,
   how often it casts each vote when the subject applies and when not. It sees only how often each pattern
   of votes occurs in the whole corpus, a table whose size does not depend on the corpus.
4. A document gets the subjects whose posterior given its pattern is at least one half.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.session import cut

ADDRESS = regex.compile(r"https?://([^\s/]+)|@([\p{L}\p{N}_.]+)|/~?/?channel/([\p{L}\p{N}_-]+)")
INVISIBLE = regex.compile(r"\p{Cf}+")
#: Classes of code points: three kinds of letters that form tokens, ends of sentences, ends of lines.
CLASSES = (r"[\p{Han}\p{Katakana}ー]", r"\p{Hiragana}", r"[\p{L}\p{M}']", r"[.!?。！？]", r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_END, _LINE = 4, 5
#: Texts are worked on in pieces of so many characters (whole texts; a longer text is a piece of its own).
PIECE_CHARS = 1_000_000

#: Sentences of a language's average that each subject is taken to have shown beforehand.
SMOOTHING = 0.2
#: levels of the votes; 0 abstains
SHARE_LEVELS = np.array([1e-9, 0.1, 0.145, 0.2, 0.3])
#: functions that read the document come first, those that read labels last
TEXT_FUNCTIONS = 4
FUNCTIONS = {"lexicon": 7, "section": 5, "address": 3, "source": 3, "curator": 3, "crowd": 3}
#: what a level of each text function counts in the number of a pattern of text functions
TEXT_PLACES = (5 * 3 * 3, 3 * 3, 3, 1)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point, 0 for none; the first pattern that matches counts."""
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    out = np.zeros(0x110000, np.uint8)
    for k, p in reversed(list(enumerate(CLASSES, 1))):
        for m in regex.finditer(p + "+", every):
            a, z = ord(m[0][0]), ord(m[0][-1])
            out[a : z + 1] = k
    out[0xD800:0xE000] = 0
    return out


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    b = 0x9E3779B97F4A7C15
    up, down = np.full(n, b, np.uint64), np.full(n, pow(b, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _hash(token: str) -> int:
    return xxhash.xxh32_intdigest(token)


@dataclass
class Sentences:
    """Features of a batch: sorted unique (sentence, feature), and for each sentence its document and its section's number."""

    sentence: np.ndarray
    feature: np.ndarray
    doc: np.ndarray
    section: np.ndarray
    addresses: list[list[int]]


def _normal(text: str | None) -> str:
    """Case, width and invisible characters do not matter."""
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).lower()


def sentences(texts: list[str | None]) -> Sentences:
    """Words and word pairs of every sentence, whole texts; case, width and invisible characters do not matter."""
    normal = [_normal(t) for t in texts]
    addresses = [[_hash(next(x for x in m if x)) for m in ADDRESS.findall(t)] if "/" in t or "@" in t else [] for t in normal]
    parts, lo, chars = [], 0, 0
    for i, t in enumerate(normal):
        if chars and chars + len(t) > PIECE_CHARS:
            parts.append(_piece(normal[lo:i], lo))
            lo, chars = i, 0
        chars += len(t) + 1
    parts.append(_piece(normal[lo:], lo))
    n_sent, n_sec, out = 0, 0, []
    for sentence, feature, doc, section in parts:
        out.append((sentence + n_sent, feature, doc, section + n_sec))
        n_sent, n_sec = n_sent + len(doc), n_sec + (int(section[-1]) + 1 if len(section) else 0)
    return Sentences(*[np.concatenate(x) for x in zip(*out)], addresses)


def _piece(texts: list[str], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentence of a feature, feature, document of a sentence, line of a sentence) of normalised texts, without a loop over tokens.

    All texts lie in one array of code points, each followed by a line end. Tokens are runs of one class of
    letters, sentences end after certain marks and with lines; a token's hash is a difference of prefix sums.
    """
    codes = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[codes]
    letter = (kind > 0) & (kind < _END)
    before = np.append(np.uint8(0), kind[:-1])
    start = np.flatnonzero(letter & (kind != before))
    end = np.flatnonzero(letter & (kind != np.append(kind[1:], np.uint8(0)))) + 1
    size = 1 << max(20, int(len(codes)).bit_length())
    up, down = _powers(size)
    mixed = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D)
    sums = np.append(np.uint64(0), np.cumsum(mixed * up[: len(codes)], dtype=np.uint64))
    h = (sums[end] - sums[start]) * down[start]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    line = np.cumsum(kind == _LINE)[start]
    raw = np.cumsum(kind >= _END)[start]  # sentences, those without words included
    new = np.append(True, raw[1:] != raw[:-1]) if len(raw) else np.zeros(0, bool)
    of = np.cumsum(new) - 1
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    doc = first + np.searchsorted(ends, start[new], side="right")
    pair = ((h[:-1] * np.uint64(0x9E3779B1)) ^ (h[1:] + np.uint64(0x7F4A7C15))) & np.uint64(0xFFFFFFFF)
    same = of[:-1] == of[1:]
    key = np.concatenate([(of.astype(np.uint64) << np.uint64(32)) | h, (of[:-1][same].astype(np.uint64) << np.uint64(32)) | pair[same]])
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), doc, line[new]


@dataclass
class Model:
    """What the labelled sample taught; arrays are over the features of ``vocabulary`` (sorted)."""

    subjects: list[str]
    languages: list[str]
    vocabulary: np.ndarray
    language_weights: np.ndarray  # features x languages
    language_prior: np.ndarray
    weights: list[np.ndarray]  # per language: features x (subjects + none)
    priors: list[np.ndarray]
    addresses: dict[int, np.ndarray]  # address -> log odds per subject
    sources: dict[tuple[str, str], np.ndarray]  # (source, language) -> votes per subject


def _lookup(vocabulary: np.ndarray, feature: np.ndarray) -> np.ndarray:
    if len(vocabulary) == 0:
        return np.full(len(feature), -1)
    at = np.minimum(np.searchsorted(vocabulary, feature), len(vocabulary) - 1)
    return np.where(vocabulary[at] == feature, at, -1)


def _sum_rows(row: np.ndarray, weights: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows ``col`` of ``weights`` by ``row``, a column at a time so that nothing large is gathered."""
    out = np.zeros((n, weights.shape[1]))
    for k in range(weights.shape[1]):
        out[:, k] = np.bincount(row, weights=np.ascontiguousarray(weights[:, k])[col], minlength=n)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def languages_of(m: Model, s: Sentences, idx: np.ndarray, n_docs: int) -> np.ndarray:
    """The most probable language of every document, from its words alone."""
    ok = idx >= 0
    score = _sum_rows(s.doc[s.sentence[ok]], m.language_weights, idx[ok], n_docs) + m.language_prior
    return score.argmax(axis=1)


def fit(texts: list[str | None], langs: list[str | None], sources: list[str | None], labels: list[dict[str, set[str]]], subjects: list[str], rounds: int = 15, least: int = 3) -> Model:
    """Learn the model from labelled documents; ``labels`` has the subjects by label source for each.

    Subjects a curator named, or else the crowd, are what a document's sentences may be about; others stay
    possible with a small weight, as labels may be wrong or incomplete, more so those of the crowd.
    """
    n, ns = len(texts), len(subjects)
    s = sentences(texts)
    vocabulary, inverse, counts = np.unique(s.feature, return_inverse=True, return_counts=True)
    keep = counts >= least
    new = np.cumsum(keep) - 1
    idx = np.where(keep[inverse], new[inverse], -1) if len(inverse) else inverse
    vocabulary = vocabulary[keep]
    nv = len(vocabulary)
    known = sorted({x for x in langs if x}) or ["?"]
    # language: naive Bayes on documents, the (sometimes wrong) language column as label
    lang_no = np.array([known.index(x) if x else -1 for x in langs]) if n else np.zeros(0, int)
    lw = np.zeros((nv, len(known)))
    ok = idx >= 0
    by_doc = lang_no[s.doc[s.sentence]]
    for k in range(len(known)):
        c = np.bincount(idx[ok & (by_doc == k)], minlength=nv)
        lw[:, k] = np.log((c + 0.05) / (c.sum() + 0.05 * max(nv, 1)))
    lp = np.log(np.array([(lang_no == k).sum() + 1.0 for k in range(len(known))]))
    m = Model(subjects, known, vocabulary, lw, lp - lp.max(), [], [], {}, {})
    lang = languages_of(m, s, idx, n) if n else np.zeros(0, int)
    allow = np.full((n, ns + 1), 1e-4)
    clear = np.zeros(n, bool)
    allow[:, ns] = 1
    truth = np.zeros((n, ns), bool)
    for d, by in enumerate(labels):
        sure = "curator" in by
        if not sure:
            allow[d, :ns] = 1e-3
        for x in by["curator"] if sure else by.get("crowd", ()):
            if x in subjects:
                allow[d, subjects.index(x)] = 1
                truth[d, subjects.index(x)] = True
        clear[d] = sure and truth[d].sum() <= 1
    for k in range(len(known)):
        mine = np.flatnonzero(lang[s.doc] == k)
        w, p = _fit_language(mine, s, idx, allow, clear, nv, rounds)
        m.weights.append(w)
        m.priors.append(p)
    # addresses and sources: smoothed log odds against the corpus rate
    rate = (truth.sum(0) + 1.0) / (n + 2.0)
    seen: dict[int, list[int]] = {}
    for d, a in enumerate(s.addresses):
        for x in set(a):
            seen.setdefault(x, []).append(d)
    for x, ds in seen.items():
        if len(ds) >= 5:
            got = (truth[ds].sum(0) + 4 * rate) / (len(ds) + 4.0)
            m.addresses[x] = np.log(got / (1 - got)) - np.log(rate / (1 - rate))
    groups: dict[tuple[str, str], list[int]] = {}
    for d in range(n):
        groups.setdefault((sources[d] or "", known[lang[d]]), []).append(d)
    for g, ds in groups.items():
        if len(ds) >= 20:
            got = (truth[ds].sum(0) + 4 * rate) / (len(ds) + 4.0)
            m.sources[g] = np.where(got > 1.5 * rate, 2, np.where(got < 0.5 * rate, 1, 0)).astype(np.int8)
    return m


def _fit_language(mine: np.ndarray, s: Sentences, idx: np.ndarray, allow: np.ndarray, clear: np.ndarray, nv: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    ns1 = allow.shape[1]
    if len(mine) == 0 or nv == 0:
        return np.zeros((nv, ns1), np.float32), np.append(np.full(ns1 - 1, -20.0), 0.0)
    number = np.full(len(s.doc), -1)
    number[mine] = np.arange(len(mine))
    sel = (idx >= 0) & (number[s.sentence] >= 0)
    row, col = number[s.sentence[sel]], idx[sel]
    a = allow[s.doc[mine]]
    p = a / a.sum(1, keepdims=True)
    background = np.bincount(col, minlength=nv) / len(mine)
    # documents a curator gave one subject or none speak first: with several, subjects could trade places
    first = clear[s.doc[mine]]
    for i in range(rounds):
        q = p * first[:, None] if i < rounds // 2 and first.any() else p
        total = q.sum(0)
        w = np.empty((nv, ns1))
        for k in range(ns1):
            w[:, k] = np.bincount(col, weights=q[row, k], minlength=nv)
        w = np.log((w + SMOOTHING * background[:, None] + 1e-9) / (total + SMOOTHING))
        prior = np.log((total + 1) / (total.sum() + ns1))
        p = _softmax(_sum_rows(row, w, col, len(mine)) + prior + np.log(a))
    return w.astype(np.float32), prior


def votes(m: Model, texts: list[str | None], sources: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, subject, level of lexicon .. source as columns) for each pair with any sign of the subject, and the rest.

    The rest, a matrix of documents and subjects, has the levels of pairs without a sign as one number, -1 where
    there is a sign: a label may name such a pair.
    """
    n, ns = len(texts), len(m.subjects)
    s = sentences(texts)
    idx = _lookup(m.vocabulary, s.feature)
    ok = idx >= 0
    lang = languages_of(m, s, idx, n) if n else np.zeros(0, int)
    kind = np.full(len(s.doc), ns)
    for k in range(len(m.languages)):
        mine = np.flatnonzero(lang[s.doc] == k)
        if len(mine):
            number = np.full(len(s.doc), -1)
            number[mine] = np.arange(len(mine))
            sel = ok & (number[s.sentence] >= 0)
            score = _sum_rows(number[s.sentence[sel]], m.weights[k], idx[sel], len(mine)) + m.priors[k]
            kind[mine] = score.argmax(1)
    hit = kind < ns
    count = np.bincount(s.doc[hit] * ns + kind[hit], minlength=n * ns).reshape(n, ns)
    total = np.bincount(s.doc, minlength=n)[:, None]
    # a line lies in one document: its first sentence names it
    lines, first = np.unique(s.section, return_index=True)
    doc_of = s.doc[first]
    seen = np.unique(np.searchsorted(lines, s.section[hit]) * ns + kind[hit])
    in_sections = np.bincount(doc_of[seen // ns] * ns + seen % ns, minlength=n * ns).reshape(n, ns) if len(seen) else np.zeros((n, ns), np.int64)
    sections = np.bincount(doc_of, minlength=n)[:, None]
    share = count / np.maximum(total, 1)
    lexicon = 1 + np.searchsorted(SHARE_LEVELS, share, side="right")
    lexicon = np.where(total > 0, lexicon, 0)
    section = np.where(sections >= 3, 1 + np.searchsorted([1e-9, 0.15, 0.3], in_sections / np.maximum(sections, 1), side="right"), 0)
    address = np.zeros((n, ns), np.int64)
    for d, a in enumerate(s.addresses):
        got = [m.addresses[x] for x in a if x in m.addresses]
        if got:
            v = np.sum(got, axis=0)
            address[d] = np.where(v > 1.5, 2, np.where(v < -1.5, 1, 0))
    source = np.zeros((n, ns), np.int64)
    for d in range(n):
        v = m.sources.get((sources[d] or "", m.languages[lang[d]]))
        if v is not None:
            source[d] = v
    sign = (count > 0) | (address == 2)
    d, k = np.nonzero(sign)
    levels = np.stack([lexicon, section, address, source], 2)
    return d, k, levels[d, k], np.where(sign, -1, levels @ np.array(TEXT_PLACES))


def pattern_of(levels: np.ndarray) -> np.ndarray:
    """One number for a row of levels in the order of FUNCTIONS."""
    out = np.zeros(len(levels), np.int64)
    for j, base in enumerate(FUNCTIONS.values()):
        out = out * base + levels[:, j]
    return out


def levels_of(pattern: np.ndarray) -> np.ndarray:
    out = np.zeros((len(pattern), len(FUNCTIONS)), np.int64)
    for j, base in reversed(list(enumerate(FUNCTIONS.values()))):
        out[:, j], pattern = pattern % base, pattern // base
    return out


def latent(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior of the truth for each pattern, by expectation maximisation over pattern counts.

    Starts from the belief that higher levels speak for the subject and that curators are nearly always
    right; abstentions carry no information. Empty input gives an empty result.
    """
    lv = levels_of(patterns)
    bases = list(FUNCTIONS.values())
    post = np.clip((lv[:, 0] - 1) / 5.0, 0.02, 0.98)
    cur = list(FUNCTIONS).index("curator")
    post = np.where(lv[:, cur] == 2, 0.97, np.where(lv[:, cur] == 1, 0.03, post))
    for _ in range(rounds):
        yes, no = (counts * post).sum(), (counts * (1 - post)).sum()
        score = np.full(len(patterns), np.log(max(yes, 1e-9)) - np.log(max(no, 1e-9)))
        for j, base in enumerate(bases):
            a = np.bincount(lv[:, j], weights=counts * post, minlength=base) + 0.5
            b = np.bincount(lv[:, j], weights=counts * (1 - post), minlength=base) + 0.5
            a[0] = b[0] = 0
            if a.sum() > 0:
                ratio = np.log(np.maximum(a, 1e-12) / a.sum()) - np.log(np.maximum(b, 1e-12) / b.sum())
                score += np.where(lv[:, j] > 0, ratio[lv[:, j]], 0)
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return post


def labelled_sample(documents: DataFrame, labels: DataFrame, max_labelled: int, max_chars: int) -> DataFrame:
    """(doc_id, text, lang, source, labels) of labelled documents, the first by a hash of the id.

    At most ``max_labelled`` documents and ``max_chars`` characters in all; a document with more than a
    hundredth of those is passed over. Whole texts only.
    """
    per = labels.groupBy("doc_id").agg(F.collect_set(F.struct("label_source", "subject")).alias("labels"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    per = per.orderBy(*order).limit(max_labelled)
    # at most ``max_labelled`` rows are broadcast: the texts of all other documents stay where they are
    sizes = documents.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n")).where(F.col("n") <= max_chars // 100).join(F.broadcast(per), "doc_id")
    chosen = sizes.withColumn("upto", F.sum("n").over(Window.orderBy(*order))).where(F.col("upto") <= max_chars).select("doc_id", "labels").dropDuplicates(["doc_id"])
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", "source").join(F.broadcast(chosen.withColumnRenamed("doc_id", "l__")), F.col("doc_id") == F.col("l__")).drop("l__")


def fitted(sample: DataFrame, subjects: list[str]) -> bytes:
    """The pickled model of a bounded sample, fitted in one task of an executor; the driver receives the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["text"] or ""))
        marks: list[dict[str, set[str]]] = []
        for r in rows:
            by: dict[str, set[str]] = {}
            for x in r["labels"]:
                by.setdefault(x["label_source"] or "crowd", set()).update([x["subject"]] if x["subject"] else [])
            marks.append(by)
        model = fit([r["text"] for r in rows], [r["lang"] for r in rows], [r["source"] for r in rows], marks, subjects)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    got = sample.repartition(1).mapInArrow(run, "model binary").first()
    return bytes(got[0]) if got else pickle.dumps(fit([], [], [], [], subjects))


def subject_posteriors(documents: DataFrame, labels: DataFrame, areas: DataFrame, max_labelled: int = 20_000, max_chars: int = 30_000_000) -> DataFrame:
    """(doc_id, subject, posterior) for every document and subject of which its text or a label shows any sign.

    Other pairs have a posterior near 0 and no row, as have null, empty and blank texts that no label names. Labels
    with subjects that are not in ``areas`` are ignored, as are labels of documents that are not there; a null
    subject is the label "none". Repeated labels count once; a document delivered several times is scored several
    times and comes out once. Without labels nothing can be learned and nothing comes out. ``max_labelled`` and
    ``max_chars`` bound the sample the lexicon is fitted on; votes, accuracies and posteriors cover all documents.
    """
    spark = documents.sparkSession
    subjects = sorted(r[0] for r in areas.select("subject").where("subject IS NOT NULL").distinct().collect())
    shipped = spark.sparkContext.broadcast(fitted(labelled_sample(documents, labels, max_labelled, max_chars), subjects))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shipped.value)
        for b in batches:
            d, k, lv, rest = votes(m, b.column(1).to_pylist(), b.column(2).to_pylist())
            each = np.arange(b.num_rows)
            ids = b.column(0).take(pa.array(np.concatenate([d, each])))
            number = np.concatenate([k, np.full(b.num_rows, -1)]).astype(np.int32)
            level = np.concatenate([lv @ np.array(TEXT_PLACES), np.zeros(b.num_rows, np.int64)]).astype(np.int32)
            # pairs with a sign have no rest; the row of the document itself (k = -1) has that of all others
            ends = np.concatenate([np.zeros(len(d) + 1, np.int64), (each + 1) * rest.shape[1]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number), pa.array(level), pa.ListArray.from_arrays(pa.array(ends), pa.array(rest.ravel().astype(np.int32)))], names=["doc_id", "k", "level", "rest"])

    seen = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source").mapInArrow(run, "doc_id bigint, k int, level int, rest array<int>")
    number = F.create_map(*[x for i, s in enumerate(subjects) for x in (F.lit(s), F.lit(i))]) if subjects else F.create_map(F.lit(""), F.lit(-1))
    who = F.coalesce("label_source", F.lit("crowd"))
    said = lambda w: F.coalesce(F.max((who == w).cast("int")), F.lit(0)).alias(w)
    named = lambda w: F.array_compact(F.collect_set(F.when(who == w, F.try_element_at(number, "subject")))).alias(f"{w}_names")
    per = labels.groupBy(F.col("doc_id").cast("bigint").alias("l__")).agg(said("curator"), said("crowd"), named("curator"), named("crowd"))
    joined = seen.join(per, F.col("doc_id") == F.col("l__"), "left")
    # a document's own row stands for the pairs that only a label names
    extra = F.filter(F.array_union("curator_names", "crowd_names"), lambda k: F.get("rest", k) >= 0)
    joined = joined.withColumn("k", F.explode(F.when(F.col("k") >= 0, F.array("k")).otherwise(F.coalesce(extra, F.array().cast("array<int>")))))
    level = lambda w: F.when(F.array_contains(f"{w}_names", F.col("k")), 2).when(F.col(w) == 1, 1).otherwise(0)
    text = F.when(F.size("rest") > 0, F.get("rest", F.col("k"))).otherwise(F.col("level")).cast("bigint")
    pattern = (text * FUNCTIONS["curator"] + level("curator")) * FUNCTIONS["crowd"] + level("crowd")
    scored = cut(joined.select("doc_id", "k", pattern.alias("pattern")), "subjects")
    table = scored.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    pats, n = np.array([r["pattern"] for r in table], np.int64), np.array([r["n"] for r in table], float)
    post = latent(pats, n) if len(pats) else np.zeros(0)
    by_pattern = spark.createDataFrame([(int(p), float(x)) for p, x in zip(pats, post)], "pattern bigint, posterior double")
    names = F.array(*[F.lit(s) for s in subjects]) if subjects else F.array(F.lit(""))
    out = scored.join(F.broadcast(by_pattern), "pattern").select("doc_id", F.get(names, F.col("k")).alias("subject"), "posterior")
    return out.groupBy("doc_id", "subject").agg(F.max("posterior").alias("posterior"))
