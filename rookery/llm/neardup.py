"""Pairs of texts that share most of their words, found exactly and without comparing all pairs.

A text is its set of distinct words. Its fingerprint sets one of 64 bits per word, so the Hamming distance of
two fingerprints is at most the number of words that only one of the texts has, and texts that are at least
70 % similar, with n and m words, lie within 3 (n + m) / 17 of each other. Vantage points divide the texts
twice:

1. Between tasks. The vantage points are the single words: a text with n words lies at distance n - 1 from a
   word it has and n + 1 from any other, so each word divides all texts into an inner branch, a shard, and an
   outer one. One vantage point rules nothing out, as every ball crosses its boundary, but several do together
   (pigeonhole on the radius): a partner lacks at most p of a text's words, so of any p + 1 vantage points at
   least one has both in its inner branch. A text is stored in, and asks, the shards of its p + 1 rarest words;
   words that too many texts have count in pairs, of p + 2. This loses no pair.
2. Inside a shard. Vantage points are texts: a point splits its shard at the median distance into an inner and
   an outer branch, and by the triangle inequality a query of radius r at distance d from the vantage point needs
   the inner branch only if d - r reaches the boundary from above and the outer one only if d + r does from
   below; queries near the boundary visit both. Leaves are read in order of the distance to a vantage point of
   their own, and a query meets only those whose distance differs by no more than its radius.

Texts as vantage points from the start would not prune: word sets have so many dimensions that a query's ball
overlaps about half of all leaves (figures in the README). Exact copies (equal word sets) are represented by
one text throughout, and what the search returns is checked on the word sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.session import cut

WORD = regex.compile(r"[\p{L}\p{N}]+")
MASK48 = (1 << 48) - 1
#: Counters of the frequency sketch: words that share one count together, which only changes their order.
SKETCH = 1 << 18
#: A word seen in at most so many distinct texts is a shard of its own; more frequent ones go in pairs.
RARE = 512
#: Shards beyond this many rows are cut into blocks that meet pairwise.
SHARD_ROWS = 8192
#: Copies of other texts are told apart by a broadcast table up to so many rows, by a shuffle beyond.
BROADCAST_ROWS = 500_000
#: Tree nodes with at most so many points are leaves; how deep trees grow, not what is found.
LEAF = 128


class _Hashes(dict):
    """48-bit hashes of words; emptied when it has grown, which changes time but no result."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w) & MASK48
        return h


_HASHES = _Hashes()


def least_common(n, m):
    """Words two texts of n and m distinct words must share to be 0.7 similar (works on arrays)."""
    return (7 * (n + m) + 16) // 17


def radius(n, m):
    """Largest Hamming distance of the fingerprints of such texts."""
    return (3 * (n + m)) // 17


def prefixes(n):
    """How many of its n words a text may have beyond what it shares, as the smaller and as the larger partner."""
    smallest = (7 * n + 9) // 10
    return n - least_common(n, n), n - least_common(n, smallest)


def word_sets(texts: list[str | None], least: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(positions, sizes, hashes in a row, sorted within each) of the texts with at least ``least`` distinct words."""
    at, sizes, flat = [], [], []
    word = _HASHES.__getitem__
    for i, t in enumerate(texts):
        words = set(WORD.findall(t.lower())) if t else ()
        if len(words) >= least:
            at.append(i)
            sizes.append(len(words))
            flat.extend(map(word, words))
    h, n = np.array(flat, np.uint64), np.array(sizes, np.int64)
    return at, n, h[np.lexsort((h, np.repeat(np.arange(len(n)), n)))]


def _sets(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(id, h1, h2, words) of the rows with enough words; h1 and h2 identify the word set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n, h = word_sets(b.column(1).to_pylist(), least)
            six = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
            ends = np.concatenate([[0], np.cumsum(n * 6)]).astype(np.int32)
            view, e = memoryview(six), ends.tolist()
            digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(e, e[1:])]), np.int64).reshape(-1, 2)
            words = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(six)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(digest[:, 0]), pa.array(digest[:, 1]), words], names=["id", "h1", "h2", "words"])

    # so many words need at least as many letters and separators between them
    long_enough = F.char_length(text) >= 2 * least - 1
    rows = df.where(F.col(key).isNotNull() & long_enough).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id bigint, h1 bigint, h2 bigint, words binary")


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all hashes in a row, words per text) of a binary column of 6-byte hashes."""
    raw = words.to_pylist()
    n = np.fromiter((len(w) // 6 for w in raw), np.int64, len(raw))
    six = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view(np.uint64).ravel(), n


def _sketch(reps: DataFrame) -> np.ndarray:
    """Distinct texts per counter; SKETCH numbers whatever the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            flat, _ = _flat(b.column(0))
            total += np.bincount((flat % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["c", "n"])

    t = reps.select("words").mapInArrow(run, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH, np.int64)
    out[t["c"].to_numpy()] = t["n"].to_numpy()
    return out


def _mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (np.uint64(b) if isinstance(b, int) else b) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def shard_keys(flat: np.ndarray, n: np.ndarray, counts: np.ndarray, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, is a smaller partner's key) for texts given by their hashes in a row and their sizes."""
    doc = np.repeat(np.arange(len(n)), n)
    c = counts[(flat % np.uint64(SKETCH)).astype(np.int64)]
    o = np.lexsort((flat, c, doc))
    flat, c = flat[o], c[o]
    start = np.cumsum(n) - n
    pos = np.arange(len(flat)) - np.repeat(start, n)
    small, large = prefixes(n)
    small, large = np.repeat(small, n), np.repeat(large, n)
    single = (pos <= large) & (c <= rare) & (c >= 2)  # a word of one text is shared with none
    docs, keys, smaller = [doc[single]], [_mix(flat[single], 1)], [pos[single] <= small[single]]
    hot = (pos <= large + 1) & (c > rare)
    f, p, d = flat[hot], pos[hot], doc[hot]
    k = np.bincount(d, minlength=len(n))
    first = np.cumsum(k) - k
    within = small[hot] + 1
    for i in range(int(k.max()) - 1 if len(f) else 0):
        for j in range(i + 1, int(k.max())):
            t = np.flatnonzero(k > j)
            a, b = first[t] + i, first[t] + j
            docs.append(t)
            keys.append(_mix(f[a], f[b]))
            smaller.append(p[b] <= within[b])
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(smaller)


def fingerprints(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit fingerprints: one bit per word."""
    bits = np.uint64(1) << ((flat * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(58))
    out = np.zeros(len(n), np.uint64)
    np.bitwise_or.at(out, np.repeat(np.arange(len(n)), n), bits)
    return out


def _keyed(reps: DataFrame, counts: np.ndarray, rare: int) -> DataFrame:
    shipped = reps.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                flat, n = _flat(part.column(1))
                d, key, small = shard_keys(flat, n, shipped.value, rare)
                fp, rep = fingerprints(flat, n), part.column(0).to_numpy()
                size = (n[d] * 2 + small).astype(np.int32)
                # 40 bits of the key: shards that fall together are merely searched together
                cols = [pa.array((key >> np.uint64(24)).astype(np.int64)), pa.array(rep[d]), pa.array(size), pa.array(fp[d].view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "rep", "size", "fp"])

    return reps.select("rep", "words").mapInArrow(run, "key bigint, rep bigint, size int, fp bigint")


def tree_pairs(rep: np.ndarray, n: np.ndarray, small: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (smaller, larger partner) within one shard that the vantage-point tree cannot rule out."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    reach = radius(n, n)  # partners of a query are not larger than it

    def visit(points: np.ndarray, asking: np.ndarray) -> None:
        if not len(points) or not len(asking):
            return
        if len(points) > LEAF:
            some = points[:: max(1, len(points) // 64)]
            tries = some[:: max(1, len(some) // 4)][:4]
            spread = [np.bitwise_count(fp[some] ^ fp[v]).std() for v in tries]
            vantage = fp[tries[int(np.argmax(spread))]]
            d = np.bitwise_count(fp[points] ^ vantage).astype(np.int64)
            boundary = int(np.median(d))
            inner = d <= boundary
            if inner.any() and not inner.all():
                dq = np.bitwise_count(fp[asking] ^ vantage).astype(np.int64)
                visit(points[inner], asking[dq - reach[asking] <= boundary])
                visit(points[~inner], asking[dq + reach[asking] > boundary])
                return
        for lo in range(0, len(asking), 512):  # a leaf
            q = asking[lo : lo + 512]
            near = np.bitwise_count(fp[points][:, None] ^ fp[q][None, :]) <= radius(n[points][:, None], n[q][None, :])
            i, j = np.nonzero(near)
            p, r = points[i], q[j]
            ok = ((n[p] < n[r]) | (n[p] == n[r]) & (rep[p] < rep[r])) & (10 * n[p] >= 7 * n[r])
            if ok.any():
                out.append((p[ok], r[ok]))

    visit(np.flatnonzero(small), np.arange(len(rep)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def leaf_pairs(shard: np.ndarray, rep: np.ndarray, n: np.ndarray, small: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (smaller, larger partner) that the vantage points of leaves cannot rule out; many leaves side by side.

    ``shard`` numbers the leaf of each row and does not fall. A leaf's vantage point is the row farthest from its
    first one. Rows are put in order of their distance to it, and each meets the rows after it while their
    distance exceeds its own by no more than its radius: beyond, the triangle inequality rules all out.
    """
    none = np.zeros(0, np.int64)
    if not len(shard):
        return none, none
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    sizes = np.diff(np.append(first, len(shard)))
    away = np.bitwise_count(fp ^ np.repeat(fp[first], sizes)).astype(np.int64)
    far = np.lexsort((away, shard))[first + sizes - 1]
    d = np.bitwise_count(fp ^ np.repeat(fp[far], sizes)).astype(np.int64)
    order = np.lexsort((d, shard))
    rep, n, small, fp, d = rep[order], n[order], small[order], fp[order], d[order]
    last = np.repeat(first + sizes, sizes)
    reach = d + radius(n, 10 * n // 7)  # no partner has more words
    a, b = [], []
    todo, off = np.arange(len(shard)), 1
    while True:
        todo = todo[todo + off < last[todo]]
        todo = todo[d[todo + off] <= reach[todo]]
        if not len(todo):
            break
        i, j = todo, todo + off
        near = np.bitwise_count(fp[i] ^ fp[j]) <= radius(n[i], n[j])
        i, j = i[near], j[near]
        swap = (n[j] < n[i]) | (n[j] == n[i]) & (rep[j] < rep[i])
        p, r = np.where(swap, j, i), np.where(swap, i, j)
        ok = small[p] & (10 * n[p] >= 7 * n[r]) & (rep[p] != rep[r])
        a.append(order[p[ok]])
        b.append(order[r[ok]])
        off += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def shard_pairs(cols: list[np.ndarray], limit: int | None) -> np.ndarray:
    """Distinct candidate pairs of whole shards, given as columns (key, rep, n, small, fp) in order of the key.

    Shards up to LEAF rows are leaves, larger ones trees of them; shards of more than ``limit`` rows are passed over.
    """
    key, rep, n, small, fp = cols
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(new, len(key)))
    leaf = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= LEAF), sizes))
    p, r = leaf_pairs(np.repeat(np.arange(len(new)), sizes)[leaf], rep[leaf], n[leaf], small[leaf], fp[leaf])
    ps, rs = [leaf[p]], [leaf[r]]
    tree = (sizes > LEAF) & (sizes <= (limit or len(key)))
    for s, k in zip(new[tree].tolist(), sizes[tree].tolist()):
        x, y = tree_pairs(rep[s : s + k], n[s : s + k], small[s : s + k], fp[s : s + k])
        ps.append(x + s)
        rs.append(y + s)
    x, y = rep[np.concatenate(ps)], rep[np.concatenate(rs)]
    return np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)


def _search(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(a, b): candidate pairs of every shard of ``rows``, which are sorted by shard within partitions.

    Shards of more than ``limit`` rows are passed over. ``rows`` must come straight from its repartitioning by
    key: nothing between may let the planner split a partition.
    """

    def found(cols: list[np.ndarray]) -> pa.RecordBatch:
        pair = shard_pairs(cols, limit)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows_held = 0
        for b in batches:
            key, rep, size, fp = (b.column(i).to_numpy() for i in range(4))
            if not len(key):
                continue
            held.append([key, rep, (size >> 1).astype(np.int64), (size & 1).astype(bool), fp.view(np.uint64)])
            rows_held += len(key)
            if rows_held < 100_000:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            end = int(np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))[-1])  # the last shard may go on
            if end:
                yield found([x[:end] for x in cols])
            rest = slice(end, None if limit is None else end + limit + 1)  # of a shard to pass over, enough to tell
            held = [[x[rest] for x in cols]]
            rows_held = len(held[0][0])
        if held:
            yield found([np.concatenate(x) for x in zip(*held)])

    return rows.mapInArrow(run, "a bigint, b bigint")


def similar(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Row by row, whether two columns of word sets are at least 0.7 similar; at most 65,536 rows."""
    (u, n), (v, m) = _flat(x), _flat(y)
    row = lambda k: np.repeat(np.arange(len(k), dtype=np.uint64), k) << np.uint64(48)
    both = np.concatenate([u | row(n), v | row(m)])
    both.sort()
    twice = both[1:][both[1:] == both[:-1]]
    common = np.bincount((twice >> np.uint64(48)).astype(np.int64), minlength=len(n))
    return common >= least_common(n, m)


def _verified(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose word sets are at least 0.7 similar."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    needed = reps.select("rep", "words").join(ids, "rep", "left_semi").dropDuplicates(["rep"])
    both = pairs.join(needed.select(F.col("rep").alias("a"), F.col("words").alias("wa")), "a").join(needed.select(F.col("rep").alias("b"), F.col("words").alias("wb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                c = b.slice(lo, 4096)
                m = pa.array(similar(c.column(2), c.column(3)), pa.bool_())
                yield pa.RecordBatch.from_arrays([c.column(0).filter(m), c.column(1).filter(m)], names=["a", "b"])

    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, key: str, text: str, least_words: int = 10, rare: int = RARE) -> tuple[DataFrame, DataFrame]:
    """(links, members) of all texts that are at least 0.7 similar.

    A word is a longest run of letters and digits of the lower-cased text; similarity is the number of
    distinct words in both texts over the number in either. ``links`` are pairs (a, b), a < b, of class
    representatives, ``members`` is (rep, id, copies) with a row for every text that takes part; texts of equal word
    sets form a class represented by its smallest id. A text with fewer than ``least_words`` distinct words,
    null and empty ones included, takes no part. Rows delivered again (same id and text) count once, rows
    with a null id do not count. An empty table gives no rows. Other columns are not read. Words are
    compared by 48 bits of their hash: the chance that a given pair of texts of 50 words is judged wrongly
    is below 1e-11.

    Sent to the driver: the frequency sketch, 2^18 counters whatever the size of the corpus.
    """
    read = cut(_sets(df, key, text, least_words), "words")  # every text is read and hashed once
    sets = cut(read.select("id", "h1", "h2").distinct(), "wordsets")
    classes = sets.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = sets.join(classes, ["h1", "h2"]).select("rep", "id", "copies", "h1", "h2")
    copies = members.where("id <> rep").select("id", "h1", "h2")
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    reps = read.join(copies, ["id", "h1", "h2"], "left_anti").select(F.col("id").alias("rep"), "words")
    keyed = _keyed(reps, _sketch(reps), rare).repartition("key")
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > SHARD_ROWS)
    whole = keyed.sortWithinPartitions("key")
    # a large shard of k blocks becomes k (k + 1) / 2 shards, one for each pair of blocks
    blocks = F.ceil(F.col("rows") / SHARD_ROWS * 2).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks)
    other = keyed.join(large, "key").withColumn("k", blocks).withColumn("m", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    other = other.withColumn("key", F.xxhash64("key", F.least("m", "o"), F.greatest("m", "o"))).select("key", "rep", "size", "fp").repartition("key").sortWithinPartitions("key")
    pairs = cut(_search(whole, SHARD_ROWS).unionAll(_search(other)).distinct(), "pairs")
    links = _verified(pairs, reps)
    return links, members.select("rep", "id", "copies")


def expand(links: DataFrame, members: DataFrame, rows_per_task: int = 1_000) -> DataFrame:
    """(id_a, id_b), id_a < id_b: links and classes as pairs of single texts.

    A class of c equal texts gives c (c - 1) / 2 pairs, which is what was asked for; the compact form is links and
    members. The pairs of a large class are divided over parts of ``rows_per_task`` of its texts.
    """
    m = members
    cross = links.join(m.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
    cross = cross.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    many = m.where("copies > 1").withColumn("parts", F.ceil(F.col("copies") / rows_per_task).cast("int"))
    left = many.select("rep", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("id_a"))
    right = many.select("rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("id_b"))
    same = left.join(right, ["rep", "part"]).where("id_a < id_b").select("id_a", "id_b")
    return cross.where("id_a < id_b").unionAll(same)
