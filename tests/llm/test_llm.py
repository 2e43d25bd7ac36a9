"""Training-data operators against brute force, public encoders, exact round trips and held-out labels."""

import base64
import collections
import random
import string
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from harness import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rookery.llm import bpe, neardup, packing, pretokenize, queries, subjects
from rookery.session import cut

V = bpe.read_vocabulary()
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PUBLIC = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in (x.split() for x in V.splitlines() if x)}, special_tokens={})


# 8. tokens


def ids_of(texts):
    ids, n = bpe.encode_texts(texts, V)
    ends = np.cumsum(n)
    return [ids[e - k : e].tolist() for e, k in zip(ends, n)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \t\n'stremvld.1é日 ‍<|>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_ids_equal_a_public_encoder(texts):
    got = ids_of(texts)
    assert got == [PUBLIC.encode_ordinary(t) for t in texts]
    assert [bpe.decode_ids(i, V) for i in got] == texts


def test_documents_equal_both_public_libraries(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(docs, "doc_id", "text", V).collect()}
    hf = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    hf.encode_special_tokens = True
    for r in docs.collect():
        assert got[r["doc_id"]] == PUBLIC.encode_ordinary(r["text"] or "") == hf.encode(r["text"] or "", add_special_tokens=False).ids


def test_a_long_piece_and_a_long_text():
    for t in ("a" * 30_000, "'s" * 5000, " " * 20_000 + "x", "ab1 \n" * 300_000):
        assert ids_of([t]) == [PUBLIC.encode_ordinary(t)]


def test_scan_crosses_blocks():
    for n in (1, 63, 64, 65, 128, 129, 4097):
        t = ("word 12 'll\n" * 400)[:n]
        assert sum(map(len, ids_of([t]))) == len(PUBLIC.encode_ordinary(t))
        _, s, e, k = pretokenize.pieces([t, "", t])
        assert k[1] == 0 and k[0] == k[2] and (e > s).all()


def test_rows_without_text_and_offsets(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<|endoftext|> hi é"), (3, "x"), (None, "y")], "id int, t string").withColumns({"ids": F.lit(1), "ends": F.lit(1)})
    got = bpe.encode_corpus(df, "id", "t", V, offsets=True).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["id"]].append(r)
    assert by[1][0]["ids"] == by[2][0]["ids"] == [] and len(by[3]) == 2 and len(by[None]) == 1
    r = max(by[3], key=lambda r: len(r["ids"]))
    assert 50256 not in r["ids"]
    raw, lo = "<|endoftext|> hi é".encode(), 0
    for i, e in zip(r["ids"], r["ends"]):
        assert raw[lo:e] == bpe._inverse(V)[i]
        lo = e
    assert lo == len(raw)
    assert bpe.encode_corpus(df.limit(0), "id", "t", V).count() == 0


# 9. containers


def brute_padding(h, k):
    sizes = [s for s in range(1, len(h)) if h[s]]
    best = {(-1, 0): 0}
    for j in range(len(sizes)):
        for c in range(1, k + 1):
            best[j, c] = min((best[i, c - 1] + sum(h[sizes[m]] * (sizes[j] - sizes[m]) for m in range(i + 1, j + 1)) for i in range(-1, j) if (i, c - 1) in best), default=10**9)
    return min(best[len(sizes) - 1, c] for c in range(1, k + 1))


@pytest.mark.parametrize("seed", range(5))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    h = rng.integers(0, 9, 18) * (rng.random(18) < 0.7)
    h[0], h[17] = 0, 1
    for k in (1, 2, 4):
        b = packing.bucket_boundaries(h, k)
        pad = sum(h[s] * (min(x for x in b if x >= s) - s) for s in range(1, 18) if h[s])
        assert len(b) <= k and pad == brute_padding(h, k)


@pytest.mark.parametrize("seed,shards", [(0, 10), (1, 1000)])
def test_packing_fills_and_never_splits(spark, seed, shards):
    rng = random.Random(seed)
    n = [rng.choice([0, 1, 5, 99, 100, 101, 250, 64, 10, 7]) if rng.random() < 0.9 else rng.randrange(1, 100) for _ in range(1000)] + [None, -3]
    df = cut(spark.createDataFrame([(i, x) for i, x in enumerate(n)], "id int, size int").withColumns({"b": F.lit(1), "h": F.lit(1), "k": F.lit(1)}), "t")
    got = packing.pack(df, "id", "size", 100, buckets=32, shard_rows=shards).collect()
    per, load = collections.defaultdict(list), collections.Counter()
    for r in got:
        per[r["id"]].append((r["piece"], r["piece_size"]))
        load[r["container"]] += r["piece_size"]
    for i, x in enumerate(n):
        x = max(x or 0, 0)
        want = [100] * (x // 100) + ([x % 100] if x % 100 else []) or [0]
        assert sorted(per[i]) == list(enumerate(want))
    assert max(load.values()) <= 100
    assert sum(load.values()) / 100 / len([c for c, v in load.items() if v]) > 0.9
    assert {tuple(r) for r in got} == {tuple(r) for r in packing.pack(df, "id", "size", 100, buckets=32, shard_rows=shards).collect()}
    assert packing.pack(cut(df.limit(0), "e"), "id", "size", 100).count() == 0


@pytest.mark.parametrize("m,k", [(300, 7), (2000, 40)])
def test_boundaries_match_a_plain_recurrence(m, k):
    rng = np.random.default_rng(m)
    h = np.zeros(m + 1, np.int64)
    h[1:] = rng.integers(0, 50, m) * (rng.random(m) < 0.8)
    s = np.flatnonzero(h)
    c, t = np.append(0, np.cumsum(h[s])), np.append(0, np.cumsum(h[s] * s))
    best = c[1:] * s - t[1:]
    for _ in range(min(k, len(s)) - 1):
        best = np.array([min([best[j]] + [best[i] + (c[j + 1] - c[i + 1]) * s[j] - (t[j + 1] - t[i + 1]) for i in range(j)]) for j in range(len(s))]) if m < 500 else np.minimum(best, [np.min(best[:j] + (c[j + 1] - c[1 : j + 1]) * s[j] - (t[j + 1] - t[1 : j + 1])) if j else best[0] for j in range(len(s))])
    b = packing.bucket_boundaries(h, k)
    assert len(b) <= k and sum(h[x] * (b[np.searchsorted(b, x)] - x) for x in s) == best[-1]


def test_boundaries_of_a_large_capacity_need_little_memory():
    import tracemalloc

    h = np.random.default_rng(1).integers(0, 9, 32_769)
    h[0] = 0
    tracemalloc.start()
    b = packing.bucket_boundaries(h, 64)
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(b) == 64 and top < 150e6


def test_split_items_come_from_the_assignment(spark):
    n = [(1, 100), (2, 101), (3, 250), (4, 0), (5, None), (6, 99), (7, 1)]
    a = packing.pack(cut(spark.createDataFrame(n, "id int, size int"), "t"), "id", "size", 100)
    assert sorted(r["id"] for r in packing.split_items(a, "id").collect()) == [2, 3]


# 5. near-duplicates


def brute_pairs(texts, least):
    s = {i: set(neardup.WORD.findall((t or "").lower())) for i, t in texts}
    ids = sorted(i for i in s if len(s[i]) >= least)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if 10 * len(s[a] & s[b]) >= 7 * len(s[a] | s[b])}


def near_texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(60)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rng.shuffle(w)
            out.append(" ".join(w + rng.sample(vocabulary, rng.randrange(3))))
        else:
            out.append(" ".join(rng.sample(vocabulary, rng.randrange(10, 25))))
    return out


@pytest.mark.parametrize("seed,rare,leaf,shard", [(0, 512, 128, 8192), (1, 3, 4, 8192), (2, 0, 4, 20)])
def test_pairs_match_brute_force(spark, monkeypatch, seed, rare, leaf, shard):
    monkeypatch.setattr(neardup, "LEAF", leaf)  # of the driver; the trees themselves are tested below
    monkeypatch.setattr(neardup, "SHARD_ROWS", shard)
    texts = list(enumerate(near_texts(seed)))
    texts += [(1000, None), (1001, ""), (1002, "one two"), (1003, texts[0][1].upper()), (1004, texts[0][1] + " " + texts[0][1]), texts[3], (None, texts[0][1]), (1005, "w" + " x" * 50_000)]
    df = spark.createDataFrame(texts, "id int, text string").withColumns({"rep": F.lit(1), "h1": F.lit(1), "words": F.lit(1)})
    got = neardup.expand(*neardup.near_duplicates(df, "id", "text", 10, rare)).collect()
    want = brute_pairs([x for x in texts if x[0] is not None], 10)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert neardup.expand(*neardup.near_duplicates(df.limit(0), "id", "text")).count() == 0


def test_tree_loses_no_pair(monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 4)
    texts = [(i, t) for i, t in enumerate(near_texts(7, 200))]
    at, n, flat = neardup.word_sets([t for _, t in texts], 10)
    fp = neardup.fingerprints(flat, n)
    p, r = neardup.tree_pairs(np.array(at), n, np.ones(len(n), bool), fp)
    got = {tuple(sorted((at[a], at[b]))) for a, b in zip(p.tolist(), r.tolist())}
    assert got >= brute_pairs(texts, 10)
    assert len(got) < len(n) * (len(n) - 1) / 4  # and it does rule pairs out


def leaf_rows(seed, n=300):
    texts = list(enumerate(near_texts(seed, n)))
    at, size, flat = neardup.word_sets([t for _, t in texts], 10)
    return texts, np.array(at), size, neardup.fingerprints(flat, size)


def test_leaves_prune_by_distance_and_lose_no_pair():
    texts, at, n, fp = leaf_rows(5)
    shard = np.repeat([3, 8, 9], [1, len(at) - 100, 99])
    p, r = neardup.leaf_pairs(shard, at, n, np.ones(len(n), bool), fp)
    got = {tuple(sorted((int(at[a]), int(at[b])))) for a, b in zip(p, r)}
    leaf = dict(zip(at.tolist(), shard.tolist()))
    assert got >= {(a, b) for a, b in brute_pairs(texts, 10) if leaf[a] == leaf[b]} and got
    assert all(leaf[a] == leaf[b] for a, b in got) and neardup.leaf_pairs(shard[:0], at[:0], n[:0], n[:0] > 0, fp[:0])[0].size == 0


@pytest.mark.parametrize("broken", ["leaf_pairs", "tree_pairs"])
def test_without_vantage_points_pairs_are_lost(spark, monkeypatch, broken):
    """All pairs come from the two vantage-point searches: leaves and trees; there is no third way."""
    monkeypatch.setattr(neardup, "LEAF", 4 if broken == "tree_pairs" else 10**6)
    texts = near_texts(2)
    at, n, flat = neardup.word_sets(texts, 10)
    d, key, small = neardup.shard_keys(flat, n, np.full(neardup.SKETCH, 2), 512)
    o = np.argsort(key)
    rows = [key[o], np.array(at)[d[o]], n[d[o]], small[o], neardup.fingerprints(flat, n)[d[o]]]
    find = lambda: {tuple(x) for x in neardup.shard_pairs(rows, None).tolist()}
    full = find()
    assert brute_pairs(list(enumerate(texts)), 10) <= full
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(neardup, broken, lambda *a: (none, none))
    assert len(find()) < len(full) and (broken == "tree_pairs" or not find())


def test_similarity_of_columns_equals_that_of_sets():
    rng = random.Random(8)
    sets = [sorted(rng.sample(range(60), rng.randrange(10, 40))) for _ in range(400)]
    pack = lambda s: b"".join(x.to_bytes(6, "little") for x in s)
    a, b = sets[:200], [sorted(set(x[: rng.randrange(8, 40)]) | set(rng.sample(range(60), 3))) for x in sets[:200]]
    got = neardup.similar(pa.array(map(pack, a), pa.binary()), pa.array(map(pack, b), pa.binary()))
    assert got.tolist() == [10 * len(set(x) & set(y)) >= 7 * len(set(x) | set(y)) for x, y in zip(a, b)] and 0 < sum(got) < 200


def test_a_large_class_is_expanded_in_parts(spark):
    members = spark.createDataFrame([(1, i, 30) for i in range(1, 31)] + [(50, 50, 1)], "rep bigint, id bigint, copies bigint")
    links = spark.createDataFrame([(1, 50)], "a bigint, b bigint")
    got = [tuple(r) for r in neardup.expand(links, members, rows_per_task=7).collect()]
    assert len(got) == len(set(got)) == 30 * 29 // 2 + 30 and all(a < b for a, b in got)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=10, max_size=30), st.sets(st.integers(0, 40), min_size=10, max_size=30))
def test_bounds_hold(a, b):
    if 10 * len(a & b) >= 7 * len(a | b):
        n, m = np.array([len(a)]), np.array([len(b)])
        flat = lambda s: np.array(sorted(s), np.uint64)
        x, y = neardup.fingerprints(flat(a), n)[0], neardup.fingerprints(flat(b), m)[0]
        assert bin(int(x ^ y)).count("1") <= neardup.radius(len(a), len(b))
        small, large = sorted((a, b), key=len)
        assert len(small - large) <= neardup.prefixes(len(small))[0] and len(large - small) <= neardup.prefixes(len(large))[1]
        assert len(a & b) >= neardup.least_common(len(a), len(b))


# 10. subjects


def subject_fixture(n, seed):
    rng = random.Random(seed)
    terms = {"law": ["court", "verdict", "statute", "plaintiff"], "food": ["broth", "skillet", "yeast", "simmer"], "music": ["chorus", "treble", "encore", "tempo"]}
    filler = ["we packed the bag and moved on", "more on that next week", "the thread grew to many entries"]
    docs, truth = [], {}
    for i in range(n):
        mine = rng.sample(sorted(terms), rng.choice([0, 1, 1, 2]))
        s = [f"we talked about the {rng.choice(terms[m])} and a {rng.choice(terms[m])}" for m in mine for _ in range(4)] + rng.choices(filler, k=3)
        rng.shuffle(s)
        docs.append((i, ". ".join(s) + ".", "en", rng.choice(["bio", "digest", None])))
        truth[i] = set(mine)
    return docs, truth


def test_subjects_of_unlabelled_documents(spark):
    docs, truth = subject_fixture(400, 1)
    df = spark.createDataFrame(docs + [(1000, None, None, None), (1001, "", "en", "bio"), (1002, " \n", "xx", "bio"), (1003, "court " * 20_000, "en", "bio")], "doc_id bigint, text string, lang string, source string")
    labels = [(i, s, "curator") for i in range(150) for s in (truth[i] or {None})] + [(5, "law", "crowd"), (6, "unheard of", "crowd"), (7, None, None)]
    lab = spark.createDataFrame(labels + labels[:20], "doc_id bigint, subject string, label_source string")
    areas = spark.createDataFrame([(s, "") for s in ("law", "food", "music", "travel")] + [(None, "")], "subject string, description string")
    got = subjects.subject_posteriors(df, lab, areas).where("posterior >= 0.5").collect()
    found = collections.defaultdict(set)
    for r in got:
        found[r["doc_id"]].add(r["subject"])
    held = [i for i in range(150, 400)]
    tp = sum(len(found[i] & truth[i]) for i in held)
    assert tp / max(1, sum(len(found[i]) for i in held)) > 0.95 and tp / sum(len(truth[i]) for i in held) > 0.95
    assert not {1000, 1001, 1002} & set(found)
    assert len(got) == len({(r["doc_id"], r["subject"]) for r in got})
    assert subjects.subject_posteriors(df.limit(0), lab, areas).count() == 0
    assert subjects.subject_posteriors(df, lab.limit(0), areas).count() == 0


def test_pairs_that_only_a_label_names_have_a_posterior(spark):
    docs, truth = subject_fixture(300, 3)
    df = spark.createDataFrame(docs + [(900, "nothing of the kind is said here", "en", "bio"), (901, None, None, None)], "doc_id bigint, text string, lang string, source string")
    labels = [(i, s, "curator") for i in range(150) for s in (truth[i] or {None})] + [(900, "law", "curator"), (901, "food", "crowd"), (902, "law", "curator")]
    areas = spark.createDataFrame([("law",), ("food",), ("music",)], "subject string")
    p = {(r["doc_id"], r["subject"]) for r in subjects.subject_posteriors(df, spark.createDataFrame(labels, "doc_id bigint, subject string, label_source string"), areas).collect()}
    assert {(900, "law"), (901, "food")} <= p and (902, "law") not in p


def test_no_label_pair_is_lost_on_the_documents(spark):
    d = f"{DATA}/sf0.01"
    names = spark.read.parquet(f"{d}/subject_labels.parquet").where("subject IS NOT NULL").select("doc_id", "subject").distinct()
    names = names.join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), "doc_id", "left_semi")
    got = queries._posteriors(spark, d).select("doc_id", "subject")
    assert names.count() > 80 and names.join(got, ["doc_id", "subject"], "left_anti").count() == 0


def test_sentences_equal_a_plain_reading():
    texts = ["One, two's. Three!four 漢字カナーと ひらがな x", None, "", "a\u2028b c?\r\n\n ... d", "É́x 12ab_c " * 3]
    s = subjects.sentences(texts)
    token = regex.compile(r"[\p{Han}\p{Katakana}ー]+|\p{Hiragana}+|[[\p{L}\p{M}']--[\p{Han}\p{Katakana}\p{Hiragana}ー]]+", regex.V1)
    want = []  # (document, number of distinct words and pairs) of every sentence with words
    for d, t in enumerate(texts):
        for line in unicodedata.normalize("NFKC", t or "").lower().splitlines():
            for part in regex.split(r"(?<=[.!?。！？])", line, flags=regex.V1):
                w = token.findall(part)
                if w:
                    want.append((d, len(set(w)) + len(set(zip(w, w[1:])))))
    assert list(zip(s.doc.tolist(), np.bincount(s.sentence).tolist())) == want
    assert s.section.tolist() == sorted(s.section.tolist()) and len(set(s.section.tolist())) == 5
    same = subjects.sentences(texts[::-1])  # a word's number does not depend on where it stands
    assert set(same.feature.tolist()) == set(s.feature.tolist())


def test_latent_model_learns_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.3
    good, bad = np.where(rng.random(20_000) < 0.95, y, ~y), np.where(rng.random(20_000) < 0.55, y, ~y)
    lv = np.zeros((20_000, len(subjects.FUNCTIONS)), int)
    lv[:, 0] = np.where(good, 6, 2)
    lv[:, 2] = np.where(bad, 2, 1)
    p, inv, n = np.unique(subjects.pattern_of(lv), return_inverse=True, return_counts=True)
    assert (subjects.levels_of(p) == lv[np.array([np.flatnonzero(inv == k)[0] for k in range(len(p))])]).all()
    post = subjects.latent(p, n.astype(float))[inv]
    assert ((post >= 0.5) == y).mean() > 0.93


def test_invisible_characters_and_case_do_not_matter():
    a, b = subjects.sentences(["The CO​URT sat. It ruled!"]), subjects.sentences(["the court sat. it ruled!"])
    assert (a.feature == b.feature).all() and len(a.doc) == 2
