"""Queries for the training-data problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.safe import scalars
from rookery.llm import bpe, neardup, packing, subjects
from rookery.session import cut
from rookery.sources.tables import table

CAPACITY = 1024


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different casts that are at least 0.7 similar."""
    links, members = neardup.near_duplicates(table(spark, d, "casts", ["id", "text"]), "id", "text")
    return neardup.expand(links, members)


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every cast that takes part, with the class of equal word sets it belongs to and the links of that class."""
    links, members = neardup.near_duplicates(table(spark, d, "casts", ["id", "text"]), "id", "text")
    n = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(n, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_corpus(table(spark, d, "documents", ["doc_id", "text"]), "doc_id", "text", bpe.read_vocabulary())


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = bpe.count_corpus(table(spark, d, "documents", ["doc_id", "text"]), "doc_id", "text", bpe.read_vocabulary())
    return packing.pack(cut(sizes, "sizes"), "doc_id", "n_tokens", CAPACITY)


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's containers of 1,024 tokens."""
    return _packed(spark, d)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be split, as they alone exceed a container: their pieces were assigned to several."""
    return packing.split_items(_packed(spark, d), "doc_id")


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing, here of the documents by characters: nothing lost, no container too full, only oversized items split."""
    chars = table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n"))
    a = packing.pack(cut(chars, "chars"), "doc_id", "n", CAPACITY)
    items = a.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("piece_size").alias("size"), F.count_distinct("container").alias("containers"))
    items = items.agg(F.count(F.lit(1)).alias("n_items"), F.sum("pieces").alias("n_pieces"), F.sum("size").alias("total"), F.count(F.when(F.col("containers") > 1, 1)).alias("n_split"))
    loads = a.where("piece_size > 0").groupBy("container").agg(F.sum("piece_size").alias("load"))
    loads = loads.agg(F.count(F.when(F.col("load") > CAPACITY, 1)).alias("n_overfull"), (F.sum("load") / F.lit(float(CAPACITY)) / F.count(F.lit(1)) > 0.95).alias("well_filled"))
    v = scalars(loads)
    return items.select("*", v("n_overfull").alias("n_overfull"), v("well_filled").alias("well_filled"))


def _posteriors(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_posteriors(table(spark, d, "documents", ["doc_id", "text", "lang", "source"]), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the subjects a good part of their text is about."""
    return _posteriors(spark, d).where("posterior >= 0.5").select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Make-up of the corpus: documents per subject, and the sum of posteriors."""
    p = _posteriors(spark, d)
    return p.groupBy("subject").agg(F.count(F.when(F.col("posterior") >= 0.5, 1)).alias("n_docs"), F.round(F.sum("posterior"), 3).alias("expected_docs"))


QUERIES = {f.__name__: f for f in (p5_found, p5_classes, p8_ids, p9_found, p9_containers, p9_invariants, p10_found, p10_composition)}

_WORDS = r"""WITH s AS (SELECT DISTINCT id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w FROM casts WHERE text IS NOT NULL AND id IS NOT NULL),
t AS (SELECT id, w, len(w) AS n, min(id) OVER (PARTITION BY w) AS class_id FROM s WHERE len(w) >= 10)"""
_PAIRS = "SELECT a.id AS id_a, b.id AS id_b FROM x a JOIN x b ON a.word = b.word AND a.id < b.id AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n) GROUP BY ALL HAVING 17 * count(*) >= 7 * (max(a.n) + max(b.n))"

#: The other results need a vocabulary or a fitted model, which SQL lacks; they are tested against public
#: encoders, brute force and held-out labels instead.
ORACLE: dict[str, str] = {
    "p9_invariants": """SELECT count(*) AS n_items, sum(greatest(1, (n + 1023) // 1024))::BIGINT AS n_pieces, sum(n)::BIGINT AS total, count(*) FILTER (n > 1024) AS n_split, 0::BIGINT AS n_overfull, true AS well_filled
FROM (SELECT coalesce(length(text), 0) AS n FROM documents)""",
    "p5_found": f"{_WORDS}, x AS (SELECT id, n, unnest(w) AS word FROM t) {_PAIRS}",
    "p5_classes": f"""{_WORDS}, x AS (SELECT id, n, unnest(w) AS word FROM t WHERE id = class_id), p AS ({_PAIRS}),
l AS (SELECT rep, count(*) AS k FROM (SELECT id_a AS rep FROM p UNION ALL SELECT id_b FROM p) GROUP BY rep)
SELECT id, class_id, coalesce(k, 0) AS n_links FROM t LEFT JOIN l ON rep = class_id""",
}
