"""Graph queries over the follows of the newest export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.graph import edges as E
from rookery.graph import propagate as P
from rookery.plans.registry import Registry
from rookery.sources import views as V

R = Registry()

_LF = "lf AS (SELECT * FROM f WHERE deleted_at IS NULL AND fid <> target_fid)"
_MUTUAL = "mu AS (SELECT least(fid, target_fid) AS a, greatest(fid, target_fid) AS b FROM (SELECT DISTINCT fid, target_fid FROM lf) GROUP BY 1, 2 HAVING count(*) = 2)"
_SYM = "sy AS (SELECT a AS src, b AS dst FROM mu UNION ALL SELECT b, a FROM mu)"


def _live(spark: SparkSession, d: str) -> DataFrame:
    return V.follows(spark, d).where("deleted_at IS NULL")


def _sym(spark: SparkSession, d: str) -> DataFrame:
    return E.symmetric(E.mutual_pairs(_live(spark, d)))


@R.add(V.with_views("f", "SELECT a, b FROM mu", _LF + ", " + _MUTUAL))
def mutual_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.mutual_pairs(_live(spark, d))


@R.add(V.with_views("f", "SELECT a, b FROM mu", _LF + ", " + _MUTUAL))
def mutual_pairs_by_join(spark: SparkSession, d: str) -> DataFrame:
    return E.mutual_pairs_by_join(_live(spark, d))


@R.add(V.with_views("f lb", "SELECT src, dst, bot FROM sy LEFT JOIN lb ON fid = src", _LF + ", " + _MUTUAL + ", " + _SYM))
def undirected_edges(spark: SparkSession, d: str) -> DataFrame:
    return E.undirected(_live(spark, d), V.labels(spark, d))


@R.add(V.with_views("f", "SELECT fid, row_number() OVER (ORDER BY fid) - 1 AS node_index FROM (SELECT DISTINCT fid FROM f)"))
def node_index(spark: SparkSession, d: str) -> DataFrame:
    return E.node_ids(V.follows(spark, d), "fid")


@R.add(V.with_views("f lb", "SELECT fid, target_fid FROM lf WHERE fid IN (SELECT fid FROM lb) AND target_fid IN (SELECT fid FROM lb)", _LF))
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return E.induced(_live(spark, d), V.labels(spark, d)).select("fid", "target_fid")


@R.add(V.with_views("f", "SELECT fid, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT fid, 1 AS o, 0 AS i FROM lf UNION ALL SELECT target_fid, 0, 1 FROM lf) GROUP BY fid", "lf AS (SELECT * FROM f WHERE deleted_at IS NULL)"))
def degree_full_join(spark: SparkSession, d: str) -> DataFrame:
    from rookery.features.network import degrees

    return degrees(_live(spark, d)).select("fid", "out_degree", "in_degree")


@R.add(V.with_views("f", """SELECT d.src AS fid, d.degree, coalesce(t.n, 0)::BIGINT AS triangles, CASE WHEN d.degree > 1 THEN coalesce(round(2 * coalesce(t.n, 0) / (d.degree * (d.degree - 1)), 6), 0.0) ELSE 0.0 END AS clustering
FROM (SELECT src, count(*) AS degree FROM sy GROUP BY 1) d LEFT JOIN (SELECT x.src, count(*) AS n FROM sy x JOIN sy y ON x.src = y.src AND x.dst < y.dst JOIN mu ON a = x.dst AND b = y.dst GROUP BY 1) t USING (src)""", _LF + ", " + _MUTUAL + ", " + _SYM))
def two_hop_triangles(spark: SparkSession, d: str) -> DataFrame:
    return E.triangles(E.mutual_pairs(_live(spark, d)))


@R.add(V.with_views("f lb", """SELECT target_fid AS fid FROM (SELECT fid, target_fid, row_number() OVER (PARTITION BY fid ORDER BY timestamp NULLS FIRST, target_fid) AS r FROM (SELECT * FROM f WHERE deleted_at IS NULL) WHERE fid IN (SELECT fid FROM lb WHERE bot))
WHERE r <= 50 AND target_fid NOT IN (SELECT fid FROM lb WHERE bot) GROUP BY 1 HAVING count(*) = 1"""))
def followee_expansion(spark: SparkSession, d: str) -> DataFrame:
    return E.followees(_live(spark, d), V.labels(spark, d).where("bot"), 50)


_PRIOR = "CASE WHEN lb.bot THEN -0.1 WHEN NOT lb.bot THEN 0.1 ELSE 0.0 END::DOUBLE"


def _rounds(n: int) -> str:
    out = [f"s0 AS (SELECT DISTINCT src AS id, {_PRIOR} AS prior, {_PRIOR} AS post FROM sy LEFT JOIN lb ON lb.fid = src)"]
    for i in range(n):
        out.append(f"s{i + 1} AS (SELECT v.id, v.prior, least(greatest(v.post + v.prior + coalesce(g.got, 0), -0.5), 0.5) AS post FROM s{i} v LEFT JOIN (SELECT e.dst AS id, sum(0.2::DOUBLE * x.post) AS got FROM sy e JOIN s{i} x ON x.id = e.src GROUP BY 1) g USING (id))")
    return ", ".join(out)


@R.add(V.with_views("f lb", "SELECT id, round(post + 0.5, 6) AS posterior FROM s10", _LF + ", " + _MUTUAL + ", " + _SYM + ", " + _rounds(10)))
def sybilscar(spark: SparkSession, d: str) -> DataFrame:
    s = P.sybil_scar(_sym(spark, d), V.labels(spark, d))
    return s.select("id", F.round("posterior", 6).alias("posterior"))


#: as many steps as the operator takes by default, floor(ln(number of nodes))
_WALK = """dg AS (SELECT src AS id, count(*) AS degree FROM sy GROUP BY 1), w AS (
  SELECT 0 AS i, dg.id, dg.degree, CASE WHEN NOT lb.bot THEN 1.0 ELSE 0.0 END::DOUBLE AS prior, CASE WHEN NOT lb.bot THEN 1.0 ELSE 0.0 END::DOUBLE AS post FROM dg LEFT JOIN lb ON lb.fid = dg.id
  UNION ALL SELECT v.i + 1, v.id, v.degree, v.prior, coalesce(g.got, 0) + 0.15 * v.prior FROM w v LEFT JOIN (SELECT e.dst AS id, sum(0.85::DOUBLE * x.post / x.degree) AS got FROM sy e JOIN w x ON x.id = e.src GROUP BY 1) g USING (id) WHERE v.i < (SELECT floor(ln(count(*))) FROM dg))"""


@R.add(V.with_views("f lb", "SELECT id, round(post / degree, 6) AS rank FROM w WHERE i = (SELECT floor(ln(count(*))) FROM dg)", _LF + ", " + _MUTUAL + ", " + _SYM + ", " + _WALK).replace("WITH ", "WITH RECURSIVE ", 1))
def sybilrank(spark: SparkSession, d: str) -> DataFrame:
    seeds = V.labels(spark, d).where("NOT bot").select(F.col("fid").alias("id"))
    return P.sybil_rank(_sym(spark, d), seeds).select("id", F.round("rank", 6).alias("rank"))


def _messages(n: int) -> str:
    prior = "CASE WHEN lb.bot THEN 0.1 WHEN NOT lb.bot THEN 0.9 ELSE 0.5 END::DOUBLE"
    out = [f"v AS (SELECT DISTINCT src AS id, {prior} AS prior FROM sy LEFT JOIN lb ON lb.fid = src)", "m0 AS (SELECT src, dst, 0.5::DOUBLE AS m FROM sy)"]
    for i in range(n):
        out.append(f"b{i} AS (SELECT dst AS id, sum(ln(m)) - sum(ln(1 - m)) AS o FROM m{i} GROUP BY 1)")
        out.append(f"m{i + 1} AS (SELECT x.src, x.dst, least(greatest(0.9 * x.q + 0.1 * (1 - x.q), 1e-10), 1 - 1e-10) AS m FROM (SELECT e.src, e.dst, 1 / (1 + exp(-(ln(v.prior) - ln(1 - v.prior) + b.o - ln(k.m) + ln(1 - k.m)))) AS q FROM m{i} e JOIN v ON v.id = e.src JOIN b{i} b ON b.id = e.src JOIN m{i} k ON k.src = e.dst AND k.dst = e.src) x)")
    return ", ".join(out)


@R.add(V.with_views("f lb", "SELECT v.id, round(1 / (1 + exp(-(ln(v.prior) - ln(1 - v.prior) + b.o))), 6) AS posterior FROM v JOIN (SELECT dst AS id, sum(ln(m)) - sum(ln(1 - m)) AS o FROM m5 GROUP BY 1) b USING (id)", _LF + ", " + _MUTUAL + ", " + _SYM + ", " + _messages(5)))
def sybilbelief(spark: SparkSession, d: str) -> DataFrame:
    s = P.sybil_belief(_sym(spark, d), V.labels(spark, d))
    return s.select("id", F.round("posterior", 6).alias("posterior"))


QUERIES, ORACLE = R.queries, R.oracle
