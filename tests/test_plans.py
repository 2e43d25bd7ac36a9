"""Properties of the plans: no cross joins, filters and columns reach the scans, shuffles are where they should be."""

import re

import pytest
from harness import DATA

import __spark_entry__ as entry
from rookery.plans import exchange, general, graph, learning, relational
from rookery.plans import features as feature_queries

SF = f"{DATA}/sf0.001"
FITS = {"ensemble", "self_training", "kmeans", "model_gbt", "model_forest", "model_logistic", "model_invariants"}
CORE = {k: q for m in (general, relational, feature_queries, graph, learning, exchange) for k, q in m.QUERIES.items() if k not in FITS}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(CORE))
def test_no_cross_join_and_no_row_udf(spark, name):
    p = plan(CORE[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p and "BatchEvalPython" not in p


def exchanges(p):
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single|Round)", p))


def test_scans_read_what_is_needed(spark):
    p = plan(relational.scan_project_filter(spark, SF))
    assert "PushedFilters: [IsNotNull(l_shipdate)" in p and "l_tax" not in p
    p = plan(general.p2_found(spark, SF))
    assert all(c not in p for c in ("text", "parent_url", "target_fid")) and p.count("IsNotNull(fid)") >= 2


def test_shuffles_per_query(spark):
    p = plan(general.p2_found(spark, SF))
    assert exchanges(p) == 7 and p.count("MergingSessions") >= 2  # events and pieces once each; the rest are counts of (account, day)
    assert exchanges(plan(feature_queries.channel_metrics(spark, SF))) <= 4
    one = plan(general.snapshot_changes(general.table(spark, SF, "follow_counts"), ["fid"], ["follower_count"], "export_ts", [1, 2, 3]))
    assert exchanges(one) == 1  # rows by key; unpivoting and both sums stay there


def test_steps_that_decide_are_in_the_plan(spark):
    p = plan(general.p7_found(spark, SF))
    assert "Window [row_number()" in p and "try_element_at" in p.lower() or "element_at" in p  # runs of keys, then as of the key
    p = plan(general.p3_found(spark, SF))
    assert p.count("CASE WHEN (day") >= 2 and "Window" in p  # the store, and its values at both ends of the period
    assert "Join" not in plan(general.p1_found(spark, SF)).replace("BroadcastHashJoin [key_field", "")  # states meet totals only


def test_every_query_is_registered_once():
    q = entry.queries()
    assert set(CORE) | FITS <= set(q) and set(entry.oracle_sql()) <= set(q)
    assert len(entry.oracle_sql()) >= 120
