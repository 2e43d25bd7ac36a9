"""The shard search depends on how rows are laid out: nothing may stand between the shuffle by key and the search."""

import re

from rookery.llm import neardup, queries
from rookery.session import cut

from harness import DATA


def test_search_reads_the_shuffle_by_key(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(neardup, "cut", lambda df, name: (seen.append((name, df._jdf.queryExecution().executedPlan().toString())), cut(df, name))[1])
    queries.p5_found(spark, f"{DATA}/sf0.001")
    text = dict(seen)["pairs"]
    below = [re.findall(r"[+:]- (?:\*\(\d+\) )?(\w+)", part)[:3] for part in text.split("MapInArrow")[1:]]
    searches = [b for b in below if b[:1] == ["Sort"]]
    assert len(searches) == 2 and all(b[1] == "Exchange" or b[1:3] == ["Project", "Exchange"] for b in searches), below
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_p9_found_ranks_documents_and_assigns_containers(spark):
    plan = queries.p9_found(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "row_number" in plan and "min(container" in plan and "max(container" in plan
