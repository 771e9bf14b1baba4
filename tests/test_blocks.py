"""Blocks of shared evidence: edges between pieces of evidence only, and plans of the grouped queries."""

from foliant.operators import grouping
from foliant.plans import registry

D = "/root/testdata/sf0.001"
KINDS = "client_name string, doc_id long, ingested_at string, said array<string>"


def edges_of(df, monkeypatch):
    seen, plain = [], grouping.components
    monkeypatch.setattr(grouping, "components", lambda e: seen.append(e.distinct().count()) or plain(e))
    return grouping.with_block(df, grouping.F.col("said")).select("doc_id", "block").collect(), seen[0]


def test_rows_that_say_the_same_are_one_set_of_edges(spark, monkeypatch):
    """Each row was a node, so edges grew with rows."""
    rows = [("a", i, "2020", ["k", "c", f"n{i % 3}"]) for i in range(600)] + [("a", 600 + i, "2020", ["x"]) for i in range(20)] + [("b", 700, "2020", ["k"]), (None, 701, "2020", ["k"]), ("a", 702, "2020", []), ("a", 703, "2020", [])]
    got, n = edges_of(spark.createDataFrame(rows, KINDS), monkeypatch)
    block = {r.doc_id: r.block for r in got}
    assert len(block) == len(rows) and n <= 30
    assert len({block[i] for i in range(600)}) == 1 and len({block[600 + i] for i in range(20)}) == 1
    assert len({block[i] for i in (0, 600, 700, 701, 702, 703)}) == 6


def test_groups_read_no_other_fields(spark):
    """All fields, money among them, were found and written for ``fuzzy_rollup``."""
    plan = registry._partly_keyed(spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "client\\s*name" in plan and "invoice\\s+total" not in plan


def test_patterns_of_clusters_run_once(spark, monkeypatch):
    """They ran once for the edges and once for the rows."""
    plans, plain = [], grouping.checkpointed
    monkeypatch.setattr(grouping, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    registry.queries()["project_clusters"](spark, D).count()
    assert sum("client\\s*name" in p for p in plans) == 1
