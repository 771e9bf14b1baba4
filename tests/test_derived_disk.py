"""What ``derived_index`` writes: a row for each project, no vectors."""

from foliant.operators import grouping
from foliant.plans import registry


def test_no_vector_is_written(spark, monkeypatch):
    """The first index was written with its vectors, and they went through two joins."""
    import duckdb

    d, seen, plain = "/root/testdata/sf0.001", [], grouping.checkpointed
    monkeypatch.setattr(grouping, "checkpointed", lambda df: seen.append(df) or plain(df))
    con = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = registry.queries()["derived_index"](spark, d)
    assert len(seen) == 2 and not any("embedding" in df.columns for df in seen)
    projects = con.execute("SELECT count(DISTINCT (o_custkey)) FROM orders").fetchone()[0]
    assert seen[0].count() <= 2 * projects
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # Vectors are drawn above all joins.
    assert min(i for i, x in enumerate(plan) if "embed(" in x) < min(i for i, x in enumerate(plan) if "Join" in x) and not any("embed(" in x for x in plan[next(i for i, x in enumerate(plan) if "Join" in x):])
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()['derived_index']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {r[3] for r in want} >= {"changed", "kept"}
