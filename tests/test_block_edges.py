"""Edges of blocks lie between the least pieces of rows alone, and stored rows aren't written again."""

from foliant.operators import grouping

KINDS = "client_name string, doc_id long, ingested_at string, said array<string>"


def test_edges_do_not_grow_with_pieces(spark, monkeypatch):
    """Each least piece had an edge to every piece of its rows."""
    rows = [("a", i, "2020", [f"own{i}", *(f"k{j}" for j in range(20))]) for i in range(40)] + [("b", 100 + i, "2020", [f"own{i}"]) for i in range(5)]
    df, seen, written = spark.createDataFrame(rows, KINDS), [], []
    plain, kept = grouping.components, grouping.checkpointed
    monkeypatch.setattr(grouping, "components", lambda e: seen.append(e.where("a != b").distinct().count()) or plain(e))
    monkeypatch.setattr(grouping, "checkpointed", lambda d: written.append(d.columns) or kept(d))
    got = {r.doc_id: r.block for r in grouping.with_block(df, grouping.F.col("said"), stored=True).select("doc_id", "block").collect()}
    assert len({got[i] for i in range(40)}) == 1 and len(set(got.values())) == 6 and seen[0] <= 80
    assert not any("said" in c for c in written)
