"""Grouping by evidence against the loop over whole clients, merge chains against carrying them out one by one."""

import random
import re

from foliant.operators import grouping, resolve
from foliant.plans import registry

KINDS = "client_name string, doc_id long, ingested_at string, project_key string, project_code string, project_name string, refs array<string>, year string"


def normal(v):
    return re.sub("[^a-z0-9]+", " ", (v or "").lower()).strip()


def plain_clusters(rows):
    """Every document against every group of its client, newest first."""
    out = {}
    for client in {r[0] for r in rows}:
        groups = []
        for _, doc, _, key, code, name, refs, year in sorted((r for r in rows if r[0] == client), key=lambda r: (-int(r[2]), r[1])):
            refs, code = {r.strip().upper() for r in refs or [] if r.strip()}, (code or "").strip().upper()
            best, at = -10, None
            for i, g in enumerate(groups):
                s = 7 * (bool(key) and key in g["k"]) + 6 * (bool(code) and code in g["c"]) + 4 * (bool(normal(name)) and normal(name) in g["n"]) + 5 * len(refs & g["r"])
                s += (1 if year in g["y"] else -1 if g["y"] else 0) if year else 0
                if s > best:
                    best, at = s, i
            if at is None or best < 7:
                at = len(groups)
                groups.append({x: set() for x in "kcnry"})
            g = groups[at]
            for x, v in (("k", key), ("c", code), ("n", normal(name)), ("y", year)):
                g[x] |= {v} - {"", None}
            g["r"] |= refs
            out[client, doc] = at
    return out


def test_clusters_against_the_loop(spark):
    rng = random.Random(1)
    pick = lambda xs: rng.choice(xs)
    rows = [(pick(["a", "a", "a", "b", None]), i, str(rng.randrange(2000, 2100)), pick([None, "", *(f"k{j}" for j in range(40))]), pick([None, "", "c1", "C1 ", *(f"c{j}" for j in range(40))]), pick([None, "Pump-House", "pump house", *(f"n{j}" for j in range(30))]), [f"r{rng.randrange(60)}" for _ in range(rng.randrange(3))], pick([None, "2020", "2021"])) for i in range(500)]
    got = {(r.client_name, r.doc_id): r.cluster for r in grouping.cluster_projects(spark.createDataFrame(rows, KINDS)).collect()}
    assert got == plain_clusters(rows) and len(set(got.values())) > 20


def test_one_large_client_is_many_tasks(spark):
    rows = [("hot", i, "2020", f"k{i % 300}", None, None, [], None) for i in range(900)]
    df = spark.createDataFrame(rows, KINDS)
    blocks = grouping.with_block(df, grouping.tagged("k", grouping.F.array("project_key")))
    assert blocks.select("block").distinct().count() == 300
    assert grouping.cluster_projects(df).select("cluster").distinct().count() == 300
    assert grouping.cluster_projects(df.limit(0)).count() == 0


DOCS = "client_name string, doc_id long, ingested_at string, project_key string, project_name string, project_code string, report_type string, title string, document_stem string, report_date string, related_references array<string>, contacts array<string>, authors array<string>, document_kind string"
STOP = set("client doc document engineering estimate for inspection order project purchase quote quotation report request rev revision site summary the variation work".split())


def plain_name(row):
    if row["project_name"] or row["report_type"]:
        return (row["project_name"] or row["report_type"]).strip()
    t = (row["title"] or "").strip()
    if not t or normal(t) in ("technical consulting report", "report", "final report"):
        t = (row["document_stem"] or "").strip()
    t = re.sub(r"\bv\d+\b", " ", re.sub(r"[_\-]+", " ", t), flags=re.I)
    if row["client_name"]:
        t = re.sub(re.escape(row["client_name"]), " ", t, flags=re.I)
    t = re.sub(r"\b(q|po|rev|report|invoice|quote|purchase order|access request|email chain)\b", " ", t, flags=re.I)
    t = re.sub(r"\s+", " ", re.sub(r"\b\d{2,4}\b", " ", t)).strip(" -")
    return t.title() or "Untitled Project"


def tokens(v):
    return {t for t in re.findall("[a-z0-9]{3,}", (v or "").lower()) if t not in STOP}


def plain_groups(rows):
    names = [c.split()[0] for c in DOCS.split(", ")]
    out = {}
    year = lambda v: (re.findall(r"\b(?:20\d{2}|19\d{2})\b", v or "") or [""])[0]
    for client in {r[0] for r in rows}:
        groups = {}
        for row in sorted((dict(zip(names, r, strict=True)) for r in rows if r[0] == client), key=lambda r: (-int(r["ingested_at"].replace("-", "")), r["doc_id"])):
            code, refs = (row["project_code"] or "").upper(), {v.upper() for v in row["related_references"]}
            contacts, authors = {v.lower() for v in row["contacts"]}, {v.lower() for v in row["authors"]}
            mine, day = tokens(row["title"]) | tokens(row["document_stem"]), row["report_date"] or row["ingested_at"]
            best, key = 0, None
            for k, g in groups.items():
                s = 6 * (bool(code) and code == g["code"].upper()) + 5 * (normal(plain_name(row)) == normal(g["name"])) + 3 * len(refs & g["refs"]) + 2 * bool(contacts & g["contacts"]) + bool(authors & g["authors"]) + 2 * (len(mine & g["hints"]) >= 2)
                s += bool(year(day)) and year(day) == year(g["day"])
                if s > best:
                    best, key = s, k
            made = re.sub("[^a-z0-9]+", "-", (row["project_code"] or plain_name(row)).lower()).strip("-") or "untitled-project"
            key = row["project_key"] or (key if best >= 4 else made)
            g = groups.setdefault(key, {"code": "", "name": plain_name(row), "refs": set(), "contacts": set(), "authors": set(), "hints": set(), "day": ""})
            if row["project_name"] and g["name"].lower().startswith("untitled "):
                g["name"] = row["project_name"]
            g["code"] = g["code"] or row["project_code"] or ""
            g["day"] = max(g["day"], day)
            g["refs"] |= refs
            g["contacts"] |= contacts
            g["authors"] |= authors
            g["hints"] |= (tokens(row["project_name"]) | mine) - tokens(client)
            out[client, row["doc_id"]] = key
    return out


def test_fuzzy_groups_against_the_loop(spark):
    rng = random.Random(2)
    pick = lambda xs: rng.choice(xs)
    words = "pump valve harbour crane boiler roof acme drain weld report".split()
    some = lambda kind, n, m: [f"{kind}{rng.randrange(n)}" for _ in range(rng.randrange(m))]
    rows = []
    for i in range(500):
        title = " ".join(pick(words) for _ in range(rng.randrange(0, 4)))
        rows.append((pick(["acme", "acme", "bell", None]), i, f"20{rng.randrange(10, 25)}-01-0{rng.randrange(1, 9)}", pick([None, None, None, "", "k1", "k2"]), pick([None, None, "", *(f"Name {j}" for j in range(25))]), pick([None, None, "", *(f"c{j}" for j in range(25))]), pick([None, None, None, "Survey"]), pick([title, "Report", ""]), f"{pick(words)}_{pick(words)}_v{rng.randrange(3)}", pick([None, "2015-03-04", "2021-03-04"]), some("r", 60, 3), some("P", 40, 2), some("A", 9, 2), pick(["report", "quote"])))
    df = spark.createDataFrame(rows, DOCS)
    got = {(r.client_name, r.doc_id): r.project_key for r in grouping.fuzzy_groups(df).collect()}
    want = plain_groups(rows)
    assert got == want, [(k, got[k], want[k]) for k in want if got.get(k) != want[k]][:5]
    assert 15 < len(set(got.values())) < 200
    assert grouping.grouped_rollup(df).groupBy().sum("reports", "other_documents").first()[0:2] == (sum(r[-1] == "report" for r in rows), sum(r[-1] != "report" for r in rows))


def test_merge_chains_are_carried_out_in_order(spark):
    rng = random.Random(3)
    for names, n in (("abcdefgh", 12), ([f"n{i}" for i in range(40)], 60), ("ab", 4)):
        cands = list({(pick := rng.sample(list(names), 2))[0] + "|" + pick[1]: (pick[0], pick[1], rng.randrange(95, 100) / 100) for _ in range(n)}.values())
        now = {x: x for x in names}
        for source, target, _ in sorted(cands, key=lambda c: (-c[2], c[1].lower(), c[0].lower())):
            now = {x: target if y == source else y for x, y in now.items()}
        got = resolve.merge_map(spark.createDataFrame(cands, "source string, target string, confidence double"))
        assert {r.source: r.target for r in got.collect()} == {x: y for x, y in now.items() if x != y}


def test_registered_queries_against_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    for name in ("duplicate_clients", "auto_merged_clients", "report_versions", "fuzzy_groups", "fuzzy_rollup"):
        got = registry.queries()[name](spark, d)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name
