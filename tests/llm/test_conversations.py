"""Conversation repair against a plain shortest-path table and, for short ones, against all edits."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from foliant.llm import conversation_repair as cr

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, key string, seg int"


def plain_faults(rows):
    out, seen = [], set()
    for role, text in rows:
        if not text.strip(BLANKS):
            out.append("b")
        elif (role, text) in seen:
            out.append("d")
        else:
            out.append("-" if text.strip(BLANKS)[-1] in ".!?" else "t")
        seen.add((role, text))
    return "".join(out)


def plain_repair(rows):
    """A table of (cost, audit) over rows and roles, each row after the next; inserts at most two in a row."""
    faults = plain_faults(rows)
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(ways):
        for _ in range(3):
            for r, (c, a) in list(ways.items()):
                ways[turn[r]] = min(ways.get(turn[r], (9**9, "")), (c + 2, a + "I"))
        return ways

    ways = inserted({"": (0, "")})
    for (role, _), f in zip(rows, faults, strict=True):
        new = {}
        for r, (c, a) in ways.items():
            new[r] = min(new.get(r, (9**9, "")), (c + 3, a + "D"))
            if f in "-t":
                t = turn[r]
                new[t] = min(new.get(t, (9**9, "")), (c + 2 + (f == "t"), a + "R"))
                i = role[:1]
                if i and (i == turn[r] or i == "s" and not r):
                    new[i] = min(new.get(i, (9**9, "")), (c + (f == "t"), a + "K"))
        ways = inserted(new)
    cost, audit = min(w for r, w in ways.items() if r in ("", "a"))
    role, made, i = "", [], 0
    for e in audit:
        if e == "D":
            i += 1
            continue
        new = rows[i][0][:1] if e == "K" else turn[role]
        made.append((rows[i][0] if e == "K" else {"u": "user", "a": "assistant"}[new], "" if e == "I" else rows[i][1]))
        role, i = new, i + (e != "I")
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in made))
    return cost, audit, made, faults


def all_edits(rows, faults, upto):
    """Every audit with at most ``upto`` edits that gives an allowed conversation, as (cost, audit)."""
    best = (9**9, "")
    for n in range(len(rows), upto + 1):
        for audit in itertools.product("DIKR", repeat=n):
            if sum(e != "I" for e in audit) != len(rows):
                continue
            states, i, cost = {""}, 0, 0
            for e in audit:
                cost += {"D": 3, "I": 2, "K": 0, "R": 2}[e]
                if e in "KR":
                    cost = 9**9 if faults[i] in "bd" else cost + (faults[i] == "t")
                if e != "D":
                    states = {s + x for s in states for x in (rows[i][0][:1] if e == "K" else "ua")}
                i += e != "I"
            if any(re.fullmatch("(s?(ua)+)?", s) for s in states):
                best = min(best, (cost, "".join(audit)))
    return best


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, k = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        if k:
            row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [row] * (1 + (k == 3))
    return out


def plain(rows, damage=True):
    out = {}
    kept = plain_damage(rows) if damage else rows
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        cost, audit, made, faults = plain_repair([r[2:] for r in own])
        numbers = {r[1] for r in own if r[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, sha)
    return out


def random_rows(rng, n):
    return [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(["", " \t", "yes.", "no", "well?", "so \n", f"t{rng.random()}.", f"u{rng.random()}"])) for _ in range(n)]


def test_search_against_all_edits():
    rng = random.Random(1)
    for _ in range(60):
        rows = random_rows(rng, rng.randrange(0, 4))
        faults = plain_faults(rows)
        assert cr.faults_of([r[0] for r in rows], [r[1] for r in rows])[0] == faults
        assert cr.cheapest([r[0][:1] for r in rows], faults) == all_edits(rows, faults, len(rows) + 3), rows


def test_search_against_table(monkeypatch):
    rng = random.Random(2)
    for block in (256, 1, 3, 17):
        monkeypatch.setattr(cr, "BLOCK", block)
        for _ in range(150):
            rows = random_rows(rng, rng.randrange(0, 40))
            cost, audit, made, faults = plain_repair(rows)
            initials = [r[0][:1] for r in rows]
            assert cr.cheapest(initials, faults) == (cost, audit), (block, rows)
            assert list(cr.turns_of([r[0] for r in rows], [r[1] for r in rows], audit, cr.NONE)) == made


def table(rng, n_convs, size):
    rows = []
    for c in range(n_convs):
        for role, text in random_rows(rng, rng.randrange(1, size)):
            rows.append((c if c else None, rng.choice([None, *range(12)]), rng.choice([role, None]) if rng.random() < 0.1 else role, None if rng.random() < 0.05 else text))
    return rows


def test_query_against_plain_rows(spark):
    rng = random.Random(3)
    rows = table(rng, 150, 9) + [(900 + i, i, "user", "hello there.") for i in range(80)]
    got = cr.repair_all(spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA))
    assert got.columns == ["conv_id", *cr.COUNTS, "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain(rows)
    assert got.count() == len({r[0] for r in rows})


def test_conversations_over_many_ranges(spark, monkeypatch):
    """Ranges of a few rows, so that most conversations are cut, one of them many times."""
    rng = random.Random(4)
    monkeypatch.setattr(cr, "parts_for", lambda spark, n: 23)
    rows = table(rng, 8, 30) + [(77, i // 3, r, t) for i, (r, t) in enumerate(random_rows(rng, 400))] + [(78, 5, "user", "same thing")] * 90 + [(79, None, "tool", "")] * 60
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)
    for damage, frame, gone in ((True, cr.damaged(docs), F.col("gone")), (False, docs.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")), None)):
        want = plain([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], damage)
        got = cr.repair(frame, gone=gone)
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
        made = cr.repair(frame, gone=gone, turns=True).orderBy("conv_id", "seg", "no").collect()
        for conv, row in want.items():
            assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in made if r.conv_id == conv).encode()).hexdigest() == row[-1]


def test_all_rows_gone_and_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert cr.repair_all(docs).count() == 0
    gone = next(i for i in range(1000) if not zlib.crc32(f"{i}:1".encode()) % 20)
    (row,) = cr.repair_all(spark.createDataFrame([(gone, 1, "user", "hi", "", 0)], SCHEMA)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
