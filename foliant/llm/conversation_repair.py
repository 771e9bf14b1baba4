"""Conversation structure repair: A* on the lattice of edits.

A repaired conversation is empty, or an optional system turn and then user and assistant turns in
turns: ``(s?(ua)+)?`` in the initials of its roles. Edits keep a row (0), give it the role of a user or an
assistant (2), delete it (3; a blank row or one whose role and text were seen earlier must go) or
insert an empty turn (2); a truncated row that stays costs 1 more. A node of the lattice is how many
rows are dealt with and what the last role was. What the rest must cost at least is the suffix sum of
3 for each row that must go and 1 for each truncated row (it stays, or is deleted for 3), which never
falls by more than an edit costs. Nodes are taken by (cost plus that sum, audit), the audit being
the initials of the edits so far, so the first goal that is reached is the cheapest and, of equally
cheap ones, the one whose audit is least. Two audits of one cost never begin one another at the same
node (the rest would be free inserts), so the lesser may stand for both. An audit fixes the roles.

Rows are dealt by ranges of conversation and turn. A conversation that lies in one range is repaired there.
One that spans several (however large) is cut there: each piece tells, for each role before it, the best
audit to each role after it, the pieces of a conversation are joined in order, and only the
chosen audits go back to the rows. A long piece is done in the same way within itself.

Defined results: rows go by turn (nulls first), rows of one turn by role, then by the beginning of the text;
a null role or text is empty; a row's first fault of blank, duplicate, truncated counts; a null id is a
conversation of its own; rows that are marked as gone only make their conversation known; repeated rows are
duplicates; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, parts_for

#: What the last role was: none yet, system, user, assistant. The next is a user's, but after a user's.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
TURN = {NONE: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}
ENDS = (NONE, ASSISTANT)
LEGAL = ("su", "ua", "au")
#: Rows that one search goes through at most; longer stretches are joined from such blocks.
BLOCK = 256
BLANKS = " \t\n\x0b\x0c\r"

Routes = dict[int, tuple[int, str]]


def search(initials: list[str], faults: str, entry: int, whole: bool) -> Routes:
    """Cost and audit of the best way to every role after the rows, or only to the best end of a ``whole`` conversation."""
    n = len(initials)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + {"b": 3, "d": 3, "t": 1}.get(faults[i], 0)
    queue, closed, out = [(rest[0], "", 0, entry, 0)], set(), {}
    while queue:
        _, audit, i, role, cost = heapq.heappop(queue)
        if (i, role) in closed:
            continue
        closed.add((i, role))
        if i == n:
            if not whole or role in ENDS:
                out[role] = (cost, audit)
                if whole or len(out) == 4:
                    break
        turn = TURN[role][0]
        steps = [("I", i, turn, 2)]
        if i < n:
            steps.append(("D", i + 1, role, 3))
            if faults[i] not in "bd":
                more = int(faults[i] == "t")
                steps.append(("R", i + 1, turn, 2 + more))
                if (role, initials[i]) in NEXT:
                    steps.append(("K", i + 1, NEXT[role, initials[i]], more))
        for edit, j, to, c in steps:
            if (j, to) not in closed:
                heapq.heappush(queue, (cost + c + rest[j], audit + edit, j, to, cost + c))
    return out


def joined(before: Routes, tables: dict[int, Routes]) -> Routes:
    """The best ways to ``before`` and on through a stretch whose ways from every role are in ``tables``."""
    out: Routes = {}
    for role, (cost, audit) in before.items():
        for to, (c, a) in tables.get(role, {}).items():
            way = (cost + c, audit + a)
            if to not in out or way < out[to]:
                out[to] = way
    return out


def routes(initials: list[str], faults: str, entries: tuple[int, ...]) -> dict[int, Routes]:
    """For each role before some rows the best way to every role after them."""
    found = {e: {e: (0, "")} for e in entries}
    for lo in range(0, len(initials), BLOCK):
        tables = {e: search(initials[lo : lo + BLOCK], faults[lo : lo + BLOCK], e, False) for e in range(4)}
        found = {e: joined(r, tables) for e, r in found.items()}
    return found


def cheapest(initials: list[str], faults: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation's repair."""
    if len(initials) <= BLOCK:
        return next(iter(search(initials, faults, NONE, True).values()))
    ways = routes(initials, faults, (NONE,))[NONE]
    return min(w for role, w in ways.items() if role in ENDS)


def faults_of(roles: list[str], texts: list[str]) -> tuple[str, list[bytes | None]]:
    """The faults of rows in order, and a digest of each row that is the first of its role and text among them."""
    seen: set[bytes] = set()
    out, firsts = [], []
    for role, text in zip(roles, texts, strict=True):
        core = text.rstrip(BLANKS)
        digest = None
        if not core:
            out.append("b")
        else:
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            if digest in seen:
                out.append("d")
                digest = None
            else:
                seen.add(digest)
                out.append("-" if core[-1] in ".!?" else "t")
        firsts.append(digest)
    return "".join(out), firsts


def turns_of(roles: list[str], texts: list[str], audit: str, role: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired turns that an audit makes of rows."""
    i = 0
    for edit in audit:
        if edit == "I":
            role, name = TURN[role]
            yield name, ""
            continue
        if edit == "K":
            role = NEXT[role, roles[i][:1]]
            yield roles[i], texts[i]
        elif edit == "R":
            role, name = TURN[role]
            yield name, texts[i]
        i += 1


def gaps(least: int | None, most: int | None, distinct: int) -> int:
    return 0 if least is None else most - least + 1 - distinct


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
SUMMARY = "key string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
TURNS = "key string, seg int, no long, role string, text string"


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list]]:
    """(key, range, rows) of each conversation of a sorted partition; rows are (turn, role, text) that aren't gone."""
    at, seg, rows = None, 0, []
    for b in batches:
        for key, s, turn, role, text, gone in zip(*(b.column(c).to_pylist() for c in ("key", "seg", "turn", "role", "text", "gone")), strict=True):
            if key != at:
                if at is not None:
                    yield at, seg, rows
                at, seg, rows = key, s, []
            if not gone:
                rows.append((turn, role, text))
    if at is not None:
        yield at, seg, rows


def dealt(rows: DataFrame, conv: str, gone: Column | None) -> DataFrame:
    """Rows by ranges of conversation and turn, in order within each range; written, so that ranges stay what they are."""
    key = F.when(F.col(conv).isNull(), "").otherwise(F.concat(F.lit("="), F.col(conv).cast("string")))
    some = rows.select(key.alias("key"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"))
    # Equal rows may be more than a range holds; which of them comes first makes no difference.
    order = ["key", "turn", "role", "head", "tail", "any"]
    some = some.withColumns({"head": F.substring("text", 1, 100), "tail": F.xxhash64("text"), "any": F.monotonically_increasing_id()})
    n = parts_for(rows.sparkSession, rows.count())
    return checkpointed(some.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", F.spark_partition_id().alias("seg"), "turn", "role", "text", "gone"))


def spanning(rows: DataFrame) -> set[str]:
    """Conversations that lie in more than one range: at most one for each range, as ranges are in order."""
    ends = rows.groupBy("seg").agg(F.min("key").alias("a"), F.max("key").alias("b")).collect()
    first = {k: r.seg for r in ends for k in (r.a, r.b)}
    return {k for r in ends for k in (r.a, r.b) if first[k] != r.seg}


def repair(rows: DataFrame, conv: str = "conv_id", gone: Column | None = None, turns: bool = False) -> DataFrame:
    """A row for each conversation: counts of faults, cost and audit of its repair, and a digest of the repaired text.

    With ``turns`` the repaired turns themselves: (id, seg, no, role, text), in the order of seg, then no.
    The digest is over ``role:text`` of the repaired turns, joined by line ends.
    """
    sorted_rows = dealt(rows, conv, gone)
    cut = spanning(sorted_rows)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, seg, own in conversations(batches):
            if key in cut:
                continue
            roles, texts, numbers = [r[1] for r in own], [r[2] for r in own], {r[0] for r in own if r[0] is not None}
            initials, (faults, _) = [r[:1] for r in roles], faults_of(roles, texts)
            cost, audit = cheapest(initials, faults)
            made = list(turns_of(roles, texts, audit, NONE))
            if turns:
                out += [(key, seg, k, *t) for k, t in enumerate(made)]
            else:
                digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
                out.append((key, gaps(min(numbers, default=None), max(numbers, default=None), len(numbers)), *(faults.count(f) for f in "bdt"), illegal(initials), cost, audit, digest))
            if len(out) >= 1000:
                yield record(out, turns)
                out = []
        if out:
            yield record(out, turns)

    found = sorted_rows.mapInArrow(whole, TURNS if turns else SUMMARY)
    if cut:
        found = found.unionByName(spread(sorted_rows, cut, turns))
    original = F.expr(f"cast(nullif(substring(key, 2), '') as {rows.schema[conv].dataType.simpleString()})").alias(conv)
    return found.select(original, *found.columns[1:])


def record(rows: list[tuple], turns: bool) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()] if turns else [pa.string(), *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
    names = [c.split()[0] for c in (TURNS if turns else SUMMARY).split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def spread(sorted_rows: DataFrame, cut: set[str], turns: bool) -> DataFrame:
    """The repair of conversations that lie in several ranges, range by range."""
    spark = sorted_rows.sparkSession
    keys = F.broadcast(spark.createDataFrame([(k,) for k in sorted(cut)], "key string"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, seg, own in conversations(batches):
            if own:
                roles, texts = [r[1] for r in own], [r[2] for r in own]
                faults, firsts = faults_of(roles, texts)
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n), pa.array([seg] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array([r[0] for r in own], pa.int64()), pa.array(roles), pa.array(texts), pa.array(list(faults)), pa.array(firsts, pa.binary())], names=["key", "seg", "pos", "turn", "role", "text", "fault", "first"])

    known = sorted_rows.join(keys, "key", "left_semi")
    marked = checkpointed(known.mapInArrow(mark, "key string, seg int, pos long, turn long, role string, text string, fault string, first binary"))
    # A range's firsts may have been seen in an earlier one: at most one row for each range and text.
    again = marked.where("first is not null").withColumn("n", F.row_number().over(Window.partitionBy("key", "first").orderBy("seg"))).where("n > 1").select("key", "seg", "pos", F.lit("d").alias("seen"))
    rows = marked.select("key", "seg", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "fault").join(again, ["key", "seg", "pos"], "left").withColumn("fault", F.coalesce("seen", "fault"))
    same = ["initial", "fault", "turn", "pos"]

    def piece(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        """One range's part of a conversation."""
        own = own.sort_values("pos")
        initials, faults = own["initial"].tolist(), "".join(own["fault"])
        turn = own["turn"].dropna().astype("int64")
        ways = [{"entry": e, "exit": to, "cost": c, "audit": a} for e, r in routes(initials, faults, (0, 1, 2, 3)).items() for to, (c, a) in r.items()]
        return pd.DataFrame([(key[0], key[1], *(faults.count(f) for f in "bdt"), illegal(initials), initials[0], initials[-1], turn.min() if len(turn) else None, turn.max() if len(turn) else None, turn.nunique(), ways)], columns=["key", "seg", *COUNTS[1:5], "head", "tail", "least", "most", "n_turns", "ways"])

    way = "struct<entry: int, exit: int, cost: long, audit: string>"
    pieces = rows.select("key", "seg", *same).groupBy("key", "seg").applyInPandas(piece, f"key string, seg int, blank long, duplicate long, truncated long, illegal long, head string, tail string, least long, most long, n_turns long, ways array<{way}>")

    def join(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        """The parts of a conversation in order; what it holds are edits, no texts."""
        own = own.sort_values("seg")
        at: Routes = {NONE: (0, "")}
        # For each part and role after it: the role before it on the best way.
        back: list[dict[int, tuple[int, str]]] = []
        for ways in own["ways"]:
            after, came = {}, {}
            for w in ways:
                if w["entry"] in at:
                    cost, audit = at[w["entry"]]
                    got = (cost + w["cost"], audit + w["audit"])
                    if w["exit"] not in after or got < after[w["exit"]]:
                        after[w["exit"]], came[w["exit"]] = got, (w["entry"], w["audit"])
            at = after
            back.append(came)
        (cost, audit), role = min((w, r) for r, w in at.items() if r in ENDS)
        chosen = []
        for seg, came in zip(own["seg"][::-1], back[::-1], strict=True):
            role, part = came[role]
            chosen.append({"seg": int(seg), "entry": role, "audit": part})
        between = sum(a + b not in LEGAL for a, b in zip(own["tail"], own["head"].iloc[1:], strict=False))
        # Ranges are in order of turn, so neighbours share one turn at most.
        known = own.dropna(subset=["least"])
        shared = int((known["least"].iloc[1:].to_numpy() == known["most"].iloc[:-1].to_numpy()).sum())
        hole = gaps(int(known["least"].min()), int(known["most"].max()), int(known["n_turns"].sum()) - shared) if len(known) else 0
        return pd.DataFrame([(key[0], hole, int(own["blank"].sum()), int(own["duplicate"].sum()), int(own["truncated"].sum()), int(own["illegal"].sum()) + between, cost, audit, chosen[::-1])], columns=["key", *COUNTS, "audit", "chosen"])

    counted = ", ".join(f"{c} long" for c in COUNTS)
    plans = checkpointed(pieces.groupBy("key").applyInPandas(join, f"key string, {counted}, audit string, chosen array<struct<seg: int, entry: int, audit: string>>"))
    chosen = plans.select("key", F.explode("chosen").alias("c")).select("key", "c.seg", "c.entry", "c.audit")

    def carry_out(key: tuple, own: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        made = turns_of(own["role"].tolist(), own["text"].tolist(), plan["audit"].iloc[0], int(plan["entry"].iloc[0]))
        return pd.DataFrame([(key[0], key[1], k, r, t) for k, (r, t) in enumerate(made)], columns=["key", "seg", "no", "role", "text"])

    made = marked.select("key", "seg", "pos", "role", "text").groupBy("key", "seg").cogroup(chosen.groupBy("key", "seg")).applyInPandas(carry_out, TURNS)
    if turns:
        return made

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The digest of each conversation, turn by turn as they stream by."""
        at, so_far, out = None, None, []
        for b in batches:
            for key, role, text in zip(*(b.column(c).to_pylist() for c in ("key", "role", "text")), strict=True):
                if key != at:
                    if at is not None:
                        out.append((at, so_far.hexdigest()))
                    at, so_far = key, hashlib.sha256()
                else:
                    so_far.update(b"\n")
                so_far.update(f"{role}:{text}".encode())
        if at is not None:
            out.append((at, so_far.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["key", "repaired_sha256"])

    digests = made.repartition("key").sortWithinPartitions("key", "seg", "no").mapInArrow(digest, "key string, repaired_sha256 string")
    nothing = hashlib.sha256().hexdigest()
    # Conversations whose rows are all gone, or all deleted, have no turns.
    empty = {c: F.lit(0) for c in COUNTS} | {"audit": F.lit(""), "repaired_sha256": F.lit(nothing)}
    each = keys.join(plans.drop("chosen"), "key", "left").join(digests, "key", "left")
    return each.select("key", *(F.coalesce(c, v).alias(c) for c, v in empty.items()))


def damaged(conversations: DataFrame) -> DataFrame:
    """The planted faults of the query: (conv_id, turn, role, text, gone); nulls are one space."""
    space = F.lit(" ")
    text = F.coalesce("text", space)
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), "kind")
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair_all(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table, repaired after planted faults."""
    return repair(damaged(conversations), gone=F.col("gone"))
