"""Conversation structure repair by depth-first branch-and-bound.

A conversation is right if its roles' initials read (s?(ua)+)?. Its rows are kept, given another role or deleted, and
empty turns are inserted, at the least cost; of equally cheap repairs the one whose edits' initials (the audit) are
least. The search keeps a stack of prefixes, tried in the order of their letters. A prefix is cut off if its cost and
a lower bound of what must follow exceed the incumbent, which a greedy dive begins and each better (cost, audit)
replaces, or if the table of its node (row, state) has a prefix that is no worse; when the stack is empty, the
incumbent is proven best. Two prefixes of a node with equal costs never begin one another, so that the lesser stays
the lesser whatever follows.

Conversations are dealt by a range sort and cut into segments of SEGMENT rows, so that a long one is many tasks' work.
A segment that may not be a whole conversation is solved for each state before and behind it; neighbouring segments
are put together, FAN at a time, until each conversation is one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.llm.shared import attach, materialize, numbered

#: Rows in a segment, and segments that are put together at once.
SEGMENT, FAN = 64, 64
#: States: nothing yet, behind system, user, assistant; what may follow each, and what an inserted turn or a new role makes of it.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
MADE = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (NOTHING, ASSISTANT)
LEGAL = {"su", "ua", "au"}
#: Faults of a row.
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE, INSERT, RENAME, CUT = 3, 2, 2, 1

Row = tuple[str, int]  # a row's initial and fault
Repair = tuple[int, str]  # cost and audit


def lower_bounds(rows: list[Row]) -> list[int]:
    """Least cost of what is done from each row on: of each row by itself, and INSERT for neighbours that can't both be kept, each row in one such pair."""
    alone = [DELETE if fault in (BLANK, DUPLICATE) else (CUT if fault == TRUNCATED else 0) + (0 if initial in ("s", "u", "a") else min(RENAME, DELETE)) for initial, fault in rows]
    alone = [min(c, DELETE) for c in alone]
    clash = [all(f in (NO_FAULT, TRUNCATED) and i in ("s", "u", "a") for i, f in pair) and pair[0][0] + pair[1][0] not in LEGAL for pair in zip(rows[:-1], rows[1:], strict=True)]
    bounds = [0] * (len(rows) + 2)
    for k in range(len(rows) - 1, -1, -1):
        bounds[k] = alone[k] + bounds[k + 1]
        if k + 1 < len(rows) and clash[k]:
            bounds[k] = max(bounds[k], alone[k] + alone[k + 1] + min(INSERT, DELETE - CUT) + bounds[k + 2])
    return bounds[:-1]


def moves(rows: list[Row], k: int, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, next row, next state, cost) of what can be done in front of row k, by letter."""
    out = []
    if k < len(rows):
        out.append(("D", k + 1, state, DELETE))
    out.append(("I", k, MADE[state], INSERT))
    if k < len(rows) and rows[k][1] in (NO_FAULT, TRUNCATED):
        initial, cut = rows[k][0], CUT * (rows[k][1] == TRUNCATED)
        if initial in NEXT[state]:
            out.append(("K", k + 1, NEXT[state][initial], cut))
        out.append(("R", k + 1, MADE[state], RENAME + cut))
    return out


def dive(rows: list[Row], state: int, goals: tuple[int, ...], bounds: list[int]) -> Repair | None:
    """A repair without going back: the cheapest move by its cost and bound, never a second insertion in a row before a row."""
    k, cost, audit = 0, 0, ""
    while k < len(rows):
        tried = [m for m in moves(rows, k, state) if m[0] != "I" or not audit.endswith("I")]
        letter, k, state, more = min(tried, key=lambda m: (m[3] + bounds[m[1]], m[0]))
        cost, audit = cost + more, audit + letter
    for _ in range(3):
        if state in goals:
            return cost, audit
        state, cost, audit = MADE[state], cost + INSERT, audit + "I"
    return None


def repaired(rows: list[Row], entry: int, goals: tuple[int, ...]) -> Repair | None:
    """The cheapest repair, and of those the one with the least audit, from the state `entry` to one of the goals; None if there is none."""
    bounds = lower_bounds(rows)
    best = dive(rows, entry, goals, bounds)
    seen: dict[tuple[int, int], Repair] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        k, state, cost, audit = stack.pop()
        if best and (cost + bounds[k] > best[0] or (cost + bounds[k] == best[0] and audit > best[1])):
            continue
        if (k, state) in seen and seen[k, state] <= (cost, audit):
            continue
        seen[k, state] = cost, audit
        if k == len(rows) and state in goals and (best is None or (cost, audit) < best):
            best = cost, audit
        for letter, to, after, more in reversed(moves(rows, k, state)):
            stack.append((to, after, cost + more, audit + letter))
    return best


def lines(turns: list[tuple[str, str]], entry: int, audit: str) -> list[str]:
    """The repaired rows as role:text."""
    out, state, rows = [], entry, iter(turns)
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "D":
            continue
        state = NEXT[state][role[0]] if letter == "K" else MADE[state]
        out.append(f"{role if letter == 'K' else NAMES[state]}:{text}")
    return out


def joined(parts: list[list[tuple]]) -> list[tuple]:
    """Repairs (before, behind, cost, audits, states) of neighbouring stretches as those of the whole."""
    whole = parts[0]
    for part in parts[1:]:
        found: dict[tuple[int, int], tuple] = {}
        for before, mid, cost, audits, states in whole:
            for other, behind, more, further, beyond in part:
                if other == mid:
                    new = (before, behind, cost + more, [*audits, *further], [*states, *beyond])
                    old = found.get((before, behind))
                    if old is None or (new[2], "".join(new[3])) < (old[2], "".join(old[3])):
                        found[before, behind] = new
        whole = list(found.values())
    return whole


FACTS = "blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,low:bigint,high:bigint,turns:bigint,first:string,last:string"
REPAIRS = "array<struct<before:int,behind:int,cost:bigint,audits:array<string>,states:array<int>>>"
SOLVED = f"conv string, seq long, facts struct<{FACTS}>, cost long, audit string, sha string, repairs {REPAIRS}, rows array<struct<role:string,text:string>>"
REPAIR_KIND = pa.list_(pa.struct([("before", pa.int32()), ("behind", pa.int32()), ("cost", pa.int64()), ("audits", pa.list_(pa.string())), ("states", pa.list_(pa.int32()))]))
FACT_KIND = pa.struct([(f.split(":")[0], pa.string() if f.endswith("string") else pa.int64()) for f in FACTS.split(",")])
ROW_KIND = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def facts_of(rows: list[tuple]) -> dict:
    """What is told of a stretch of rows (turn, role, text, fault)."""
    turns, initials = [r[0] for r in rows if r[0] is not None], [r[1][:1] for r in rows]
    of = lambda fault: sum(r[3] == fault for r in rows)
    illegal = sum(a + b not in LEGAL for a, b in zip(initials[:-1], initials[1:], strict=True))
    return {"blank": of(BLANK), "duplicate": of(DUPLICATE), "truncated": of(TRUNCATED), "illegal": illegal, "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)), "first": initials[0], "last": initials[-1]}


def both(a: dict, b: dict) -> dict:
    """The facts of two neighbouring stretches."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"low": a["low"] if a["low"] is not None else b["low"], "high": b["high"] if b["high"] is not None else a["high"], "first": a["first"], "last": b["last"]}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple], bool]]:
    """(conv, rows, surely whole) of a shard in order: runs of a conversation, cut at SEGMENT rows."""
    conv, rows, first = None, [], True
    for batch in batches:
        for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and (own != conv or len(rows) == SEGMENT):
                yield conv, rows, not first and own != conv
                first, rows = own == conv, []  # the rest of a conversation that was cut is no whole one
            conv = own
            rows.append(tuple(row))
    if rows:
        yield conv, rows, False


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their facts, their repair if they are whole conversations, and those for all states if they may not be."""
    seq, out, size = TaskContext.get().partitionId() << 40, [], 0
    for conv, rows, whole in _segments(batches):
        codes = [(r[1][:1], r[3]) for r in rows]
        turns = [(r[1], r[2]) for r in rows]
        cost, audit = repaired(codes, NOTHING, ENDS)
        sha = hashlib.sha256("\n".join(lines(turns, NOTHING, audit)).encode()).hexdigest()
        tried = [] if whole else [(a, b, repaired(codes, a, (b,))) for a in range(4) for b in range(4)]
        repairs = [{"before": a, "behind": b, "cost": r[0], "audits": [r[1]], "states": [a]} for a, b, r in tried if r]
        out.append((conv, seq, facts_of(rows), cost, audit, sha, repairs, None if whole else [{"role": r, "text": t} for r, t in turns]))
        seq, size = seq + 1, size + sum(len(t) for _, t in turns)
        if len(out) >= 1000 or size > 8 << 20:
            yield _batch(out)
            out, size = [], 0
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), FACT_KIND, pa.int64(), pa.string(), pa.string(), REPAIR_KIND, ROW_KIND)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv", "seq", "facts", "cost", "audit", "sha", "repairs", "rows"])


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for conv, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            facts = found[0]["facts"]
            for f in found[1:]:
                facts = both(facts, f["facts"])
            whole = joined([[(r["before"], r["behind"], r["cost"], r["audits"], r["states"]) for r in f["repairs"]] for f in found])
            repairs = [dict(zip(("before", "behind", "cost", "audits", "states"), r, strict=True)) for r in whole]
            columns = [pa.array([conv]), pa.array([found[0]["seq"]], pa.int64()), pa.array([[s for f in found for s in f["seqs"]]], pa.list_(pa.int64())), pa.array([facts], FACT_KIND), pa.array([repairs], REPAIR_KIND)]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "seq", "seqs", "facts", "repairs"])


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's lines, whose segments (conv, seq, state, audit, rows) follow each other."""
    conv, hashed, begun = None, hashlib.sha256(), False

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([hashed.hexdigest()])], ["conv", "sha"])

    for batch in batches:
        for own, _, state, audit, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != conv:
                if conv is not None:
                    yield out()
                conv, hashed, begun = own, hashlib.sha256(), False
            if said := lines([(r["role"], r["text"]) for r in rows], state, audit):
                hashed.update(("\n" * begun + "\n".join(said)).encode())
                begun = True
    if conv is not None:
        yield out()


def _long_ones(segments: DataFrame) -> DataFrame:
    """(conv, facts, cost, audit, sha) of the conversations of several segments: put together in rounds, then written out and hashed in order."""
    spark, n = segments.sparkSession, 0
    shape = f"conv string, seq long, seqs array<long>, facts struct<{FACTS}>, repairs {REPAIRS}"
    waiting = materialize(segments.select("conv", "seq", F.array("seq").alias("seqs"), "facts", "repairs"), "waiting")
    done = []
    while True:
        left = waiting.count()
        if not left:
            break
        # Blocks move by half of their width each round, so that neighbours meet sooner or later.
        nth = numbered(waiting.select("conv", "seq"), F.struct("conv", "seq")).select("seq", F.floor((F.col("nth") + FAN // 2 * (n % 2)) / FAN).alias("block"))
        grouped = waiting.join(nth, "seq").groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("seq", "seqs", "facts", "repairs"))).alias("found"))
        met = materialize(grouped.select("conv", "found").mapInArrow(_put_together, shape), "met")
        several = materialize(met.groupBy("conv").count().where("count > 1").select("conv"), "several")
        done.append(met.join(several, "conv", "left_anti"))
        waiting, n = materialize(met.join(several, "conv", "left_semi"), "waiting"), n + 1
    if not done:
        return spark.createDataFrame([], f"conv string, facts struct<{FACTS}>, cost long, audit string, sha string")
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    ends = F.filter("repairs", lambda r: (r["before"] == NOTHING) & r["behind"].isin(*ENDS))
    cheapest = F.array_min(F.transform(ends, lambda r: F.struct(r["cost"].alias("cost"), F.array_join(r["audits"], "").alias("audit"), r["audits"].alias("audits"), r["states"].alias("states"))))
    whole = materialize(whole.select("conv", "seqs", "facts", cheapest.alias("r")).select("conv", "seqs", "facts", "r.*"), "repaired")
    own = whole.select("conv", F.explode(F.arrays_zip("seqs", "audits", "states")).alias("x")).select("conv", F.col("x.seqs").alias("seq"), F.col("x.states").alias("state"), F.col("x.audits").alias("audit"))
    told = segments.select("seq", "rows").join(own, "seq").select("conv", "seq", "state", "audit", "rows")
    hashes = told.repartition("conv").sortWithinPartitions("conv", "seq").mapInArrow(_written, "conv string, sha string")
    return whole.select("conv", "facts", "cost", "audit").join(hashes, "conv")


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv string, conv_id, turn, role, text) with crc32 of conv_id:turn, by 20, telling what befalls each: 0 drops it, 1 empties it, 2 takes .!? away, 3 repeats it, 4 makes it the user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = rows.withColumn("_hit", F.crc32(key.cast("binary")) % 20).where("_hit <> 0")
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hit.select("conv", "turn", F.when(F.col("_hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), twice.alias("copy"))


SPACE = " \t\n\x0b\f\r"


def repair(rows: DataFrame) -> DataFrame:
    """(conv, facts, cost, audit, sha) of each conversation of rows (conv string, turn, role, text), by turn (none first), role and text.

    facts: rows by their first fault (blank, duplicate, truncated), illegal neighbours, the least and the largest turn and
    how many turns there are. A row whose role is empty has no initial and can't be kept. sha: of the repaired rows.
    """
    own = materialize(rows.select("conv", F.col("turn").cast("long").alias("turn"), "role", "text", F.monotonically_increasing_id().alias("_row")), "turns")
    bare = F.rtrim("text", F.lit(SPACE))
    blank = F.ltrim(bare, F.lit(SPACE)) == ""
    # A row repeats an earlier one: counted by digests first, then only those of repeated digests are looked at again.
    said = own.where(~blank).select("conv", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"), F.struct(F.col("turn"), F.col("_row")).alias("place"))
    first = said.groupBy("conv", "said").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select("conv", "said", "first"), "firsts")
    again = materialize(attach(said, first, ["conv", "said"]).where("place <> first").select(F.col("place._row").alias("_row"), F.lit(True).alias("again")), "again")
    fault = F.when(blank, BLANK).when(F.col("again"), DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(NO_FAULT)
    told = attach(own, again, ["_row"], "left").withColumn("fault", fault)
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text", "_row")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = told.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "fault")
    segments = materialize(shards.mapInArrow(_solved, SOLVED), "segments")
    several = materialize(segments.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv"), "several")
    alone = segments.select("conv", "facts", "cost", "audit", "sha").join(several, "conv", "left_anti")
    return alone.unionByName(_long_ones(materialize(segments.join(several, "conv", "left_semi"), "long")))


def repair_damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation of rows (conv_id, turn, role, text, ...), damaged first.

    A null role or text is a blank, as is a null conv_id or turn in what tells the damage; rows without conv_id are one
    conversation, rows without turn come first and make no gap. Repeated rows are rows of their own, and duplicates of
    each other. A conversation none of whose rows is left has zeros, an empty audit and the hash of nothing. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    given = rows.select(conv.alias("conv"), "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    found = repair(damaged(given))
    every = given.select("conv", "conv_id").distinct()
    none = F.lit(0).cast("long")
    gaps = F.coalesce(F.col("facts.high") - F.col("facts.low") + 1 - F.col("facts.turns"), none)
    counts = [F.coalesce(f"facts.{c}", none).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    return every.join(found, "conv", "left").select(
        "conv_id", gaps.alias("gaps"), *counts, F.coalesce("cost", none).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )

