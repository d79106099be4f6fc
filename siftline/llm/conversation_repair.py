"""Conversation structure repair: the cheapest edits that give a conversation its turns, by a retained-subsequence programme.

A repaired conversation is empty or an optional system turn followed by user and assistant turns in pairs. A turn is kept, given the role user or assistant, or deleted (blank
turns and duplicates must be); empty turns may be inserted. The programme decides, turn by turn, which turn of which role is retained next: what lies between two
retained turns costs the difference of two prefix sums of deletions plus the inserts that the pair of roles asks for, and a running minimum for each role that was
retained last makes that linear. Of equally cheap edits the least audit (one initial an edit) wins.

Such programmes compose: a stretch of turns is a small table "state before, state after: cost and audit", so a conversation of any length is cut into blocks that tasks work on apart.
Conversations that lie whole in a sorted partition are solved where they are read; of the others only the tables meet, then each block is repaired alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.common import OWN, written

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
#: Inserts between the turn retained last ("-": none) and the next one, by their initials; other pairs cannot be.
INSERTS = {"-s": 0, "-u": 0, "-a": 1, "su": 0, "sa": 1, "uu": 1, "ua": 0, "au": 0, "aa": 1}
AT_END = {"-": 0, "s": 2, "u": 1, "a": 0}
NEXT = {"-": "u", "s": "u", "u": "a", "a": "u"}


@dataclass(frozen=True)
class Costs:
    """Prices of edits, each above zero; a truncated turn that is not deleted costs ``truncated`` more."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Run(NamedTuple):
    """``n`` equal turns in a row; ``fault`` is that of the first: blank, duplicate, truncated or none (the others are duplicates, or blank)."""

    turn: int | None
    role: str
    text: str
    n: int
    fault: str


class Repaired(NamedTuple):
    """``report``: a row for each conversation; ``turns``: (id, piece, place, role, text) of what is left and what was inserted, in order of piece and place."""

    report: DataFrame
    turns: DataFrame


def run_of(turn: int | None, role: str, text: str, n: int, seen: bool) -> Run:
    said = text.rstrip(SPACE)
    return Run(turn, role, text, n, "blank" if not said else "duplicate" if seen else "truncated" if said[-1] not in ".!?" else "")


def best_paths(runs: list[Run], entry: str, costs: Costs) -> dict[str, tuple[int, str]]:
    """For every role that can be the last retained one after ``runs``, given the one before them: the least cost and the least audit at that cost.

    ``best`` holds, for each state, cost minus the deletions up to there, the audit so far and the number of turns it covers; the turns since are deletions.
    """
    best = {entry: (0, "", 0)}
    gone = place = 0
    for run in runs:
        if run.fault in ("", "truncated"):
            more = costs.truncated if run.fault else 0
            new = {}
            for role in "sua":
                if run.role[:1] == role:
                    letter, price = "K", more
                elif role in ROLES:
                    letter, price = "R", more + costs.rerole
                else:
                    continue
                found = None
                for state, (value, audit, at) in best.items():
                    between = INSERTS.get(state + role)
                    if between is None:
                        continue
                    cost = value + gone + between * costs.insert + price
                    if found is None or cost <= found[0]:
                        path = audit + "D" * (place - at) + "I" * between + letter
                        if found is None or (cost, path) < found:
                            found = cost, path
                if found is not None:
                    new[role] = found
            for role, (cost, path) in new.items():
                value = cost - gone - costs.delete
                was = best.get(role)
                if was is None or (value, path) < (was[0], was[1] + "D" * (place + 1 - was[2])):
                    best[role] = value, path, place + 1
        gone += costs.delete * run.n
        place += run.n
    return {state: (value + gone, audit + "D" * (place - at)) for state, (value, audit, at) in best.items()}


def ended(paths: dict[str, tuple[int, str]], costs: Costs) -> tuple[int, str]:
    """The least cost and audit of a whole conversation, what must be inserted at its end included."""
    return min((cost + AT_END[state] * costs.insert, audit + "I" * AT_END[state]) for state, (cost, audit) in paths.items())


def applied(runs: list[Run], audit: str, state: str = "-") -> list[tuple[str, str]]:
    """Roles and texts after the edits of ``audit``. As system, user and assistant turns must follow each other in one way, the initials say it all."""
    out: list[tuple[str, str]] = []
    at = 0

    def insert() -> None:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            state = NEXT[state]
            out.append((ROLES[state], ""))
            at += 1

    for run in runs:
        # A turn's own edit stands behind the inserts before it; deletions stand before those.
        if audit[at : at + 1] == "I":
            insert()
        letter = audit[at]
        if letter == "K":
            state = run.role[:1]
            out.append((run.role, run.text))
        elif letter == "R":
            state = NEXT[state]
            out.append((ROLES[state], run.text))
        at += run.n
    insert()
    return out


def counted(runs: list[Run]) -> dict:
    """What a report counts, and what is needed to count on across blocks. ``runs`` are in order."""
    turns = [r.turn for r in runs if r.turn is not None]
    initials = [r.role[:1] for r in runs]
    count = {"blank": 0, "duplicate": 0, "truncated": 0}
    for r in runs:
        if r.fault:
            count[r.fault] += 1
        count["blank" if r.fault == "blank" else "duplicate"] += r.n - 1
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])) + sum(r.n - 1 for r in runs if r.role[:1] * 2 not in LEGAL)
    return count | {
        "illegal": illegal,
        "first_turn": turns[0] if turns else None,
        "last_turn": turns[-1] if turns else None,
        "distinct": len(set(turns)),
        "first_initial": initials[0] if runs else None,
        "last_initial": initials[-1] if runs else None,
    }


def added(a: dict | None, b: dict) -> dict:
    """The counts of two stretches that follow each other."""
    if a is None or a["first_initial"] is None:
        return b
    if b["first_initial"] is None:
        return a
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    out["illegal"] += a["last_initial"] + b["first_initial"] not in LEGAL
    out["distinct"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    out["first_turn"] = a["first_turn"] if a["first_turn"] is not None else b["first_turn"]
    out["last_turn"] = b["last_turn"] if b["last_turn"] is not None else a["last_turn"]
    return out | {"first_initial": a["first_initial"], "last_initial": b["last_initial"]}


def reported(counts: dict | None, cost: int, audit: str) -> dict:
    c = counts or {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first_turn": None}
    gaps = c["last_turn"] - c["first_turn"] + 1 - c["distinct"] if c["first_turn"] is not None else 0
    return {"gaps": gaps, **{k: c[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit}


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COUNTS = "blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, distinct long, first_initial string, last_initial string"
RUNS = "array<struct<turn: long, role: string, text: string, n: long, fault: string>>"
TURNS = "array<struct<role: string, text: string>>"


def _fields(of: str) -> list[T.StructField]:
    return T.StructType.fromDDL(of).fields


def _batches(rows: list[dict], schema: pa.Schema):
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _solve(costs: Costs, block_rows: int, block_chars: int, schema: pa.Schema):
    """Over sorted runs: a row for each conversation that lies within the partition, a row for each block of those that touch an edge of it or are long."""

    def over(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        out: list[dict] = []
        runs: list[Run] = []
        chars = 0
        key = held = None
        edge = True  # the first conversation may have begun in the partition before

        def block(whole: bool) -> None:
            nonlocal number, chars, runs
            row = {"key": held["conv_id"], "number": number, "whole": whole}
            if whole:
                cost, audit = ended(best_paths(runs, "-", costs), costs)
                row["report"] = reported(counted(runs), cost, audit)
                row["turns"] = [{"role": r, "text": t} for r, t in applied(runs, audit)]
            else:
                row["counts"] = counted(runs)
                row["paths"] = [{"before": b, "after": a, "cost": c, "audit": s} for b in "-sua" for a, (c, s) in best_paths(runs, b, costs).items()]
                row["runs"] = [r._asdict() for r in runs]
            out.append(row)
            number += 1
            runs, chars = [], 0

        for batch in batches:
            for r in batch.to_pylist():
                if held is None or r["conv_id"] != key:
                    if held is not None:
                        block(not edge)
                        edge = False
                    key, held = r["conv_id"], r
                elif len(runs) >= block_rows or chars >= block_chars:
                    edge = True
                    block(False)
                if r["n"]:
                    runs.append(run_of(r["turn"], r["role"], r["text"], r["n"], r["seen"]))
                    chars += len(r["text"])
            yield from _batches(out, schema)
            out.clear()
        if held is not None:
            block(False)  # it may go on in the next partition
            yield from _batches(out, schema)

    return over


def _choose(costs: Costs, schema: pa.Schema):
    """Over the blocks of conversations in order: the least way through their tables; a row for each block (its state before, its audit) and one report."""

    def over(batches):
        out: list[dict] = []
        key = None
        begun = False
        counts, state, trail = None, {}, []

        def end() -> None:
            at = min(state, key=lambda s: (state[s][0] + AT_END[s] * costs.insert, state[s][1], "I" * AT_END[s]))
            cost, more, pieces = state[at][0] + AT_END[at] * costs.insert, "I" * AT_END[at], []
            for number, came in reversed(trail):
                at, audit = came[at]
                pieces.append(audit + more)
                more = ""
                out.append({"key": key, "number": number, "before": at, "audit": pieces[-1]})
            out.append({"key": key, "report": reported(counts, cost, "".join(reversed(pieces)))})

        for batch in batches:
            for r in batch.to_pylist():
                if not begun or r["key"] != key:
                    if begun:
                        end()
                    begun, key, counts, state, trail = True, r["key"], None, {"-": (0, 0)}, []
                counts = added(counts, r["counts"])
                found: dict = {}
                for p in r["paths"]:
                    if p["before"] in state:
                        cost, rank = state[p["before"]]
                        way = cost + p["cost"], rank, p["audit"], p["before"]
                        if p["after"] not in found or way < found[p["after"]]:
                            found[p["after"]] = way
                order = sorted({(rank, audit) for _, rank, audit, _ in found.values()})  # audits up to here by rank: no one begins another
                state = {s: (cost, order.index((rank, audit))) for s, (cost, rank, audit, _) in found.items()}
                trail.append((r["number"], {s: (before, audit) for s, (_, _, audit, before) in found.items()}))
            yield from _batches(out, schema)
            out.clear()
        if begun:
            end()
            yield from _batches(out, schema)

    return over


def _apply(schema: pa.Schema):
    def over(batches):
        for batch in batches:
            for r in batch.to_pylist():
                turns = applied([Run(**x) for x in r["runs"]], r["audit"], r["before"])
                yield from _batches([{"key": r["key"], "number": r["number"], "turns": [{"role": a, "text": t} for a, t in turns]}], schema)

    return over


def _hash(schema: pa.Schema):
    """SHA-256 of the pieces of each conversation, in order, one after the other: no piece is kept."""

    def over(batches):
        key = None
        digest = None
        empty = True
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if digest is None or r["key"] != key:
                    if digest is not None:
                        out.append({"key": key, "repaired_sha256": digest.hexdigest()})
                    key, digest, empty = r["key"], hashlib.sha256(), True
                for t in r["turns"]:
                    digest.update((("" if empty else "\n") + t["role"] + ":" + t["text"]).encode("utf-8", "surrogatepass"))
                    empty = False
            yield from _batches(out, schema)
        if digest is not None:
            yield from _batches([{"key": key, "repaired_sha256": digest.hexdigest()}], schema)

    return over


def runs_of(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copies) with equal rows as one and ``seen``: did the conversation have this role and text at an earlier turn?

    Equal rows are counted where they are read. First turns are found by digests and are unique by conversation, turn, role and text, so their join has no hot key.
    """
    keyed = rows.select(F.struct("conv_id").alias("c"), F.struct("turn").alias("t"), "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("h"), "text", "copies")
    runs = keyed.groupBy("c", "t", "role", "h").agg(F.first("text").alias("text"), F.sum("copies").alias("n"))
    least = keyed.where("copies > 0").groupBy("c", "role", "h").agg(F.bool_or(F.col("t.turn").isNull()).alias("none"), F.min("t.turn").alias("turn"))
    least = least.select("c", F.struct(F.when(~F.col("none"), F.col("turn")).alias("turn")).alias("t"), "role", "h", F.lit(True).alias("first"))
    return runs.join(least, ["c", "t", "role", "h"], "left").select("c.conv_id", "t.turn", "role", "text", "n", F.col("first").isNull().alias("seen"))


def repair(rows: DataFrame, costs: Costs = Costs(), block_rows: int = 512, block_chars: int = 1 << 20) -> Repaired:
    """Repairs ``rows`` (conv_id, turn, role, text; with ``copies``, how often the row stands there, none included): a report for each conversation, and its turns.

    Order is by turn (nulls first), role, text. A null role or text counts as one space, and null ids are one conversation; other columns are left alone. A row with no
    copies only says that its conversation exists: if it has no other rows, its counts are zero and its audit is empty. The report holds ``conv_id``, ``gaps`` (turn numbers
    missing between the least and the largest), ``blank``, ``duplicate``, ``truncated`` (first faults), ``illegal`` (neighbours that cannot be), ``cost``, ``audit`` and
    ``repaired_sha256`` (of ``role:text`` lines). An empty table gives empty results.

    A conversation's audit is one value, an initial a turn, and a hash reads its text in order: these two, but nothing else, pass through one task for each conversation.
    """
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    plain = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(copies > 0, F.coalesce("role", F.lit(" "))).otherwise("").alias("role"), F.when(copies > 0, F.coalesce("text", F.lit(" "))).otherwise("").alias("text"), copies.alias("copies")
    )
    dealt = runs_of(plain).repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    key = T.StructField("key", kind)

    def typed(of: str) -> tuple[T.StructType, pa.Schema]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = T.StructType([key, *_fields(of)])
        return shape, to_arrow_schema(shape)

    shape, arrow = typed(f"number long, whole boolean, report struct<{REPORT}>, turns {TURNS}, counts struct<{COUNTS}>, paths array<struct<before: string, after: string, cost: long, audit: string>>, runs {RUNS}")
    solved = written(dealt.mapInArrow(_solve(costs, block_rows, block_chars, arrow), shape), "conversations")
    whole, blocks = solved.where("whole"), solved.where("not whole")
    shape, arrow = typed(f"number long, before string, audit string, report struct<{REPORT}>")
    chosen = written(blocks.select("key", "number", "counts", "paths").repartition("key").sortWithinPartitions("key", "number").mapInArrow(_choose(costs, arrow), shape), "conversation-paths")
    shape, arrow = typed(f"number long, turns {TURNS}")
    picked = chosen.where("number is not null").select("number", "before", "audit")
    pieces = blocks.select("key", "number", "runs").join(picked, "number").select("key", "number", "runs", "before", "audit").mapInArrow(_apply(arrow), shape)
    shape, arrow = typed("repaired_sha256 string")
    hashed = pieces.repartition("key").sortWithinPartitions("key", "number").mapInArrow(_hash(arrow), shape)
    lines = F.concat_ws("\n", F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text)))
    long = chosen.where("number is null").select("key", "report").join(hashed.withColumnRenamed("key", f"{OWN}key"), F.col("key").eqNullSafe(F.col(f"{OWN}key")))
    report = whole.select(F.col("key").alias("conv_id"), "report.*", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256")).unionByName(
        long.select(F.col("key").alias("conv_id"), "report.*", "repaired_sha256")
    )
    turns = whole.select("key", "number", "turns").unionByName(pieces).select(F.col("key").alias("conv_id"), F.col("number").alias("piece"), F.posexplode("turns").alias("place", "of"))
    return Repaired(report, turns.select("conv_id", "piece", "place", "of.role", "of.text"))


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults put in, told by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20, and ``copies``.

    0 drops the row (no copies), 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes its role user.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(text("role")).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )
