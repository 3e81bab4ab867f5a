"""Conversation structure repair: the cheapest edits that bring a conversation's roles into order, by Knuth's lightest derivation.

A repair item (rows, state) says that the last `rows` rows can be repaired from a state of the role grammar on.  Its
derivations are the hyperedges of a graph: an edit of the row before, or an inserted turn, put before a finished item.
The agenda pops items by (cost, rows, audit).  All edits are superior functions in this order: none lowers the cost,
those that cost nothing consume a row, and what is put before two audits keeps their order; so an item is final when
it is popped first, and the search ends with the goal item.  From one item no two derivations begin with the same
edit, so audits of equal cost are told apart by their first letter and need not be held as texts.

Rows of a conversation stand in order of turn (nulls first), then role and a digest of the row; of equal rows all but the first are
duplicates.  Null roles and texts are one space, a row with an empty role fits nowhere unless it is reroled, a null conv_id is a
conversation of its own, extra columns are left out, an empty table gives no rows.  Texts are only streamed: a task holds about a
hundred bytes for each row of the conversation at hand.  One conversation is the work of one task, as its digest runs over all of
its text in order.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import ship_code

#: Costs of the edits; an undeleted truncated row adds TRUNCATED.
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
#: The grammar (s?(ua)+)? of role initials: by state, the next state for an initial.  States 0 and 3 may end a conversation.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLE = {2: "user", 3: "assistant"}
#: By state, the (state before, initial) that lead to it.
_BEFORE = [[(p, x) for p, step in enumerate(NEXT) for x, q in step.items() if q == state] for state in range(len(NEXT))]
#: Faults of a row, the first that applies counts.
BLANK, DUPLICATE, TRUNCATED_ROW, SOUND = range(4)
_SPACE = " \t\n\x0b\x0c\r"


def lightest_repair(initials: list[str], faults: list[int] | bytearray) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair; of equal costs the audit that is least in ASCII."""
    n = len(initials)
    step: list[dict[int, tuple[str, int]]] = [{} for _ in range(n + 1)]
    agenda = [(0, 0, "", q, q) for q in ENDS]
    while True:
        cost, rows, letter, state, tail = heapq.heappop(agenda)
        if state in step[rows]:
            continue
        step[rows][state] = (letter, tail)
        if rows == n and state == 0:
            break
        for p, x in _BEFORE[state]:
            if x != "s":
                heapq.heappush(agenda, (cost + COST["I"], rows, "I", p, state))
        if rows == n:
            continue
        initial, fault = initials[n - 1 - rows], faults[n - 1 - rows]
        heapq.heappush(agenda, (cost + COST["D"], rows + 1, "D", state, state))
        if fault in (BLANK, DUPLICATE):
            continue
        extra = TRUNCATED if fault == TRUNCATED_ROW else 0
        for p, x in _BEFORE[state]:
            if x == initial:
                heapq.heappush(agenda, (cost + COST["K"] + extra, rows + 1, "K", p, state))
            if x != "s":
                heapq.heappush(agenda, (cost + COST["R"] + extra, rows + 1, "R", p, state))
    audit, rows, state = [], n, 0
    while True:
        letter, state_after = step[rows][state]
        if not letter:
            return cost, "".join(audit)
        audit.append(letter)
        rows, state = rows - (letter != "I"), state_after


def damage(turns: DataFrame) -> DataFrame:
    """The test damage of a table of turns, by crc32 of 'conv_id:turn' modulo 20; a dropped row stays as one with `gone` set.

    0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it,
    4 makes it the user's.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    hurt = t.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return hurt.drop("_copy")


def _prepared(turns: DataFrame) -> DataFrame:
    """Nulls as one space, `gone` where the table has none, and a digest that tells roles and texts apart."""
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), gone.alias("gone"))
    return t.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))


def _together(rows: DataFrame, *first: str) -> DataFrame:
    """Conversations side by side, rows in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "digest")


def _kind(turns: DataFrame) -> T.DataType:
    return turns.schema["conv_id"].dataType


def find_repairs(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): faults and the cheapest edits of each conversation.

    turns: (conv_id, turn, role, text) and perhaps gone, which marks rows that only say that a conversation exists.
    Only digests and flags are shuffled, no text.
    """
    ship_code(turns.sparkSession)
    body = F.rtrim(F.col("text"), F.lit(_SPACE))
    end: Column = F.right(body, F.lit(1))
    fault = F.when(body == "", BLANK).when(end.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED_ROW)
    t = _together(_prepared(turns).select("conv_id", "turn", "role", "gone", "digest", fault.cast("int").alias("fault")))
    slim = t.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "gone", "digest", "fault")
    out = T.StructType(
        [T.StructField("conv_id", _kind(turns))]
        + [T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        + [T.StructField("audit", T.StringType())]
    )

    def report(key: object, turn: list[int], initials: list[str], faults: bytearray) -> dict:
        cost, audit = lightest_repair(initials, faults)
        gaps = max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        return {"conv_id": key, "gaps": gaps, "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED_ROW), "illegal": illegal, "cost": cost, "audit": audit}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, key, done, schema = False, None, [], None
        turn: list[int] = []
        initials: list[str] = []
        faults, seen = bytearray(), set()
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("conv_id"), *((c.name, pa.int64() if c.name != "audit" else pa.string()) for c in out.fields[1:])])
            for conv, at, initial, gone, digest, fault_of in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if not started or conv != key:
                    if started:
                        done.append(report(key, turn, initials, faults))
                        if len(done) >= 5000:
                            yield pa.RecordBatch.from_pylist(done, schema)
                            done = []
                    started, key, turn, initials, faults, seen = True, conv, [], [], bytearray(), set()
                if gone:
                    continue
                if at is not None:
                    turn.append(at)
                initials.append(initial)
                faults.append(DUPLICATE if fault_of != BLANK and digest in seen else fault_of)
                seen.add(digest)
        if started:
            done.append(report(key, turn, initials, faults))
            yield pa.RecordBatch.from_pylist(done, schema)

    return slim.mapInArrow(run, out)


def repaired_turns(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the turns that stay, place counted from 0; inserted ones have no turn.

    A conversation's rows come out side by side and in order.  Each text is shuffled once, with the audit of its
    conversation in a row before them.
    """
    ship_code(turns.sparkSession)
    rows = _prepared(turns).filter("not gone").select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "text")
    heads = repairs.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    t = _together(heads.unionByName(rows), "part").select("conv_id", "part", "turn", "role", "text")
    out = T.StructType(
        [T.StructField("conv_id", _kind(turns)), T.StructField("place", T.LongType()), T.StructField("turn", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("role", "text", "edit")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, state, odd = "", 0, 0, 0, False

        def fill(conv: object, made: list[tuple]) -> None:
            """Insertions that stand before the next row."""
            nonlocal at, place, state, odd
            while at < len(audit) and audit[at] == "I":
                state, odd = (3 if state == 2 else 2), False
                made.append((conv, place, None, ROLE[state], "", "I"))
                at, place = at + 1, place + 1

        for batch in batches:
            made: list[tuple] = []
            for conv, part, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part == 0:
                    audit, at, place, state = text, 0, 0, 0
                    odd = (len(audit) - audit.count("D")) % 2 == 1
                    fill(conv, made)
                    continue
                edit = audit[at]
                at += 1
                if edit != "D":
                    state, odd = (1 if odd else 3 if state == 2 else 2), False
                    made.append((conv, place, turn, role if edit == "K" else ROLE[state], text, edit))
                    place += 1
                fill(conv, made)
            columns = list(zip(*made)) or [()] * 6
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=out.names)

    return t.mapInArrow(run, out)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the turns as 'role:text', joined by line breaks; rows as repaired_turns leaves them."""
    out = T.StructType([T.StructField("conv_id", _kind(repaired)), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, kind = None, None, None
        for batch in batches:
            keys, values = [], []
            kind = batch.schema.field("conv_id").type
            for conv, place, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if place == 0:
                    if sha is not None:
                        keys.append(key)
                        values.append(sha.hexdigest())
                    key, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(values, pa.string())], names=out.names)
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([sha.hexdigest()], pa.string())], names=out.names)

    return repaired.select("conv_id", "place", "role", "text").mapInArrow(run, out)


def repair_digest(turns: DataFrame) -> DataFrame:
    """find_repairs with repaired_sha256, that of the empty text where nothing stays."""
    repairs = find_repairs(turns)
    made = digests(repaired_turns(turns, repairs)).withColumnRenamed("conv_id", "_conv")
    joined = repairs.join(made, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))).drop("_conv")
