"""Repair of conversation structure: the cheapest edits that give every conversation well-ordered roles.

A conversation is well-ordered if its role initials spell ``(s?(ua)+)?``: nothing, or an optional system turn and then user and
assistant in turn. Edits and their costs: keep a row 0, give it the role user or assistant 1, delete it 2, insert an empty user or
assistant turn 5; a truncated row that stays adds 5; blank and repeated rows must go. Of all cheapest edits those with the
ASCII-least initials (D, I, K, R) are taken. In each of four states (nothing yet, after system, after user, after assistant) an edit
leads to one state only, so the string of initials names one repair.

Square-root checkpoints. The rows of a conversation reach one task twice, sorted in Spark: first from its end to its start without
their texts, then from start to end. The first pass carries the vector of four backward costs and stores it at every
``sqrt(n)``-th row only; the second gathers ``sqrt(n)`` rows, recomputes their vectors from the checkpoint at the block's end, walks them forward
and lets them go. So a task holds about ``sqrt(n)`` vectors and ``sqrt(n)`` rows of a conversation of ``n`` rows, however long it is; Spark's
sort spills. The edits of a row depend on all rows before and after it, so a conversation is one task's work, as its digest is.

Defined cases. Rows are ordered by turn, null turns first, then by role and text, so ties and repeated rows have one order. Null roles and
texts are one space; a null conv_id is one conversation. A role with another initial than s, u or a can only be changed or deleted; an empty role has an empty initial.
A conversation without rows keeps its id: zeros, an empty audit, the hash of the empty string. An empty table gives an empty table. Only ``conv_id``, ``turn``,
``role`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomatch.llm.common import SLICE_ROWS

WHITE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, CUT_SHORT = 2, 5, 1, 5
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or renamed turn leads: its role follows from the state.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row leads, by the initial of its role.
_KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
_NOWHERE = (None, None, None, None)
#: Backward costs after the last row: what must still be inserted.
_END = (0, 2 * INSERT, INSERT, 0)
_LEGAL = {"su", "ua", "au"}

REPORT = T.StructType(
    [T.StructField("conv_id", T.LongType())]
    + [T.StructField(name, T.LongType()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
)
TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def damage(conversations: DataFrame) -> DataFrame:
    """Rows after a fixed damage by ``crc32(conv_id:turn) % 20``: 0 drops the row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats
    the row, 4 makes it a user's. A dropped row stays with ``dropped`` set, so that its conversation is known."""
    or_space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.array_repeat(F.col("kind") == 0, F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("dropped"))


def _fault(earlier: Column) -> Column:
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    return (
        F.when(end == "", BLANK)
        .when(earlier, DUPLICATE)
        .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
        .otherwise(NO_FAULT)
    )


def _sorted_twice(rows: DataFrame) -> DataFrame:
    """Each conversation in one partition: its rows from last to first without texts, then from first to last.

    One shuffle by conv_id serves the windows and the walk, as conv_id is among the keys of all of them.
    """
    own = rows.repartition("conv_id")
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    # Dropped rows stand first and are not counted.
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("dropped"), *order))
    gone = F.count(F.when(F.col("dropped"), 1)).over(Window.partitionBy("conv_id"))
    total = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    placed = own.select("*", (place - gone - 1).alias("at"), (total - gone).alias("n"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("at")) > 1
    judged = placed.select("conv_id", "n", "at", "turn", "role", "text", "dropped", _fault(earlier).alias("fault"))
    both = judged.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("forward")).where("not (forward and dropped)")
    return both.select(
        "conv_id", "n", F.col("at").cast("long").alias("at"), "turn", "role", F.when(F.col("forward"), F.col("text")).alias("text"), "fault", "dropped", "forward",
        F.when(F.col("forward"), F.col("at")).otherwise(-F.col("at")).alias("key"),
    ).sortWithinPartitions("conv_id", "forward", "key").drop("key")


def _options(initial: str, fault: int, state: int, after: tuple[int, ...]) -> Iterator[tuple[str, int, int]]:
    """The edits that use up a row: initial, cost with all that follows, next state; in ASCII order."""
    yield "D", DELETE + after[state], state
    if fault in (BLANK, DUPLICATE):
        return
    stays = CUT_SHORT if fault == TRUNCATED else 0
    if (to := _KEPT.get(initial, _NOWHERE)[state]) is not None:
        yield "K", stays + after[to], to
    yield "R", stays + REROLE + after[_NEXT[state]], _NEXT[state]


def back(initial: str, fault: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Backward costs before a row from those after it."""
    best = [min(cost for _, cost, _ in _options(initial, fault, state, after)) for state in range(4)]
    user, assistant = min(best[USER], INSERT + best[ASSISTANT]), min(best[ASSISTANT], INSERT + best[USER])
    return min(best[START], INSERT + user), min(best[SYSTEM], INSERT + user), user, assistant


class _Conversation:
    """One conversation, fed with its rows from the last to the first, then from the first to the last."""

    def __init__(self, conv_id: int | None, n: int) -> None:
        self.conv_id, self.n, self.step = conv_id, n, max(1, isqrt(n))
        self.counts = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.low = self.high = None
        self.later: str | None = None
        self.vector: tuple[int, ...] = _END
        self.checkpoints: dict[int, tuple[int, ...]] = {n: _END}
        self.block: list[tuple] = []
        self.state, self.cost = START, 0
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.kept = 0

    def backward(self, at: int, turn: int | None, role: str, fault: int) -> None:
        initial = role[:1]
        self.counts[fault] += 1
        if self.later is not None and initial + self.later not in _LEGAL:
            self.illegal += 1
        self.later = initial
        if turn is not None and turn != self.low:
            self.turns += 1
            self.low, self.high = turn, turn if self.high is None else self.high
        self.vector = back(initial, fault, self.vector)
        if at % self.step == 0:
            self.checkpoints[at] = self.vector
        if at == 0:
            self.cost = self.vector[START]

    def forward(self, at: int, role: str, text: str, fault: int) -> Iterator[tuple[str, str | None, str | None]]:
        self.block.append((role, text, fault))
        if (at + 1) % self.step and at + 1 < self.n:
            return
        costs = [self.checkpoints.pop(at + 1)]
        for own_role, _, own_fault in reversed(self.block):
            costs.append(back(own_role[:1], own_fault, costs[-1]))
        costs.reverse()
        for (own_role, own_text, own_fault), before, after in zip(self.block, costs, costs[1:]):
            yield from self._row(own_role, own_text, own_fault, before, after)
        self.block = []

    def _row(self, role: str, text: str, fault: int, before: tuple[int, ...], after: tuple[int, ...]) -> Iterator[tuple]:
        while True:
            due = before[self.state]
            tight = {edit: to for edit, cost, to in _options(role[:1], fault, self.state, after) if cost == due}
            if "D" not in tight and INSERT + before[_NEXT[self.state]] == due:
                yield self._insert()
                continue
            edit = min(tight)
            self.state = tight[edit]
            yield self._emit(edit, role if edit == "K" else _ROLE.get(self.state), text)
            return

    def _insert(self) -> tuple:
        self.state = _NEXT[self.state]
        return self._emit("I", _ROLE[self.state], "")

    def _emit(self, edit: str, role: str | None, text: str) -> tuple:
        self.audit.append(edit)
        if edit == "D":
            return edit, None, None
        self.digest.update(f"{chr(10) if self.kept else ''}{role}:{text}".encode())
        self.kept += 1
        return edit, role, text

    def close(self) -> Iterator[tuple]:
        while _END[self.state]:
            yield self._insert()

    def report(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def _walk(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[tuple]:
    """Rows of one partition as they come; yields repaired turns, or one report for each conversation."""
    now: _Conversation | None = None
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            columns = [column.to_pylist() for column in batch.slice(start, SLICE_ROWS).columns]
            for conv_id, n, at, turn, role, text, fault, dropped, forward in zip(*columns):
                if now is None or conv_id != now.conv_id:
                    yield from _closed(now, turns)
                    now = _Conversation(conv_id, n)
                if forward:
                    edits = now.forward(at, role, text, fault)
                    yield from _out(now, edits, turns)
                elif not dropped:
                    now.backward(at, turn, role, fault)
    yield from _closed(now, turns)


def _out(now: _Conversation, edits: Iterator[tuple], turns: bool) -> Iterator[tuple]:
    for edit, role, text in edits:
        if turns:
            yield now.conv_id, len(now.audit) - 1, edit, role, text


def _closed(now: _Conversation | None, turns: bool) -> Iterator[tuple]:
    if now is not None:
        yield from _out(now, now.close(), turns)
        if not turns:
            yield now.report()


def _repaired(rows: DataFrame, turns: bool) -> DataFrame:
    schema = TURNS if turns else REPORT
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in _walk(batches, turns):
            held.append(row)
            if len(held) >= SLICE_ROWS:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    def _batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*held), kinds)], schema.names)

    return _sorted_twice(rows).mapInArrow(run, schema)


def _undamaged(conversations: DataFrame) -> DataFrame:
    or_space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), or_space("role"), or_space("text"), F.lit(False).alias("dropped"))


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """One row for each edit, in order: ``conv_id, place, edit, role, text``; a deleted row has no role and no text. The rows with a
    role are the repaired conversation."""
    return _repaired(_undamaged(conversations), True)


def reports(conversations: DataFrame) -> DataFrame:
    """Faults, cost, audit and the digest of the repaired turns of every conversation."""
    return _repaired(_undamaged(conversations), False)


def damaged_reports(conversations: DataFrame) -> DataFrame:
    """:func:`reports` of the rows that :func:`damage` leaves; conversations that lose all rows stay."""
    return _repaired(damage(conversations), False)
