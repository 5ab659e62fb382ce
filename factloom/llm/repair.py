"""Conversation structure repair by weighted finite-state composition.

Three machines are composed lazily. The input acceptor is the chain of a conversation's rows; a symbol is the row's
role initial, whether the row must go (blank, duplicate) and whether its text breaks off. The edit transducer rewrites
it: Keep, Rerole, Delete and Insert, each with its label and cost; its state counts the inserts since the last row,
two at most, since a third would lead back to a grammar state that was there before at no cost. The grammar acceptor
takes the role initials (s?(ua)+)?. Arcs of the composition are made when a state (row, inserts, grammar state) is
first visited; it has no cycles, so the shortest path takes one visit a state, from the last row to the first, over
weights (cost, labels) compared in that order. Labels are prepended, so a state's best path goes on with its
successor's best path, and as all arcs that leave one state carry different labels, two paths of equal cost are told
apart by their first label: no weight has to hold more than that.

Spark's part: rows are dealt by conversation and sorted. One pass takes them from last to first and notes for each row
how each of the four grammar states goes on through it, which depends on later rows alone; a second pass takes them
from first to last and follows. Neither holds more than a batch of rows and four numbers, so a conversation with
a third of all rows streams through its task. (A digest over its whole text in order, as contracts ask for, can't be
split anyway.) Between the passes Spark sorts within partitions and may spill.

Defined cases: null role and text are one space, and so are nulls in the key that picks the damage; rows go by turn,
nulls first, then by role and text; rows with a null conversation id are one conversation; a repeated row is a duplicate;
a conversation without rows keeps one row without an edit; an empty table gives an empty result; columns
other than the four named ones are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import frugal
from .staging import partitions

WHITE = " \t\n\x0b\x0c\r"
ROLES = ("user", "assistant")
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
MOST_INSERTS = 2
#: The grammar acceptor of (s?(ua)+)?: arcs by state and role initial; START and ASSISTANT are final.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
GRAMMAR = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
_FAR = 1 << 40


def edits(initial: str, fault: int):
    """Arcs of the edit transducer that read a row: label, output initial (None: none), cost."""
    yield "D", None, DELETE_COST
    if fault not in (BLANK, DUPLICATE):
        broken = TRUNCATED_COST * (fault == TRUNCATED)
        yield "K", initial, broken
        for role in ROLES:
            yield "R", role[0], REROLE_COST + broken


def arcs(inserts: int, state: int, row: tuple[str, int] | None):
    """Arcs of the composition from (row, inserts, state): label, cost, whether the row is read, next grammar state."""
    if inserts < MOST_INSERTS:
        for role in ROLES:
            if (state, role[0]) in GRAMMAR:
                yield "I", INSERT_COST, False, GRAMMAR[state, role[0]]
    for label, out, cost in edits(*row) if row else ():
        if out is None:
            yield label, cost, True, state
        elif (state, out) in GRAMMAR:
            yield label, cost, True, GRAMMAR[state, out]


@functools.lru_cache(maxsize=1 << 14)
def layer(row: tuple[str, int] | None, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """For each grammar state before a row: the least cost to the end, and the labels up to and with the row's own, with
    the grammar state behind it. after: the least cost to the end for each state behind the row. Without a row, the
    end of the conversation: after is what ending costs in each state."""
    best: dict[tuple[int, int], tuple[int, str, int]] = {}
    for inserts in range(MOST_INSERTS, -1, -1):
        for state in STATES:
            found = [] if row else [(after[state], "", state)]
            for label, cost, reads, to in arcs(inserts, state, row):
                rest, labels, behind = (after[to], "", to) if reads else best[inserts + 1, to]
                found.append((cost + rest, label + labels, behind))
            best[inserts, state] = min(found, default=(_FAR, "", state))
    return tuple(min(best[0, s][0], _FAR) for s in STATES), tuple(best[0, s][1:] for s in STATES)


#: At the end of a conversation: what ending costs, and the inserts that come last.
END_COSTS, END_STEPS = layer(None, tuple(0 if s in FINAL else _FAR for s in STATES))


@functools.lru_cache(maxsize=1 << 16)
def back(initial: str, fault: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """One row against the direction of reading: costs before it, relative to the least, and its steps as text, such as
    D0,K2,IK3,R3: labels and next state for each of the four states."""
    costs, steps = layer((initial, fault), after)
    least = min(costs)
    return tuple(c - least for c in costs), ",".join(f"{labels}{to}" for labels, to in steps)


def shortest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and labels of the cheapest repair of one conversation: role initials and faults of its rows."""
    total, costs, steps = 0, END_COSTS, []
    for row in reversed(rows):
        costs, step = layer(row, costs)
        steps.append(step)
    total, out, state = costs[START], "", START
    for step in reversed(steps):
        labels, state = step[state]
        out += labels
    return total, out + END_STEPS[state][0]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after a damage that crc32 of "conv_id:turn" modulo 20 picks, and gone: 0 drops the row (gone, so
    that its conversation stays known), 1 empties the text, 2 takes its [.!?], 3 repeats the row, 4 makes the role user."""
    space = F.lit(" ")
    c = conversations
    conv, turn = (F.coalesce(c[x].cast("string"), space) for x in ("conv_id", "turn"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    rows = c.select(c["conv_id"].alias("conv_id"), c["turn"].cast("long").alias("turn"), F.coalesce(c["role"].cast("string"), space).alias("role"), F.coalesce(c["text"].cast("string"), space).alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("gone"), F.explode(times).alias("_copy"))
    return rows.drop("_copy")


def _fault(copy: Column) -> Column:
    ink = F.rtrim("text", F.lit(WHITE))
    fault = F.when(ink == "", BLANK).when(copy > 1, DUPLICATE).when(~F.right(ink, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
    return fault.otherwise(NO_FAULT).cast("int")


_EDITS = "conv_id {id}, seq long, edit string, role string, text string, turn long, given_role string, fault int"


def repair(turns: DataFrame) -> DataFrame:
    """One row for each edit, in order within partitions: conv_id, seq (from 0), edit (K, R, D or I; null for the only row of a
    conversation that has none), role and text after it (null if deleted), and of the row it reads turn, given_role
    and fault (0 none, 1 blank, 2 duplicate, 3 truncated). turns: conv_id, turn, role, text, and gone where a row only names
    its conversation."""
    t = turns if "gone" in turns.columns else turns.withColumn("gone", F.lit(False))
    space = F.lit(" ")
    t = t.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"), "gone")
    t = t.repartition(partitions(t.sparkSession), "conv_id")
    # The deal by conversation is kept, so the window takes a sort and no shuffle.
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    t = t.withColumn("copy", F.row_number().over(same))
    t = t.select("conv_id", "turn", "role", "text", "gone", "copy", _fault(F.col("copy")).alias("fault"))
    keys = ("conv_id", "turn", "role", "text", "copy")
    noted = T.StructType([*t.schema.fields]).add("steps", T.StringType())

    def backwards(batches):
        conv, costs = object(), END_COSTS
        for b in batches:
            steps = []
            for c, role, gone, fault in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "gone", "fault"))):
                if c != conv:
                    conv, costs = c, END_COSTS
                if not gone:
                    costs, step = back(role[:1], fault, costs)
                steps.append(None if gone else step)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(steps, pa.string())], names=[*b.schema.names, "steps"])

    t = t.sortWithinPartitions(*(F.desc_nulls_last(k) for k in keys)).mapInArrow(frugal(backwards), noted)
    out = T.StructType.fromDDL(_EDITS.format(id=t.schema["conv_id"].dataType.simpleString()))

    def inserted(conv, seq: int, state: int) -> tuple:
        role = next(r for r in ROLES if (state, r[0]) in GRAMMAR)
        return (conv, seq, "I", role, "", None, None, None)

    def forwards(batches):
        conv, seq, state, none = object(), 0, START, True
        begun = False

        def end() -> list[tuple]:
            rows, s = [], state
            for _ in END_STEPS[state][0]:
                rows.append(inserted(conv, seq + len(rows), s))
                s = GRAMMAR[s, rows[-1][3][0]]
            return [(conv, 0, None, None, None, None, None, None)] if none else rows

        for b in batches:
            rows = []
            for c, turn, role, text, gone, _, fault, steps in zip(*(b.column(x).to_pylist() for x in b.schema.names)):
                if not begun or c != conv:
                    rows += end() if begun else []
                    conv, seq, state, none, begun = c, 0, START, True, True
                if gone:
                    continue
                none = False
                step = steps.split(",")[state]
                for _ in range(len(step) - 2):
                    rows.append(inserted(conv, seq, state))
                    state, seq = GRAMMAR[state, rows[-1][3][0]], seq + 1
                edit = step[-2]
                to = next((r for r in ROLES if (state, r[0]) in GRAMMAR), None) if edit == "R" else role
                rows.append((conv, seq, edit, *((None, None) if edit == "D" else (to, text)), turn, role, fault))
                state, seq = int(step[-1]), seq + 1
            if rows:
                yield _batch(rows, out)
        if begun and (rows := end()):
            yield _batch(rows, out)

    return t.sortWithinPartitions(*(F.asc_nulls_first(k) for k in keys)).mapInArrow(frugal(forwards), out)


_DIGESTS = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


class _Tally:
    """One conversation's figures while its edits pass by."""

    def __init__(self, conv):
        self.conv, self.least, self.turn, self.turns, self.faults, self.illegal, self.cost = conv, None, None, 0, [0] * 4, 0, 0
        self.initial, self.audit, self.sha, self.first = None, [], hashlib.sha256(), True

    def add(self, edit, role, text, turn, given, fault) -> None:
        if edit is None:
            return
        self.audit.append(edit)
        if edit != "I":
            if turn is not None:
                self.least = turn if self.least is None else self.least
                self.turns += turn != self.turn
                self.turn = turn
            self.faults[fault] += 1
            self.illegal += self.initial is not None and self.initial + given[:1] not in LEGAL
            self.initial = given[:1]
        self.cost += {"K": 0, "R": REROLE_COST, "D": DELETE_COST, "I": INSERT_COST}[edit] + TRUNCATED_COST * (edit in "KR" and fault == TRUNCATED)
        if edit != "D":
            self.sha.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
            self.first = False

    def row(self) -> tuple:
        gaps = self.turn - self.least + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def digests(repaired: DataFrame) -> DataFrame:
    """Figures of whole conversations, from repair's rows in their partitions: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit (the edits' labels) and the digest of the repaired "role:text" lines."""
    out = T.StructType.fromDDL(_DIGESTS.format(id=repaired.schema["conv_id"].dataType.simpleString()))

    def run(batches):
        held = None
        for b in batches:
            rows = []
            for conv, _, *edit in zip(*(b.column(x).to_pylist() for x in b.schema.names)):
                if held is None or held.conv != conv:
                    rows += [held.row()] if held else []
                    held = _Tally(conv)
                held.add(*edit)
            if rows:
                yield _batch(rows, out)
        if held:
            yield _batch([held.row()], out)

    return repaired.mapInArrow(frugal(run), out)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], names=schema.fieldNames())
