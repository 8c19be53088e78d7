"""Conversation structure repair: a generalised LR parse of roles with weighted edits.

Conversations shall be `(s?(ua)+)?` in the initials of their roles. The parser shifts and reduces
by the tables below; where a row allows several edits, it follows all of them on a
graph-structured stack, whose tops of equal state are merged by least (cost, audit).

A run of rows takes each top to each other top at a least (cost, audit), and runs compose. So a
conversation may be cut into segments anywhere: tasks parse segments, and only their summaries
meet. An insert is counted to the row behind it. Audits of one segment therefore end with a row's
own edit and none goes on where another ends, so the order of audits is that of their parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bytegrain.llm.arrow import ddl, slices
from bytegrain.operators.ordering import with_rank
from bytegrain.session import Stage

# Grammar: S -> (empty) | T | s T;  T -> u a | T u a. States by what lies on the stack:
# 0 nothing, 1 s, 2 u, 3 T, 4 T u, 5 s T; 6 and 7 are complete handles.
SHIFT = {
    (0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 6, (3, "u"): 4, (4, "a"): 7, (5, "u"): 4,
}
HANDLE = {6: 2, 7: 3}  # signs that a reduction to T takes off the stack
GOTO = {0: 3, 1: 5}
ACCEPT = (0, 3, 5)
STACKS = ((0,), (0, 1), (0, 2), (0, 3), (0, 3, 4), (0, 1, 5))  # one for each state as top

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
SEGMENT = 4096  # rows that are parsed together
SPACE = " \t\n\v\f\r"
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")


class Node(NamedTuple):
    """A node of the stack; `below` leads down to the bottom."""

    cost: int
    audit: str
    state: int
    below: Node | None


Tops = dict[int, Node]


def stack(states: tuple[int, ...]) -> Node:
    node = None
    for state in states:
        node = Node(0, "", state, node)
    return node


def shift(node: Node, initial: str, cost: int, edit: str) -> Node | None:
    """The top after a sign, reduced if it ends a handle; None if the sign can't follow."""
    state = SHIFT.get((node.state, initial))
    if state is None:
        return None
    cost, audit = node.cost + cost, node.audit + edit
    if state not in HANDLE:
        return Node(cost, audit, state, node)
    base = node
    for _ in range(HANDLE[state] - 1):
        base = base.below
    return Node(cost, audit, GOTO[base.state], base)


def merge(tops: Tops, node: Node | None) -> bool:
    """Keep the cheaper of two tops of a state. What lies below a top decides no later step."""
    if node is None or (node.state in tops and tops[node.state][:2] <= node[:2]):
        return False
    tops[node.state] = node
    return True


def insert(tops: Tops) -> Tops:
    """Tops with those that inserted rows lead to."""
    tops, fresh = dict(tops), list(tops.values())
    while fresh:
        made = [shift(node, initial, INSERT_COST, INSERT) for node in fresh for initial in ROLES]
        fresh = [node for node in made if merge(tops, node)]
    return tops


def advance(tops: Tops, initial: str, fault: int) -> Tops:
    """Tops behind one more row, under all edits."""
    after: Tops = {}
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    for node in insert(tops).values():
        merge(after, node._replace(cost=node.cost + DELETE_COST, audit=node.audit + DELETE))
        if fault in (BLANK, DUPLICATE):
            continue
        merge(after, shift(node, initial, extra, KEEP))
        for other in ROLES:
            merge(after, shift(node, other, REROLE_COST + extra, REROLE))
    return after


@cache
def moves(state: int, initial: str, fault: int) -> list[tuple[int, int, str]]:
    """(state, cost, audit) that one row leads to from a top."""
    after = advance({state: stack(STACKS[state])}, initial, fault)
    return [(to, node.cost, node.audit) for to, node in after.items()]


def parse(start: int, signs: list[tuple[str, int]]) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) of each top that rows lead to from a top."""
    tops = {start: (0, "")}
    for initial, fault in signs:
        after: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in tops.items():
            for to, more, edits in moves(state, initial, fault):
                found = (cost + more, audit + edits)
                if to not in after or found < after[to]:
                    after[to] = found
        tops = after
    return tops


def summary_of(signs: list[tuple[str, int]], turns: list[int | None], border: bool) -> dict:
    """What a segment of a conversation says about the whole. `border`: rows may lie before it."""
    initials = [initial for initial, _ in signs]
    faults = [fault for _, fault in signs]
    known = [turn for turn in turns if turn is not None]
    paths = [
        {"from": start, "to": to, "cost": cost, "audit": audit}
        for start in (range(len(STACKS)) if border else (0,))
        for to, (cost, audit) in parse(start, signs).items()
    ]
    return {
        "first": initials[0],
        "last": initials[-1],
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE),
        "truncated": faults.count(TRUNCATED),
        "low": known[0] if known else None,
        "high": known[-1] if known else None,
        "turns": len(set(known)),
        "paths": paths,
    }


SUMMARY = (
    "first string, last string, illegal bigint, blank bigint, duplicate bigint, truncated bigint, "
    "low bigint, high bigint, turns bigint, paths array<struct<`from`:int,`to`:int,cost:bigint,audit:string>>"
)
RESULT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
)


def arrow_schema(columns: str, spark) -> pa.Schema:
    fields = spark.createDataFrame([], columns).schema.fields
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])


class Whole:
    """A conversation put together from the summaries of its segments, in order.

    Of each top it holds the cost, the place of its audit among the audits of all tops, and the
    audit as a chain of pieces, which the tops share.
    """

    def __init__(self):
        self.tops = {0: (0, 0, None)}
        self.sums = dict.fromkeys(("illegal", "blank", "duplicate", "truncated", "turns"), 0)
        self.last = self.low = self.high = None

    def add(self, part: dict) -> None:
        for name in self.sums:
            self.sums[name] += part[name]
        if self.last is not None:
            self.sums["illegal"] += self.last + part["first"] not in LEGAL
        if part["low"] is not None:
            self.sums["turns"] -= part["low"] == self.high
            self.low = part["low"] if self.low is None else self.low
            self.high = part["high"]
        self.last = part["last"]
        order = {audit: i for i, audit in enumerate(sorted({p["audit"] for p in part["paths"]}))}
        after: dict[int, tuple] = {}
        for path in part["paths"]:
            if path["from"] in self.tops:
                cost, place, chain = self.tops[path["from"]]
                found = (cost + path["cost"], (place, order[path["audit"]]), (chain, path["audit"]))
                if path["to"] not in after or found[:2] < after[path["to"]][:2]:
                    after[path["to"]] = found
        places = {pair: i for i, pair in enumerate(sorted({found[1] for found in after.values()}))}
        self.tops = {to: (cost, places[pair], chain) for to, (cost, pair, chain) in after.items()}

    def result(self) -> dict:
        ends = []
        for state, (cost, place, chain) in self.tops.items():
            tail = insert({state: stack(STACKS[state])})
            ends += [
                (cost + node.cost, place, node.audit, chain) for to, node in tail.items() if to in ACCEPT
            ]
        cost, _, tail, chain = min(ends, key=lambda end: end[:3])
        pieces = [tail]
        while chain is not None:
            chain, piece = chain
            pieces.append(piece)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["turns"]
        del self.sums["turns"]
        return {**self.sums, "gaps": gaps, "cost": cost, "audit": "".join(reversed(pieces))}


def sorted_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(_conv, _turn, _role, _text, _digest); the order of a conversation's rows is that of
    `_turn`, `_role` and `_digest`. Null roles and texts become one space."""
    shown = rows.select(
        F.col(conv).alias("_conv"),
        F.col(turn).cast("bigint").alias("_turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("_text"),
    )
    return shown.withColumn("_digest", F.unhex(F.md5(F.col("_text").cast("binary"))))


def faults(rows: DataFrame) -> DataFrame:
    """(rank, _conv, _turn, initial, fault): all rows in order, without their texts."""
    end = F.substring(F.rtrim("_text", F.lit(SPACE)), -1, 1)
    fault = F.when(end == "", BLANK).when(end.isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    narrow = rows.select("_conv", "_turn", "_role", "_digest", fault.alias("_fault"))
    ranked = with_rank(narrow, "_conv", "_turn", "_role", "_digest")
    first = (
        ranked.groupBy("_conv", "_role", "_digest")
        .agg(F.min("rank").alias("rank"))
        .select("rank", F.lit(True).alias("_first"))
    )
    again = F.col("_first").isNull() & (F.col("_fault") != BLANK)
    return ranked.join(first, "rank", "left").select(
        "rank",
        "_conv",
        "_turn",
        F.substring("_role", 1, 1).alias("initial"),
        F.when(again, DUPLICATE).otherwise(F.col("_fault")).alias("fault"),
    )


def segments(placed: DataFrame, size: int) -> DataFrame:
    """Summaries of the conversations inside each `size` rows in order."""
    conv = ddl(placed, "_conv")
    schema = arrow_schema(f"_conv {conv}, block bigint, {SUMMARY}", placed.sparkSession)

    def summarise(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_pylist() for c in table.column_names}
        order = sorted(range(table.num_rows), key=column["rank"].__getitem__)
        runs = [list(run) for _, run in groupby(order, key=column["_conv"].__getitem__)]
        found = []
        for i, run in enumerate(runs):
            signs = [(column["initial"][at], column["fault"][at]) for at in run]
            part = summary_of(signs, [column["_turn"][at] for at in run], border=i == 0)
            found.append({"_conv": column["_conv"][run[0]], "block": column["block"][0], **part})
        return pa.Table.from_pylist(found, schema)

    blocks = placed.withColumn("block", F.expr(f"rank div {size}"))
    return blocks.groupBy("block").applyInArrow(summarise, f"_conv {conv}, block bigint, {SUMMARY}")


def combine(parts: DataFrame) -> DataFrame:
    """(_conv, and RESULT), one row for each conversation; its summaries go by in order."""
    conv = ddl(parts, "_conv")
    schema = arrow_schema(f"_conv {conv}, {RESULT}", parts.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, current, known = None, None, []
        for batch in batches:
            for part in batch.to_pylist():
                if found is None or part["_conv"] != current:
                    if found is not None:
                        known.append({"_conv": current, **found.result()})
                    found, current = Whole(), part["_conv"]
                found.add(part)
            yield pa.RecordBatch.from_pylist(known, schema)
            known = []
        if found is not None:
            yield pa.RecordBatch.from_pylist([{"_conv": current, **found.result()}], schema)

    ordered = parts.repartition("_conv").sortWithinPartitions("_conv", "block")
    return ordered.mapInArrow(whole, f"_conv {conv}, {RESULT}")


def repair_plan(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    ids: DataFrame | None = None,
    segment: int = SEGMENT,
) -> DataFrame:
    """The cheapest edits of each conversation: (conv, gaps, blank, duplicate, truncated, illegal,
    cost, audit), one row for each conversation of `rows`, or of `ids` (which has `conv`).

    Rows are read in the order of `turn`, nulls first; rows of one turn by role and the digest of
    their text. Null roles and texts are one space; rows without conversation are one.
    A row is blank, or a duplicate (role and text seen earlier), or truncated (doesn't end
    with `.`, `!` or `?`), by the first that holds. Edits: keep a row (0), give it the role user or
    assistant (3), delete it (4; blank rows and duplicates must be), insert a row of either role
    (3); a truncated row that stays adds 3. A role counts by its initial; an empty one has none
    and can't be kept. `audit` spells the cheapest edits by initial, the least in ASCII order of
    equally cheap ones; it settles all roles. `illegal` counts neighbours whose initials aren't
    su, ua or au, `gaps` the turns missing between the least and the largest. Conversations
    without rows have zeros and an empty audit; empty tables give no rows (`ids` if given).
    Other columns are not read.

    1. Rows are ranked without their texts by one range shuffle; the first of equal rows is found
       by a minimum of ranks that is formed before the shuffle.
    2. Every `segment` rows are parsed by one task, so a conversation of any length is spread.
    3. Summaries of a conversation are put together in order.
    """
    placed = faults(sorted_rows(rows, conv, turn, role, text))
    found = combine(segments(placed, segment))
    if ids is not None:
        wanted = ids.select(F.col(conv).alias("_id")).distinct()
        found = wanted.join(found, F.col("_id").eqNullSafe(F.col("_conv")), "left").withColumn("_conv", F.col("_id"))
    zeros = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("_conv").alias(conv), *zeros, F.coalesce("audit", F.lit("")).alias("audit"))


class Replay:
    """Applies an audit to the rows of a conversation, which go by in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.next = audit, 0, "u"

    def _emit(self, role: str, text: str) -> tuple[str, str]:
        self.next = "a" if role[:1] == "u" else "u"
        return role, text

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at += 1
            yield self._emit(ROLES[self.next], "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != DELETE:
            yield self._emit(role if edit == KEEP else ROLES[self.next], text)


def replayed(rows: DataFrame, plan: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows behind the audit of their conversation, in order within partitions."""
    body = sorted_rows(rows, conv, turn, role, text)
    none = {c: F.lit(None).cast(t) for c, t in body.dtypes if c != "_conv"}
    head = plan.select(F.col(conv).alias("_conv"), F.col("audit").alias("_audit")).withColumns(none)
    both = body.withColumn("_audit", F.lit(None).cast("string")).unionByName(head)
    order = ["_conv", F.isnull("_audit"), "_turn", "_role", "_digest"]
    return both.repartition("_conv").sortWithinPartitions(*order).drop("_turn", "_digest")


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, list[tuple[str, str]]]]:
    """(number, conversation, repaired rows) in order; each conversation begins with no rows."""
    number, conv, replay = -1, None, None
    for batch in batches:
        for part in slices(batch, "_text"):
            columns = [part.column(c).to_pylist() for c in ("_conv", "_audit", "_role", "_text")]
            for found, audit, role, text in zip(*columns):
                if audit is None:
                    yield number, conv, list(replay.row(role, text))
                    continue
                if replay is not None:
                    yield number, conv, list(replay.inserted())
                number, conv, replay = number + 1, found, Replay(audit)
                yield number, conv, []
    if replay is not None:
        yield number, conv, list(replay.inserted())


BATCH_CHARS = 1 << 22


def repaired_rows(
    rows: DataFrame, plan: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, turn, role, text): the repaired conversations, turns numbered from 0."""
    key = ddl(rows, conv)
    columns = f"_conv {key}, turn bigint, role string, text string"
    schema = arrow_schema(columns, rows.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, turn, current = [], 0, 0, -1
        for number, found, parts in walk(batches):
            turn, current = (turn, current) if number == current else (0, number)
            for role, text in parts:
                made.append({"_conv": found, "turn": turn, "role": role, "text": text})
                turn, held = turn + 1, held + len(text)
            if held > BATCH_CHARS or len(made) > SEGMENT:
                yield pa.RecordBatch.from_pylist(made, schema)
                made, held = [], 0
        yield pa.RecordBatch.from_pylist(made, schema)

    done = replayed(rows, plan, conv, turn, role, text).mapInArrow(write, columns)
    return done.withColumnRenamed("_conv", conv)


def repaired_digests(
    rows: DataFrame, plan: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, sha256): the digest of each repaired conversation, `role:text` joined by line feeds.

    Texts are hashed as they go by, so no conversation is held.
    """
    columns = f"_conv {ddl(rows, conv)}, sha256 string"
    schema = arrow_schema(columns, rows.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, current, state, conv, empty = [], -1, None, None, True
        for number, found, parts in walk(batches):
            if number != current:
                if state is not None:
                    made.append({"_conv": conv, "sha256": state.hexdigest()})
                current, conv, state, empty = number, found, hashlib.sha256(), True
            for role, text in parts:
                state.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
            if len(made) >= SEGMENT:
                yield pa.RecordBatch.from_pylist(made, schema)
                made = []
        if state is not None:
            made.append({"_conv": conv, "sha256": state.hexdigest()})
        yield pa.RecordBatch.from_pylist(made, schema)

    done = replayed(rows, plan, conv, turn, role, text).mapInArrow(digest, columns)
    return done.withColumnRenamed("_conv", conv)
