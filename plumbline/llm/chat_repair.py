"""Repair of conversation structure at the least cost, by bidirectional Dijkstra over an edit lattice.

A conversation reads ``system? (user assistant)+`` or is empty. A node of its lattice is (rows consumed, what was
written last); an edge keeps, reroles or deletes the next row or inserts an empty turn. A forward heap from the
start and a reverse heap from the accepted ends meet; all crossings of equal cost are finished, and the least
concatenated audit (the initials of the edits) wins.

No task holds a conversation. Rows are range-sorted by conversation and turn and cut into segments of at most
``SEGMENT_ROWS``. A segment that is a whole conversation is searched once. Any other is searched from each of the four
states to each of the four, and the small tables of a conversation's segments are chained, again by cost and
then audit; the chosen end states go back to the segments, which write their turns.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

SEGMENT_ROWS = 512
SEGMENT_CHARS = 4_000_000
RANGE_CHARS = 64
SPACES = "\x20\t\n\x0b\x0c\r"
MOST = (1 << 63) - 1

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3

# What was written last: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (START, ASSISTANT)
NEXT_TURN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
BY_INITIAL = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
LEGAL_NEIGHBOURS = {"su", "ua", "au"}
UNREACHED = (float("inf"), "")

_SEGMENTS = (
    "conv string, part int, segment bigint, whole boolean, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, opens string, closes string, low bigint, high bigint, turns bigint, "
    "costs array<bigint>, audits array<string>, roles array<string>, texts array<string>, copies array<bigint>"
)
_CHAINED = (
    "conv string, part int, segment bigint, entry int, exit int, position bigint, closing boolean, gaps bigint, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
)
_REPAIRED = "conv string, part int, segment bigint, whole boolean, position bigint, edits string, roles array<string>, texts array<string>"


@dataclass(frozen=True)
class Step:
    """One row of the lattice, or a run of rows that have to go."""

    initial: str
    forced: int = 0
    truncated: bool = False


@cache
def _edges(step: Step) -> tuple[tuple[tuple[int, int, int, str], ...], ...]:
    """(from, to, cost, edits) of every way over a step, once by source and once by target state."""
    if step.forced:
        ways = [(s, s, DELETE_COST * step.forced, DELETE * step.forced) for s in STATES]
    else:
        more = TRUNCATED_COST if step.truncated else 0
        ways = [(s, s, DELETE_COST, DELETE) for s in STATES]
        ways += [(s, t, more, KEEP) for s, t in BY_INITIAL.get(step.initial, {}).items()]
        ways += [(s, t, REROLE_COST + more, REROLE) for s, t in NEXT_TURN.items()]
    return (
        tuple(tuple(w for w in ways if w[0] == s) for s in STATES),
        tuple(tuple(w for w in ways if w[1] == s) for s in STATES),
    )


def _forward(steps: list[Step], at: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    yield at, NEXT_TURN[state], INSERT_COST, INSERT
    if at < len(steps):
        for _, to, cost, edits in _edges(steps[at])[0][state]:
            yield at + 1, to, cost, edits


def _reverse(steps: list[Step], at: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    for source, to in NEXT_TURN.items():
        if to == state:
            yield at, source, INSERT_COST, INSERT
    if at:
        for source, _, cost, edits in _edges(steps[at - 1])[1][state]:
            yield at - 1, source, cost, edits


def cheapest(steps: list[Step], entry: int, exits: tuple[int, ...]) -> tuple[float, str]:
    """Least (cost, audit) from state ``entry`` before the steps to one of ``exits`` after them.

    Labels are (cost, audit). Heaps go by cost, then along the direction of travel, so that steps without cost
    are taken in order and an audit is final when its node is settled. The search ends when no unsettled
    pair can be as cheap as the best path; every path of that cost then has an edge from a node settled forwards
    to one settled in reverse, or is settled whole by one side.
    """
    end = len(steps)
    ahead, behind = {(0, entry): (0, "")}, {(end, x): (0, "") for x in exits}
    ahead_heap = [(0, 0, entry)]
    behind_heap = [(0, -end, x) for x in exits]
    heapq.heapify(behind_heap)
    settled_ahead: set[tuple[int, int]] = set()
    settled_behind: set[tuple[int, int]] = set()
    best = UNREACHED[0]
    while ahead_heap and behind_heap and ahead_heap[0][0] + behind_heap[0][0] <= best:
        forwards = (ahead_heap[0][0], len(settled_ahead)) <= (behind_heap[0][0], len(settled_behind))
        heap, labels, settled, other = (
            (ahead_heap, ahead, settled_ahead, behind) if forwards else (behind_heap, behind, settled_behind, ahead)
        )
        cost, at, state = heapq.heappop(heap)
        at = abs(at)
        if (at, state) in settled:
            continue
        settled.add((at, state))
        audit = labels[at, state][1]
        if (at, state) in other:
            best = min(best, cost + other[at, state][0])
        for to_at, to, more, edits in (_forward if forwards else _reverse)(steps, at, state):
            label = (cost + more, audit + edits if forwards else edits + audit)
            known = labels.get((to_at, to))
            if known is None or label < known:
                labels[to_at, to] = label
                if known is None or label[0] < known[0]:
                    heapq.heappush(heap, (label[0], to_at if forwards else -to_at, to))
    crossings = [ahead[end, x] for x in exits if (end, x) in settled_ahead]
    if (0, entry) in settled_behind:
        crossings.append(behind[0, entry])
    for at, state in settled_ahead:
        cost, audit = ahead[at, state]
        for to_at, to, more, edits in _forward(steps, at, state):
            if (to_at, to) in settled_behind:
                rest = behind[to_at, to]
                if cost + more + rest[0] == best:
                    crossings.append((best, audit + edits + rest[1]))
    return min(crossings, default=UNREACHED)


class _Segment:
    """Rows of one conversation, in order, until a border is reached."""

    def __init__(self, conv: str, opens_conversation: bool) -> None:
        self.conv, self.first = conv, opens_conversation
        self.steps: list[Step] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.copies: list[int] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.chars = 0
        self.opens = self.closes = None
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, copies: int, repeated: bool) -> None:
        initial = role[:1]
        said = text.rstrip(SPACES)
        if not said:
            self.blank += copies
            self.steps.append(Step("", copies))
        elif repeated:
            self.duplicate += copies
            self.steps.append(Step("", copies))
        else:
            cut = said[-1] not in ".!?"
            self.truncated += cut
            self.duplicate += copies - 1
            self.steps.append(Step(initial if initial in BY_INITIAL else "", 0, cut))
            if copies > 1:
                self.steps.append(Step("", copies - 1))
        if self.roles:
            self.illegal += self.closes + initial not in LEGAL_NEIGHBOURS
        else:
            self.opens = initial
        self.illegal += copies - 1
        self.closes = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(copies)
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.roles) >= SEGMENT_ROWS or self.chars >= SEGMENT_CHARS

    def row(self, part: int, number: int, last: bool) -> tuple:
        whole = self.first and last
        entries = (START,) if self.first else STATES
        if whole:
            table = {(START, 0): cheapest(self.steps, START, ENDS)}
        else:
            table = {(s, t): cheapest(self.steps, s, (t,)) for s in entries for t in STATES}
        costs, audits = [], []
        for s in STATES:
            for t in STATES:
                cost, audit = table.get((s, t), UNREACHED)
                found = cost != UNREACHED[0]
                costs.append(cost if found else None)
                audits.append(audit if found else None)
        return (
            self.conv, part, number, whole, self.blank, self.duplicate, self.truncated, self.illegal, self.opens, self.closes,
            self.low, self.high, self.turns, costs, audits, self.roles, self.texts, self.copies,
        )


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most 1,024 rows, or fewer when their texts are long."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row[weight])) if weight is not None else 0
        if len(held) >= 1024 or size >= SEGMENT_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            yield from zip(*[c.to_pylist() for c in batch.slice(lo, 512).columns], strict=True)


def _cut(schema: pa.Schema):
    """Sorted rows to segments; a conversation's first and last segment are known by its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def segments() -> Iterator[tuple]:
            held, before, number = None, None, 0
            for conv, turn, role, text, copies, repeated in _rows(batches):
                if held is not None and (held.conv != conv or held.full()):
                    yield held.row(part, number, held.conv != conv)
                    before, held, number = held.conv, None, number + 1
                if held is None:
                    held = _Segment(conv, before is not None and before != conv)
                held.add(turn, role, text, copies, repeated)
            if held is not None:
                yield held.row(part, number, False)

        yield from _batches(segments(), schema, weight=16)

    return run


class _Chain:
    """The segments of one conversation, met in order.

    Holds per state the least audit beyond what all states share, and per segment where each state came
    from: a few bytes a segment.
    """

    def __init__(self, conv: str) -> None:
        self.conv = conv
        self.reached: dict[int, tuple[int, str]] = {START: (0, "")}
        self.shared: list[str] = []
        self.places: list[tuple[int, int]] = []
        self.came: list[dict[int, tuple[int, int]]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.closes = self.low = self.high = None

    def add(self, part, segment, blank, duplicate, truncated, illegal, opens, closes, low, high, turns, costs, audits) -> None:
        self.places.append((part, segment))
        after, came = {}, {}
        for s, (cost, audit) in self.reached.items():
            for t in STATES:
                if costs[4 * s + t] is not None:
                    label = (cost + costs[4 * s + t], audit + audits[4 * s + t])
                    if t not in after or label < after[t]:
                        after[t] = label
                        edits = audits[4 * s + t]
                        came[t] = (s, len(edits) - edits.count(DELETE))
        common = os.path.commonprefix([audit for _, audit in after.values()])
        self.shared.append(common)
        self.reached = {t: (cost, audit[len(common) :]) for t, (cost, audit) in after.items()}
        self.came.append(came)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.illegal += illegal
        if self.closes is not None:
            self.illegal += self.closes + opens not in LEGAL_NEIGHBOURS
        self.closes = closes
        if low is not None:
            self.turns += turns - (self.high is not None and self.high == low)
            self.low = low if self.low is None else self.low
            self.high = high

    def rows(self) -> Iterator[tuple]:
        """Per segment its end states and the place of its first turn; last the conversation's own row."""
        (cost, tail), state = min((self.reached[t], t) for t in ENDS if t in self.reached)
        path = []
        for came in reversed(self.came):
            source, written = came[state]
            path.append((source, state, written))
            state = source
        place, none = 0, (None,) * 7
        for (part, segment), (source, target, written) in zip(self.places, reversed(path), strict=True):
            yield (self.conv, part, segment, source, target, place, False, *none)
            place += written
        gaps = 0 if self.low is None else min(MOST, self.high - self.low + 1 - self.turns)
        yield (
            self.conv, None, None, None, None, place, True,
            gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join([*self.shared, tail]),
        )


def _chain(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chained() -> Iterator[tuple]:
            held = None
            for conv, whole, *segment in _rows(batches):
                if whole:  # the accepted ends were searched together
                    segment[-2], segment[-1] = list(segment[-2]), list(segment[-1])
                    segment[-2][ASSISTANT], segment[-1][ASSISTANT] = segment[-2][START], segment[-1][START]
                    segment[-2][START] = None
                if held is None or held.conv != conv:
                    if held is not None:
                        yield from held.rows()
                    held = _Chain(conv)
                held.add(*segment)
            if held is not None:
                yield from held.rows()

        yield from _batches(chained(), schema)

    return run


def _written(state: int, audit: str, roles: list[str], texts: list[str], copies: list[int]) -> tuple[str, list[str], list[str]]:
    """The turns that an audit writes, entered in ``state``, with their edits."""
    edits, out_roles, out_texts = [], [], []
    row, left = 0, copies[0] if copies else 0
    for edit in audit:
        role, text = None, ""
        if edit != INSERT:
            while left == 0:
                row += 1
                left = copies[row]
            left -= 1
            role, text = roles[row], texts[row]
        if edit == DELETE:
            continue
        if edit == KEEP:
            state = BY_INITIAL[role[:1]][state]
        else:
            state = NEXT_TURN[state]
            role = "user" if state == USER else "assistant"
        edits.append(edit)
        out_roles.append(role)
        out_texts.append(text)
    return "".join(edits), out_roles, out_texts


def _write(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written() -> Iterator[tuple]:
            for conv, part, segment, whole, entry, position, audit, roles, texts, copies in _rows(batches):
                edits, out_roles, out_texts = _written(entry, audit, roles, texts, copies)
                yield conv, part, segment, whole, position, edits, out_roles, out_texts

        yield from _batches(written(), schema, weight=7)

    return run


@dataclass(frozen=True)
class Repaired:
    """``report``: a row per conversation. ``segments``: its repaired turns in runs. ``turns()``: a row per turn."""

    report: DataFrame
    segments: DataFrame

    def turns(self) -> DataFrame:
        """``conv``, ``position`` (from 0), ``edit`` (K, R or I), ``role``, ``text``."""
        lined = F.transform(
            F.arrays_zip("roles", "texts"),
            lambda t, i: F.struct(
                (F.col("position") + i).alias("position"),
                F.substring("edits", i + 1, F.lit(1)).alias("edit"),
                t["roles"].alias("role"),
                t["texts"].alias("text"),
            ),
        )
        return self.segments.select("conv", F.inline(lined))

    def digests(self) -> DataFrame:
        """``conv`` and ``sha256`` of its repaired turns as ``role:text``, joined by line feeds.

        A conversation in one segment is digested in place; one in several is read once, in order, by a running digest
        that holds one segment.
        """
        lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit(":"), t["texts"])), "\n")
        joined = self.segments.select("conv", "part", "segment", "whole", F.size("roles").alias("n"), lines.alias("lines"))
        schema = _arrow("conv string, sha256 string")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def digested() -> Iterator[tuple]:
                conv, running, started = None, None, False
                for name, n, text in _rows(batches):
                    if running is None or name != conv:
                        if running is not None:
                            yield conv, running.hexdigest()
                        conv, running, started = name, hashlib.sha256(), False
                    if n:
                        running.update((b"\n" if started else b"") + text.encode())
                        started = True
                if running is not None:
                    yield conv, running.hexdigest()

            yield from _batches(digested(), schema)

        several = joined.where("not whole").repartition("conv").sortWithinPartitions("conv", "part", "segment")
        return (
            joined.where("whole")
            .select("conv", F.sha2("lines", 256).alias("sha256"))
            .unionByName(several.select("conv", "n", "lines").mapInArrow(run, "conv string, sha256 string"))
        )


def conversation_key(conv: Column) -> Column:
    """A conversation's name as text; null is a conversation of its own."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair(
    messages: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    copies: Column | None = None,
) -> Repaired:
    """Least-cost repairs of all conversations in ``messages`` (a row per message; other columns are ignored).

    ``copies`` is how often a row stands for itself, 1 by default; rows with less than 1 are none. Rows are ordered by turn
    (null first, read as a whole number), then role, then text; null roles and texts read as empty. A row's first fault counts: *blank* (only
    white space), *duplicate* (role and text seen earlier), *truncated* (the last letter is none of ``.!?``). Blank and
    duplicate rows have to go. Deleting costs 4, inserting an empty user or assistant turn 3, giving a row another role 3, and a
    truncated row that stays 3 more. Of equal costs the least audit wins, as text.

    ``report`` has ``conv`` (see :func:`conversation_key`), ``gaps`` (turn numbers missing between the least and the largest),
    ``blank``, ``duplicate``, ``truncated``, ``illegal`` (neighbours whose role initials are none of su, ua, au), ``cost`` and
    ``audit``. A conversation without rows has no row here; an empty table gives empty results.
    """
    rows = messages.select(
        conversation_key(F.col(conv)).alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        (F.lit(1) if copies is None else copies).cast("bigint").alias("copies"),
    ).where("copies > 0")
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    when = F.struct(F.col("turn").isNotNull(), "turn")
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.select("*", said.alias("said"), when.alias("when"))
    repeats = (
        rows.groupBy("conv", "said")
        .agg(F.min("when").alias("first"), F.count_if(F.col("copies") > 0).alias("times"))
        .where("times > 1")
        .drop("times")
    )
    marked = rows.join(repeats, ["conv", "said"], "left").select(
        "conv", "turn", "role", "text", "copies", F.coalesce(F.col("first") < F.col("when"), F.lit(False)).alias("repeated")
    )
    ordered = marked.repartitionByRange(
        "conv", "turn", F.substring("role", 1, RANGE_CHARS), F.substring("text", 1, RANGE_CHARS)
    ).sortWithinPartitions("conv", "turn", "role", "text")
    segments = stored(ordered.mapInArrow(_cut(_arrow(_SEGMENTS)), _SEGMENTS), "chat-segments")
    summary = segments.drop("roles", "texts", "copies").repartition("conv").sortWithinPartitions("conv", "part", "segment")
    narrow = [c for c in summary.columns if c not in ("conv", "whole")]
    chained = stored(
        summary.select("conv", "whole", *narrow).mapInArrow(_chain(_arrow(_CHAINED)), _CHAINED), "chat-chains"
    )
    report = chained.where("closing").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    taken = ["conv", "part", "segment", "whole", "entry", "position", "audit", "roles", "texts", "copies"]
    alone = segments.where("whole").select("*", F.lit(START).alias("entry"), F.lit(0).cast("bigint").alias("position"))
    linked = segments.where("not whole").join(
        chained.where("not closing").select("part", "segment", "entry", "exit", "position"), ["part", "segment"]
    )
    parts = alone.withColumn("audit", F.col("audits")[0]).select(*taken).unionByName(
        linked.withColumn("audit", F.get("audits", F.col("entry") * 4 + F.col("exit"))).select(*taken)
    )
    return Repaired(report, parts.mapInArrow(_write(_arrow(_REPAIRED)), _REPAIRED))
