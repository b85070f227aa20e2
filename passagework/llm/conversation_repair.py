"""Repair of damaged conversations by depth-first branch and bound.

Rows are first damaged by a fixed rule (``damaged``), then each conversation is made legal by the cheapest edits:
keep a row (0), give it the role that is due (3), delete it (4; blank and repeated rows must go), insert an empty
turn of the role that is due (3); a truncated row that is not deleted costs 3 more. Role initials must come out as
``(s?(ua)+)?``. Of equally cheap edits the audit (their initials in order) that is least in ASCII wins.

``search`` walks rows with an explicit stack. Each node is (row, state of the grammar); a backward pass gives every
node a lower bound of what its suffix costs; the incumbent is the best (cost, audit) of a complete walk; a table for
each node keeps the best prefix that reached it, and worse ones are dropped. It ends when the stack is empty, so
the incumbent is proved best.

Scale: rows are range-partitioned by conversation and order and sorted there; conversations that lie whole inside
a partition and hold at most ``HELD_ROWS`` rows are repaired in one pass. All others (two at the edges of each
partition, and long ones, however many rows they have) are cut into segments of at most ``2**SEGMENT_BITS`` rows.
A segment is searched for each pair of states at its ends; then only 16 costs and ranks of a segment are chained
for each conversation, and the audits chosen go back to the rows. Repeated rows of long conversations are found by
a grouping that Spark pre-aggregates. Last, rows pass once, in order, through a running SHA-256, which a digest of
the whole conversation cannot avoid; that pass holds one row and the audit.

Defined cases: nulls count as one space, also in the string whose checksum picks the damage; a null conv_id is a
conversation; rows of one turn are ordered by role, then text (32 characters of each, then by a hash);
repeated rows are repeats like others; a role is known by its first character only, and an empty role or one of
another initial cannot be kept; conversations without rows after the damage have zeros, an empty audit and the
digest of nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from passagework.session import written

#: The damage by remainder of the checksum, white space, costs.
DROP, EMPTY, UNSTOP, REPEAT, RENAME, KINDS = 0, 1, 2, 3, 4, 20
WHITE, STOPS = " \t\n\x0b\x0c\r", ".!?"
DELETE, REROLE, INSERT, UNFINISHED = 4, 3, 3, 3

HELD_ROWS, HELD_CHARS = 2048, 32_000_000
SEGMENT_BITS = 10
NEVER = 10**9
BLANK, DUPLICATE, TRUNCATED, SOUND, DROPPED = "b", "d", "t", ".", "x"

#: States of the grammar: nothing yet, after s, after u, after a (a full pair).
START, SYSTEM, USER, PAIR = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIR, (PAIR, "u"): USER}
DUE = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", PAIR), PAIR: ("user", USER)}
#: Turns inserted after the last row, by state.
TAIL = {START: "", SYSTEM: "II", USER: "I", PAIR: ""}

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def flaw(text: Column) -> Column:
    """The fault that a text has by itself."""
    body = F.rtrim(text, F.lit(WHITE))
    return F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(*STOPS), SOUND).otherwise(TRUNCATED)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, flaw``; rows that the damage drops stay as marks, so no conversation is lost."""
    c = conversations
    name = F.concat_ws(":", *(F.coalesce(c[x].cast("string"), F.lit(" ")) for x in ("conv_id", "turn")))
    kind = F.crc32(name.cast("binary")) % KINDS
    role, text = (F.coalesce(c[x], F.lit(" ")) for x in ("role", "text"))
    text = F.when(kind.isin(EMPTY, DROP), "").when(kind == UNSTOP, F.translate(text, STOPS, "")).otherwise(text)
    rows = c.select(
        c["conv_id"], c["turn"], F.when(kind == RENAME, "user").when(kind == DROP, "").otherwise(role).alias("role"), text.alias("text"),
        (kind == DROP).alias("gone"), F.explode(F.when(kind == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.select("conv_id", "turn", "role", "text", F.when(F.col("gone"), DROPPED).otherwise(flaw(F.col("text"))).alias("flaw"))


def moves(state: int, fault: str, initial: str) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of one row, by edit."""
    yield "D", DELETE, state
    if fault not in (BLANK, DUPLICATE):
        more = UNFINISHED if fault == TRUNCATED else 0
        if (kept := STEPS.get((state, initial))) is not None:
            yield "K", more, kept
        yield "R", REROLE + more, DUE[state][1]


def bounds(faults: str, initials: Sequence[str], ends: Sequence[int]) -> list[list[int]]:
    """For each row and state, the least that the rest can cost, whatever its audit."""
    after = list(ends)
    out = [after]
    for fault, initial in zip(reversed(faults), reversed(initials)):
        now = [min(cost + after[to] for _, cost, to in moves(q, fault, initial)) for q in range(4)]
        for q in (USER, PAIR, USER, START, SYSTEM):
            now[q] = min(now[q], INSERT + now[DUE[q][1]])
        out.append(now)
        after = now
    return out[::-1]


def spelled(walk: tuple | None) -> str:
    out = []
    while walk is not None:
        out.append(walk[0])
        walk = walk[1]
    return "".join(reversed(out))


def search(faults: str, initials: Sequence[str], start: int = START, ends: Sequence[int] | None = None) -> tuple[int, str] | None:
    """Least (cost, audit) from ``start``. ``ends`` prices the states after the last row; without it the whole
    conversation ends here, with its last insertions. None: no walk reaches a priced state."""
    whole = ends is None
    ends = [INSERT * len(TAIL[q]) for q in range(4)] if whole else ends
    least = bounds(faults, initials, ends)
    best: tuple[int, str] | None = None
    reached: list[dict[int, tuple[int, tuple | None]]] = [{} for _ in range(len(faults) + 1)]
    stack: list[tuple[int, int, int, tuple | None]] = [(0, start, 0, None)]
    while stack:
        at, state, cost, walk = stack.pop()
        bound = cost + least[at][state]
        if bound >= NEVER or (best is not None and bound > best[0]):
            continue
        if best is not None and bound == best[0]:
            prefix = spelled(walk)
            if prefix > best[1][: len(prefix)]:
                continue
        known = reached[at].get(state)
        if known is not None and (known[0] < cost or (known[0] == cost and spelled(known[1]) <= spelled(walk))):
            continue
        reached[at][state] = (cost, walk)
        if at == len(faults):
            found = (bound, spelled(walk) + (TAIL[state] if whole else ""))
            best = found if best is None else min(best, found)
            continue
        then = [(cost + INSERT + least[at][DUE[state][1]], "I", at, DUE[state][1], cost + INSERT)]
        for edit, price, to in moves(state, faults[at], initials[at]):
            then.append((cost + price + least[at + 1][to], edit, at + 1, to, cost + price))
        for _, edit, row, to, price in sorted(then, reverse=True):  # the most promising one comes off the stack first
            stack.append((row, to, price, (edit, walk)))
    return best


@dataclass
class Tally:
    """Counts, audit and running digest of one conversation, fed row by row."""

    low: int | None = None
    high: int | None = None
    turns: int = 0
    counts: dict[str, int] = field(default_factory=lambda: {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, SOUND: 0})
    illegal: int = 0
    initial: str | None = None
    cost: int = 0
    audit: list[str] = field(default_factory=list)
    state: int = START
    lines: int = 0

    def __post_init__(self) -> None:
        self.digest = hashlib.sha256()

    def line(self, role: str, text: str, state: int) -> None:
        self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines, self.state = self.lines + 1, state

    def add(self, turn: int | None, role: str, text: str, fault: str, edits: str) -> None:
        self.counts[fault] += 1
        if turn is not None and turn != self.high:  # turns come in order
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        self.audit.append(edits)
        for edit in edits:
            if edit == "D":
                self.cost += DELETE
                continue
            due, state = DUE[self.state]
            if edit == "I":
                self.cost += INSERT
                self.line(due, "", state)
            else:
                self.cost += (REROLE if edit == "R" else 0) + (UNFINISHED if fault == TRUNCATED else 0)
                self.line(*((due, text, state) if edit == "R" else (role, text, STEPS[self.state, role[:1]])))

    def row(self) -> dict:
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return {
            "gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[TRUNCATED], "illegal": self.illegal,
            "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest(),
        }


def edits_of(audit: str) -> list[str]:
    """The audit cut after each row; the last part has the insertions at the end."""
    out, held = [], ""
    for edit in audit:
        held += edit
        if edit != "I":
            out.append(held)
            held = ""
    if out:
        out[-1] += held
    return out


def repaired(rows: Iterable[tuple]) -> dict:
    """One whole conversation of (turn, role, text, flaw)."""
    seen, live = set(), []
    for turn, role, text, fault in rows:
        if fault == DROPPED:
            continue
        if (role, text) in seen and fault != BLANK:
            fault = DUPLICATE
        seen.add((role, text))
        live.append((turn, role, text, fault))
    tally = Tally()
    if live:
        audit = search("".join(r[3] for r in live), [r[1][:1] for r in live])[1]
        for row, edits in zip(live, edits_of(audit), strict=True):
            tally.add(*row, edits)
    return tally.row()


def _each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _first_pass(kind: pa.Schema):
    """Repairs conversations that lie whole inside the partition; returns the rows of all others with their place."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        size, seq, first = 0, 0, True
        held: list[tuple] | None = []  # None: the conversation at hand is too long to be held
        of: object = None

        def stored(rows: list[tuple]) -> None:
            nonlocal seq
            for turn, role, text, fault in rows:
                out.append({"conv_id": of, "done": None, "row": {"pos": (part << 33) | seq, "turn": turn, "role": role, "text": text, "flaw": fault}})
                seq += 1

        def close(last: bool) -> None:
            nonlocal first
            if held and (first or last):
                stored(held)
            elif held:
                out.append({"conv_id": of, "done": repaired(held), "row": None})
            first = False

        begun = False
        for conv, *row in _each_row(batches):
            if begun and conv != of:
                close(last=False)
                held, size = [], 0
            of, begun = conv, True
            if held is None:
                stored([tuple(row)])
            else:
                held.append(tuple(row))
                size += len(row[2])
                if len(held) > HELD_ROWS or size > HELD_CHARS:
                    stored(held)
                    held = None
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, kind)
                out.clear()
        if begun:
            close(last=True)
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    return each


def _segment(table: pa.Table) -> pa.Table:
    """Costs, ranks and audits from each state to each state, as lists of 16, of one run of rows."""
    conv = table.column("conv_id").slice(0, 1)
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("pos", "initial", "fault"))))
    faults, initials = "".join(r[2] for r in rows), [r[1] for r in rows]
    costs, ranks, audits = [], [], []
    for start in range(4):
        found = [search(faults, initials, start, [0 if q == end else NEVER for q in range(4)]) for end in range(4)]
        order = sorted({f[1] for f in found if f})
        costs += [f[0] if f else NEVER for f in found]
        ranks += [order.index(f[1]) if f else 4 for f in found]
        audits += [f[1] if f else None for f in found]
    lists = {"places": [[r[0] for r in rows]], "costs": [costs], "ranks": [ranks], "audits": [audits]}
    kinds = {"places": pa.int64(), "costs": pa.int64(), "ranks": pa.int32(), "audits": pa.string()}
    return pa.table({"conv_id": conv, "start": pa.array([rows[0][0]], pa.int64()), **{k: pa.array(v, pa.list_(kinds[k])) for k, v in lists.items()}})


def _chain(table: pa.Table) -> pa.Table:
    """For the segments of one conversation: which of the 16 walks is taken, and the insertions after the last."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("start", "costs", "ranks"))))
    after = [INSERT * len(TAIL[q]) for q in range(4)]
    rest = [after]
    for _, costs, _ in reversed(rows):
        after = [min(costs[4 * q + e] + after[e] for e in range(4)) for q in range(4)]
        rest.append(after)
    rest.reverse()
    state, picks = START, []
    for k, (_, costs, ranks) in enumerate(rows):
        # no audit of a segment begins another one that is as cheap in the end: both end with an edit of the last row
        end = min((e for e in range(4) if costs[4 * state + e] + rest[k + 1][e] == rest[k][state]), key=lambda e: ranks[4 * state + e])
        picks.append(4 * state + end)
        state = end
    tails = [""] * (len(rows) - 1) + [TAIL[state]]
    return pa.table({"start": pa.array([r[0] for r in rows], pa.int64()), "pick": pa.array(picks, pa.int32()), "tail": pa.array(tails)})


def _last_pass(kind: pa.Schema):
    """Rows of whole conversations in order, with their edits, to results."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, rows in groupby(_each_row(batches), key=lambda r: r[0]):
            tally = Tally()
            for _, turn, role, text, fault, edits in rows:
                if fault != DROPPED:
                    tally.add(turn, role, text, fault, edits)
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, **tally.row()}], kind)

    return each


def repair(conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation."""
    conv = T.StructField("conv_id", conversations.schema["conv_id"].dataType)
    turn = T.StructField("turn", conversations.schema["turn"].dataType)
    result = T.StructType([conv, *T.StructType.fromDDL(RESULT)])
    row = T.StructType([T.StructField("pos", T.LongType()), turn, *T.StructType.fromDDL("role string, text string, flaw string")])
    passed = T.StructType([conv, T.StructField("done", T.StructType.fromDDL(RESULT)), T.StructField("row", row)])

    rows = damaged(conversations).withColumns({"n": F.monotonically_increasing_id(), "h": F.xxhash64("role", "text"), "r": F.substring("role", 1, 32), "t": F.substring("text", 1, 32)})
    dealt = rows.repartitionByRange("conv_id", "turn", "r", "t", "h", "n").sortWithinPartitions("conv_id", "turn", "r", "t", "h", "role", "text", "n")
    first = written(dealt.select("conv_id", "turn", "role", "text", "flaw").mapInArrow(_first_pass(to_arrow_schema(passed)), passed), "repair-first")
    done = first.where("done is not null").select("conv_id", "done.*")
    return done.unionAll(_long(first.where("row is not null").select("conv_id", "row.*"), conv, result))


def _long(rows: DataFrame, conv: T.StructField, result: T.StructType) -> DataFrame:
    """The same for conversations that reach over partitions or are too long to be held."""
    live = rows.where(F.col("flaw") != DROPPED)
    fresh = live.groupBy("conv_id", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("fresh"))
    fault = F.when(F.col("flaw").isin(BLANK, DROPPED) | F.col("fresh").isNotNull(), F.col("flaw")).otherwise(DUPLICATE)
    told = written(rows.join(fresh, "pos", "left").select("conv_id", "pos", "turn", "role", "text", fault.alias("fault")), "repair-rows")

    segment = T.StructType([conv, *T.StructType.fromDDL("start long, places array<long>, costs array<long>, ranks array<int>, audits array<string>")])
    narrow = told.where(F.col("fault") != DROPPED).select("conv_id", "pos", F.substring("role", 1, 1).alias("initial"), "fault")
    segments = written(narrow.groupBy("conv_id", F.shiftright("pos", SEGMENT_BITS)).applyInArrow(_segment, segment), "repair-segments")
    picks = segments.select("conv_id", "start", "costs", "ranks").groupBy("conv_id").applyInArrow(_chain, "start long, pick int, tail string")
    audit = F.concat(F.element_at("audits", F.col("pick") + 1), F.col("tail"))
    parts = F.regexp_extract_all(audit, F.lit("I*[DKR](?:I*$)?"), F.lit(0))
    edits = segments.join(picks, "start").select(F.inline(F.arrays_zip(F.col("places").alias("pos"), parts.alias("edits"))))
    whole = told.join(edits, "pos", "left").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return whole.select("conv_id", "turn", "role", "text", "fault", "edits").mapInArrow(_last_pass(to_arrow_schema(result)), result)
