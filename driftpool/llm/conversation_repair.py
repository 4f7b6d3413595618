"""Repair of conversation structure by weighted interval parsing of the turns' roles.

A well-formed conversation is nothing, or an optional system turn and then pairs of user and assistant turns. In Chomsky
normal form the repair grammar has one nonterminal per pair of states (p, q) of that form: "takes p to q". Its rules are
(p, q) -> (p, r) (r, q); its terminals are a row kept, given another role, or deleted; and a closure of insertions lies
around every row. A chart cell holds, for every nonterminal, the least cost of a span and its audit. Since the states at
any border of a span are all in the grammar, every split of a span gives the same cell, so the chart needs one split per
span: spans are combined bottom-up by their length, 1, 2, 4 and so on, and a conversation of n rows takes n products.

Of equal costs the ASCII-least audit shall win. An audit that is no prefix of another wins or loses whatever follows, but
a prefix may lose to its own continuation, so cells keep all least audits that are prefixes of each other.

Rows are range-partitioned by conversation and turn. A task parses its stretch of every conversation; only the first and
last of a task may go on elsewhere, and send one cell each. So one very long conversation is parsed by many tasks; only
its SHA-256, which is sequential by definition, streams through one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from driftpool.llm.common import prepare, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
STATES = 4
#: State after a turn of that role: 0 nothing yet, 1 behind the system turn, 2 behind a user's, 3 behind a pair.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The only role that the form allows next, given to rows that change their role and to inserted turns.
WANTED = {0: "user", 1: "user", 2: "assistant", 3: "user"}
ENDS = (0, 3)
_SPACE = " \t\n\x0b\x0c\r"
#: Spans up to this length are looked up when they come again.
REMEMBERED = 8

Entry = tuple[int, tuple[str, ...]] | None
Cell = tuple[Entry, ...]

DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SPANS = f"split boolean, part int, stats string, cell string, {DIGEST}"


def _least(options: Iterable[tuple[int, str]]) -> Entry:
    """The least cost and, of its audits in order, each that continues all before it."""
    options = list(options)
    if not options:
        return None
    cost = min(c for c, _ in options)
    kept: list[str] = []
    for audit in sorted({a for c, a in options if c == cost}):
        if not kept or audit.startswith(kept[-1]):
            kept.append(audit)
    return cost, tuple(kept)


def product(a: Cell, b: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out = []
    for p in range(STATES):
        for q in range(STATES):
            ways = [(x, y) for r in range(STATES) if (x := a[p * STATES + r]) and (y := b[r * STATES + q])]
            least = min((x[0] + y[0] for x, y in ways), default=0)
            out.append(_least((x[0] + y[0], s + t) for x, y in ways if x[0] + y[0] == least for s in x[1] for t in y[1]))
    return tuple(out)


_remembered = lru_cache(1 << 15)(product)


@lru_cache(1)
def insertions() -> Cell:
    """Any number of inserted turns, none included."""
    out = []
    for p in range(STATES):
        best, at, n = {p: (0, "")}, p, 0
        while (at := STEP[at, WANTED[at][0]]) not in best:
            n += 1
            best[at] = (n * INSERT, "I" * n)
        out += [_least([best[q]] if q in best else []) for q in range(STATES)]
    return tuple(out)


@lru_cache(4096)
def terminal(initial: str, bad: bool, truncated: bool) -> Cell:
    """A row behind any number of inserted turns. ``bad`` rows must go."""
    more = TRUNCATED if truncated else 0
    out = []
    for p in range(STATES):
        ways: dict[int, list[tuple[int, str]]] = {p: [(DELETE, "D")]}
        if not bad:
            ways.setdefault(STEP[p, WANTED[p][0]], []).append((REROLE + more, "R"))
            if (p, initial) in STEP:
                ways.setdefault(STEP[p, initial], []).append((KEEP + more, "K"))
        out += [_least(ways.get(q, [])) for q in range(STATES)]
    return product(insertions(), tuple(out))


class Chart:
    """Cells of spans, combined as soon as two neighbours have the same length."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, Cell]] = []

    def add(self, cell: Cell) -> None:
        size = 1
        while self.spans and self.spans[-1][0] == size:
            left = self.spans.pop()[1]
            cell = _remembered(left, cell) if size < REMEMBERED else product(left, cell)
            size *= 2
        self.spans.append((size, cell))

    def whole(self) -> Cell | None:
        cell = None
        for _, left in reversed(self.spans):
            cell = left if cell is None else product(left, cell)
        return cell


def best_repair(cell: Cell | None) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    whole = insertions() if cell is None else product(cell, insertions())
    cost, audits = _least((e[0], a) for q in ENDS if (e := whole[q]) for a in e[1])
    return cost, audits[0]


class Writer:
    """SHA-256 over the repaired rows, given in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.digest, self.first = audit, 0, 0, hashlib.sha256(), True

    def _line(self, role: str, text: str) -> None:
        self.digest.update(f"{role}:{text}".encode() if self.first else f"\n{role}:{text}".encode())
        self.first, self.state = False, STEP[self.state, role[:1]]

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._line(WANTED[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else WANTED[self.state], text)

    def end(self) -> str:
        self._inserted()
        return self.digest.hexdigest()


class Stretch:
    """What a task knows of its rows of one conversation."""

    def __init__(self) -> None:
        self.chart = Chart()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.turn_range: list[int] = []
        self.ends: list[str] = []

    def add(self, turn: int | None, role: str, blank: bool, seen: bool, cut: bool, copies: int) -> None:
        """``copies`` equal rows; ``seen`` if one came before them."""
        if not copies:
            return
        first = role[:1]
        new = int(not blank and not seen)
        self.blank += copies * blank
        self.duplicate += 0 if blank else copies - new
        self.truncated += cut * new
        for k in range(copies):
            good = new and k == 0
            self.chart.add(terminal(first, not good, bool(good and cut)))
        self.illegal += (copies - 1) + int(bool(self.ends) and self.ends[1] + first not in ("su", "ua", "au"))
        self.ends = [self.ends[0] if self.ends else first, first]
        if turn is not None:
            self.turns += not self.turn_range or turn != self.turn_range[1]
            self.turn_range = [self.turn_range[0] if self.turn_range else turn, turn]

    def after(self, other: dict) -> None:
        """Add what a later stretch found."""
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + other[name])
        if other["ends"]:
            self.illegal += int(bool(self.ends) and self.ends[1] + other["ends"][0] not in ("su", "ua", "au"))
            self.ends = [self.ends[0] if self.ends else other["ends"][0], other["ends"][1]]
        if other["turn_range"]:
            self.turns -= bool(self.turn_range) and self.turn_range[1] == other["turn_range"][0]
            self.turn_range = [self.turn_range[0] if self.turn_range else other["turn_range"][0], other["turn_range"][1]]

    def stats(self) -> str:
        return json.dumps({n: getattr(self, n) for n in ("blank", "duplicate", "truncated", "illegal", "turns", "turn_range", "ends")})

    def counts(self) -> list[int]:
        gaps = self.turn_range[1] - self.turn_range[0] + 1 - self.turns if self.turn_range else 0
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


def _packed(cell: Cell | None) -> str:
    return json.dumps(cell)


def _unpacked(text: str) -> Cell | None:
    found = json.loads(text)
    return None if found is None else tuple(e and (e[0], tuple(e[1])) for e in found)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range: the digest of every conversation inside, and the first's and last's cells."""
    part = TaskContext.get().partitionId()
    now: object = _parse  # no id equals it
    stretch, rows, number, out = Stretch(), [], 0, []

    def split() -> tuple:
        return (True, part, stretch.stats(), _packed(stretch.chart.whole()), now, *[None] * 8)

    def whole() -> tuple:
        cost, audit = best_repair(stretch.chart.whole())
        writer = Writer(audit)
        for role, text, copies in rows:
            for _ in range(copies):
                writer.row(role, text)
        return (False, None, None, None, now, *stretch.counts(), cost, audit, writer.end())

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "blank", "seen", "cut", "copies"))
        for conv_id, turn, role, text, blank, seen, cut, copies in zip(*columns, strict=True):
            if now is _parse or conv_id != now:
                if now is not _parse:
                    out.append(split() if number == 1 else whole())
                now, stretch, rows, number = conv_id, Stretch(), [], number + 1
            stretch.add(turn, role, blank, seen, cut, copies)
            if number > 1:
                rows.append((role, text, copies))
        if out:
            yield _batch(out, SPANS)
            out = []
    if now is not _parse:
        yield _batch([split()], SPANS)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of conversations in stretches, sorted by conversation and part: their digests without the SHA-256."""
    now: object = _joined
    stretch, cells = Stretch(), []

    def digest() -> pa.RecordBatch:
        chart = None
        for cell in cells:
            chart = cell if chart is None else product(chart, cell)
        return _batch([(now, *stretch.counts(), *best_repair(chart), None)], DIGEST)

    for batch in batches:
        for conv_id, stats, cell in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "stats", "cell")), strict=True):
            if now is _joined or conv_id != now:
                if now is not _joined:
                    yield digest()
                now, stretch, cells = conv_id, Stretch(), []
            stretch.after(json.loads(stats))
            if (found := _unpacked(cell)) is not None:
                cells.append(found)
    if now is not _joined:
        yield digest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations, each after its audit: their SHA-256. Holds one row at a time."""
    now: object = _hashed
    writer = Writer("")
    for batch in batches:
        for conv_id, turned, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "is_row", "role", "text", "copies")), strict=True):
            if not turned:
                if now is not _hashed:
                    yield _batch([(now, writer.end())], "conv_id long, repaired_sha256 string")
                now, writer = conv_id, Writer(text)
                continue
            for _ in range(copies):
                writer.row(role, text)
    if now is not _hashed:
        yield _batch([(now, writer.end())], "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``copies`` of the rows after damage; dropped rows have no copies.

    Nulls in any column are read as one space, also in the number that chooses the damage.
    """
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", blank)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _trimmed() -> Column:
    return F.rtrim(F.col("text"), F.lit(_SPACE))


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation: counts of faults, the least cost, its audit and the SHA-256 of the repaired rows.

    ``rows``: ``conv_id`` and ``turn`` long, ``role`` and ``text`` (no nulls), ``copies`` of the row. Rows are ordered by
    turn (nulls first), role and text, so ties have one order and equal rows lie together. A null ``conv_id`` is one
    conversation. A conversation without copies has zeros, an empty audit and the hash of nothing. Empty in, empty out.
    """
    prepare(rows.sparkSession)
    same = ["conv_id", "turn", "role", "text"]
    each = rows.groupBy(*same).agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    name = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"))
    each = written(each.withColumn("name", name), "turns")
    # Only texts that come at several turns need their first; those are few, and Catalyst knows the table's size.
    again = each.filter("copies > 0").groupBy("name").agg(F.min(place).alias("first"), F.count("*").alias("turns")).filter("turns > 1")
    again = written(again.select("name", "first"), "said-again")
    cut = ~F.right(_trimmed(), F.lit(1)).isin(".", "!", "?")
    judged = each.join(again, "name", "left").select(
        *same, "copies", (_trimmed() == "").alias("blank"), F.coalesce(F.col("first") < place, F.lit(False)).alias("seen"), cut.alias("cut"),
    )
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role").asc()]
    ranged = judged.repartitionByRange(*order, F.substring("text", 1, 64).asc()).sortWithinPartitions(*order, "text")
    found = written(ranged.mapInArrow(_parse, SPANS), "conversation-spans", ["split"])
    names = [c.split()[0] for c in DIGEST.split(", ")]
    done = found.filter("NOT split").select(*names)
    spans = found.filter("split").select("conv_id", "part", "stats", "cell")
    joined = spans.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part").mapInArrow(_joined, DIGEST)
    joined = written(joined, "joined-conversations")
    chosen = joined.select(F.col("conv_id").alias("chosen"))
    texts = each.join(chosen, F.col("conv_id").eqNullSafe(F.col("chosen"))).select("conv_id", F.lit(True).alias("is_row"), *same[1:], "copies")
    audits = joined.select("conv_id", F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"))
    order = [F.asc_nulls_first("conv_id"), "is_row", F.asc_nulls_first("turn"), "role", "text"]
    hashed = audits.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    hashed = hashed.withColumnRenamed("conv_id", "chosen")
    split = joined.drop("repaired_sha256").join(hashed, F.col("conv_id").eqNullSafe(F.col("chosen"))).select(*names)
    return done.unionByName(split)
