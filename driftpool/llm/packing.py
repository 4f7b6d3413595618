"""Bounded-space online packing of token sequences into windows of fixed length.

Each partition keeps a fixed number of open windows. A piece goes where it fits best; when it fits nowhere, its head
fills the fullest window, which is emitted, and its tail goes on. At the end a partition merges its open windows, and
what is left (less than one window per partition) is laid end to end over all partitions and cut once more.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from driftpool.llm.common import prepare, texts, written
from driftpool.llm.word_tokens import encoder, with_end

OPEN_WINDOWS = 64
#: Sequence ids of merged leftovers have this bit.
MERGED = 1 << 62
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, leftover boolean"
#: Rows that the packer hands on at once.
ROWS = 512


class Packer:
    """Open windows of one partition; ``put`` and ``close`` yield pieces with their sequence and offset."""

    def __init__(self, size: int, windows: int, first_id: int) -> None:
        self.size, self.windows, self.next_id = size, windows, first_id
        self.free: list[tuple[int, int]] = []  # (room, number of the window), sorted
        self.held: dict[int, list] = {}
        self.numbers = 0

    def _emit(self, pieces: list, leftover: bool = False) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, data, total in pieces:
            yield doc_id, start, len(data) // 4, total, self.next_id, offset, data, leftover
            offset += len(data) // 4
        self.next_id += 1

    def put(self, doc_id: int | None, data: bytes) -> Iterator[tuple]:
        total, start = len(data) // 4, 0
        while total - start >= self.size:
            yield from self._emit([(doc_id, start, data[start * 4 : (start + self.size) * 4], total)])
            start += self.size
        while start < total:
            left = total - start
            at = bisect_left(self.free, (left, -1))
            if at == len(self.free) and len(self.free) < self.windows:
                self.numbers += 1
                self.held[self.numbers] = []
                self.free.append((self.size, self.numbers))
            elif at == len(self.free):
                at, left = 0, self.free[0][0]
            room, number = self.free.pop(at)
            self.held[number].append((doc_id, start, data[start * 4 : (start + left) * 4], total))
            start += left
            if room > left:
                insort(self.free, (room - left, number))
            else:
                yield from self._emit(self.held.pop(number))

    def close(self) -> Iterator[tuple]:
        """Open windows end to end, the fullest first; less than a window stays, marked as left over."""
        row, filled = [], 0
        for _, number in self.free:
            for doc_id, start, data, total in self.held[number]:
                while data:
                    taken = min(len(data) // 4, self.size - filled)
                    row.append((doc_id, start, data[: taken * 4], total))
                    data, start, filled = data[taken * 4 :], start + taken, filled + taken
                    if filled == self.size:
                        yield from self._emit(row)
                        row, filled = [], 0
        if row:
            yield from self._emit(row, leftover=True)


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of all whole texts: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``
    (little-endian unsigned 32-bit).

    Every sequence but one is full. Null or empty texts are the end id alone, a null ``doc_id`` is carried, repeated
    rows are packed each, an empty table gives no rows.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = encoder(tokenizer), Packer(size, windows, TaskContext.get().partitionId() << 32)

        def pieces() -> Iterator[tuple]:
            for batch in batches:
                ids, bounds = with_end(*words.encode(batch.column("text")), end_id)
                data, at = ids.astype("<u4").tobytes(), (bounds * 4).tolist()
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                    yield from packer.put(doc_id, data[a:b])
            yield from packer.close()

        rows = []
        for piece in pieces():
            rows.append(piece)
            if len(rows) == ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    placed = written(texts(docs).mapInArrow(run, PIECES), "packed", ["leftover"])
    kept = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    done, rest = placed.filter("NOT leftover").select(*kept), placed.filter("leftover")
    totals = rest.groupBy("sequence_id").agg(F.sum("length").alias("_n"))  # one row per partition at most
    before = Window.orderBy("sequence_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    laid = rest.join(totals, "sequence_id").withColumn("_from", F.col("_base") + F.col("offset")).withColumn("_to", F.col("_from") + F.col("length"))
    cut = laid.withColumn("_w", F.explode(F.expr(f"sequence(_from div {size}, (_to - 1) div {size})")))
    head, tail = F.greatest(F.col("_from"), F.col("_w") * size), F.least(F.col("_to"), (F.col("_w") + 1) * size)
    cut = cut.withColumn("_head", head).withColumn("_length", tail - head)
    merged = cut.select(
        "doc_id", (F.col("start") + F.col("_head") - F.col("_from")).alias("start"), F.col("_length").alias("length"), "doc_tokens",
        (F.col("_w") + F.lit(MERGED)).alias("sequence_id"), (F.col("_head") - F.col("_w") * size).alias("offset"),
        F.substring("ids", ((F.col("_head") - F.col("_from")) * 4 + 1).cast("int"), (F.col("_length") * 4).cast("int")).alias("ids"),
    )
    return done.unionByName(merged)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    long, kinds = pa.int64(), {"ids": pa.binary(), "leftover": pa.bool_()}
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, long)) for n, v in zip(names, zip(*rows, strict=True), strict=True)], names=names)
