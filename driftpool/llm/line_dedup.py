"""Line dedup over all documents: every key's first document keeps its lines, later documents lose them.

Keys are range-partitioned by (hash, document) and sorted, so that even one very common key is dealt over many tasks.
A task streams its rows and marks those whose key was first seen in another document. Only the rows of a task's first
key that share its first document depend on earlier tasks; they are settled with one row per task edge. The answer
for a document is a compressed bitmap of the lines to keep.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from driftpool.llm.common import prepare, texts, unused, whole_text, written

SPACE = b" \t\n\x0b\x0c\r"
MIN_POINTS = 10
KEYS = "h1 long, h2 long, doc_id long, row long, lines binary"
MARKS = "kind string, h1 long, h2 long, doc_id long, row long, lines binary"


def line_keys(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """One row per document and key: 128-bit hash of the key and the numbers of its lines (unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owners, rows, lines = [], [], [], []
            for doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                found: dict[bytes, list[int]] = {}
                for k, line in enumerate(text.encode().split(b"\n")):
                    key = line.strip(SPACE).lower()
                    if len(key) >= min_points and (key.isascii() or len(key.decode(errors="replace")) >= min_points):
                        found.setdefault(xxhash.xxh3_128_digest(key), []).append(k)
                hashes += found
                owners += [doc_id] * len(found)
                rows += [row] * len(found)
                lines += [np.array(x, "<u4").tobytes() for x in found.values()]
            pair = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[:, 0].astype(np.int64)), pa.array(pair[:, 1].astype(np.int64)), pa.array(owners, pa.int64()), pa.array(rows, pa.int64()), pa.array(lines, pa.binary())],
                names=["h1", "h2", "doc_id", "row", "lines"],
            )

    known = texts(docs).filter("doc_id IS NOT NULL").withColumn("row", F.xxhash64("text"))
    return known.mapInArrow(run, KEYS)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range: dropped rows, rows that hang on earlier ranges, and the range's first and last key."""
    first = last = None  # (h1, h2, first document)
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        if last is not None and last[:2] == (h1[0], h2[0]):
            new[0] = False
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        holder = np.where(at >= 0, doc[np.maximum(at, 0)], last[2] if last else 0)
        first = first or (int(h1[0]), int(h2[0]), int(doc[0]))
        last = (int(h1[-1]), int(h2[-1]), int(holder[-1]))
        opens = (h1 == first[0]) & (h2 == first[1]) & (doc == first[2])
        marks = np.where(opens, "open", np.where(doc != holder, "drop", ""))
        chosen = pa.array(np.flatnonzero(marks != ""))
        table = batch.take(chosen)
        yield pa.RecordBatch.from_arrays([pa.array(marks[marks != ""].tolist(), pa.string()), *table.columns], names=["kind", *table.schema.names])
    if first is not None:
        edges = list(dict.fromkeys((first, last)))
        columns = [["edge"] * len(edges), *(list(c) for c in zip(*edges, strict=True)), [None] * len(edges), [None] * len(edges)]
        kinds = [pa.string(), *[pa.int64()] * 4, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "h1", "h2", "doc_id", "row", "lines"])


def keep_bitmaps(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Documents that lose lines: ``doc_id``, ``row`` (hash of the text, apart for rows that share an id), ``n_dropped``
    and ``keep``, the zlib-compressed bits (1: stays) of all lines in order.

    Null and empty texts are one empty line. Rows that share an id are one document. Rows without an id hold no key and
    lose nothing. Documents that lose nothing have no row.
    """
    prepare(docs.sparkSession)
    keys = written(line_keys(docs, min_points), "line-keys")
    order = ["h1", "h2", "doc_id", "row"]
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    marks = written(ranged.mapInArrow(_stream, MARKS), "line-marks", ["kind"])
    holders = marks.filter("kind = 'edge'").groupBy("h1", "h2").agg(F.min("doc_id").alias("holder"))
    late = marks.filter("kind = 'open'").join(holders, ["h1", "h2"]).filter("doc_id > holder")
    dropped = marks.filter("kind = 'drop'").select("doc_id", "row", "lines").unionByName(late.select("doc_id", "row", "lines"))
    per_row = dropped.groupBy("doc_id", "row").agg(F.collect_list("lines").alias("lines"))  # bounded by the text's own lines
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    counts = counts.select("doc_id", F.xxhash64("text").alias("row"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines"))
    sized = counts.groupBy("doc_id", "row").agg(F.max("n_lines").alias("n_lines")).join(per_row, ["doc_id", "row"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keeps = [], []
            for n, parts in zip(batch.column("n_lines").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                keep = np.ones(n, bool)
                keep[np.frombuffer(b"".join(parts), "<u4")] = False
                counts.append(n - int(keep.sum()))
                keeps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(counts, pa.int64()), pa.array(keeps, pa.binary())], names=["doc_id", "row", "n_dropped", "keep"])

    return sized.mapInArrow(bits, "doc_id long, row long, n_dropped long, keep binary")


def kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut to the lines that stay (null stays null when nothing is cut); other columns as they are.

    A document that loses all its lines stays, with an empty text.
    """
    row, doc, its_row, bits = unused(docs, "row", "doc", "its_row", "bits")
    marked = docs.withColumn(row, F.xxhash64(whole_text()))
    keep = bitmaps.select(F.col("doc_id").alias(doc), F.col("row").alias(its_row), F.col("keep").alias(bits))
    joined = marked.join(keep, (F.col("doc_id") == F.col(doc)) & (F.col(row) == F.col(its_row)), "left")

    @F.pandas_udf("string")
    def cut(text, keep):
        return text.combine(keep, _cut)

    return joined.withColumn("text", F.when(F.col(bits).isNull(), F.col("text")).otherwise(cut(F.col("text"), F.col(bits)))).drop(row, doc, its_row, bits)


def _cut(text: str | None, keep: bytes | None) -> str | None:
    if keep is None or text is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(line for line, bit in zip(lines, bits, strict=True) if bit)


def kept_report(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_lines``, ``n_dropped``, ``kept`` (the remaining text)."""
    base = texts(docs).withColumn("__row", F.xxhash64("text"))
    keep = bitmaps.select(F.col("doc_id").alias("__id"), F.col("row").alias("__hash"), "n_dropped", F.col("keep").alias("__keep"))
    joined = base.join(keep, (F.col("doc_id") == F.col("__id")) & (F.col("__row") == F.col("__hash")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_cut(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column("__keep").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_lines"), batch.column("n_dropped"), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    plain = joined.select("doc_id", n_lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "text", "__keep")
    return plain.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")
