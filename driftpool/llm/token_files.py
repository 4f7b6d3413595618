"""Token ids in files of length-delimited records with masked checksums, and an offset index beside each file.

A record is: length of the body (8 bytes), masked checksum of those 8 bytes (4), body, masked checksum of the body
(4); all numbers little-endian. A checksum is CRC-32, turned right by 15 bits and raised by a constant, so that a
checksum stored inside checked data does no harm. A body is: 1 if the record has an id, else 0 (1 byte), doc_id (8),
ids (2 bytes each if the vocabulary allows, else 4). The index of a file holds each record's offset and the file's
size (8 bytes each), so a reader can take records in any order.

A task writes files under names of its own and reports them in the manifest; files of a lost attempt are in no manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from driftpool.llm.common import in_order, prepare, table_path, written
from driftpool.llm.word_tokens import encoder, with_end

MASK = 0xA282EAD8
#: Bytes of one file that a reader holds at a time.
READ_BYTES = 4 << 20
MANIFEST = "part int, file string, width int, records long, tokens long, bytes long"
RECORDS = "doc_id long, start long, ids binary"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    length = struct.pack("<Q", len(body))
    return b"".join((length, struct.pack("<I", masked(length)), body, struct.pack("<I", masked(body))))


def unframe(data: memoryview) -> bytes:
    """The body of one record; an error if a checksum does not fit."""
    length, check = struct.unpack_from("<QI", data)
    body = bytes(data[12 : 12 + length])
    if check != masked(bytes(data[:8])) or struct.unpack_from("<I", data, 12 + length)[0] != masked(body):
        raise ValueError("a record's checksum does not fit")
    return body


def write_records(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the ids of whole texts, ``end_id`` after each, in ascending ``doc_id`` order; returns the manifest.

    ``path`` is a folder that all executors reach through ``pyarrow.fs`` (default: one in the shared folder). Null
    texts are empty, rows without an id come first, repeated rows each get a record, an empty table no files.
    """
    spark = prepare(docs.sparkSession)
    folder = path or table_path(spark, "records")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name = TaskContext.get().partitionId(), f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        words, offsets, tokens, at, out = encoder(tokenizer), [], 0, 0, None
        width = 2 if max(len(words.ends) - 1, end_id) < 1 << 16 else 4
        store, place = pafs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        place = f"{place}/{name.rpartition('/')[2]}"
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or store.open_output_stream(f"{place}.records")
            ids, bounds = with_end(*words.encode(batch.column("text")), end_id)
            data, sizes = ids.astype(f"<u{width}").tobytes(), bounds * width
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), sizes[:-1].tolist(), sizes[1:].tolist(), strict=True):
                record = frame(struct.pack("<Bq", doc_id is not None, doc_id or 0) + data[a:b])
                offsets.append(at)
                at += len(record)
                out.write(record)
            tokens += len(ids)
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{place}.index") as index:
            index.write(np.array([*offsets, at], "<u8").tobytes())
        row = [part], [name], [width], [len(offsets)], [tokens], [at]
        kinds = pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "file", "width", "records", "tokens", "bytes"])

    return written(in_order(docs).mapInArrow(write, MANIFEST), "manifest")


def read_records(manifest: DataFrame, seed: int | None = None) -> DataFrame:
    """Records of all files of a manifest: ``doc_id``, ``start`` (ids in the files before it) and ``ids``
    (little-endian unsigned 32-bit). With ``seed``, each file is read in a shuffled order through its index."""
    spark = prepare(manifest.sparkSession)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    spread = files.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_file(row, seed)

    return spread.mapInArrow(read, RECORDS)


def _read_file(row: dict, seed: int | None) -> Iterator[pa.RecordBatch]:
    store, place = pafs.FileSystem.from_uri(row["file"])
    with store.open_input_stream(f"{place}.index") as stream:
        offsets = np.frombuffer(stream.read(), "<u8").astype(np.int64)
    width, sizes = row["width"], np.diff(offsets)
    counts = (sizes - 25) // width  # without 16 bytes of frame and 9 of the body's head
    starts = row["base"] + np.cumsum(counts) - counts
    with store.open_input_file(f"{place}.records") as file:
        if seed is None:  # runs of records of about READ_BYTES
            groups = np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(offsets[:-1] // READ_BYTES)) + 1)
        else:
            order = np.random.default_rng([seed, row["part"]]).permutation(len(sizes))
            groups = np.split(order, range(1, len(order)))
        for group in groups:
            first, last = int(group[0]), int(group[-1])
            data = memoryview(file.read_at(int(offsets[last + 1] - offsets[first]), int(offsets[first])))
            doc_ids, bodies = [], []
            for k in group:
                body = unframe(data[offsets[k] - offsets[first] : offsets[k + 1] - offsets[first]])
                known, doc_id = struct.unpack_from("<Bq", body)
                doc_ids.append(doc_id if known else None)
                bodies.append(np.frombuffer(body, f"<u{width}", offset=9).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(starts[group], pa.int64()), pa.array(bodies, pa.binary())], names=["doc_id", "start", "ids"]
            )
