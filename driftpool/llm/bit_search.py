"""Nearest vectors by inner product, found with randomly rotated one-bit codes and reranked exactly.

Every vector is rotated by a fixed random orthogonal matrix and kept as the signs of its coordinates, packed into bits,
with its length and the cosine between it and its signs. From those an inner product is estimated without bias, and
its error is at most ``BOUND`` standard deviations but for rare cases. A vector is reranked on its original numbers if the upper
bound of its estimate reaches the best lower bounds, or the exact scores found so far. Vectors and queries travel as chunks
of fixed size, so memory is bounded; each task returns at most ``k`` rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from driftpool.functions.ranking import top_per_group
from driftpool.llm.common import prepare, written

NEAREST = 20
#: Vectors and queries of a chunk.
CHUNK, QUERY_CHUNK = 4096, 256
#: Chunks of vectors that one chunk of queries meets in one task, about.
MEETINGS = 16
#: Half-width of the error bounds in standard deviations of the estimate.
BOUND = 4.0
CHUNKS = "dims int, ids binary, codes binary, scalars binary, vectors binary"


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    basis, upper = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return (basis * np.sign(np.diag(upper))).astype(np.float32)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors, and length and cosine to the signs of each."""
    size = np.linalg.norm(vectors, axis=1)
    turned = (vectors / size[:, None]).astype(np.float32) @ rotation(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), np.stack([size, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])], axis=1)


def bounds(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries by vectors) and the half-widths of their bounds."""
    dims = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dims).astype(np.float32) * 2 - 1
    turned = queries.astype(np.float32) @ rotation(dims)
    size, cosine = scalars.T
    estimate = (turned @ signs.T) * (size / cosine / np.sqrt(dims)).astype(np.float32)
    spread = size * np.sqrt(np.maximum(0, 1 - cosine**2) / max(1, dims - 1)) / cosine
    return estimate, BOUND * np.linalg.norm(queries, axis=1)[:, None] * spread + 1e-6 * size * np.linalg.norm(queries, axis=1)[:, None]


def usable() -> Column:
    """Vectors that take part: an id, and finite components that are not all zero."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0)


def chunks(vectors: DataFrame, size: int) -> DataFrame:
    """Up to ``size`` usable vectors of one length in each row, with their codes."""

    def emit(dims: int, ids: list, parts: list) -> pa.RecordBatch:
        table = np.concatenate(parts).reshape(-1, dims)
        codes, scalars = encode(table)
        data = [np.concatenate(ids).astype("<i8"), codes, scalars.astype("<f8"), table.astype("<f8")]
        return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in data)], names=["dims", "ids", "codes", "scalars", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            lists, ids = batch.column("embedding"), batch.column("vec_id").to_numpy()
            flat, starts = lists.flatten().to_numpy().astype(np.float64), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            lengths = np.diff(starts)
            for dims in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dims)
                own_ids, own = held.setdefault(dims, ([], []))
                own_ids.append(ids[rows])
                own.append(flat[starts[rows][:, None] + np.arange(dims)].reshape(-1, dims))
                if sum(map(len, own_ids)) >= size:
                    all_ids, every = np.concatenate(own_ids), np.concatenate(own)
                    for at in range(0, len(all_ids) - size + 1, size):
                        yield emit(dims, [all_ids[at : at + size]], [every[at : at + size]])
                    rest = len(all_ids) // size * size
                    held[dims] = [all_ids[rest:]], [every[rest:]]
        for dims, (own_ids, own) in held.items():
            if sum(map(len, own_ids)):
                yield emit(dims, own_ids, own)

    return vectors.filter(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, CHUNKS)


class Best:
    """The nearest vectors found so far for the queries of one chunk."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.scores = [np.zeros(0)] * len(ids)
        self.found = [np.zeros(0, np.int64)] * len(ids)

    def meet(self, ids: np.ndarray, codes: np.ndarray, scalars: np.ndarray, vectors: np.ndarray) -> None:
        estimate, width = bounds(codes, scalars, self.queries)
        lower = estimate - width
        other = ids[None, :] != self.ids[:, None]
        lower[~other] = -np.inf
        least = np.full(len(self.ids), -np.inf)
        if len(ids) >= self.k:
            least = np.partition(lower, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
        exact = np.array([s[self.k - 1] if len(s) >= self.k else -np.inf for s in self.scores])
        chosen = (estimate + width >= np.maximum(least, exact)[:, None]) & other
        for q in range(len(self.ids)):
            rows = np.flatnonzero(chosen[q])
            if len(rows):
                scores = np.r_[self.scores[q], (vectors[rows] * self.queries[q]).sum(axis=1)]
                found = np.r_[self.found[q], ids[rows]]
                order = np.lexsort((found, -scores))[: self.k]
                self.scores[q], self.found[q] = scores[order], found[order]


def _table(row: dict) -> tuple[np.ndarray, ...]:
    dims = row["dims"]
    return (
        np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["codes"], np.uint8).reshape(-1, (dims + 7) // 8),
        np.frombuffer(row["scalars"], "<f8").reshape(-1, 2), np.frombuffer(row["vectors"], "<f8").reshape(-1, dims),
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` nearest vectors of each query.

    Both tables have ``vec_id`` and ``embedding``; rows of the query's own id are no candidates. Score is the inner product
    in double precision, ties go to the smaller ``vec_id``. Rows without an id, with a vector that is null, empty or zero, or
    with a null or non-finite component take no part; vectors of different lengths do not meet; repeated rows count
    each. Fewer candidates than ``k`` give them all. An empty table gives no rows.
    """
    prepare(vectors.sparkSession)
    asked = written(chunks(queries, QUERY_CHUNK).withColumn("part", F.monotonically_increasing_id()), "queries")
    stored = written(chunks(vectors, CHUNK), "codes")
    asked_at = asked.select("part", "dims").groupBy("dims").agg(F.collect_list("part").alias("parts"))  # one number per chunk of queries
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    spans = max(1, -(-stored.count() // MEETINGS))
    met = stored.withColumn("span", F.pmod(F.xxhash64("ids"), F.lit(spans))).join(asked_at, "dims").withColumn("part", F.explode("parts")).drop("parts")
    each = asked.select("part", *names).withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spans - 1).cast("long"))))
    both = met.withColumn("query", F.lit(False)).unionByName(each.withColumn("query", F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: Best | None = None
        for batch in batches:
            for row in batch.to_pylist():
                ids, codes, scalars, table = _table(row)
                if row["query"]:
                    if best is not None:
                        yield from _rows(best)
                    best = Best(ids, table, k)
                else:
                    best.meet(ids, codes, scalars, table)
        if best is not None:
            yield from _rows(best)

    sent = both.repartition("part", "span").sortWithinPartitions("part", "span", F.desc("query"))
    found = sent.mapInArrow(run, "query_id long, vec_id long, score double")
    return top_per_group(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _rows(best: Best) -> Iterator[pa.RecordBatch]:
    counts = np.fromiter(map(len, best.found), np.int64, len(best.found))
    if counts.sum():
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(best.ids, counts)), pa.array(np.concatenate(best.found)), pa.array(np.concatenate(best.scores))], names=["query_id", "vec_id", "score"])
