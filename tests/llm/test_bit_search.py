"""One-bit search against all inner products."""

import numpy as np
import pytest

from driftpool.llm import bit_search, queries


def brute(rows, wanted, k=20):
    fit = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q, a in fit:
        if wanted(q):
            scored = sorted((-float((a * b).sum()), i) for i, b in fit if i != q and len(a) == len(b))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def compare(found, want, recall):
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)
    assert len(got) == len(want)
    hits = {(q, i) for q, _, i, _ in want} & {(q, i) for q, _, i, _ in got}
    assert len(hits) >= recall * len(want)
    return got


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = compare(queries.QUERIES["op8_bit_search"](spark, sf_dir).collect(), want := brute(rows, lambda i: i % 20 == 0), 0.99)
    score = {(q, i): s for q, _, i, s in want}
    assert all(abs(score[q, i] - s) < 1e-12 for q, _, i, s in got if (q, i) in score)


@pytest.mark.parametrize("size", [2, 7, 100_000])
def test_odd_vectors_and_ties(spark, monkeypatch, size):
    monkeypatch.setattr(bit_search, "CHUNK", size)
    monkeypatch.setattr(bit_search, "MEETINGS", 2)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 5)]) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 0.0, -1.0, 2.0]) for i in range(30)] + [(200, None), (201, []), (202, [0.0] * 5), (203, [1.0, None, 1.0, 1.0, 1.0]), (204, [float("nan")] * 5)]
    rows += [(205, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 5), (206, [1.0, 2.0]), (208, [3.0, 2.0]), (210, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = bit_search.nearest(table, table.filter("vec_id % 2 = 0"))
    assert compare(found.collect(), want := brute(rows, lambda i: i % 2 == 0), 1) == want


def test_empty(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert bit_search.nearest(table, table).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert bit_search.nearest(one, one).count() == 0
