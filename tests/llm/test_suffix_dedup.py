"""Repeated windows against a plain search over all windows."""

import hashlib
import random
from collections import Counter

import pytest

from driftpool.llm import queries, suffix_dedup


def brute(rows, threshold):
    texts = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    seen = Counter(t[i : i + threshold] for _, t in texts for i in range(len(t) - threshold + 1))
    out = []
    for doc_id, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - threshold + 1):
            if seen[t[i : i + threshold]] > 1:
                gone[i : i + threshold] = [True] * threshold
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def check(docs, threshold):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, threshold).collect()), key=repr)
    assert got == brute(rows, threshold)


def test_odd_texts(odd_docs):
    check(odd_docs, 16)


@pytest.mark.parametrize("threshold", [24, 200])
def test_cut_and_pasted_texts(spark, threshold):
    rng = random.Random(threshold)
    parts = ["".join(rng.choice("ab é\n") for _ in range(rng.randrange(1, 3 * threshold))) for _ in range(25)] + ["xy" * threshold, "z" * 2 * threshold]
    rows = [(i, "".join(x[rng.randrange(len(x)) :] for x in rng.choices(parts, k=rng.randrange(1, 6)))) for i in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), threshold)


def test_segments_meet(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(5000))
    check(spark.createDataFrame([(1, long), (2, long[100:4500] + "!"), (3, long[2000:2199])], "doc_id long, text string"), 200)


def test_text_is_cut_at_characters(spark):
    shared = "é" * 30 + "".join(map(chr, range(0x4E00, 0x4E80)))
    docs = spark.createDataFrame([(1, "à" + shared, "k", 1), (2, "b" + shared + "日", "l", 2), (3, None, "m", 3)], "doc_id long, text string, item string, core int")
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns
    assert {r.doc_id: (r.text, r.item) for r in left.collect()} == {1: ("à", "k"), 2: ("b日", "l"), 3: (None, "m")}


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = [(d, n, m, s, hashlib.sha256(k).hexdigest()) for d, n, m, s, k in brute([(r.doc_id, r.text) for r in docs.collect()], 200)]
    got = [tuple(r) for r in queries.QUERIES["op1_suffix_dedup"](spark, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(no_docs, 8)
