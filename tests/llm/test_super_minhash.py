"""Near-duplicate components against a comparison of all shingle sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, connection

from driftpool.llm import queries, super_minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3)) if len(words) >= 4 else frozenset([tuple(words)] if words else [])


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and group[i] != group[j] and 100 * len(a & b) >= 80 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, _), g in zip(rows, group, strict=True):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    return sorted(((d, len(s), least.get(g), d is not None and d == least.get(g)) for (d, _), g, s in zip(rows, group, sets, strict=True)), key=repr)


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = super_minhash.near_groups(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == brute(rows)
    return got


def test_odd_texts(odd_docs):
    check(odd_docs)


@pytest.mark.parametrize("block", [256, 8])
def test_copies_with_edits(spark, monkeypatch, block):
    monkeypatch.setattr(super_minhash, "BLOCK", block)  # so that one group spans several blocks
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(900)}"
    rows = []
    for k in range(10):
        base = [word() for _ in range(rng.choice([6, 40, 120]) if k else 60)]
        for copy in range(160 if k == 0 else rng.randrange(1, 12)):
            words = list(base)
            for _ in range(copy % 6):
                words[rng.randrange(len(words))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, class string, kept boolean").repartition(5)
    got = check(docs)
    assert len({r[2] for r in got}) < len(got)


def test_links_that_only_later_blocks_see(spark, monkeypatch):
    """A chain in which neighbours link and all share bands with a centre that links to few."""
    monkeypatch.setattr(super_minhash, "BLOCK", 4)
    words = [f"t{i}" for i in range(400)]
    rows = [(k, " ".join(words[k * 3 : k * 3 + 100])) for k in range(60)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r[2] for r in got} == {0}


def test_registers_agree_like_sets():
    rng = np.random.default_rng(5)
    for size, shared in ((40, 30), (3000, 2400), (20_000, 10_000)):
        errors = []
        for _ in range(12):
            pool = np.unique(rng.integers(0, 1 << 63, 2 * size - shared, dtype=np.uint64))
            a, b = np.sort(pool[:size]), np.sort(pool[-size:])
            one, two = super_minhash.signatures([a, b], 128)
            errors.append((one == two).mean() - shared / (2 * size - shared))
            assert np.isfinite(one).all() and (np.sort(np.floor(one)) <= np.arange(128)).all()
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.045


def test_a_signature_is_of_the_set_alone():
    """Rounds of other sets in the batch and the cut into chunks change nothing."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 5, 20_000, 300, 8191, 2)]
    together = super_minhash.signatures(sets, 128)
    for k, s in enumerate(sets):
        assert (super_minhash.signatures([s], 128)[0] == together[k]).all()


def test_common_counts():
    one, others = np.array([2, 5, 9], np.uint64), [np.array([1, 5], np.uint64), np.array([9, 10], np.uint64), np.array([11], np.uint64)]
    assert super_minhash.common(one, others).tolist() == [1, 1, 0]


def test_shingles_keep_white_space_apart():
    a, b, c = super_minhash.shingles(pa.array(["A b\tc  d \n", "a b c d", "a b\u00a0c d"]))
    assert a.tolist() == b.tolist() != c.tolist()


def test_long_text_and_no_words(spark, no_docs):
    long = " ".join(f"word{k}" for k in range(300_000))
    check(spark.createDataFrame([(1, long), (2, long + " tail"), (3, " \n"), (4, None), (5, None)], "doc_id long, text string"))
    assert super_minhash.near_groups(no_docs).count() == 0


def test_query(spark, sf_dir):
    name = "op13_super_minhash"
    assert compare(queries.QUERIES[name](spark, sf_dir), queries.SQL[name], connection(sf_dir)) is None
