"""Near-duplicate groups against a comparison of all shingle sets."""

import random

import pytest

from driftpool.llm import jaccard_join, queries


def shingle_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    group, links = list(range(len(rows))), [0] * len(rows)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, _), g in zip(rows, group, strict=True):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    return sorted(((d, least.get(g), n) for (d, _), g, n in zip(rows, group, links, strict=True)), key=repr)


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_groups(docs).collect()), key=repr)
    assert got == brute(rows)


def test_odd_texts(odd_docs):
    check(odd_docs)


def test_copies_with_edits(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)  # so that one group spans several blocks
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(900)}"
    rows = []
    for k in range(8):
        base = [word() for _ in range(rng.choice([6, 40, 200]))]
        for copy in range(70 if k == 0 else rng.randrange(1, 9)):
            words = list(base)
            for _ in range(copy % 3):
                words[rng.randrange(len(words))] = word()
            rows.append((len(rows), " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_one_row_of_each_group_stays(spark, odd_docs):
    docs = spark.createDataFrame([(5, "a b c d e f", 1), (2, "A b c  d e f", 2), (9, "other", 3), (None, "other", 4)], "doc_id long, text string, root int")
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r.root for r in left.collect()) == [2, 3]
    groups = jaccard_join.near_groups(odd_docs)
    assert groups.filter("first").count() >= groups.select("class_id").distinct().count() - 1


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op9_jaccard_join"](spark, sf_dir).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_chain_of_many_nodes(spark):
    names = [f"{k * 7919 % 1000:03d}".encode() for k in range(300)]
    edges = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in zip(names, names[1:])], "a binary, b binary")
    roots = jaccard_join.components(edges).collect()
    assert len(roots) == 300 and len({bytes(r.root) for r in roots}) == 1


def test_depth_and_empty(no_docs):
    assert jaccard_join.prefix_depth(0.8) == 4 and jaccard_join.prefix_depth(0.99) > 4 and jaccard_join.prefix_depth(0.1) == 1
    assert jaccard_join.near_groups(no_docs).count() == 0


@pytest.mark.parametrize("text", [None, "", " \n"])
def test_texts_without_words(spark, text):
    found = jaccard_join.near_groups(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r.first) for r in found) == [(1, 1, 0, True), (2, 2, 0, True)]
