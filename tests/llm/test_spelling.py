"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from oracle import compare, connection

from driftpool.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def counted(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def brute(words):
    out = {}
    for w, n in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        out[w] = [w, form, None, n, len(around), words.get(form)]
    for row in out.values():
        at = row
        while at[1] is not None:
            at = out[at[1]]
        row[2] = at[0]
    return sorted(map(tuple, out.values()))


def got(docs, most=spelling.MOST):
    found = spelling.variants(docs, most=most).select("word", "form", "root", "n", "n_near", "form_n")
    return sorted(map(tuple, found.collect()))


@pytest.fixture
def noisy(spark):
    """Few stems with many edits, so that words share halves, runs of one letter, ties, and chains of forms."""
    rng = random.Random(5)
    letters = "abé"
    words = []
    for stem, n in (("aaaaaaaa", 1500), ("abababab", 1200), ("abcdefghij", 500), ("éàüöçñ", 300), ("chemins", 400)):
        for _ in range(n):
            w = list(stem)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w[i : i + rng.choice([0, 1])] = rng.choice([[], [rng.choice(letters)], [rng.choice(letters)] * 2])
            words.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
    words += ["planted"] * 700 + ["plantet"] * 120 + ["plantett"] * 22 + ["plantettt"] * 5
    rng.shuffle(words)
    rows = [(k, " ".join(words[k * 20 : k * 20 + 20])) for k in range(len(words) // 20 + 1)]
    rows += [(None, "planted " * 6), (3, rows[3][1]), (900, None), (901, ""), (902, "12 ... 34"), (903, "planted-plantet_planted\u0100planted")]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n long").repartition(3)


@pytest.mark.parametrize("most", [spelling.MOST, 3, 1])
def test_variants(noisy, most):
    rows = [(r.doc_id, r.text) for r in noisy.collect()]
    expected = brute(counted(rows))
    assert len(expected) > 30 and any(r[1] and r[2] != r[1] for r in expected)
    assert got(noisy, most) == expected


def test_odd_texts(odd_docs):
    assert got(odd_docs) == brute(counted([(r.doc_id, r.text) for r in odd_docs.collect()]))


def test_near_pairs_are_all_and_once():
    rng = random.Random(1)
    for _ in range(200):
        k = rng.randint(1, 6)
        words = {"".join(rng.choice("abc") for _ in range(rng.choice([k, k + 1]))) for _ in range(rng.randint(1, 50))}
        k = min(map(len, words))
        words = {w for w in words if len(w) <= k + 1}
        pairs = list(spelling.near_pairs(list(words)))
        expected = {(u, v) for u in words for v in words if u != v and len(u) == k and near(u, v) and (len(v) > k or u < v)}
        assert len(pairs) == len(set(pairs)) and set(pairs) == expected


def test_acceptor_is_minimal():
    nodes = []
    spelling.acceptor(sorted(["tapped", "topped", "tapping", "topping"]), nodes, {})
    assert len(nodes) == 9  # start, t, one behind a and o, p, one before e and i, d, n, g, end


def test_a_very_long_word(spark):
    long = "ab" * 20_000
    docs = spark.createDataFrame([(k, f"{long} {long[:-1]}c {long}") for k in range(3)], "doc_id long, text string")
    words = counted([(r.doc_id, r.text) for r in docs.collect()])
    assert [(r[0], r[4]) for r in got(docs)] == [(w, 0) for w in sorted(words)]


def test_empty(no_docs, spark):
    assert got(no_docs) == [] and got(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")) == []


def test_query(spark, sf_dir):
    name = "op11_spelling_variants"
    assert compare(queries.QUERIES[name](spark, sf_dir), queries.SQL[name], connection(sf_dir)) is None
