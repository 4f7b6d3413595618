"""Merkle fingerprints and the comparison with the next document."""

import hashlib
import random
from collections import Counter

from driftpool.llm import merkle


def check(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    found = merkle.compare_with_next(docs).collect()
    assert len(found) == len(rows)
    if len({d for d, _ in rows}) == len(rows):
        rows.sort(key=lambda r: -r[0])
        got = {r.doc_id: r for r in found}
        for k, (doc_id, text) in enumerate(rows):
            following, r = rows[(k + 1) % len(rows)][1], got[doc_id]
            n = len(text) // 3
            changed = text[: len(text) - n] + following[:n]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (merkle.fingerprint(text), merkle.fingerprint(changed))
            assert r.near_edited == merkle.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == merkle.likeness(r.fingerprint, merkle.fingerprint(following))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_given_documents(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_odd_texts(odd_docs):
    check(odd_docs)
    check(odd_docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))


def test_one_row_and_none(spark, no_docs):
    check(spark.createDataFrame([(1, "alone")], "doc_id long, text string"))
    assert merkle.compare_with_next(no_docs).count() == 0


def test_edits_are_located():
    text = "\n".join(f"Paragraph {k} of the text. It has two sentences." for k in range(60))
    other = text.replace("Paragraph 31 of", "Section 31 of")
    a, b = merkle.fingerprint(text), merkle.fingerprint(other)
    places = merkle.edits(a, b)
    assert a != b and len(places) <= 8 and merkle.edits(a, a) == []
    section, paragraph = places[0]
    assert a.partition("#")[2].split("|")[section].split(";")[paragraph] == merkle.paragraph(text.split("\n")[31])
    assert 0.95 < merkle.likeness(a, b) < 1 and merkle.likeness(a, merkle.fingerprint("Other words.")) == 0


def test_leaves_are_bounded_and_edits_stay_local():
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9))) for _ in range(400)]
    lines = [
        " ".join(draw.choices(words, k=600)),  # no full stop
        " | ".join(str(draw.randrange(10**6)) for _ in range(400)),
        "".join(chr(0x4E00 + draw.randrange(3000)) + "。" * (k % 12 == 0) for k in range(2_000)),
        "".join(draw.choices("0123456789abcdef", k=3_000)),
        "ab " * 1_000, "=" * 3_000, ". " * 900, "!" * 2_000, " " * 2_000,
    ]
    for line in lines:
        parts = [leaf for s in merkle._SENTENCE.findall(line) for leaf in merkle.leaves(s)]
        assert "".join(parts) == line and max(map(len, parts)) <= merkle.LEAF and len(parts) < len(line) / 8 + 900 * (line == ". " * 900)
        a = merkle.fingerprint(line)
        assert merkle.likeness(a, merkle.fingerprint(merkle.edited(line, "Other text here" * 500))) > 0.6
        half = len(line) // 2
        for changed in (line[:half] + "#" + line[half:], line[:half] + "#" + line[half + 1 :], "#" + line):
            assert 0.85 < merkle.likeness(a, merkle.fingerprint(changed)) < 1
    changed = lines[0][:2000] + "#" + lines[0][2000:]
    places = merkle.edited_leaves(merkle.fingerprint(lines[0]), merkle.fingerprint(changed))
    assert 0 < len(places) < 6 and any(start <= 2000 <= start + n for *_, start, n in places) and all(abs(start - 2000) < 500 for *_, start, n in places)
    assert merkle.edited_leaves(merkle.fingerprint(lines[0]), merkle.fingerprint(lines[0])) == []


def plain_likeness(a, b):
    """By the leaves' own texts, without hashes, sections or fingerprints; an empty paragraph counts as one code point."""
    x, y = (Counter(leaf for line in t.split("\n") for leaf in ([p for s in merkle._SENTENCE.findall(line) for p in merkle.leaves(s)] or [""])) for t in (a, b))
    weigh = lambda c: sum(n * max(1, len(leaf)) for leaf, n in c.items())
    return 2 * weigh(x & y) / (weigh(x) + weigh(y))


def test_likeness_and_roots_by_plain_comparison(spark, sf_dir):
    given = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").orderBy("doc_id").collect()]
    prints = [merkle.fingerprint(t) for t in given]
    assert len(set(prints)) == len({p.partition("#")[0] for p in prints}) == len(set(given))
    for a, b in zip(given, given[1:] + given[:1], strict=True):
        for other in (b, merkle.edited(a, b)):
            assert abs(merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(other)) - plain_likeness(a, other)) < 1e-12


def test_roots_differ_where_short_leaf_hashes_could_meet():
    numbers = [f"Item number {k:07d} is sold out today." for k in range(120_000)]
    shown = Counter(merkle.paragraph(x) for x in numbers)
    roots = {merkle.fingerprint(x).partition("#")[0] for x in numbers}
    assert len(roots) == len(numbers) and len(shown) >= len(numbers) - 20
    moved = ["a. b.\nc", "a.\n b.\nc", "a. b.\n\nc", "a. b.c", "", "\n", "\n\n"]
    assert len({merkle.fingerprint(x).partition("#")[0] for x in moved}) == len(moved)


def test_text_of_some_megabytes():
    draw = random.Random(9)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(3_000)]
    text = " ".join(draw.choices(words, k=600_000))
    other = text[:1_500_000] + "an insertion of some words" + text[1_500_000:]
    assert 0.9999 < merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(other)) < 1
