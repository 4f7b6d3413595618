"""Line dedup against a plain loop."""

import string

import pytest

from driftpool.llm import line_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    """doc_id, n_lines, n_dropped, kept per row."""
    holder = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for doc_id, text in rows:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                holder[key(line)] = min(doc_id, holder.get(key(line), doc_id))
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(key(x)) < 10 or holder[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    bitmaps = line_dedup.keep_bitmaps(docs)
    report = line_dedup.kept_report(docs, bitmaps).collect()
    want = brute(rows)
    assert sorted((tuple(r) for r in report), key=repr) == want
    cut = line_dedup.kept_lines(docs, bitmaps)
    assert cut.columns == docs.columns
    got = sorted(((r.doc_id, r.text or "") for r in cut.select("doc_id", "text").collect()), key=repr)
    assert got == sorted(((d, t) for d, _, _, t in want), key=repr)


def test_odd_texts(odd_docs):
    check(odd_docs)


def test_given_documents(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_one_line_everywhere_spans_ranges(spark):
    docs = spark.createDataFrame([(i, f"the very common line\nown line number {i}\nTHE very common line ") for i in range(400)], "doc_id long, text string")
    check(docs.repartition(7))
    marks = line_dedup.line_keys(docs).filter("doc_id < 0")
    assert marks.count() == 0


@pytest.mark.parametrize("text", [None, "", "only one line of text"])
def test_single_row(spark, text):
    check(spark.createDataFrame([(1, text)], "doc_id long, text string"))


def test_empty(no_docs):
    assert line_dedup.keep_bitmaps(no_docs).count() == 0
    assert line_dedup.kept_lines(no_docs, line_dedup.keep_bitmaps(no_docs)).count() == 0
