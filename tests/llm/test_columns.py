"""Columns of the documents whose names an operator could use itself."""

import pytest

from driftpool.functions import staging
from driftpool.llm import common, jaccard_join, language_id, line_dedup, suffix_dedup

NAMES = [
    "doc", "tie", "row", "keep", "bits", "its_row", "own_doc", "own_tie", "gone_doc", "gone_tie", "items", "item", "class", "first", "size", "labels", "class_id", "kept", "key",
    "__doc", "__tie", "__row", "__id", "__hash", "__keep", "__items", "__own_doc", "__own_tie", "_doc", "_row", "DOC_", "with.dot", "of", "part", "n",
]
STAGES = {
    "language": lambda docs: language_id.accepted(docs, language_id.train(docs)),
    "lines": lambda docs: line_dedup.kept_lines(docs, line_dedup.keep_bitmaps(docs)),
    "join": jaccard_join.one_of_each,
    "suffixes": suffix_dedup.without_repeats,
}


@pytest.mark.parametrize("name", STAGES)
def test_clashing_columns_stay(spark, name):
    line = "this line is in several of the documents and long enough to count for every one of the stages, which is why it goes on and on "
    texts = [line * 3 + str(k) + "\n" + f"document {k} has words of its own: " + " ".join(f"w{k}x{j}" for j in range(30)) for k in range(6)]
    rows = [(k, t, "en", *[f"keep me {k}"] * len(NAMES)) for k, t in enumerate([*texts, texts[0], None, ""])]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in NAMES)).repartition(3)
    found = STAGES[name](plain)
    assert found.columns == plain.columns
    got = {r.doc_id: r for r in found.collect()}
    expected = {r.doc_id: r.text for r in STAGES[name](plain.select("doc_id", "text", "lang")).collect()}
    assert {k: r.text for k, r in got.items()} == expected and len(got) > 0
    assert all(value == f"keep me {k}" for k, r in got.items() for value in r[3:])


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "doc int, _DOC int, tie int")
    assert common.unused(df, "doc", "doc", "row") == ["__doc", "___doc", "row"]


def test_written_tables_are_released(spark):
    staging.release(spark)
    table = common.written(spark.range(10), "some")
    path = table.inputFiles()[0].rpartition("/")[0].removeprefix("file:")
    assert staging.release(spark) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)
