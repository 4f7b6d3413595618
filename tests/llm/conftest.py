import pytest

#: Texts on which an encoder or a splitter can go wrong.
ODD = [
    None, "", " ", "\n", "\n\n", "a", "A", "  lead and trail  ", "tab\tand no-break", "x\x1cy\x1fz", "don't we'll I'D", "naïve Café CAFÉ café",
    "ΑΣ ΟΔΟΣ", "İstanbul ıI", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|>\n\n<|startoftext|> z", "12345 3.14", "日本語のテキスト", "🙂🙃 ok", "ﬁ ǅ ß ẞ",
    "...!!! ?;", "word.\nnext\n\n  two", "a" * 3000, "ab " * 2000, "x y　z", "́start", "é́", "﻿bom", "mixed1word2", "tail\n", "ﷺ ½ ²",
    "same line here\nsame line here", "Same LINE here  \nother line of text", "null\x00byte", "it's 's 't", "under_score-dash", "trailing   ", "\r\nwin\r\nlines\r\n",
]


@pytest.fixture
def odd_docs(spark):
    """Odd texts twice (under other ids), a repeated row, a row without an id, and columns whose names could clash."""
    rows = [(i, t) for i, t in enumerate(ODD + ODD)] + [(3, ODD[3]), (None, "no id at all here"), (7, "another text under id seven")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, n_lines long")
    return docs.repartition(5)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
