"""Held-out accuracy and odd texts of the language classifier."""

import random

from driftpool.llm import language_id, queries


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    found = queries.QUERIES["op7_language_id"](spark, sf_dir).join(docs, "doc_id").filter("held_out AND length(text) > 200").collect()
    assert len(found) > 20 and sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_texts(spark, sf_dir, odd_docs):
    model = language_id.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = language_id.predict(odd_docs, model)
    assert found.count() == odd_docs.count()
    text = {r.doc_id: r.text for r in odd_docs.collect()}
    unknown = [r for r in found.collect() if r.lang_pred == "und"]
    assert all(r.score == 0 and r.rejected and not any(c.isalpha() for c in text[r.doc_id] or "") for r in unknown) and len(unknown) > 8
    left = language_id.accepted(odd_docs, model)
    assert left.columns == odd_docs.columns and left.count() == found.filter("NOT rejected").count()


def test_no_labels_and_no_rows(no_docs, odd_docs):
    assert language_id.train(no_docs) == {}
    assert {r.lang_pred for r in language_id.predict(odd_docs, {}).collect()} == {"und"}
    assert language_id.predict(no_docs, {"en": b"some words"}).count() == 0


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) > 400")
    assert language_id.accepted(docs, language_id.train(docs)).count() >= 0.97 * docs.count()


def test_clean_document_of_any_length(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    model = language_id.train(docs)
    texts = [r.text for r in docs.filter("lang = 'en' AND length(text) > 400").orderBy("doc_id").collect()]
    texts = [t for t in texts if language_id.Classifier(model).judge(t)[0] == "en"]
    words, draw = " ".join(texts).split(" "), random.Random(1)
    starts = [draw.randrange(len(words) - 8) for _ in range(240_000)]
    long = " ".join(" ".join(words[k : k + 8]) for k in starts)
    assert len(long) > 10_000_000
    rows = spark.createDataFrame([(1, long[:100_000]), (2, long)], "doc_id long, text string")
    found = {r.doc_id: r for r in language_id.predict(rows, model).collect()}
    assert {r.lang_pred for r in found.values()} == {"en"} and not any(r.rejected for r in found.values())
    assert abs(found[1].score - found[2].score) < 0.2 * found[1].score
    assert language_id.accepted(rows, model).count() == 2


def test_every_language_is_learned(spark):
    draw, rows = random.Random(2), []
    names = [f"l{k:02d}" for k in range(70)]
    for k, lang in enumerate(names):
        words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 8))) for _ in range(60)]
        rows += [(100 * k + i, lang, "1234567890 " * 300 * (k == 69) + " ".join(draw.choices(words, k=80))) for i in range(4 if k < 64 else 3)]
    docs = spark.createDataFrame([*rows, (-1, "none", "12 34"), (-2, None, "some words")], "doc_id long, lang string, text string")
    model = language_id.train(docs)
    assert sorted(model) == names
    given = docs.filter("doc_id >= 0").repartition(2)
    found = language_id.predict(given, model)
    right = found.join(given, "doc_id").filter("lang = lang_pred AND NOT rejected")
    assert right.count() == len(rows) == language_id.accepted(given, model).count()
    assert [language_id.Classifier({x: model[x] for x in names[:64]}).judge(t)[0] for *_, t in rows[:3]] == ["l00"] * 3
