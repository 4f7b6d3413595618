"""Token files and packing against the library, text by text."""

import struct
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftpool.llm import packing, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(params=["odd", "given"])
def docs(request, odd_docs, given):
    return odd_docs if request.param == "odd" else given


def expected(docs, end):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    return [(d, e.ids + [end]) for (d, _), e in zip(rows, tokenizer.encode_batch([t for _, t in rows], add_special_tokens=False))]


def unpack(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


@pytest.mark.parametrize("seed", [None, 5])
def test_records_round_trip(docs, seed):
    manifest = token_files.write_records(docs, PATH, 2)
    got = token_files.read_records(manifest, seed).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, unpack(r.ids)) for r in got), key=key) == sorted(expected(docs, 2), key=key)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids) // 4
    ordered = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert ordered == sorted(ordered)


def test_damaged_record():
    record = token_files.frame(b"some ids")
    assert token_files.unframe(memoryview(record)) == b"some ids"
    for k in range(len(record)):
        with pytest.raises((ValueError, struct.error, OverflowError)):
            token_files.unframe(memoryview(record[:k] + bytes([record[k] ^ 1]) + record[k + 1 :]))


def test_pieces_cover_every_token(docs):
    pieces = packing.pack(docs, PATH, 1).collect()
    sequences, owned = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        owned[p.doc_id].append(p)
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(sum(x for _, x in placed) < 2048 for placed in sequences.values()) <= 1
    want = defaultdict(list)
    for doc_id, ids in expected(docs, 1):
        want[doc_id].append(ids)
    assert set(want) == set(owned)
    for doc_id, texts in want.items():
        if len(texts) == 1:
            own = sorted(owned[doc_id], key=lambda p: p.start)
            assert sum((unpack(p.ids) for p in own), []) == texts[0]
            assert [p.start for p in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
            assert {p.doc_tokens for p in own} == {len(texts[0])}
        else:
            assert sum(p.length for p in owned[doc_id]) == sum(map(len, texts))


def test_empty_tables(no_docs):
    assert token_files.read_records(token_files.write_records(no_docs, PATH, 2)).count() == 0
    assert packing.pack(no_docs, PATH, 1).count() == 0


def test_small_windows_meet_the_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 10_000), (2, "tail")], "doc_id long, text string")
    pieces = packing.pack(docs, PATH, 1, size=64, windows=2)
    totals = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(t.n for t in totals) == 10_003 and sum(t.n < 64 for t in totals) == 1
