"""Byte-level BPE against the library, text by text."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftpool.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(docs, library):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want = [(d, library.encode(t, add_special_tokens=False).ids) for d, t in rows]
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.text) for r in got), key=key) == sorted(
        ((d, ids, library.decode(ids, skip_special_tokens=False)) for d, ids in want), key=key
    )


def test_odd_texts(odd_docs, library):
    check(odd_docs, library)


def test_given_documents(spark, sf_dir, library):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"), library)


def test_random_signs(spark, library):
    rng = random.Random(5)
    signs = "  \n\t'’stdmrvl1234éßñ…—\u00a0\u2003日🙂\u0301<|>endoftextABC.,;"
    check(spark.createDataFrame([(i, "".join(rng.choices(signs, k=rng.randrange(1, 60)))) for i in range(1500)], "doc_id long, text string"), library)


def test_proposals_are_checked():
    coder = bpe.coder(PATH)
    words = [bytes(random.Random(k).choices(b"aeinrst hlo", k=12)) for k in range(3000)]
    tokens, counts = coder.encode_words(words)
    runs = np.split(tokens, np.cumsum(counts)[:-1])
    assert [r.tolist() for r in runs] == [coder.merge(w) for w in words]


def test_empty(no_docs):
    assert bpe.decode(bpe.encode(no_docs, PATH), PATH).count() == 0


def test_long_text_and_small_memory(spark, library, monkeypatch):
    """Texts beyond one block, one of them without white space, and a store that is full all the time."""
    rng = random.Random(8)
    long = " ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(400_000))
    check(spark.createDataFrame([(1, long), (2, "ab" * 40_000), (3, "x<|endoftext|>" + long[:1_200_000])], "doc_id long, text string"), library)
    monkeypatch.setattr(bpe, "KEPT_BYTES", 5_000)
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 10)
    monkeypatch.setattr(bpe, "POINTS_AT_ONCE", 50)
    own = bpe.Coder(PATH)
    texts = ["", long[:3000], " a", "<|endoftext|>", long[2000:9000]]
    ids, bounds = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.held < 3 * bpe.KEPT_BYTES
    assert bpe.Decoder(PATH).decode(ids, bounds) == texts
