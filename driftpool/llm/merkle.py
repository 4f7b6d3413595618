"""Merkle fingerprints: a tree of hashes over sentences, paragraphs (lines) and sections of a text.

A section ends at a blank line or after a paragraph whose hash says so, hence an edit moves no other section's border.
A fingerprint is the tree as a string: the root's hash, ``#``, then sections between ``|``, paragraphs between ``;``,
sentences between ``,``. A sentence is 8 digits of its hash and its length (code points), all hexadecimal. One of more
than LEAF code points is several leaves, with borders that the content sets, so that an edit changes only leaves around
it. Paragraphs, sections and the root are hashed (SHA-256) over the whole hashes of their children, so roots are equal
only if texts are, and only the root's hash is kept of these. The string grows with the text, by some 0.4 of its length.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from driftpool.llm.common import prepare, texts, written

#: One paragraph in so many ends a section.
SECTION = 8
#: Most code points of a leaf, and fewest before a border that the content sets.
LEAF, LEAST = 64, 16
#: In a longer sentence, a border follows a word whose last code point these many divide; where words are none, a code point.
WORDS, POINTS = 4, 16


def _divided_by(n: int) -> str:
    """Code points that ``n`` divides, as a set of a pattern; beyond the first plane, all."""
    return "[" + "".join(re.escape(chr(c)) for c in range(0, 0x10000, n) if not 0xD800 <= c < 0xE000) + "\U00010000-\U0010ffff]"


_SENTENCE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")
_PHRASE = re.compile(rf"[\s\S]{{{LEAST - 2},}}?{_divided_by(WORDS)}\s+|[\s\S]+")
_PIECE = re.compile(rf"[\s\S]{{{LEAST - 1},{LEAF - 2}}}?{_divided_by(POINTS)}|[\s\S]{{1,{LEAF}}}")


def leaves(sentence: str) -> list[str]:
    """A sentence, or its parts if it has more than LEAF code points."""
    if len(sentence) <= LEAF:
        return [sentence]
    found = []
    for phrase in _PHRASE.findall(sentence):
        if len(phrase) <= LEAF:
            found.append(phrase)
        else:
            found += _PIECE.findall(phrase)
    return found


def _digest(kind: bytes, parts: Iterable[bytes]) -> bytes:
    return hashlib.sha256(kind + b"".join(parts)).digest()


def _paragraph(line: str) -> tuple[str, bytes]:
    """Its leaves as eight digits of their hashes and lengths, and its own hash over all their whole hashes."""
    parts = [leaf for s in _SENTENCE.findall(line) for leaf in leaves(s)]
    wide = [hashlib.sha256(leaf.encode()).digest() for leaf in parts]
    return ",".join([f"{h[:4].hex()}{len(leaf):x}" for h, leaf in zip(wide, parts, strict=True)]), _digest(b"P", wide)


def paragraph(line: str) -> str:
    """Leaves of one paragraph as hash and length."""
    return _paragraph(line)[0]


def fingerprint(text: str) -> str:
    sections, inner, row, below = [], [], [], []
    lines = text.split("\n")
    for k, line in enumerate(lines, 1):
        shown, digest = _paragraph(line)
        row.append(shown)
        below.append(digest)
        if k == len(lines) or not line.strip() or digest[0] % SECTION == 0:
            sections.append(";".join(row))
            inner.append(_digest(b"S", below))
            row, below = [], []
    root = _digest(b"R%d|" % len(text), inner)
    return f"{root[:16].hex()}#{'|'.join(sections)}"


def _leaves(sections: Counter) -> Counter:
    """Leaves, each with the newline-free length that it stands for; blank paragraphs count 1."""
    found: Counter = Counter()
    for section, times in sections.items():
        for leaf in section.replace(";", ",").split(","):
            found[leaf] += times
    return found


def _weight(leaves: Counter) -> int:
    return sum(n * (int(leaf[8:], 16) if leaf else 1) for leaf, n in leaves.items())


def likeness(a: str, b: str) -> float:
    """Share of the two texts (0 to 1) in leaves that both have, by length; equal branches are not opened."""
    if a == b:
        return 1.0
    x, y = Counter(a.partition("#")[2].split("|")), Counter(b.partition("#")[2].split("|"))
    same = _weight(_leaves(x & y))
    p, q = _leaves(x - y), _leaves(y - x)
    total = 2 * same + _weight(p) + _weight(q)
    return (2 * same + 2 * _weight(p & q)) / total if total else 0.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Where the first text differs: (section, paragraph) numbers whose branch the second text lacks."""
    if a == b:
        return []
    x, y = a.partition("#")[2].split("|"), b.partition("#")[2].split("|")
    sections = Counter(y)
    paragraphs = Counter(p for s in (Counter(y) - Counter(x)).elements() for p in s.split(";"))
    found = []
    for k, section in enumerate(x):
        if sections[section] > 0:
            sections[section] -= 1
            continue
        for j, part in enumerate(section.split(";")):
            if paragraphs[part] > 0:
                paragraphs[part] -= 1
            else:
                found.append((k, j))
    return found


def edited_leaves(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Where inside the paragraphs of ``edits``: section, paragraph, start and length (code points) of each leaf that the second text lacks."""
    x = [s.split(";") for s in a.partition("#")[2].split("|")]
    places = edits(a, b)
    inside = set(places)
    spare = _leaves(Counter(b.partition("#")[2].split("|")))
    spare -= _leaves(Counter(p for k, s in enumerate(x) for j, p in enumerate(s) if (k, j) not in inside))
    found = []
    for k, j in places:
        start = 0
        for leaf in x[k][j].split(","):
            n = int(leaf[8:], 16) if leaf else 0
            if spare[leaf] > 0:
                spare[leaf] -= 1
            else:
                found.append((k, j, start, n))
            start += n
    return found


def edited(text: str, following: str) -> str:
    """The last third (code points, rounded down) replaced by as many of the following text, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_STAGED = f"kind string, part int, packed binary, {REPORT}"
_NAMES = [x.split()[0] for x in REPORT.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _judge(doc_id: int | None, text: str, own: str, following: str, its: str) -> tuple:
    changed = edited(text, following)
    fresh = fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, fresh, likeness(own, fresh), likeness(own, its)


def _rows(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with likenesses to that and to the next document.

    The next document is that of the next smaller ``doc_id`` (after the smallest: the largest; alone: itself). Null
    texts are empty. Repeated rows follow each other, ordered by the text's hash; rows without an id come last. An empty
    table gives no rows. Texts travel compressed; each range of ids is streamed once, and its last document is settled
    with the first of the next range (one row per range).
    """
    prepare(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            given = [t.encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in given], pa.int64()), pa.array([squeeze.compress(t) for t in given], pa.binary())],
                names=["doc_id", "tie", "packed"],
            )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, expand = TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
        names, kinds, none = ["kind", "part", "packed", *_NAMES], [pa.string(), pa.int32(), pa.binary(), *_KINDS], [None] * len(_NAMES)
        last = None  # (doc_id, text, fingerprint, packed)
        for batch in batches:
            rows = []
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                text = expand.decompress(packed).decode()
                here = doc_id, text, fingerprint(text), packed
                if last is None:
                    rows.append(("head", part, packed, *none))
                else:
                    rows.append(("done", part, None, *_judge(*last[:3], text, here[2])))
                last = here
            if rows:
                yield _rows(rows, names, kinds)
        if last is not None:
            yield _rows([("tail", part, last[3], last[0], *none[1:])], names, kinds)

    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    small = texts(docs).mapInArrow(pack, "doc_id long, tie long, packed binary")
    staged = written(small.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(judge, _STAGED), "merkle", ["kind"])
    heads = staged.filter("kind = 'head'").select("part", F.col("packed").alias("following"))
    tails = staged.filter("kind = 'tail'").select("part", "doc_id", "packed")
    # A range's number and the next one that has rows: one row per range, without its text.
    ranges = heads.select("part", F.lead("part").over(Window.orderBy("part")).alias("later"), F.min("part").over(Window.partitionBy()).alias("least"))
    ranges = ranges.select("part", F.coalesce("later", "least").alias("next_part"))
    pairs = tails.join(ranges, "part").join(heads.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "packed", "following")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, packed, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "following")), strict=True):
                text, after = expand.decompress(packed).decode(), expand.decompress(following).decode()
                rows.append(_judge(doc_id, text, fingerprint(text), after, fingerprint(after)))
            if rows:
                yield _rows(rows, _NAMES, _KINDS)

    return staged.filter("kind = 'done'").select(*_NAMES).unionByName(pairs.mapInArrow(settle, REPORT))
