"""Language identification by compression: the language whose dictionary shortens a text most.

Training takes a bounded sample of labelled texts per language as a raw-content dictionary. A text's letters (lower
case, words apart) are compressed with each in pieces of fixed length, each piece anew; the smallest sum wins, and the
margin over the second decides whether the answer is sure. As a dictionary saves a bounded number of bytes in one frame,
only pieces give a lead that holds for texts of any length. Sampled texts that the other half of the sample places in another language are left out, as labels
can be wrong and a wrong text in a dictionary attracts its copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from driftpool.functions.ranking import top_per_group
from driftpool.llm.common import prepare, whole_text, written

#: The classifier's sample: so many labelled texts per language, so many code points of each, so many bytes in all.
SAMPLE_TEXTS, SAMPLE_POINTS, DICTIONARY_BYTES = 160, 2_000, 128 << 10
#: Languages whose dictionaries are ready at once; more are scored group by group.
LANGUAGES_TOGETHER = 64
#: Partitions whose best texts are compared in one task before those of a whole language are.
PARTS_TOGETHER = 32
LEVEL = 9
#: Bytes of letters compressed as one frame; a longer text is several.
PIECE_BYTES = 16 << 10
#: Smallest lead over the second language, as a share of the second's size beyond its frames' own bytes.
MARGIN = 0.01
FRAME_BYTES = 9
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def letters_of(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode()


def dictionaries(sample: dict[str, list[bytes]]) -> dict[str, bytes]:
    return {lang: b"\n".join(parts)[-DICTIONARY_BYTES:] for lang, parts in sample.items() if parts}


def train(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionary content per language from ``text`` and ``lang``; rows that lack either or have no letter are left out.

    Every language that is left is learned. The sample is the texts of smallest hash, read from their first letter on, so
    it depends neither on order nor on partitions; equal texts count once and ties cannot occur. No labelled row gives an
    empty model. The driver and each worker hold at most DICTIONARY_BYTES per language and half of the sample.
    """
    prepare(labelled.sparkSession)
    rows = labelled.select("lang", whole_text().alias("text")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    from_letter = F.regexp_replace("text", r"\A\P{L}+", "")
    rows = rows.select("lang", F.xxhash64("text").alias("tie"), F.substring(from_letter, 1, SAMPLE_POINTS).alias("text"))
    rows = rows.dropDuplicates(["lang", "tie"]).withColumn("part", F.floor(F.spark_partition_id() / PARTS_TOGETHER))
    best = top_per_group(rows, ["lang", "part"], [F.col("tie")], SAMPLE_TEXTS)  # bounds what one task of a language reads
    sample = top_per_group(best.select("lang", "tie", "text"), ["lang"], [F.col("tie")], SAMPLE_TEXTS)
    sample = written(sample.select("lang", "rank", "text"), "language-sample")
    models: list[dict[str, bytes]] = [{}, {}]
    for lang, parts in _by_language(sample):
        for half in (0, 1):
            models[half] |= dictionaries({lang: [t for rank, t, _ in parts if (rank - 1) % 2 == half]})

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = [Classifier(m) for m in models]
        for batch in batches:
            own = [True] * batch.num_rows
            langs, ranks, given = (batch.column(c).to_pylist() for c in ("lang", "rank", "text"))
            for half in (0, 1):
                there = [k for k, (lang, rank) in enumerate(zip(langs, ranks, strict=True)) if (rank - 1) % 2 == half and lang in models[1 - half]]
                for k, (found, _) in zip(there, halves[1 - half].judge_all([given[k] for k in there]), strict=True):
                    own[k] = found == langs[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "rank", "text")), pa.array(own, pa.bool_())], names=["lang", "rank", "text", "own"])

    checked = written(sample.mapInArrow(check, "lang string, rank int, text string, own boolean"), "language-checked")
    model: dict[str, bytes] = {}
    for lang, parts in _by_language(checked):
        model |= dictionaries({lang: [t for _, t, own in parts if own] or [t for _, t, _ in parts]})
    return model


def _by_language(sample: DataFrame) -> Iterator[tuple[str, list[tuple[int, bytes, bool]]]]:
    """Rank, letters and check of each language's texts; the driver holds one partition at a time."""
    rows = sample.orderBy("lang", "rank").toLocalIterator()
    for lang, parts in groupby(rows, key=lambda r: r.lang):
        yield lang, [(r["rank"], letters_of(r.text), "own" not in r or r.own) for r in parts]


class Classifier:
    def __init__(self, model: dict[str, bytes]) -> None:
        self.model, self.languages = model, sorted(model)
        self.groups = [self.languages[k : k + LANGUAGES_TOGETHER] for k in range(0, len(self.languages), LANGUAGES_TOGETHER)]
        self.kept = self.compressors(self.groups[0]) if len(self.groups) == 1 else None

    def compressors(self, languages: list[str]) -> list[zstandard.ZstdCompressor]:
        found = []
        for lang in languages:
            content = zstandard.ZstdCompressionDict(self.model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            found.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))
        return found

    def judge(self, text: str) -> tuple[str, float]:
        """Language and lead: 0 (tie) to 1; ties go to the language first in order."""
        return self.judge_all([text])[0]

    def judge_all(self, texts: list[str]) -> list[tuple[str, float]]:
        """The same for many texts; each group's dictionaries are made ready once, the best two go on."""
        data = [letters_of(t) for t in texts]
        pieces = [[x[k : k + PIECE_BYTES] for k in range(0, len(x), PIECE_BYTES)] or [x] for x in data]
        best: list[list[tuple[int, str]]] = [[] for _ in data]
        for group in self.groups if data else []:
            ready = self.kept or self.compressors(group)
            for k, parts in enumerate(pieces):
                best[k] = sorted([*best[k], *((sum(len(c.compress(p)) for p in parts), lang) for c, lang in zip(ready, group, strict=True))])[:2]
        return [_lead(two, len(parts)) for two, parts in zip(best, pieces, strict=True)]


def _lead(two: list[tuple[int, str]], frames: int) -> tuple[str, float]:
    if len(two) == 1:
        return two[0][1], 1.0
    (best, lang), (second, _) = two
    return lang, (second - best) / max(1, second - FRAME_BYTES * frames, second - best)


def _judged(texts: pa.Array, classifier: Classifier | None) -> list[tuple[str, float]]:
    """Answers for a batch; texts without letters, or an empty model, are unknown."""
    found, given = [(UNKNOWN, 0.0)] * len(texts), texts.to_pylist()
    if classifier:
        there = [k for k, known in enumerate(pc.match_substring_regex(texts, r"\p{L}").to_pylist()) if known]
        for k, answer in zip(there, classifier.judge_all([given[k] for k in there]), strict=True):
            found[k] = answer
    return found


def predict(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (the lead) and ``rejected`` (lead below ``margin``, or unknown) per row.

    Every whole text is judged; a text that is null, empty or without letters, or an empty model, gives ``und`` with
    score 0. Repeated rows are judged each, a null ``doc_id`` is carried.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model) if model else None
        for batch in batches:
            found = _judged(batch.column("text"), classifier)
            langs, scores = [x for x, _ in found], [s for _, s in found]
            rejected = [x == UNKNOWN or s < margin for x, s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """Rows of ``docs`` whose language is sure, with all their columns; order and repeats as given."""
    prepare(docs.sparkSession)

    ready: list[Classifier | None] = []  # one in each worker

    @F.pandas_udf("boolean")
    def sure(texts):
        if not ready:
            ready.append(Classifier(model) if model else None)
        found = [lang != UNKNOWN and score >= margin for lang, score in _judged(pa.array(texts, pa.string()), ready[0])]
        return texts.__class__(found, dtype=bool)

    return docs.filter(sure(whole_text()))
