"""Spelling variants by finite-state composition: vocabulary acceptor, one-edit transducer, acceptor again.

A word of the vocabulary meets only words that share one of its halves, since one edit leaves the other half as it is.
The half is the state from which a partition's acceptors start: a partition holds the minimised acceptors of the words of
``size`` and of ``size + 1`` code points behind that state. Composing them with the transducer of one replacement or one
insertion and walking the composition's useful states gives exactly the near pairs. A partition of more than ``MOST``
words is cut at the edit itself: its words go on as (place of the edit, rest of the word), and as few words share those
as the alphabet has letters. Tasks return one row per word, never the pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftpool.llm.common import prepare, texts, written

MIN_POINTS, MIN_COUNT, RATIO, ONE_IN = 6, 5, 5, 199
#: Words of one partition; a larger one is cut by the place of the edit.
MOST = 20_000
#: Distinct words that a task holds before it hands their counts on.
HELD = 100_000
_LETTERS = {*range(65, 91), *range(97, 123), *range(192, 256)}
#: Latin-1 bytes: A-Z to a-z, letters as they are, all else to a blank.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b in _LETTERS else 32 for b in range(256))
KEYED = "size int, side string, half string, word string, n long"
NEAR = "word string, n_near long, best_n long, best string"


def vocabulary(docs: DataFrame, min_points: int = MIN_POINTS, min_count: int = MIN_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """``word`` and ``n``: lower-cased runs of letters of all whole texts, some with a letter deleted, and their counts.

    Null and empty texts hold no words. A row without an id loses no letters. Repeated rows count each.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def counted() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in total]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own: dict[bytes, int] = {}
                for word in text.encode("latin-1", "replace").translate(_TABLE).split(b" "):
                    if len(word) >= min_points:
                        own[word] = own.get(word, 0) + 1
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in own.items():
                    if doc_id is not None:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % one_in == 0:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                            if len(word) < min_points:
                                continue
                    total[word] = total.get(word, 0) + n
                if len(total) > HELD:
                    yield counted()
                    total.clear()
        yield counted()

    return texts(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def acceptor(words: list[str], nodes: list[tuple[bool, dict[str, int]]], known: dict) -> int:
    """The start of the minimal acceptor of sorted ``words``; equal states of all acceptors in ``nodes`` are one."""
    path, before = [(False, {})], ""

    def freeze(node: tuple[bool, dict[str, int]]) -> int:
        name = (node[0], *node[1].items())
        if name not in known:
            known[name] = len(nodes)
            nodes.append(node)
        return known[name]

    for word in words:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        while len(path) > shared + 1:
            node = path.pop()
            path[-1][1][before[len(path) - 1]] = freeze(node)
        path += [(k == len(word) - 1, {}) for k in range(shared, len(word))]
        before = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1][before[len(path) - 1]] = freeze(node)
    return freeze((path[0][0] or words[:1] == [""], path[0][1]))


def _common(nodes: list, p: int, q: int, dead: set[tuple[int, int]]) -> list[str]:
    """All strings that lead from both states to acceptance; pairs of states that have none are kept in ``dead``."""
    found, stack, on = [], [(p, q, "", None)], []
    while stack:
        p, q, read, leave = stack.pop()
        if leave is not None:
            if leave == len(found):
                dead.add((p, q))
            continue
        if (p, q) in dead:
            continue
        stack.append((p, q, read, len(found)))
        (end_p, out_p), (end_q, out_q) = nodes[p], nodes[q]
        if end_p and end_q:
            found.append(read)
        stack += [(to, out_q[c], read + c, None) for c, to in out_p.items() if c in out_q]
    return found


def near_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart of distinct ``words`` of k and k + 1 code points: the first has k, and each pair comes once.

    Both tapes of the composition read the same letters up to the edit; behind it they read what both states accept.
    """
    size = min(map(len, words))
    nodes: list = []
    known: dict = {}
    short = acceptor(sorted(w for w in words if len(w) == size), nodes, known)
    longer = sorted(w for w in words if len(w) > size)
    dead: set[tuple[int, int]] = set()
    stack = [(short, "")]
    while stack:
        p, read = stack.pop()
        out = list(nodes[p][1].items())
        for k, (a, to_a) in enumerate(out):
            stack.append((to_a, read + a))
            for b, to_b in out[:k]:
                for rest in _common(nodes, to_a, to_b, dead):
                    yield read + b + rest, read + a + rest
    if not longer:
        return
    pairs = [(short, acceptor(longer, nodes, known), "")]
    while pairs:
        p, q, read = pairs.pop()
        (end, out_p), out_q = nodes[p], nodes[q][1]
        for b, q1 in out_q.items():
            if end and nodes[q1][0]:
                yield read, read + b
            for a, to_a in out_p.items():
                if a != b and a in nodes[q1][1]:
                    for rest in _common(nodes, to_a, nodes[q1][1][a], dead):
                        yield read + a + rest, read + b + a + rest
            if b in out_p:
                pairs.append((out_p[b], q1, read + b))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each partition, counted per word."""
    for (size, side, _), held in _partitions(batches):
        if len(held) < 2 or min(map(len, held)) > size:
            continue
        found: dict[str, list] = {}
        half = size // 2
        for u, v in near_pairs(list(held)):
            if side == "end" and u[:half] == v[:half]:  # the partition of that beginning has the pair
                continue
            for a, b in ((u, v), (v, u)):
                best = found.setdefault(a, [0, 0, ""])
                best[0] += 1
                n = held[b]
                if n > best[1] or n == best[1] and b < best[2]:
                    best[1], best[2] = n, b
        if found:
            count, most, best = zip(*found.values(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.string()), pa.array(count, pa.int64()), pa.array(most, pa.int64()), pa.array(best, pa.string())],
                names=["word", "n_near", "best_n", "best"],
            )


def _partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[str, int]]]:
    key, held = None, {}
    for batch in batches:
        names = [batch.column(c).to_pylist() for c in ("size", "side", "half")]
        for now, word, n in zip(zip(*names, strict=True), batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if now != key:
                if key is not None:
                    yield key, held
                key, held = now, {}
            held[word] = n
    if key is not None:
        yield key, held


def _at_the_edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of large partitions by the place of the edit and the rest of the word."""
    for batch in batches:
        rows = []
        for size, side, word, n in zip(*(batch.column(c).to_pylist() for c in ("size", "side", "word", "n")), strict=True):
            half = size // 2
            free = range(half, len(word)) if side == "start" else range(len(word) - (size - half))
            if len(word) == size:
                rows += [(size, side, f"{i} {word[:i]} {word[i + 1:]}", word, n) for i in free]
                rows.append((size, side, word, word, n))
            else:
                rows += [(size, side, rest, word, n) for rest in {word[:i] + word[i + 1 :] for i in free}]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["size", "side", "half", "word", "n"])


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """Per word with a near word: ``word``, ``n_near`` and the near word of largest count, ``best_n`` and ``best``.

    ``words`` has distinct ``word`` of two code points or more, and ``n``. Of equal counts the smaller word is best.
    """
    prepare(words.sparkSession)
    known = words.select("word", "n", F.length("word").alias("points"))
    size = F.explode(F.array(F.col("points"), F.col("points") - 1)).alias("size")
    sides = F.explode(F.array(F.lit("start"), F.lit("end"))).alias("side")
    half = F.when(F.col("side") == "start", F.expr("left(word, size div 2)")).otherwise(F.expr("right(word, size - size div 2)"))
    keyed = known.select("word", "n", size).filter("size >= 2").select("size", "word", "n", sides).withColumn("half", half)
    key = ["size", "side", "half"]
    counts = keyed.groupBy(*key).agg(F.count("*").alias("members"))
    large = written(counts.filter(F.col("members") > most).select(*key), "large-partitions")
    plain = keyed.join(large, key, "left_anti").select("size", "side", "half", "word", "n")
    cut = keyed.join(large, key).select("size", "side", "half", "word", "n").mapInArrow(_at_the_edit, KEYED)
    rows = plain.unionByName(cut).repartition(*key).sortWithinPartitions(*key)
    found = rows.mapInArrow(_near, NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    return found.select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def roots_of(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of rows ``word``, ``form``: the last word that forms lead to. Forms must not run in circles.

    Every round doubles the steps that a row has gone.
    """
    reached = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(reached.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return reached


def variants(docs: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """Per word: ``word``, ``n``, ``n_near``, its ``form`` (null if none), ``form_n`` and ``root``.

    A word's form is its near word of largest count if that is at least ``ratio`` times the word's own; of equal counts
    the smaller word. An empty table, or texts without words, give no rows.
    """
    words = written(vocabulary(docs), "vocabulary")
    near = near_words(words, most)
    joined = words.join(near, "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    judged = written(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"),
    ), "spelling-forms")
    roots = roots_of(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
