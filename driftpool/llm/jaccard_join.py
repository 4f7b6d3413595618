"""Near duplicates by Jaccard similarity of word n-grams, found with a forest of MinHash prefix tries.

Texts with equal shingle sets are one class first, so copies cost one row. Each class has a signature of ``TREES``
labels of ``DEPTH`` MinHash values; sorted by label, a tree is a prefix trie. A join needs all pairs above the threshold,
so prefixes are shortened from the whole label, value by value, until the share of such pairs that meet in some tree
reaches the target recall; classes below a common prefix of that length are candidates. A pair is verified once, in
the first tree where it meets, on whole shingle sets (64-bit hashes), in blocks of bounded size: blocks return counts
and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from driftpool.llm.common import prepare, unused, written
from driftpool.llm.suffix_dedup import keyed_texts, packed_texts, row_keys

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 20, 8, 0.9999
#: Classes of one block; a bucket with more is cut into blocks, which meet two by two.
BLOCK = 512
#: Shingle columns that a block multiplies at once.
COLUMNS = 4096
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def prefix_depth(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which pairs of that similarity meet in some tree with the target recall (1 at least)."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; fewer words than ``words`` are one shingle, none none.

    Words are lower-case and lie between white space.
    """
    split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))  # the split may miss white space at the very end
    flat = split.flatten()
    bounds = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)  # runs of white space may give empty words
    kept = np.concatenate([[0], np.cumsum(~empty)])
    bounds, coded = kept[bounds], flat.filter(pa.array(~empty)).dictionary_encode()
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    each = names[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    grams = np.zeros(max(0, len(each) - words + 1), np.uint64)
    for k in range(words):
        grams = grams * _MIX + each[k : k + len(grams)]
        grams ^= grams >> np.uint64(31)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(each[a:b].tobytes(), b - a)], np.uint64) if b > a else np.zeros(0, np.uint64))
    return out


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def buckets(grams: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One number per tree: the hash of the first ``depth`` MinHash values of its label."""
    times, plus = _factors(trees * depth)
    low = np.full(trees * depth, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 4096):
        some = grams[at : at + 4096, None] * times + plus
        low = np.minimum(low, (some ^ (some >> np.uint64(32))).min(axis=0))
    label = np.zeros(trees, np.uint64)
    for column in low.reshape(trees, depth).T:
        label = (label ^ column) * _MIX
        label ^= label >> np.uint64(29)
    return label + np.arange(trees, dtype=np.uint64) * _STEP


def classes_of(docs: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    """Per row: ``doc_id``, ``doc``, ``tie``, ``class`` (128-bit hash of the shingle set; null without words) and ``labels``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingles(batch.column("text"), words)
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            labels: dict[bytes | None, np.ndarray | None] = {None: None}
            for name, s in zip(names, sets, strict=True):
                if name not in labels:
                    labels[name] = buckets(s, trees, depth).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "doc", "tie")), pa.array(names, pa.binary()), pa.array([labels[n] for n in names], pa.list_(pa.int64()))],
                names=["doc_id", "doc", "tie", "class", "labels"],
            )

    return keyed_texts(docs).mapInArrow(run, "doc_id long, doc long, tie int, class binary, labels array<long>")


def _numbers(labels: pa.Array) -> np.ndarray:
    return labels.flatten().to_numpy().reshape(len(labels), -1)


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each block pair that have a pair to verify there."""
    for rows in _blocks(batches):
        side, labels = rows.column("side").to_numpy(zero_copy_only=False), _numbers(rows.column("labels"))
        first = _first_meetings(labels, side, rows.column("tree")[0].as_py(), rows.column("x")[0].as_py() == rows.column("y")[0].as_py())
        some = np.zeros(rows.num_rows, bool)
        for a, b in first:
            some[a], some[b] = True, True
        if some.any():
            yield rows.filter(pa.array(some)).select(["bucket", "x", "y", "side", "tree", "class", "doc", "tie", "labels", "size"])


def _first_meetings(labels: np.ndarray, side: np.ndarray, tree: int, alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a block pair that meet in no tree before ``tree``, as arrays of row numbers, row by row block."""
    left = np.arange(len(labels)) if alone else np.flatnonzero(~side)
    right = left if alone else np.flatnonzero(side)
    for at in range(0, len(left), 128):
        rows = left[at : at + 128]
        met = np.zeros((len(rows), len(right)), bool)
        for t in range(tree):
            met |= labels[rows, t][:, None] == labels[right, t][None, :]
        a, b = np.nonzero(~met)
        if alone:
            later = right[b] > rows[a]
            a, b = a[later], b[later]
        if len(a):
            yield rows[a], right[b]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, one batch for each (bucket, x, y); at most two blocks of rows each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(c).to_numpy() for c in ("bucket", "x", "y")]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
        cuts = [0, *new.tolist(), batch.num_rows]
        if held and tuple(held[-1].column(c)[-1].as_py() for c in ("bucket", "x", "y")) != tuple(k[0] for k in key):
            yield pa.concat_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a and held:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def _links(sets: list[np.ndarray], pairs: Iterator[tuple[np.ndarray, np.ndarray]], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    for a, b in pairs:
        fit = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-9
        a, b = a[fit], b[fit]
        if not len(a):
            continue
        if len(a) <= 256:
            both = np.fromiter((len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(a))
        else:
            both = _products(sets, a, b)
        linked = both >= similarity * (sizes[a] + sizes[b] - both) - 1e-9
        yield a[linked], b[linked]


def _products(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of common sets of many pairs by matrix products over the shingles that more than one member has."""
    left, right = np.unique(a), np.unique(b)
    members = np.union1d(left, right)
    flat = np.concatenate([sets[m] for m in members])
    owner = np.repeat(np.arange(len(members)), [len(sets[m]) for m in members])
    values, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    use = count[code] > 1
    owner, code = owner[use], shared[code[use]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    rows, columns = np.searchsorted(members, left), np.searchsorted(members, right)
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        lo, hi = np.searchsorted(code, [at, at + COLUMNS])
        table = np.zeros((len(members), COLUMNS), np.float32)
        table[owner[lo:hi], code[lo:hi] - at] = 1
        total += table[rows] @ table[columns].T
    return total[np.searchsorted(left, a), np.searchsorted(right, b)].astype(np.int64)


def _verifier(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            alone = rows.column("x")[0].as_py() == rows.column("y")[0].as_py()
            side = rows.column("side").to_numpy(zero_copy_only=False)
            labels = _numbers(rows.column("labels"))
            sets = _sets_of(rows.column("packed"), words)
            size, links, root = rows.column("size").to_numpy(), np.zeros(rows.num_rows, np.int64), list(range(rows.num_rows))

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            found = False
            for a, b in _links(sets, _first_meetings(labels, side, rows.column("tree")[0].as_py(), alone), similarity):
                found = found or len(a) > 0
                np.add.at(links, a, size[b])
                np.add.at(links, b, size[a])
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    x, y = top(x), top(y)
                    if x != y:
                        root[max(x, y)] = min(x, y)
            if found:
                some = np.flatnonzero(links > 0)
                names = rows.column("class")
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(some)), names.take(pa.array([top(int(x)) for x in some])), pa.array(links[some])], names=["class", "other", "links"]
                )

    return run


def _sets_of(packed: pa.Array, words: int) -> list[np.ndarray]:
    expand = zstandard.ZstdDecompressor()
    return shingles(pa.array([expand.decompress(p).decode() for p in packed.to_pylist()], pa.string()), words)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for all nodes of ``edges`` (``a``, ``b``, binary): the same root within a component.

    Nodes are hashes, so hooking each node to its least neighbour shortens every round to a fraction; rounds end when
    no edge joins two roots. Every round is a written table.
    """
    edges = written(edges.filter("a <> b").distinct(), "edges")
    labels = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("old"), F.least("a", "p").alias("new"))
        parent = written(parent, "parents")
        hop = parent.select(F.col("old").alias("new"), F.col("new").alias("next"))
        parent = written(parent.join(hop, "new", "left").select("old", F.coalesce("next", "new").alias("new")), "parents")
        labels = written(labels.join(parent, labels.root == parent.old, "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
        moved = edges.join(parent.withColumnsRenamed({"old": "a", "new": "na"}), "a").join(parent.withColumnsRenamed({"old": "b", "new": "nb"}), "b")
        edges = written(moved.select(F.col("na").alias("a"), F.col("nb").alias("b")).filter("a <> b").distinct(), "edges")
    return labels


def near_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``doc``, ``tie``, ``class_id``, ``same_id``, ``n_links`` and ``first``.

    ``class_id`` is the least id of the documents that links connect with this one, ``same_id`` the least id with the same
    shingle set, ``n_links`` the number of other rows whose similarity is ``similarity`` or more (equal sets included).
    ``first`` marks the row that stays when one of each group shall: the least (id, hash); rows equal in id and text
    share the mark. Texts without words (null, empty) stand alone, each first, without links. A null ``doc_id`` takes
    part, ordered last. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    depth = prefix_depth(similarity, recall=recall)
    rows = written(classes_of(docs, words, TREES, depth), "classes")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc"), F.col("tie"))
    known = rows.filter("class IS NOT NULL")
    classes = written(known.groupBy("class").agg(F.min(order).alias("least"), F.min("doc_id").alias("same_id"), F.count("*").alias("size"), F.first("labels").alias("labels")), "class-table")
    tries = classes.select("class", "least.doc", "least.tie", "size", "labels", F.posexplode("labels").alias("tree", "bucket"))
    counted = tries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = tries.join(counted, "bucket").withColumn("k", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = shared.withColumn("own", F.pmod(F.xxhash64("class"), "k").cast("int"))
    pairs = own.withColumn("with", F.explode(F.expr("sequence(0, k - 1)")))
    pairs = pairs.select("bucket", "tree", "class", "doc", "tie", "size", "labels", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), (F.col("own") > F.col("with")).alias("side"))
    key = ["bucket", "x", "y"]
    needed_schema = "bucket long, x int, y int, side boolean, tree int, class binary, doc long, tie int, labels array<long>, size long"
    needed = written(pairs.repartition(*key).sortWithinPartitions(*key).mapInArrow(_needed, needed_schema), "needed")
    # Each class's text once per block pair where it has a pair to verify.
    asked = needed.groupBy("doc", "tie", "class", "size").agg(F.first("labels").alias("labels"), F.collect_list(F.struct(*key, "side", "tree")).alias("at"))
    text = packed_texts(docs).join(asked, ["doc", "tie"]).dropDuplicates(["doc", "tie"])
    dealt = text.select("class", "size", "labels", "packed", F.explode("at").alias("at")).select("at.*", "class", "size", "labels", "packed")
    found = written(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_verifier(words, similarity), "class binary, other binary, links long"), "links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class").alias("a"), F.col("other").alias("b")))
    joined = classes.select("class", "least", "same_id", "size").join(links, "class").join(roots, F.col("class") == F.col("node")).drop("node")
    joined = written(joined, "linked-classes")
    groups = joined.groupBy("root").agg(F.min("same_id").alias("group_id"), F.min("least").alias("group_least"))
    linked = joined.join(groups, "root").select("class", "links", "group_id", "group_least")
    whole = classes.select("class", "least", "same_id", "size").join(linked, "class", "left")
    whole = whole.select(
        F.col("class").alias("of"), "same_id", F.coalesce("group_id", "same_id").alias("class_id"), F.coalesce("group_least", "least").alias("keeper"),
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
    )
    whole = written(whole, "class-verdicts")  # so that the join's sides are plain exchanges, and a large class is split
    judged = rows.drop("labels").join(whole, F.col("class") == F.col("of"), "left")
    return judged.select(
        "doc_id", "doc", "tie", F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("same_id")).alias("same_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce(F.col("keeper") == order, F.lit(True)).alias("first"),
    )


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows whose group has an earlier document; all columns as they are."""
    doc, tie, gone_doc, gone_tie = unused(docs, "doc", "tie", "gone_doc", "gone_tie")
    gone = near_groups(docs, words, similarity).filter("NOT first").select(F.col("doc").alias(gone_doc), F.col("tie").alias(gone_tie)).distinct()
    own = docs.withColumns(dict(zip((doc, tie), row_keys(), strict=True)))
    return own.join(gone, (F.col(doc) == F.col(gone_doc)) & (F.col(tie) == F.col(gone_tie)), "left_anti").drop(doc, tie)
