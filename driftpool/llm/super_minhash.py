"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find.

SuperMinHash gives every shingle one permutation of the registers and one rank in each: in round j a shingle offers
j + r to the j-th register of its permutation. Ranks of one shingle exclude each other, which lowers the variance against
independent hashes, and a text stops at the first round in which every register already holds less than the round's
number, so long texts need few rounds.

Texts with equal shingle sets are one class. Classes that share a band meet in a bucket. First every member of a bucket is
verified against the bucket's centre only, the class that meets most others, and links are grouped: a large group of near
copies is one component after this, at one comparison each. Then only pairs around one centre that share a band and whose
components still differ are verified: the members outside the centre's largest component against each other and against
that component, in blocks. Blocks unite what they link, so no pair that is already connected is compared, and they return a
forest, never the pairs. Similarities are counted on whole shingle sets (64-bit hashes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from driftpool.llm.common import prepare, written
from driftpool.llm.jaccard_join import components
from driftpool.llm.suffix_dedup import keyed_texts, packed_texts

WORDS, PERCENT = 4, 80
#: Two texts of similarity 0.8 share no band with a chance of 5e-8.
BANDS, ROWS = 32, 4
#: Members and shingles of one block of a bucket.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
#: Shingles whose permutations are drawn at once.
CHUNK = 8192
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW32 = np.uint64(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``words`` words of each text; fewer words are one shingle, none are none.

    Words lie between white space of ASCII, and only A-Z are lower-cased.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten()
    bounds = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    bounds, coded = np.concatenate([[0], np.cumsum(full)])[bounds], flat.filter(pa.array(full)).dictionary_encode()
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    each = names[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    runs = np.zeros(max(0, len(each) - words + 1), np.uint64)
    for k in range(words):
        runs = _mixed(runs * _A + each[k : k + len(runs)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(each[a:b].tobytes(), b - a)] if b > a else [], np.uint64))
    return out


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` registers per set, none of them empty. Registers agree with the chance of the sets' similarity."""
    low = np.full((len(sets), size), np.inf)
    flat, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for at in range(0, len(flat), CHUNK):
        item, owner = flat[at : at + CHUNK], owners[at : at + CHUNK]
        first, last = owner[0], owner[-1] + 1
        place = np.tile(np.arange(size, dtype=np.uint16), (len(item), 1))
        own = low[first:last].reshape(-1)
        for j in range(size):
            # A text goes on while a register holds j or more; what this round offers is never less than j.
            active = (own.reshape(-1, size).max(axis=1) >= j)[owner - first]
            if not active.all():
                if not active.any():
                    break
                item, owner, place = item[active], owner[active], place[active]
            drawn = _mixed(item + np.uint64((j + 1) * int(_A) & 0xFFFFFFFFFFFFFFFF))
            other = j + ((drawn & _LOW32) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64)
            row = np.arange(len(item))
            register = place[row, other]
            place[row, other] = place[:, j]
            offered = j + (drawn >> np.uint64(32)).astype(np.float64) / 2.0**32
            np.minimum.at(own, (owner - first) * size + register, offered)
        low[first:last] = own.reshape(-1, size)
    return low


def band_labels(low: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One number per band: a hash of its registers."""
    bits = np.ascontiguousarray(low).view(np.uint64).reshape(len(low), bands, -1)
    label = np.zeros(bits.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _A
    for k in range(bits.shape[2]):
        label = _mixed(label + bits[:, :, k])
    return label.view(np.int64)


def classes_of(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Per row its keys, ``n_shingles``, ``class`` (128-bit hash of the set; null without words) and band ``labels``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingles(batch.column("text"), words)
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            new = {n: s for n, s in zip(names, sets, strict=True) if n is not None}
            labels: dict[bytes | None, np.ndarray | None] = {None: None}
            if new:
                labels |= zip(new, band_labels(signatures(list(new.values()), bands * rows), bands), strict=True)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "doc", "tie")), pa.array(list(map(len, sets)), pa.int64()), pa.array(names, pa.binary()),
                 pa.array([labels[n] for n in names], pa.list_(pa.int64()))],
                names=["doc_id", "doc", "tie", "n_shingles", "class", "labels"],
            )

    return keyed_texts(docs).mapInArrow(run, "doc_id long, doc long, tie int, n_shingles long, class binary, labels array<long>")


def sets_of(packed: pa.Array, words: int) -> list[np.ndarray]:
    expand = zstandard.ZstdDecompressor()
    return shingles(pa.array([expand.decompress(p).decode() for p in packed.to_pylist()], pa.string()), words)


def common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with sorted sets."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    flat = np.concatenate(others)
    at = np.searchsorted(one, flat)
    at[at == len(one)] = 0
    return np.bincount(np.repeat(np.arange(len(others)), sizes), one[at] == flat, len(others)).astype(np.int64)


def linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    both, sizes = common(one, others), np.fromiter(map(len, others), np.int64, len(others))
    return 100 * both >= percent * (len(one) + sizes - both)


def _to_the_centre(words: int, percent: int):
    """Rows sorted by unit, its centre first: the members that link to the centre. Holds the centre and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            names, found = batch.column("class").to_pylist(), []
            units = list(zip(batch.column("centre").to_pylist(), batch.column("salt").to_pylist(), strict=True))
            members, sets = batch.column("member").to_pylist(), sets_of(batch.column("packed"), words)
            k = 0
            while k < len(units):
                if units[k] != now:
                    now, centre, k = units[k], sets[k], k + 1
                    continue
                end = k
                while end < len(units) and units[end] == now and members[end]:
                    end += 1
                if end > k:
                    found += [(names[k + i], now[0]) for i in np.flatnonzero(linked(centre, sets[k:end], percent))]
                k = max(end, k + 1)  # a repeated row of the centre is passed by
            if found:
                yield _edges(found)

    return run


def _edges(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, one batch per unit."""
    held, now = [], None
    for batch in batches:
        units = list(zip(*(batch.column(c).to_pylist() for c in ("centre", "x", "y")), strict=True))
        k = 0
        while k < len(units):
            end = k
            while end < len(units) and units[end] == units[k]:
                end += 1
            if units[k] != now and held:
                yield pa.concat_batches(held)
                held = []
            now = units[k]
            held.append(batch.slice(k, end - k))
            k = end
    if held:
        yield pa.concat_batches(held)


class _Unit:
    """Members of two blocks around a centre and the pairs to verify there."""

    def __init__(self, rows: pa.RecordBatch, percent: int) -> None:
        self.percent = percent
        self.labels = rows.column("labels").flatten().to_numpy().reshape(rows.num_rows, -1)
        self.size = rows.column("n_shingles").to_numpy()
        names: dict[bytes, int] = {}
        self.root = np.array([names.setdefault(r, len(names)) for r in rows.column("root").to_pylist()])
        side = rows.column("side").to_numpy(zero_copy_only=False)
        self.alone = rows.column("x")[0].as_py() == rows.column("y")[0].as_py()
        self.left, self.right = np.flatnonzero(~side), np.flatnonzero(side)

    def partners(self) -> Iterator[tuple[int, np.ndarray]]:
        """Per member its partners: another component, a fitting size, and a band in common."""
        for k, x in enumerate(self.left.tolist()):
            y = self.left[k + 1 :] if self.alone else self.right
            y = y[self.root[y] != self.root[x]]
            y = y[100 * np.minimum(self.size[y], self.size[x]) >= self.percent * np.maximum(self.size[y], self.size[x])]
            y = y[(self.labels[y] == self.labels[x]).any(axis=1)]
            if len(y):
                yield x, y


_UNIT = "centre binary, x int, y int, side boolean, class binary, root binary, n_shingles long, labels array<long>"


def _needed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units(batches):
            some = np.zeros(rows.num_rows, bool)
            for x, y in _Unit(rows, percent).partners():
                some[x] = some[y] = True
            if some.any():
                yield rows.filter(pa.array(some))

    return run


def _united(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units(batches):
            unit, sets, found = _Unit(rows, percent), sets_of(rows.column("packed"), words), []
            names = rows.column("class").to_pylist()
            for x, y in unit.partners():
                while len(y := y[unit.root[y] != unit.root[x]]):
                    some, y = y[:64], y[64:]
                    for k in some[linked(sets[x], [sets[i] for i in some], percent)].tolist():
                        if unit.root[k] != unit.root[x]:
                            found.append((names[x], names[k]))
                            unit.root[unit.root == unit.root[k]] = unit.root[x]
            if found:
                yield _edges(found)

    return run


def with_texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``asked`` (with ``doc``, ``tie`` and ``class``) with their packed text, each text sent once."""
    others = [c for c in asked.columns if c not in ("doc", "tie", "class")]
    per_class = asked.groupBy("doc", "tie", "class").agg(F.collect_list(F.struct(*others)).alias("at"))
    text = packed_texts(docs).select("doc", "tie", "packed").join(per_class, ["doc", "tie"]).dropDuplicates(["doc", "tie"])
    return text.select("class", "packed", F.explode("at").alias("at")).select("class", "packed", "at.*")


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (least id that links reach) and ``kept``.

    Null and empty texts and those without words have no shingles, no links and their own id. Rows that share an id are
    linked as any others. A null id takes part; ``component_id`` is null only where all ids of the component are, and
    ``kept`` is false for a null id. Repeated rows are one class. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    each = written(classes_of(docs, words, bands, rows), "sets")
    order = F.struct(F.col("doc"), F.col("tie"))
    classes = written(each.filter("class IS NOT NULL").groupBy("class").agg(
        F.min(order).alias("least"), F.min("doc_id").alias("same_id"), F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels"),
    ), "set-classes")
    keys = classes.select("class", "least.doc", "least.tie")
    met = classes.select("class", "n_shingles", F.explode("labels").alias("label"))
    crowds = met.groupBy("label").agg(F.count("*").alias("members")).filter("members > 1")
    shared = written(met.join(crowds, "label"), "shared-bands")
    # A text that others were edited from shares more bands with more classes than its copies do among each other.
    score = shared.groupBy("class").agg(F.sum("members").alias("score"))
    scored = shared.join(score, "class").select("label", "class", "n_shingles", F.struct("score", "class", "n_shingles").alias("rank"))
    centres = scored.groupBy("label").agg(F.max("rank").alias("centre"))
    around = shared.join(centres, "label").select("class", "n_shingles", F.col("centre.class").alias("centre"), F.col("centre.n_shingles").alias("centre_size"))
    around = written(around.filter(F.col("class") != F.col("centre")).distinct(), "centres")

    # Every member against the centres of its buckets.
    fits = 100 * F.least("n_shingles", "centre_size") >= percent * F.greatest("n_shingles", "centre_size")
    stars = around.filter(fits).select("centre", "class")
    sizes = stars.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    salted = stars.join(sizes, "centre").select("centre", F.pmod(F.xxhash64("class"), "salts").cast("int").alias("salt"), F.lit(True).alias("member"), "class")
    middle = sizes.select("centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("centre").alias("class"))
    asked = with_texts(docs, salted.unionByName(middle).join(keys, "class"))
    unit = ["centre", "salt"]
    first = written(asked.repartition(*unit).sortWithinPartitions(*unit, "member").mapInArrow(_to_the_centre(words, percent), "a binary, b binary"), "star-links")
    roots = components(first)

    # Pairs around a centre that are still in different components.
    known = around.join(roots.withColumnRenamed("node", "class"), "class", "left")
    known = written(known.select("centre", "class", "n_shingles", F.coalesce("root", "class").alias("root")), "components-around")
    open_ = known.groupBy("centre").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("centre")
    # A written table of known size, so that a centre with very many members stays dealt as it is.
    members = known.join(written(open_, "centres-left"), "centre")
    parts = members.groupBy("centre", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    pieces = lambda n, s: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    plan = parts.groupBy("centre").agg(F.max(F.struct("n", "s", "root")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s")).select(
        "centre", F.col("top.root").alias("largest"), pieces(F.col("top.n"), F.col("top.s")).alias("k"), pieces(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("r"),
    )
    planned = members.join(written(plan, "open-centres"), "centre").withColumn("large", F.col("root") == F.col("largest"))
    planned = planned.withColumn("own", F.pmod(F.xxhash64("class"), F.when(F.col("large"), F.col("k")).otherwise(F.col("r"))).cast("int"))
    # Blocks of the rest have numbers below r, those of the largest component lie above.
    place = F.when(F.col("large"), F.expr("transform(sequence(0, r - 1), i -> struct(i AS x, r + own AS y, true AS side))")).otherwise(
        F.expr("transform(sequence(0, r + k - 1), j -> struct(least(own, j) AS x, greatest(own, j) AS y, j < own AS side))")
    )
    dealt = planned.select("centre", "class", "root", "n_shingles", F.explode(place).alias("at")).select("centre", "at.*", "class", "root", "n_shingles")
    dealt = dealt.join(classes.select("class", "labels"), "class").select(*(c.split()[0] for c in _UNIT.split(", ")))
    unit = ["centre", "x", "y"]
    needed = written(dealt.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_needed(percent), _UNIT), "needed-pairs")
    asked = with_texts(docs, needed.join(keys, "class"))
    second = written(asked.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_united(words, percent), "a binary, b binary"), "block-links")

    # Both forests together.
    hop = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    between = second.join(hop("a"), "a", "left").join(hop("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    last = components(between)
    grouped = classes.select("class", "same_id").join(hop("class"), "class", "left").select("class", "same_id", F.coalesce("class_root", "class").alias("root"))
    grouped = grouped.join(last.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("class", "same_id", F.coalesce("top", "root").alias("root"))
    grouped = written(grouped, "grouped-classes")
    least = grouped.groupBy("root").agg(F.min("same_id").alias("component_id"))
    verdicts = written(grouped.join(least, "root").select(F.col("class").alias("of"), "component_id"), "set-verdicts")
    judged = each.select("doc_id", "n_shingles", "class").join(verdicts, F.col("class") == F.col("of"), "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return judged.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
