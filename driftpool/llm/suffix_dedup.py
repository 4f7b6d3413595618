"""Removal of repeated windows by a radix sort of suffixes that goes no deeper than a threshold.

A window of ``threshold`` bytes is known by its anchor, the leftmost smallest hash of its 8-byte strings, and by how far
before the anchor it starts. So all windows with one anchor and a run of starts are one block. The first pass sorts
blocks of up to 128 starts by the bytes that all windows of the block share, then by all bytes of the block. A block
whose shared bytes occur once holds no repeated window and is done; one that occurs again as a whole is repeated as a
whole. The others are cut into blocks of 16 starts and then of one, which are sorted the same way: at that depth equal
neighbours are exactly the repeated windows. Every pass is a range partition by key and a sort inside each range, so one
very common passage is dealt over many tasks; only the first and last row of a range need a look at the next range.

Keys are hashes: 64 bits for the bytes shared and 64 for all bytes, so two blocks pass for equal on 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftpool.llm.common import prepare, unused, whole_text, written

THRESHOLD = 200
GRAM = 8
#: Starts that a block holds in each pass.
BLOCKS = (128, 16, 1)
#: Windows whose anchors are searched at once; bounds a worker's memory.
SEGMENT = 1 << 19
ITEMS = "core long, span long, doc long, tie int, item long"
FOUND = f"kind string, part int, second boolean, {ITEMS}, inner_core long, inner_span long"
_KINDS = [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in FOUND.split(", ")]
_ODD, _EVEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_HIGH, _LOW, _SHIFT = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF), np.uint64(29)


def row_keys() -> list[Column]:
    """``doc`` and ``tie`` tell rows apart: the id (for null: a hash of the text) and a short hash of both."""
    text = whole_text()
    known = F.col("doc_id").cast("long")
    return [F.coalesce(known, F.xxhash64(text)).alias("doc"), F.hash(text, known.isNull()).alias("tie")]


def keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(), whole_text().alias("text"))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each value's begin (one more entry than values)."""
    wide = column.cast(pa.large_binary())
    bounds = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def anchors(data: np.ndarray, bounds: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of windows with a common anchor: text number, anchor, first and last start (all inside ``data``)."""
    width = threshold - GRAM + 1
    for begin in range(0, len(data), SEGMENT):
        n = min(SEGMENT, len(data) - begin)
        some = data[begin : begin + n + threshold]
        some = np.concatenate([some, np.zeros(n + 2 * width + GRAM - len(some), np.uint8)])
        grams = np.ndarray(len(some) - GRAM + 1, "<u8", some.data, strides=(1,)) * _ODD
        grams ^= grams >> _SHIFT
        grams *= _EVEN
        grams = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64)
        grams = grams[: len(grams) // width * width].reshape(-1, width)
        ahead = np.minimum.accumulate(grams, axis=1).ravel()
        back = np.minimum.accumulate(grams[:, ::-1], axis=1)[:, ::-1].ravel()
        smallest = np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & _LOW
        owner = np.searchsorted(bounds, np.arange(begin, begin + n), "right") - 1
        start = np.flatnonzero(np.arange(begin, begin + n) + threshold <= bounds[owner + 1])
        if not len(start):
            continue
        anchor, owner = smallest[start].astype(np.int64), owner[start]
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
        last = np.r_[first[1:], len(start)] - 1
        yield owner[first], anchor[first] + begin, start[first] + begin, start[last] + begin


def cut(low: np.ndarray, high: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts cut at multiples of ``block``: number of the run, its low and high end."""
    pieces = high // block - low // block + 1
    run = np.repeat(np.arange(len(low)), pieces)
    base = (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + np.repeat(low // block, pieces)) * block
    return run, np.maximum(low[run], base), np.minimum(high[run], base + block - 1)


def _hashes(view: memoryview, left: np.ndarray, right: np.ndarray, seeds: np.ndarray) -> pa.Array:
    digest = xxhash.xxh3_64_intdigest
    found = [digest(view[a:b], s) for a, b, s in zip(left.tolist(), right.tolist(), seeds.tolist(), strict=True)]
    return pa.array(np.array(found, np.uint64).view(np.int64))


def _items(view: memoryview, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, block: int, threshold: int) -> list[pa.Array]:
    """Keys of blocks whose starts lie ``low`` to ``high`` before ``anchor`` (a place in ``view``)."""
    base = low // block * block
    end = np.minimum(base + block - 1, threshold - GRAM)
    core = _hashes(view, anchor - base, anchor - end + threshold, base)
    return [core, _hashes(view, anchor - high, anchor - low + threshold, (low << 16) | high)]


def first_items(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = buffer_of(batch.column("text"))
            view = memoryview(data)
            doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            for owner, anchor, start, stop in anchors(data, bounds, threshold):
                run_of, low, high = cut(anchor - stop, anchor - start, BLOCKS[0])
                owner, anchor = owner[run_of], anchor[run_of]
                keys = _items(view, anchor, low, high, BLOCKS[0], threshold)
                item = ((anchor - bounds[owner]) << 32) | (low << 16) | high
                yield pa.RecordBatch.from_arrays([*keys, pa.array(doc[owner]), pa.array(tie[owner]), pa.array(item)], names=["core", "span", "doc", "tie", "item"])

    return keyed_texts(docs).select("doc", "tie", "text").mapInArrow(run, ITEMS)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of one sorted range. The last row of a batch waits for the next batch."""
    part, held, before, opened = TaskContext.get().partitionId(), None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        core, span = (batch.column(c).to_numpy() for c in ("core", "span"))
        if not opened and len(core) > 1:
            yield _edge(part, False, batch.slice(0, 1), core[1], span[1])
            opened, before, batch, core, span = True, (core[0], span[0]), batch.slice(1), core[1:], span[1:]
        held = batch.slice(batch.num_rows - 1)
        if len(core) > 1:
            up, up_span = np.r_[before[0], core[:-1]][:-1], np.r_[before[1], span[:-1]][:-1]
            yield from _kinds(part, batch.slice(0, len(core) - 1), core[:-1], span[:-1], up, up_span, core[1:], span[1:])
            before = core[-2], span[-2]
    if held is not None:
        yield _edge(part, opened, held, *(before if opened else (None, None)))


def _edge(part: int, second: bool, row: pa.RecordBatch, core, span) -> pa.RecordBatch:
    inner = [None if x is None else int(x) for x in (core, span)]
    columns = [pa.array(["edge"]), pa.array([part], pa.int32()), pa.array([second]), *row.columns, *(pa.array([x], pa.int64()) for x in inner)]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _kinds(part: int, rows: pa.RecordBatch, core, span, up, up_span, down, down_span) -> Iterator[pa.RecordBatch]:
    above, below = core == up, core == down
    same_above, same_below = above & (span == up_span), below & (span == down_span)
    whole = same_above | same_below
    partner = whole & ((above & ~same_above) | (below & ~same_below))
    for kind, chosen in (("whole", whole & ~partner), ("partner", partner), ("open", (above | below) & ~whole)):
        some = rows.take(pa.array(np.flatnonzero(chosen)))
        n = some.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.bool_()), *some.columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=_NAMES)


def sorted_pass(items: DataFrame, name: str) -> DataFrame:
    """Blocks that occur again: ``doc``, ``tie``, ``item``, ``kind``.

    ``whole``: all of it occurs again. ``open``: only the shared bytes do. ``partner``: as whole, and open blocks beside
    it may repeat parts of it, so one such block of each kind goes on to the next pass.
    """
    order = ["core", "span", "doc", "tie", "item"]
    ranged = items.repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(ranged.mapInArrow(_judge, FOUND), name, ["kind"])
    at = Window.orderBy("part", "second")  # at most two rows per range
    edges = found.filter("kind = 'edge'").withColumns({f"{w}_{c}": f(c).over(at) for c in ("core", "span") for w, f in (("up", F.lag), ("down", F.lead))})
    edges = edges.withColumns({
        f"{w}_{c}": F.expr(f"coalesce(if(second = {on}, inner_{c}, NULL), {w}_{c})") for c in ("core", "span") for w, on in (("up", "true"), ("down", "false"))
    })
    above, below = F.expr("core <=> up_core"), F.expr("core <=> down_core")
    same_above, same_below = above & F.expr("span <=> up_span"), below & F.expr("span <=> down_span")
    whole = same_above | same_below
    kind = F.when(whole & ((above & ~same_above) | (below & ~same_below)), "partner").when(whole, "whole").when(above | below, "open")
    keep = ["doc", "tie", "item", "kind"]
    return found.filter("kind <> 'edge'").select(*keep).unionByName(edges.withColumn("kind", kind).filter("kind IS NOT NULL").select(*keep))


def packed_texts(docs: DataFrame) -> DataFrame:
    """Texts compressed for an exchange, with their row keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            small = [squeeze.compress(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "doc", "tie")), pa.array(small, pa.binary())], names=["doc_id", "doc", "tie", "packed"])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, doc long, tie int, packed binary")


def _items_of(lists: list, k: int) -> np.ndarray:
    return np.array(lists[k] or [], np.int64)


def repeated_blocks(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Blocks of windows that start anywhere else too: ``doc``, ``tie`` (see :func:`row_keys`) and ``item``.

    ``item`` holds the anchor's place in the text, and the least and the most bytes before it at which windows start.
    """
    first = sorted_pass(first_items(docs, threshold), "suffix-1")
    more = first.filter("kind <> 'whole'").groupBy("doc", "tie").agg(F.collect_set("item").alias("items"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            lists = batch.column("items").to_pylist()
            for k, (doc, tie, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "packed")), strict=True)):
                text, items = expand.decompress(packed), _items_of(lists, k)
                anchor, low, high = items >> 32, (items >> 16) & 0xFFFF, items & 0xFFFF
                pieces = [text[a:b] for a, b in zip((anchor - high).tolist(), (anchor - low + threshold).tolist(), strict=True)]
                n = len(items)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n), pa.array([tie] * n, pa.int32()), pa.array(items), pa.array(pieces, pa.binary())], names=["doc", "tie", "item", "piece"])

    around = packed_texts(docs).join(more, ["doc", "tie"]).select("doc", "tie", "packed", "items")
    pieces = written(around.mapInArrow(contexts, "doc long, tie int, item long, piece binary"), "suffix-pieces")

    def shorter(block: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, bounds = buffer_of(batch.column("piece"))
                item = batch.column("item").to_numpy()
                own = np.arange(len(item))
                if "items" in batch.schema.names:
                    lists = batch.column("items")
                    own = np.repeat(own, np.diff(lists.offsets.to_numpy()))
                    ask = lists.flatten().to_numpy()
                else:
                    ask = item
                part, low, high = cut((ask >> 16) & 0xFFFF, ask & 0xFFFF, block)
                own = own[part]
                anchor = bounds[own] + (item[own] & 0xFFFF)
                keys = _items(memoryview(data), anchor, low, high, block, threshold)
                rows = pa.array(own)
                found = pa.array((item[own] >> 32 << 32) | (low << 16) | high)
                yield pa.RecordBatch.from_arrays([*keys, batch.column("doc").take(rows), batch.column("tie").take(rows), found], names=["core", "span", "doc", "tie", "item"])

        return run

    of = (F.shiftright("item", 32) * 512 + F.shiftright(F.col("item").bitwiseAND(0xFFFF), 7)).alias("of")
    done, source = [first.filter("kind <> 'open'")], pieces
    for k, block in enumerate(BLOCKS[1:], 2):
        level = sorted_pass(source.mapInArrow(shorter(block), ITEMS), f"suffix-{k}")
        done.append(level.filter("kind <> 'open'"))
        if block > 1:
            asked = level.filter("kind <> 'whole'").groupBy("doc", "tie", of).agg(F.collect_set("item").alias("items"))
            source = pieces.withColumn("of", of).join(asked, ["doc", "tie", "of"]).select("doc", "tie", "item", "piece", "items")
    out = done[0]
    for level in done[1:]:
        out = out.unionByName(level)
    return out.select("doc", "tie", "item")


def _mask(size: int, items: np.ndarray, threshold: int) -> np.ndarray:
    """Bytes that go."""
    anchor, low, high = items >> 32, (items >> 16) & 0xFFFF, items & 0xFFFF
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, anchor - high, 1)
    np.add.at(steps, anchor - low + threshold, -1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes that stay.

    Every byte goes that lies in a window of ``threshold`` bytes which starts anywhere else too, in the same or another
    text, so all copies go; windows are judged on the whole input. Null and empty texts have no bytes; texts shorter
    than the threshold lose nothing; a null ``doc_id`` is carried; repeated rows are copies of each other; an empty
    table gives no rows. ``threshold`` may be 16 to 65,000.
    """
    if not 2 * GRAM <= threshold <= 65_000:
        raise ValueError("threshold must be 16 to 65,000")
    prepare(docs.sparkSession)
    blocks = repeated_blocks(docs, threshold).groupBy("doc", "tie").agg(F.collect_set("item").alias("items"))  # bounded by the text's own anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            lists, rows = batch.column("items").to_pylist(), []
            for k, packed in enumerate(batch.column("packed").to_pylist()):
                text = expand.decompress(packed)
                gone = _mask(len(text), _items_of(lists, k), threshold)
                spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(text) else 0
                rows.append((len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
            sizes, removed, spans, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in (sizes, removed, spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    joined = packed_texts(docs).join(blocks, ["doc", "tie"], "left").select("doc_id", "packed", "items")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with repeated windows cut from ``text`` at whole characters; other columns as they are.

    A null text stays null; a text of which all is repeated becomes empty.
    """
    prepare(docs.sparkSession)
    own_doc, own_tie, doc, tie, gone = unused(docs, "own_doc", "own_tie", "doc", "tie", "items")
    blocks = repeated_blocks(docs, threshold).groupBy("doc", "tie").agg(F.collect_set("item").alias("items")).withColumnsRenamed({"doc": doc, "tie": tie, "items": gone})
    own = docs.withColumns(dict(zip((own_doc, own_tie), row_keys(), strict=True)))
    joined = own.join(blocks, (F.col(own_doc) == F.col(doc)) & (F.col(own_tie) == F.col(tie)), "left")

    @F.pandas_udf("string")
    def kept(text, items):
        return text.combine(items, lambda t, x: _cut_text(t, x, threshold))

    return joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept("text", gone))).drop(own_doc, own_tie, doc, tie, gone)


def _cut_text(text: str | None, items: np.ndarray | None, threshold: int) -> str | None:
    if text is None or items is None:
        return text
    data = np.frombuffer(text.encode(), np.uint8)
    keep = ~_mask(len(data), np.array(items, np.int64), threshold)
    head = np.flatnonzero((data & 0xC0) != 0x80)  # a character stays if any of its bytes does
    whole = np.repeat(np.logical_or.reduceat(keep, head), np.diff(np.r_[head, len(data)]))
    return data[whole].tobytes().decode()
