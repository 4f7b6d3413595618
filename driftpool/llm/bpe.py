"""Byte-level BPE by speculation: longest matches propose tokens, a pair check accepts them, the rest is merged exactly.

A sequence of tokens is the encoding of its bytes exactly when every two neighbours are the encoding of theirs. So a
word's proposal by longest match is tested pair by pair, for all words at once, and only words with a pair that fails
are merged by rank. Each distinct word is encoded once per worker.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftpool.llm.common import prepare, texts

#: Bytes that a worker keeps for words it has met; what is to exceed it starts anew.
KEPT_BYTES = 48 << 20
#: What a kept word takes besides its own characters and tokens.
ENTRY_BYTES = 160
#: Words looked up together, and characters split together; both bound a worker's memory whatever a text's length.
WORDS_AT_ONCE, POINTS_AT_ONCE = 50_000, 1 << 20
#: Longest word (bytes) whose proposal is searched together with all others; longer ones are searched alone.
TOGETHER = 64
NEVER = np.int64(1 << 40)
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The vocabulary's split never joins what these keep apart, whatever stands around them.
_CHUNKS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
# In chunks of these characters the split needs no table of letters; others go to the library's splitter.
_COMMON = re.compile("[\\t\\n\\r -~À-ÖØ-öø-ÿ]*")
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\\s{_L}0-9]+|\\s+(?!\\S)|\\s+")
_coders: dict[str, Coder] = {}
_decoders: dict[str, Decoder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def shown_bytes() -> dict[str, int]:
    """Bytes by the characters that stand for them: themselves where they print, those from 256 on elsewhere."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {c: b for b, c in [*zip(shown, map(chr, shown), strict=True), *((b, chr(256 + k)) for k, b in enumerate(hidden))]}


def contents(vocab: dict[str, int], special: dict[str, int]) -> list[bytes]:
    """The bytes of every token by its id."""
    byte_of = shown_bytes()
    content = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in vocab.items():
        content[i] = bytes(map(byte_of.__getitem__, token))
    for token, i in special.items():
        content[i] = token.encode()
    return content


class Decoder:
    """Token bytes only: a worker that decodes needs neither merges nor the tree."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        content = contents(spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]})
        self.token_bytes = pa.array(content, pa.binary())
        self.token_sizes = np.array([len(x) for x in content], np.int64)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of runs of ids; bytes that are no UTF-8 become replacement characters."""
        data = (self.token_bytes.take(pa.array(ids)).buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        at = np.concatenate([[0], np.cumsum(self.token_sizes[ids])])[bounds].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


class Coder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.byte_of = shown_bytes()
        content = contents(vocab, self.special)
        size = len(content)
        self._learn_merges(vocab, merges, size)
        self._grow_tree({content[i]: i for i in vocab.values() if self.sound[i]})
        self._clear()

    def _bytes(self, shown: str) -> bytes:
        return bytes(map(self.byte_of.__getitem__, shown))

    def _learn_merges(self, vocab: dict[str, int], merges: list, size: int) -> None:
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.left, self.right, self.made = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[x, y] = k, z
            if self.made[z] < 0:
                self.left[z], self.right[z], self.made[z] = x, y, k
        self.size = size
        keys = np.array([x * size + y for x, y in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([k for k, _ in self.rank.values()], np.int64)[order]
        self.byte_ids = np.full(256, -1, np.int64)
        for c, b in self.byte_of.items():
            self.byte_ids[b] = vocab[c]
        # A token is sound if its own bytes encode to it; only sound tokens are proposed.
        self.sound = np.zeros(size, bool)
        self.sound[self.byte_ids] = True
        merged = np.flatnonzero(self.made >= 0)
        whole = self._fits(self.left[merged], self.right[merged], self.made[merged])
        for z, fits in sorted(zip(merged.tolist(), whole.tolist(), strict=True), key=lambda x: self.made[x[0]]):
            self.sound[z] = fits and self.sound[self.left[z]] and self.sound[self.right[z]]

    def _grow_tree(self, tokens: dict[bytes, int]) -> None:
        """Prefix tree of the tokens' bytes as sorted edges (node, byte)."""
        nodes, ends = {b"": 0}, [-1]
        for token, i in tokens.items():
            for k in range(1, len(token) + 1):
                if token[:k] not in nodes:
                    nodes[token[:k]] = len(ends)
                    ends.append(-1)
            ends[nodes[token]] = i
        edges = sorted((nodes[p[:-1]] * 256 + p[-1], n) for p, n in nodes.items() if p)
        self.edges, self.targets = np.array([e for e, _ in edges], np.int64), np.array([n for _, n in edges], np.int64)
        self.ends, self.tokens, self.longest = np.array(ends, np.int64), tokens, max(map(len, tokens))

    def _clear(self) -> None:
        self.places: dict[str, int] = {t: k for k, t in enumerate(self.special)}
        n = len(self.special)
        self.flat, self.used = np.zeros(1 << 12, np.int32), n
        self.flat[:n] = list(self.special.values())
        self.starts, self.sizes = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.starts[:n], self.sizes[:n] = np.arange(n), 1
        self.held = 0

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def _fits(self, a: np.ndarray, b: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border between tokens ``a`` and ``b`` (but for their own, of rank ``own``).

        Runs the merges backwards: the pair at the border changes when either side is taken apart, the later made
        first. A crossing merge happens if its turn comes before the side at its left or right is merged away.
        """
        fits = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.copy(), b.copy()
        until_x, until_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        if own is not None:
            until_x, until_y = own.copy(), own - 1
        while len(at):
            rank = self._pair_rank(x, y)
            crossed = (rank < until_x) & (rank <= until_y) & (rank < NEVER)
            fits[at[crossed]] = False
            made_x, made_y = self.made[x], self.made[y]
            go = ~crossed & ((made_x >= 0) | (made_y >= 0))
            at, x, y, until_x, until_y, made_x, made_y = (v[go] for v in (at, x, y, until_x, until_y, made_x, made_y))
            first = made_x > made_y
            until_x, until_y = np.where(first, made_x, until_x), np.where(first, until_y, made_y)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return fits

    def _propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from left to right for short words: tokens of all words, and how many each has."""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        stops = np.cumsum([len(w) for w in words])
        owner, at, stop = np.arange(len(words)), stops - [len(w) for w in words], stops
        node, reach, best, best_at = np.zeros(len(words), np.int64), at.copy(), np.full(len(words), -1), at.copy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(owner):
            key = node * 256 + data[np.minimum(reach, len(data) - 1)]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            on = (reach < stop) & (self.edges[edge] == key)
            node = np.where(on, self.targets[edge], node)
            reach = reach + on
            ends = on & (self.ends[node] >= 0)
            best, best_at = np.where(ends, self.ends[node], best), np.where(ends, reach, best_at)
            if not on.all():
                off = ~on
                found.append((owner[off], at[off], best[off]))
                at = np.where(off, best_at, at)
                node, reach = np.where(off, 0, node), np.where(off, best_at, reach)
                more = at < stop
                owner, at, stop, node, reach, best, best_at = (v[more] for v in (owner, at, stop, node, reach, best, best_at))
        owners, places, tokens = (np.concatenate(x) for x in zip(*found, strict=True))
        return tokens[np.argsort(places)], np.bincount(owners, minlength=len(words))

    def _propose_long(self, word: bytes) -> list[int]:
        tokens, at = [], 0
        while at < len(word):
            for size in range(min(self.longest, len(word) - at), 0, -1):
                token = self.tokens.get(word[at : at + size])
                if token is not None:
                    tokens.append(token)
                    at += size
                    break
        return tokens

    def merge(self, word: bytes) -> list[int]:
        """Exact merging by rank, leftmost first among equals."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(self.rank[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, k, x, y = heapq.heappop(heap)
            n = after[k]
            if ids[k] != x or n < 0 or ids[n] != y:
                continue
            ids[k], ids[n] = self.rank[x, y][1], -1
            after[k] = after[n]
            if after[n] >= 0:
                before[after[n]] = k
            for i, j in ((before[k], k), (k, after[k])):
                if i >= 0 and j >= 0 and (p := (ids[i], ids[j])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], i, *p))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words one after the other, and how many each has."""
        short = [w for w in words if len(w) <= TOGETHER]
        tokens, counts = self._propose(short) if short else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(short) < len(words):
            runs = iter(np.split(tokens, np.cumsum(counts)[:-1]))
            lists = [next(runs) if len(w) <= TOGETHER else np.array(self._propose_long(w), np.int64) for w in words]
            tokens, counts = np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))
        owner = np.repeat(np.arange(len(words)), counts)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        failed = np.unique(owner[inside[~self._fits(tokens[inside], tokens[inside + 1])]])
        if not len(failed):
            return tokens, counts
        exact = [self.merge(words[k]) for k in failed]
        good = np.ones(len(words), bool)
        good[failed] = False
        pool = np.concatenate([tokens, np.fromiter((i for x in exact for i in x), np.int64)])
        starts = np.cumsum(counts) - counts
        sizes = np.fromiter(map(len, exact), np.int64, len(exact))
        starts[failed], counts = len(tokens) + np.cumsum(sizes) - sizes, counts.copy()
        counts[failed] = sizes
        return ragged(pool, starts, counts), counts

    def _split(self, chunk: str) -> list[bytes]:
        if _COMMON.fullmatch(chunk):
            return [w.encode() for w in _WORDS.findall(chunk)]
        return [self._bytes(shown) for shown, _ in self.library.pre_tokenize_str(chunk)]

    def _add(self, chunks: list[str]) -> None:
        split = [self._split(c) for c in chunks]
        words = list({w: None for x in split for w in x})
        number = {w: k for k, w in enumerate(words)}
        tokens, counts = self.encode_words(words)
        starts = np.cumsum(counts) - counts
        at = np.fromiter((number[w] for x in split for w in x), np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts[at])])[np.cumsum([0, *map(len, split)])]
        first, more = len(self.places), int(bounds[-1])
        self.places.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        self.flat = _grown(self.flat, self.used + more)
        self.flat[self.used : self.used + more] = ragged(tokens, starts[at], counts[at])
        self.starts, self.sizes = _grown(self.starts, first + len(chunks)), _grown(self.sizes, first + len(chunks))
        self.starts[first : first + len(chunks)], self.sizes[first : first + len(chunks)] = self.used + bounds[:-1], np.diff(bounds)
        self.used += more

    def _blocks(self, text: str) -> Iterator[list[str]]:
        """What the split never joins, in lists of bounded length."""
        for part in self.cut.split(text) if self.cut is not None and any(t in text for t in self.special) else [text]:
            if part in self.special:
                yield [part]
            elif part and len(part) <= POINTS_AT_ONCE:
                yield _CHUNKS.findall(part)
            elif part:
                found = _CHUNKS.finditer(part)
                while block := [m.group() for m in islice(found, WORDS_AT_ONCE)]:
                    yield block

    def _look_up(self, chunks: list[str]) -> np.ndarray:
        new = dict.fromkeys(c for c in chunks if c not in self.places)
        weight = sum(map(len, new)) * 2 + len(new) * ENTRY_BYTES
        if self.held + weight > KEPT_BYTES and self.held:
            self._clear()
            new = dict.fromkeys(c for c in chunks if c not in self.places)
            weight = sum(map(len, new)) * 2 + len(new) * ENTRY_BYTES
        if new:
            self._add(list(new))
            self.held += weight
        return np.fromiter(map(self.places.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, given: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (one more entry than texts)."""
        parts, counts = [np.zeros(0, np.int32)], np.zeros(len(given), np.int64)
        chunks: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            at = self._look_up(chunks)
            sizes = self.sizes[at].astype(np.int64)
            parts.append(ragged(self.flat, self.starts[at].astype(np.int64), sizes))
            whose, how_many = zip(*owners, strict=True)
            np.add.at(counts, np.repeat(whose, how_many), sizes)
            chunks.clear()
            owners.clear()

        for k, text in enumerate(given):
            for block in self._blocks(text):
                chunks += block
                owners.append((k, len(block)))
                if len(chunks) >= WORDS_AT_ONCE:
                    flush()
        if chunks:
            flush()
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])


def _grown(held: np.ndarray, size: int) -> np.ndarray:
    """The array with room for ``size`` entries; it doubles when it must grow."""
    if size <= len(held):
        return held
    more = np.zeros(max(size, 2 * len(held)), held.dtype)
    more[: len(held)] = held
    return more


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit) of every whole text.

    Null and empty texts have no ids; a null ``doc_id`` is carried; repeated rows are encoded each. Strings of special
    tokens become their ids, as in the library's default.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = coder(path).encode(batch.column("text").to_pylist())
            data, at = ids.astype("<u4").tobytes(), (bounds * 4).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``text``, the decoded ``ids``; null ids give an empty text."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [x or b"" for x in batch.column("ids").to_pylist()]
            bounds = np.cumsum([0, *(len(x) // 4 for x in parts)])
            decoded = decoder(path).decode(np.frombuffer(b"".join(parts), "<u4").astype(np.int64), bounds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(decoded, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
