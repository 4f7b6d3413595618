"""Token ids of whole texts by a vocabulary that drops white space (``tokenizers`` library).

White space never takes part in a match of this kind of vocabulary, so a text's ids are those of its chunks between
white space, one after the other. Chunks repeat, so each distinct one is encoded once per worker.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker keeps; beyond it starts anew.
KEPT = 600_000
#: Words that one call of the library gets.
CALL_WORDS = 2_000
# Letters that every step (composition, lower case, split) treats one by one, then signs that make one run.
_PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"
_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        suffix = model["end_of_word_suffix"]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size, bool)
        self.ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain words, many in one text; the ids that end a word tell them apart."""
        ids = self._library([" ".join(words)])[0]
        stops = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(stops, prepend=0)) if len(stops) == len(words) else self._library(words)

    def _places(self, chunks: pa.Array, plain: bool) -> np.ndarray:
        """Where the ids of each chunk are kept; encodes those that are new."""
        coded = chunks.dictionary_encode()
        names = coded.dictionary.to_pylist()
        new = [x for x in names if x not in self.places]
        found = []
        for at in range(0, len(new), CALL_WORDS):
            some = new[at : at + CALL_WORDS]
            found.append(self._words(some) if plain else self._library(some))
        if found:
            self.places.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, *(ids for ids, _ in found)])
            self.sizes = np.concatenate([self.sizes, *(sizes for _, sizes in found)])
        at = np.fromiter(map(self.places.__getitem__, names), np.int64, len(names))
        return at[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32), and where each text's ids start (one more entry than texts)."""
        if len(self.places) > KEPT:
            self._clear()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        parts = pc.extract_regex(coded.dictionary, _PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        places = np.empty((len(plain), 2), np.int64)  # a chunk is a word and the signs after it
        places[~plain, 0] = self._places(coded.dictionary.filter(parts.is_null()), False)
        places[~plain, 1] = self._places(pa.array([""]), False)[0]
        word, signs = parts.drop_null().flatten()
        places[plain, 0] = self._places(pc.utf8_lower(word), True)
        places[plain, 1] = self._places(signs, False)
        at = places[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        starts = np.cumsum(self.sizes) - self.sizes
        lengths = self.sizes[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(starts[at] - (ends - lengths), lengths)]
        bounds = 2 * (split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py())
        return ids, np.concatenate([[0], ends])[bounds]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end`` after each text's ids."""
    return np.insert(ids, offsets[1:], np.uint32(end)), offsets + np.arange(len(offsets))
