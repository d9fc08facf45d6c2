"""Token ids of whole texts: each distinct piece of a word is encoded once in a worker.

The tokenizer (a `tokenizers` file, given by its path) drops white space, so a text's ids are the
ids of its space-separated chunks on end. Chunks of plain letters, digits and punctuation are cut
further where the kind changes; any other chunk (apostrophes, control characters, `|`, letters
beyond Latin-1) is encoded whole. `tests/llm` compares the result with encoding whole texts.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from driftloom.llm.words import SPACE, span_hashes, word_spans

_KIND = np.zeros(256, np.uint8)  # 0 space, 1 letter, 2 digit, 3 punctuation, 9 anything else
_KIND[:] = 9
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = 1
_KIND[97:123] = 1
_KIND[[39, 124]] = 9
_KIND[SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Entries a worker keeps; beyond that it starts anew. This bounds memory, not the result.
CACHE_ENTRIES = 1_200_000


class Encoder:
    """Ids of texts given as bytes; holds the ids of the pieces seen so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[int, int] = {}
        self.begin = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _learn(self, hashes: list[int], pieces: list[bytes]) -> None:
        """Encodes unseen pieces in one go; the place of a token tells its piece."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        ids = np.array(got.ids, np.uint32)
        places = np.array([o[0] for o in got.offsets], np.int64)
        counts = np.bincount(np.searchsorted(begins, places, "right") - 1, minlength=len(texts)) if len(ids) else np.zeros(len(texts), np.int64)
        first = len(self.number)
        need = first + len(texts)
        while need > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.begin[first:need] = self.used + np.cumsum(counts) - counts
        self.length[first:need] = counts
        self.used += len(ids)
        self.number.update(zip(hashes, range(first, need)))

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and where each text's ids begin."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(at), np.int64)
        kind = _KIND[data]
        low = _LOWER[data]
        self._latin(data, kind, low)
        begins, ends, _ = word_spans(data, at)
        odd = np.concatenate([[0], np.cumsum(kind == 9)])
        whole = odd[ends] > odd[begins]
        if whole.any():
            step = np.zeros(len(data) + 1, np.int8)
            step[begins[whole]] += 1
            step[ends[whole]] -= 1
            inside = np.cumsum(step[:-1], dtype=np.int8) > 0
            kind[inside] = 9
            low[inside] = data[inside]
        edge = np.ones(len(data) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[at] = True
        text = kind > 0
        begins = np.flatnonzero(edge[:-1] & text)
        ends = np.flatnonzero(edge[1:] & text) + 1
        bounds = np.searchsorted(begins, at)
        if not len(begins):
            return np.empty(0, np.uint32), np.zeros(len(at), np.int64)
        codes, distinct = pd.factorize(span_hashes(low, begins, ends))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        if len(self.number) + len(distinct) > CACHE_ENTRIES:
            self._clear()
        keys = distinct.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.number]
        if new:
            raw = low.tobytes()
            self._learn([keys[i] for i in new], [raw[begins[first[i]] : ends[first[i]]] for i in new])
        number = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))[codes]
        length = self.length[number]
        total = np.concatenate([[0], np.cumsum(length)])
        place = np.repeat(self.begin[number] - total[:-1], length) + np.arange(total[-1])
        return self.pool[place], total[bounds]

    @staticmethod
    def _latin(data: np.ndarray, kind: np.ndarray, low: np.ndarray) -> None:
        """Two-byte letters U+00C0 to U+00FF count as letters; capitals become small."""
        lead = np.flatnonzero(data[:-1] == 0xC3)
        if len(lead):
            second = data[lead + 1]
            ok = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
            kind[ok] = 1
            kind[ok + 1] = 1
            big = ok[data[ok + 1] <= 0x9E]
            low[big + 1] += 32


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file; later tasks of the worker use it again."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
