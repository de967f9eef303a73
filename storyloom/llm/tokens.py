"""Token ids of whole texts by the tokenizers library, with a cache of units.

A text is cut into units at places where no token can cross: before white space, and
between a Latin letter and ASCII punctuation other than an apostrophe.  A unit's ids do
not depend on what stands around it, so the library encodes each unit once per worker;
units are found and looked up by hash in numpy.  A text in which that is not certain (rare
white space, which a pre-tokenizer may join to a run, or the mark of a special token) is
encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from . import words

#: Bytes of text encoded at once; a longer text is encoded alone.
SLICE = 1 << 21
#: Units kept per worker; the cache starts anew when full.
CACHE_UNITS = 1_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, dtype=bool)
for _a, _b in ((33, 38), (40, 47), (58, 64), (91, 96), (123, 126)):
    _MARK[_a : _b + 1] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_ODD = np.zeros(256, dtype=bool)
_ODD[0x1C:0x20] = _ODD[0xE1:0xE4] = True
_ODD[[0xC2, 0x7C]] = True
_WHOLE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|")


class Encoder:
    """``drops_space``: the tokenizer ignores white space, so units leave it out."""

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.drops_space = drops_space
        self._empty()

    def _empty(self) -> None:
        # Hashes of known units in order, and where each stands in ``at``; 16 bytes a unit.
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.at = np.zeros((2, 1 << 14), dtype=np.int64)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, places: np.ndarray, texts: list[str]) -> None:
        """Adds units by their hashes, which go before ``places`` in the known ones."""
        ids = self._plain(texts)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.known) + len(keys) > self.at.shape[1]:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)], axis=1)
        self.pool[self.used : self.used + len(flat)] = flat
        n = len(self.known)
        self.at[0, n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.at[1, n : n + len(keys)] = sizes
        self.known, self.slot = np.insert(self.known, places, keys), np.insert(self.slot, places, np.arange(n, n + len(keys)))
        self.used += len(flat)

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space, mark, letter = _SPACE[data], _MARK[data], _LETTER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        plain = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        letter[plain] = letter[plain + 1] = True
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1]) | (space[1:] & ~space[:-1])
        cut[offsets] = True
        if self.drops_space:
            cut[1:-1] |= space[:-1] & ~space[1:]
        bounds = np.flatnonzero(cut)
        starts, stops = bounds[:-1], bounds[1:]
        if self.drops_space:
            own = ~space[starts]
            starts, stops = starts[own], stops[own]
        return starts, stops

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, where each text's ids start, with the total at the end)."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(texts + 1, np.int64)
        starts, stops = self._units(data, offsets)
        keys, where = np.unique(words.hashes(data, starts, stops), return_inverse=True)
        if len(self.known) + len(keys) > CACHE_UNITS:
            self._empty()
        places = np.searchsorted(self.known, keys)
        there = np.zeros(len(keys), bool)
        there[places < len(self.known)] = self.known[places[places < len(self.known)]] == keys[places < len(self.known)]
        new = np.flatnonzero(~there)
        if len(new):
            some = np.zeros(len(keys), dtype=np.int64)
            some[where[::-1]] = np.arange(len(where))[::-1]
            some = some[new]
            raw = data.tobytes()
            # A cut never parts the bytes of a character, so each unit decodes alone.
            self._learn(keys[new], places[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[some].tolist(), stops[some].tolist(), strict=True)])
        slot = self.slot[np.searchsorted(self.known, keys)][where] if len(keys) else np.zeros(0, np.int64)
        begin, size = self.at[0, slot], self.at[1, slot]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        bounds = ends[np.searchsorted(starts, offsets)]
        return self._whole_texts(data, offsets, ids, bounds) if _ODD[data].any() else (ids, bounds)

    def _whole_texts(self, data, offsets, ids, bounds):
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(_ODD[data]), side="right") - 1)
        whole = {int(d): x for d in odd if _WHOLE.search(x := data[offsets[d] : offsets[d + 1]].tobytes())}
        if not whole:
            return ids, bounds
        again = dict(zip(whole, self._plain([x.decode("utf-8", "replace") for x in whole.values()]), strict=True))
        parts = [np.array(again[d], "<u4") if d in again else ids[bounds[d] : bounds[d + 1]] for d in range(len(offsets) - 1)]
        return np.concatenate(parts).astype("<u4"), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def batches(self, batch: pa.RecordBatch, column: str):
        """(rows, ids, bounds) for runs of the batch's rows; null texts have no ids."""
        for rows, data, offsets in words.slices(batch, column, SLICE):
            yield rows, *self.encode(data, offsets)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """The worker's own encoder, kept from task to task."""
    key = (path, drops_space)
    if key not in _encoders:
        _encoders[key] = Encoder(path, drops_space)
    return _encoders[key]
