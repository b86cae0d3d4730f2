"""Words of many texts at once: positions and hashes of ``[^\\x20\\x09-\\x0D]+`` in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
WORD = ~WHITE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE = 1 << 20  # bytes hashed together, so that temporary arrays stay small whatever a text's length


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offset of every text; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count or column.type not in (pa.binary(), pa.string()):
        column = column.cast(pa.binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _tables(seed: int, lower: bool) -> tuple[np.ndarray, np.uint64]:
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    values[WHITE] = 0
    if lower:
        values = values[LOWER]
    return values, mixed(np.array([seed + 12345], np.uint64))[0] | np.uint64(1)


class WordHashes:
    """64-bit hashes of the words of texts, with A-Z lower-cased if asked; equal for equal words in every process."""

    def __init__(self, seed: int = 1, lower: bool = True):
        self.values, self.base = _tables(seed, lower)
        self.powers = np.ones(1, np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        if len(self.powers) < n:
            out = np.full(max(n, 2 * len(self.powers), 256), self.base)
            out[0] = 1
            self.powers = np.cumprod(out)
        return self.powers

    def _piece(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = WORD[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        first[bounds] = word[bounds]
        starts = np.flatnonzero(first)
        if not len(starts):
            return starts, np.zeros(0, np.uint64)
        place = np.arange(starts[0], len(data), dtype=np.int64)
        lengths = np.diff(np.append(starts, len(data)))
        place -= np.repeat(starts, lengths)
        place[~word[starts[0]:]] = 0
        terms = self.values[data[starts[0]:]]
        terms *= self._powers(int(place.max()) + 1)[place]
        return starts, mixed(np.add.reduceat(terms, starts - starts[0]))

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and for every text the index of its first word (one more entry at the end)."""
        starts, hashes, at, n = [], [], 0, len(data)
        while at < n:
            end = min(at + PIECE, n)
            while end < n and WORD[data[end]] and WORD[data[end - 1]]:  # a word is never cut
                white = np.flatnonzero(WHITE[data[end:end + 4096]])
                end = end + int(white[0]) if len(white) else min(end + 4096, n)
            bounds = offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, end)] - at
            s, h = self._piece(data[at:end], bounds)
            starts.append(s + at)
            hashes.append(h)
            at = end
        where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(where, offsets)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of one text."""
    word = WORD[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
