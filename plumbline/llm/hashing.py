"""Hashes of words and word shingles over Arrow string columns, with no Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SLICE_BYTES = 2 << 20
TOKEN_BITS = 58

# Kinds of bytes: 0 parts words. The plain kinds know words only, the fine ones letters (with all
# bytes beyond ASCII), digits and symbols.
PLAIN = np.ones(256, np.uint8)
PLAIN[[0x20, 9, 10, 11, 12, 13]] = 0
FINE = np.where(PLAIN > 0, np.uint8(3), np.uint8(0))
FINE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
FINE[48:58] = 2
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def draws(seed: int, count: int) -> np.ndarray:
    """Fixed pseudo-random odd numbers."""
    start = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(start + np.uint64(seed)) | np.uint64(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each value's bounds; null reads as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of a string column in runs of rows of about ``limit`` bytes.

    What is computed from the texts is several times their size, so it is done run by run.
    """
    data, offsets = utf8(column)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class WordHasher:
    """Hashes of the words of many texts at once.

    A word is a run of bytes of one kind other than 0. Its hash is a polynomial in its bytes, read off
    running sums, so the cost per byte is a few array operations. A-Z count as a-z. Texts are taken in
    chunks that end between words, so memory does not depend on how long a text is.
    """

    def __init__(self, kinds: np.ndarray = PLAIN) -> None:
        self.kinds = kinds
        table = draws(1, 256)
        table[65:91] = table[97:123]
        self.table = table
        self.step = np.uint64(0xD1342543DE82EF95)
        self.back = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
        self._grow(CHUNK_BYTES)

    def _grow(self, size: int) -> None:
        ones = np.full(size, self.step, np.uint64)
        ones[0] = 1
        self.power = np.cumprod(ones)
        ones = np.full(size, self.back, np.uint64)
        ones[0] = 1
        self.inverse = np.cumprod(ones)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of its text) of every word, in order."""
        return self.shaped(data, offsets)[:2]

    def shaped(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, index of its text, shape) of every word.

        A shape holds the kind, whether no, the first, all or some letters are A-Z, and the length up
        to 15.
        """
        found, owners, shapes = [], [], []
        lo, total = 0, len(data)
        while lo < total:
            hi = min(lo + CHUNK_BYTES, total)
            if hi < total and hi not in offsets[np.searchsorted(offsets, hi) :][:1]:
                hi = self._border(data, offsets, lo, hi)
            if hi - lo > len(self.power):
                self._grow(hi - lo)
            h, starts, shape = self._chunk(data, offsets, lo, hi)
            found.append(h)
            shapes.append(shape)
            owners.append(np.searchsorted(offsets, starts, "right") - 1)
            lo = hi
        if not found:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found), np.concatenate(owners), np.concatenate(shapes)

    def _border(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> int:
        """The next place from ``hi`` on where no word is cut."""
        end = int(offsets[np.searchsorted(offsets, hi, "left")])
        while hi < end:
            step = min(hi + 4096, end)
            spaces = np.flatnonzero(self.kinds[data[hi:step]] == 0)
            if len(spaces):
                return hi + int(spaces[0])
            hi = step
        return end

    def _chunk(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        part = data[lo:hi]
        kind = self.kinds[part]
        first = np.ones(len(part), bool)
        first[1:] = kind[1:] != kind[:-1]
        cuts = offsets[(offsets > lo) & (offsets < hi)] - lo
        first[cuts] = True
        last = np.ones(len(part), bool)
        last[:-1] = first[1:]
        starts = np.flatnonzero(first & (kind > 0))
        ends = np.flatnonzero(last & (kind > 0))
        running = np.cumsum(self.table[part] * self.power[: len(part)])
        before = running[starts - 1]
        if len(starts) and starts[0] == 0:
            before[0] = 0
        hashes = mix((running[ends] - before) * self.inverse[starts])
        if self.kinds is PLAIN:
            return hashes, starts + lo, np.zeros(0, np.int64)
        upper = np.cumsum(_UPPER[part])
        capitals = upper[ends] - upper[starts] + _UPPER[part[starts]]
        size = ends - starts + 1
        opens = _UPPER[part[starts]]
        case = np.where(capitals == 0, 0, np.where(capitals == size, 2, np.where((capitals == 1) & (opens == 1), 1, 3)))
        return hashes, starts + lo, (kind[starts].astype(np.int64) << 8) | (case << 4) | np.minimum(size, 15)

    def shingles(self, data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(token, index of its text) of every run of ``width`` words; shorter texts are one run.

        Tokens have 58 bits.
        """
        words, owner = self.words(data, offsets)
        weights = draws(2, width)
        count = np.bincount(owner, minlength=len(offsets) - 1)
        if len(words) >= width:
            size = len(words) - width + 1
            total = np.zeros(size, np.uint64)
            for i in range(width):
                total += words[i : i + size] * weights[i]
            whole = owner[: size] == owner[width - 1 :]
            tokens, owners = mix(total[whole]), owner[:size][whole]
        else:
            tokens, owners = np.empty(0, np.uint64), np.empty(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            at = np.searchsorted(owner, short)
            more = np.array(
                [
                    (words[a : a + c] * weights[:c]).sum(dtype=np.uint64) + np.uint64(c)
                    for a, c in zip(at, count[short], strict=True)
                ],
                np.uint64,
            )
            tokens, owners = np.concatenate([tokens, mix(more)]), np.concatenate([owners, short])
            order = np.argsort(owners, kind="stable")
            tokens, owners = tokens[order], owners[order]
        return tokens >> np.uint64(64 - TOKEN_BITS), owners
