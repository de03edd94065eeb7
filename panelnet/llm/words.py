"""Words of many texts at once, as arrays: bounds, 64-bit hashes, and a bounded table of known words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes at a time: their arrays stay in a core's cache.
CHUNK = 1 << 16
#: Slots that a table of words begins with.
FIRST_BITS = 18
_LONG = 64
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(_LONG)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, over arrays."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def separators(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def _chunks(buf: bytes, sep: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of buf of about CHUNK bytes that end after a separator, or with buf."""
    at = 0
    while at < len(buf):
        stop = at + CHUNK
        while stop < len(buf):
            found = np.flatnonzero(sep[np.frombuffer(buf, np.uint8, CHUNK, stop - CHUNK)])
            if len(found):
                stop += int(found[-1]) + 1 - CHUNK
                break
            stop += min(CHUNK, max(1, len(buf) - stop))
        stop = min(stop, len(buf))
        yield at, stop
        at = stop


def _hashed(buf: bytes, at: int, stop: int, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(buf, np.uint8, stop - at, at)
    inside = ~sep[a]
    edge = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = ends - starts
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    np.minimum(place, _LONG - 1, out=place)
    v = (a[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[place]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
    h = mix64(total[first + n] - total[first] + n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    for k in np.flatnonzero(n > _LONG):
        h[k] = xxhash.xxh3_64_intdigest(buf[at + starts[k] : at + ends[k]])
    return starts + at, ends + at, h


def hash_words(texts: list[bytes], sep: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, word starts, word ends, word hashes, for each text the number of its first word, and the total).

    The buffer is the texts with a line feed after each, which has to be a separator. Equal words have equal
    hashes; different words share one with a probability of about 2^-64. Words over 64 bytes go through xxh3.
    """
    buf = b"\n".join([*texts, b""])
    found = [_hashed(buf, a, b, sep) for a, b in _chunks(buf, sep)] or [(np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)]
    starts, ends, h = (np.concatenate(x) for x in zip(*found))
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return buf, starts, ends, h, np.searchsorted(starts, bounds)


class WordTable:
    """Hash -> number of a word, open addressing over arrays that grow up to 1 << bits slots; clear() when full() says so."""

    def __init__(self, bits: int = 21, fill: float = 0.55):
        self.fill, self.most = fill, int(fill * (1 << bits))
        self.first = min(bits, FIRST_BITS)
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self._empty(self.first)

    def _empty(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def room(self) -> int:
        return self.most - self.n

    def reserve(self, more: int) -> None:
        """Let the table grow, if need be, so that it takes `more` words: one very long text may need that."""
        while more > self.room():
            self.most *= 2

    def _grow(self) -> None:
        """Twice the slots; words keep their numbers and go over in small parts."""
        held = self.values >= 0
        keys, values = self.keys[held], self.values[held]
        self._empty(self.bits + 1)
        for i in range(0, len(keys), 1 << 16):
            self._place(keys[i : i + (1 << 16)], values[i : i + (1 << 16)])

    def find(self, h: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 where a word is new."""
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.values[slot]
        left = np.flatnonzero((self.keys[slot] != h) & (out >= 0))
        while len(left):
            at = (slot[left] + 1) & mask
            slot[left] = at
            v = self.values[at]
            out[left] = v
            left = left[(self.keys[at] != h[left]) & (v >= 0)]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Numbers for distinct new hashes, in their order."""
        while self.n + len(h) > self.fill * (1 << self.bits):
            self._grow()
        number = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self._place(h, number)
        self.n += len(h)
        return number

    def _place(self, h: np.ndarray, number: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.values[slot[left]] < 0]
            self.values[slot[free]] = number[free]
            won = free[self.values[slot[free]] == number[free]]
            self.keys[slot[won]] = h[won]
            done = np.zeros(len(h), bool)
            done[won] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & mask


class Ragged:
    """Growing rows of numbers, one after another."""

    def __init__(self, dtype):
        self.flat, self.used = np.zeros(1 << 16, dtype), 0
        self.at, self.count, self.n = np.zeros(1 << 14, np.uint32), np.zeros(1 << 14, np.uint32), 0

    def extend(self, rows: list) -> None:
        """Add rows of numbers."""
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self.add(np.fromiter((i for r in rows for i in r), self.flat.dtype, int(lengths.sum())), lengths)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        """Add rows that stand one after another in flat; positions are 32-bit, far above what a table of words holds."""
        total, n = len(flat), len(lengths)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + n > len(self.at):
            self.at, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.count))
        self.flat[self.used : self.used + total] = flat
        self.at[self.n : self.n + n] = self.used + np.cumsum(lengths) - lengths
        self.count[self.n : self.n + n] = lengths
        self.used += total
        self.n += n

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the rows' numbers in a row, the rows' lengths)."""
        n = self.count[rows].astype(np.int64)
        place = np.arange(int(n.sum())) + np.repeat(self.at[rows].astype(np.int64) - (np.cumsum(n) - n), n)
        return self.flat[place], n
