"""Elias-Fano coded monotone sequences with vectorised access and search, and flat files of arrays."""

from __future__ import annotations

import json

import numpy as np

_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_COUNT = _ONES.sum(axis=1).astype(np.uint8)
#: _PLACE[b, r]: position of the r-th one of byte b.
_PLACE = np.stack([np.pad(np.flatnonzero(row), (0, 8 - int(row.sum()))) for row in _ONES]).astype(np.uint64)
_U = np.uint64
#: Masks of a word: every second bit, pair, low half of a byte; a one in each byte; each byte's top bit.
_PAIRS, _FOURS, _BYTES, _EACH = _U(0x5555555555555555), _U(0x3333333333333333), _U(0x0F0F0F0F0F0F0F0F), _U(0x0101010101010101)
_TOPS = _EACH << _U(7)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of the values, one after another, in 64-bit words (and one spare word)."""
    if width == 0 or len(values) == 0:
        return np.zeros(1, np.uint64)
    out = []
    for at in range(0, len(values), 65536):  # a multiple of 64 values ends on a word
        part = values[at : at + 65536]
        bits = ((part[:, None] >> np.arange(width, dtype=np.uint64)) & _U(1)).astype(np.uint8)
        packed = np.packbits(bits.ravel(), bitorder="little")
        out.append(np.pad(packed, (0, -len(packed) % 8)).view(np.uint64))
    return np.concatenate([*out, np.zeros(1, np.uint64)])


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts in unary, zeros counted per word."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros = n, width, low, high, zeros
        self.ones: np.ndarray | None = None  # made of zeros when first asked for

    @staticmethod
    def encode(values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        if n == 0:
            return EliasFano(0, 0, np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.int64))
        width = max(0, (int(values[-1]) // n).bit_length() - 1)
        low = _pack(values & ((_U(1) << _U(width)) - _U(1)), width)
        parts = (values >> _U(width)).astype(np.int64)
        bits = np.zeros(-(-(n + int(parts[-1]) + 2) // 64) * 64, np.uint8)
        bits[parts + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = _COUNT[high.view(np.uint8).reshape(-1, 8)].sum(axis=1, dtype=np.int64)
        zeros = np.concatenate([[0], np.cumsum(64 - ones)[:-1]]).astype(np.int64)
        return EliasFano(n, width, low, high, zeros)

    def decode(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))
        return ((at - np.arange(self.n)).astype(np.uint64) << _U(self.width)) | self._low(np.arange(self.n))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if self.width == 0:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * _U(self.width)
        word, shift = (bit >> _U(6)).astype(np.int64), bit & _U(63)
        over = self.low[word + 1] << ((_U(64) - shift) & _U(63))
        both = (self.low[word] >> shift) | np.where(shift == 0, _U(0), over)
        return both & ((_U(1) << _U(self.width)) - _U(1))

    @staticmethod
    def _nth(words: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Position of the r-th one of each word, by sums of its eight bytes at once."""
        r = r.astype(np.uint64)
        pairs = words - ((words >> _U(1)) & _PAIRS)
        fours = (pairs & _FOURS) + ((pairs >> _U(2)) & _FOURS)
        upto = ((fours + (fours >> _U(4))) & _BYTES) * _EACH  # byte i: ones of bytes 0 to i
        byte = (((((r * _EACH) | _TOPS) - upto) & _TOPS) >> _U(7)) * _EACH >> _U(56)  # bytes that end before it
        place = byte << _U(3)
        before = ((upto << _U(8)) >> place) & _U(255)
        return (place + _PLACE[(words >> place) & _U(255), r - before]).astype(np.int64)

    def _one(self, k: np.ndarray) -> np.ndarray:
        if self.ones is None:
            self.ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(self.ones, k, side="right") - 1
        return word * 64 + self._nth(self.high[word], k - self.ones[word])

    def _zero(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return word * 64 + self._nth(~self.high[word], k - self.zeros[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._one(i) - i).astype(np.uint64) << _U(self.width)) | self._low(i)

    def find(self, x: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Successor search: the first index in [start, end) whose value is x or more; -1 if that isn't x."""
        if self.n == 0 or len(x) == 0:
            return np.full(len(x), -1, np.int64)
        part = (x >> _U(self.width)).astype(np.int64)
        last = len(self.high) * 64 - self.n - 1  # of the zeros there are
        inside = part <= last
        h = np.minimum(part, last)
        lo = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) - (h - 1), 0)
        hi = self._zero(h) - h
        if start is not None:
            lo, hi = np.maximum(lo, start), np.minimum(hi, end)
        stop = np.where(inside, hi, lo)
        hi = stop.copy()
        low = x & ((_U(1) << _U(self.width)) - _U(1))
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        there = np.flatnonzero(lo < stop)
        hit = there[self._low(lo[there]) == low[there]]
        out = np.full(len(x), -1, np.int64)
        out[hit] = lo[hit]
        return out

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.meta": np.array([self.n, self.width], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros}

    @staticmethod
    def of(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width = map(int, arrays[f"{name}.meta"])
        return EliasFano(n, width, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.zeros"])


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """A flat file: a JSON directory, then the arrays, each at a multiple of 64 bytes."""
    at, places = 0, {}
    for name, a in arrays.items():
        places[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(places).encode()
    size = -(-(8 + len(head)) // 64) * 64
    out = [len(head).to_bytes(8, "little"), head, bytes(size - 8 - len(head))]
    for a in arrays.values():
        out += [np.ascontiguousarray(a).tobytes(), bytes(-a.nbytes % 64)]
    return b"".join(out)


def from_buffer(buffer) -> dict[str, np.ndarray]:
    """Views of the arrays of a flat file, for instance of a memory map; nothing is copied."""
    view = memoryview(buffer)
    n = int.from_bytes(view[:8], "little")
    places, size = json.loads(bytes(view[8 : 8 + n])), -(-(8 + n) // 64) * 64
    return {name: np.frombuffer(view, np.dtype(kind), length, size + at) for name, (kind, length, at) in places.items()}
