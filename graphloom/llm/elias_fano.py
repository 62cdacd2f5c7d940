"""Elias-Fano sequences of rising integers, and files of arrays that are read through a memory map.

A sequence of n integers below u is kept in about 2 + log2(u / n) bits each: the low bits packed,
the high bits in unary. Counts of ones and zeros before each 64-bit word of the latter (a bit and
a half an integer) turn select into one binary search and six steps inside a word, for any number
of queries at once.
"""

from __future__ import annotations

import json
import mmap
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs

U64 = np.uint64


def _leading_zeros(word: np.ndarray) -> np.ndarray:
    alone = word & ~(word >> U64(1))  # the first one stays, the next bit is clear, so that no rounding carries
    return 64 - np.frexp(alone.astype(np.float64))[1].astype(np.int64)


class EliasFano:
    def __init__(self, n: int, width: int, size: int, lows: np.ndarray, upper: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        """size: one more than the largest integer that may be asked for."""
        self.n, self.width, self.size, self.upper, self.ones, self.zeros = n, width, size, upper, ones, zeros
        self.eight = np.ndarray(max(len(lows) - 7, 0), dtype="<u8", buffer=lows, strides=(1,))
        self.lows = lows

    @classmethod
    def of(cls, values: np.ndarray, size: int) -> EliasFano:
        """values rise, equal ones are allowed."""
        values, n, size = values.astype(U64), len(values), max(1, int(size))
        width = max(0, (size // max(n, 1)).bit_length() - 1)
        high = (values >> U64(width)).astype(np.int64)
        bits = np.zeros(-(-(n + ((size - 1) >> width) + 1) // 64) * 64, bool)
        bits[high + np.arange(n)] = True
        upper = np.packbits(bits, bitorder="little").view("<u8")
        before = np.cumsum(np.bitwise_count(upper), dtype=np.int64)
        ones = np.concatenate(([0], before)).astype(np.uint32)
        zeros = np.concatenate(([0], 64 * np.arange(1, len(upper) + 1) - before)).astype(np.uint32)
        low = values & U64((1 << width) - 1)
        parts = [np.packbits(((low[i : i + 65536, None] >> np.arange(width, dtype=U64)) & U64(1)).astype(np.uint8), bitorder="little") for i in range(0, n if width else 0, 65536)]
        return cls(n, width, size, np.concatenate([*parts, np.zeros(8, np.uint8)]), upper, ones, zeros)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.lows": self.lows, f"{name}.upper": self.upper, f"{name}.ones": self.ones, f"{name}.zeros": self.zeros, f"{name}.shape": np.array([self.n, self.width, self.size], np.int64)}

    @classmethod
    def read(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width, size = arrays[f"{name}.shape"].tolist()
        return cls(n, width, size, *(arrays[f"{name}.{k}"] for k in ("lows", "upper", "ones", "zeros")))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U64)
        bit = i * self.width
        return (self.eight[bit >> 3] >> (bit & 7).astype(U64)) & U64((1 << self.width) - 1)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the one or zero number k."""
        before = self.ones if one else self.zeros
        at = np.searchsorted(before, k.astype(np.uint32), side="right") - 1
        word = self.upper[at] if one else ~self.upper[at]
        left, inside = (k - before[at]).astype(np.uint8), np.zeros(len(k), np.uint8)
        for i in (5, 4, 3, 2, 1, 0):  # halves of what is left of the word
            count = np.bitwise_count(word & U64((1 << (1 << i)) - 1))
            further = (left >= count).view(np.uint8)
            left -= count * further
            further <<= np.uint8(i)
            inside += further
            if i:
                word >>= further.astype(U64)
        return (at << 6) + inside

    def _ones_before(self, place: np.ndarray) -> np.ndarray:
        """How many ones stand right before a place in the high bits."""
        at, bit = place >> 6, (place & 63).astype(U64)
        word = ~(self.upper[at] << (U64(63) - bit) << U64(1))  # the bits before it at the top
        word[bit == 0] = ~U64(0)
        zeros = np.minimum(_leading_zeros(word), bit.astype(np.int64))
        more = np.flatnonzero((zeros == bit.astype(np.int64)) & (at > 0))
        while len(more):
            word = ~self.upper[at[more] - 1]
            add = _leading_zeros(word)
            zeros[more] += add
            at[more] -= 1
            more = more[(add == 64) & (at[more] > 0)]
        return zeros

    def get(self, i: np.ndarray) -> np.ndarray:
        if not len(i):
            return np.empty(0, np.int64)
        return ((self._select(i, True) - i) << self.width) | self._low(i).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, by a successor search among those with its high bits; -1: not there. The integers differ."""
        out = np.full(len(keys), -1, np.int64)
        asked = np.flatnonzero((keys >= 0) & (keys < self.size)) if keys.dtype != U64 else np.flatnonzero(keys < U64(self.size))
        if not self.n or not len(asked):
            return out
        key = keys[asked].astype(U64)
        high = (key >> U64(self.width)).astype(np.int64)
        place = self._select(high, False)
        end = place - high
        low = end - self._ones_before(place)
        goal, stop, top = key & U64((1 << self.width) - 1), end, end.copy()
        open_ = np.flatnonzero(low < top)
        while len(open_):
            middle = (low[open_] + top[open_]) >> 1
            less = self._low(middle) < goal[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            top[open_] = np.where(less, top[open_], middle)
            open_ = open_[low[open_] < top[open_]]
        inside = np.flatnonzero(low < stop)
        hit = inside[self._low(low[inside]) == goal[inside]]
        out[asked[hit]] = low[hit]
        return out


def write_arrays(uri: str, arrays: dict[str, np.ndarray], **meta: object) -> None:
    """A file of arrays; it appears whole, so a task that runs twice does no harm."""
    header, at = {}, 0
    for name, a in arrays.items():
        header[name] = (a.dtype.str, at, len(a))
        at += -(-a.nbytes // 8) * 8
    head = json.dumps({"arrays": header, "meta": meta}).encode()
    head += b" " * (-len(head) % 8)
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(len(head).to_bytes(8, "little"))
        f.write(head)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).data)
            f.write(b"\0" * (-a.nbytes % 8))
    fs.move(part, path)


def map_arrays(uri: str) -> tuple[dict[str, np.ndarray], dict]:
    """The arrays of a file through a memory map. From a store that cannot be mapped, the file is first copied to one without a name."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        f = open(path, "rb")
    else:
        f = tempfile.TemporaryFile()
        with fs.open_input_stream(path) as source:
            while part := source.read(1 << 24):
                f.write(part)
        f.flush()
    with f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    n = int.from_bytes(data[:8], "little")
    head = json.loads(data[8 : 8 + n])
    return {k: np.frombuffer(data, dtype, count, 8 + n + at) for k, (dtype, at, count) in head["arrays"].items()}, head["meta"]
