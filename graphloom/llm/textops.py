"""Whole-text word splitting and hashing over Arrow batches.

Every operator here sees documents through ``chunks``: slices of a partition of
about ``limit`` bytes of text, so that numpy's temporaries stay bounded whatever
Spark's batch size is. A document is never cut; a single one larger than
``limit`` makes a chunk of its own.

Words are runs of ``[^\\x20\\x09-\\x0D]`` (what ``bytes.split`` splits on), hashed
to 64 bits with eight bytes a step.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 2 << 20
LARGE_CHUNK = 4 << 20  # where equal things are better met in one chunk
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_GOLDEN = U64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_LONG_WORD = 512


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64's constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Tables of consecutive rows with their texts as bytes; a null text is b""."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> tuple[pa.Table, list[bytes]]:
        table = pa.Table.from_batches(held)
        return table, [x or b"" for x in table.column(text).cast(pa.large_binary()).to_pylist()]

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        at = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > limit:
                held.append(batch.slice(at, i - at))
                yield out()
                held, size, at = [], 0, i
            size += n
        held.append(batch.slice(at))
    if size:
        yield out()
    held.clear()
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system (glibc), so that an idle worker does not keep it."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Words:
    """Words of some documents: byte spans [start, end) in data; first[d]:first[d + 1] are those of document d."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.data = np.frombuffer(b"\n".join(texts) + b"\n" * 9, dtype=np.uint8)
        edges = np.flatnonzero(np.diff(SPACE[self.data].view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edges[0::2], edges[1::2]
        self.doc_at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
        self.first = np.searchsorted(self.start, self.doc_at)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.texts), dtype=np.int64), self.count)

    def hashes(self, data: np.ndarray | None = None, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64 bits for each word; data: the same bytes after a length-preserving change such as lower-casing; start, end: other spans."""
        data = self.data if data is None else data
        return hash_spans(data, self.start if start is None else start, self.end if end is None else end)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each byte span; at least eight bytes must follow the last span."""
    if not len(start):
        return np.empty(0, U64)
    eight = np.ndarray(len(data) - 7, dtype="<u8", buffer=data.data if data.flags.c_contiguous else np.ascontiguousarray(data).data, strides=(1,))
    length = end - start
    h = mix(length.astype(U64) * _GOLDEN)
    left, at, which = length, start, None
    while True:
        part = np.minimum(left, 8)
        word = eight[at] & (~U64(0) >> ((8 - part) * 8).astype(U64)) * (part > 0)
        if which is None:
            h = mix((h ^ word) * _GOLDEN + U64(1))
        else:
            h[which] = mix((h[which] ^ word) * _GOLDEN + U64(1))
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        which = more if which is None else which[more]
        left, at = left[more] - 8, at[more] + 8
        if (long := left > _LONG_WORD).any():
            for k in np.flatnonzero(long):
                rest = data[at[k] : at[k] + left[k]].tobytes()
                h[which[k]] ^= U64(int.from_bytes(hashlib.blake2b(rest, digest_size=8).digest(), "little"))
            which, left, at = which[~long], left[~long], at[~long]
            if not len(which):
                return h


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z in lower case; other bytes, and so all positions, stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


class Rolling:
    """Hashes of any run of consecutive values in constant time: differences of prefix sums of value * base^i modulo 2^64."""

    _power = np.ones(1, U64)
    _inverse = np.ones(1, U64)

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        if len(Rolling._power) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                Rolling._power = np.cumprod(np.concatenate(([U64(1)], np.full(size - 1, _BASE, U64))), dtype=U64)
                Rolling._inverse = np.cumprod(np.concatenate(([U64(1)], np.full(size - 1, pow(_BASE, -1, 1 << 64), U64))), dtype=U64)
        self.sums = np.concatenate(([U64(0)], np.cumsum(values * Rolling._power[: n - 1], dtype=U64)))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Rolling._inverse[start] + (end - start).astype(U64) * _GOLDEN)

    def windows(self, k: int) -> np.ndarray:
        """One for each k consecutive values, by the position of the first."""
        n = len(self.sums) - k
        if n <= 0:
            return np.empty(0, U64)
        return mix((self.sums[k:] - self.sums[:n]) * Rolling._inverse[:n] + np.full(1, k, U64) * _GOLDEN)


def inside(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Positions at which k consecutive words lie in one document."""
    ok = np.ones(max(total - k + 1, 0), dtype=bool)
    for j in range(1, k):  # a window that starts j words before a document's first word runs over it
        at = first[1:-1] - j
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then those of start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)


def packed_by(shard: np.ndarray, n: int, *arrays: np.ndarray) -> list[pa.Array]:
    """For arrays sorted by shard: columns with one binary value for each of n shards."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(shard, minlength=n))))
    return [pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((offsets * a.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(a))]) for a in arrays]


def same_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """Whether the bytes of each span of a are those of the span of b of the same length."""
    same = np.ones(len(length), bool)
    for lo in range(0, len(length), block):
        s = slice(lo, lo + block)
        n = length[s]
        filled = np.flatnonzero(n)
        if len(filled):
            equal = a[ragged(a_start[s][filled], n[filled])] == b[ragged(b_start[s][filled], n[filled])]
            same[lo + filled] = np.logical_and.reduceat(equal, np.concatenate(([0], np.cumsum(n[filled])[:-1])))
    return same


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, from 0, equal exactly where the bytes are; and a span with each number."""
    _, first, number = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
    number = number.reshape(-1)
    model = first[number]
    length = end - start
    other = np.flatnonzero((length != length[model]) | ~same_spans(data, start, data, start[model], np.minimum(length, length[model])))
    if len(other):  # two contents with one hash
        seen: dict[bytes, int] = {}
        for i in other:
            number[i] = seen.setdefault(data[start[i] : end[i]].tobytes(), len(first) + len(seen))
        first = np.concatenate((first, np.array([other[np.flatnonzero(number[other] == len(first) + k)[0]] for k in range(len(seen))], first.dtype)))
    return number, first
