"""Periodic runs of words, found in a grammar-compressed text.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least ``LEAST`` words and
``TIMES`` periods. The words of a chunk of documents are numbered and compressed by Re-Pair: of all pairs of neighbours
those that occur most often become new symbols, again and again, until no pair occurs twice; what is left is paired to a
balanced tree. A round takes at once all pairs that win against every pair they share a symbol with crosswise, so that
no two occurrences overlap, and a text shrinks in few rounds. Pairs never join two documents.

Every run has one node of this derivation that is the lowest to hold all of it, so the run crosses the boundary between
that node's two parts. For each new symbol, once, whatever its number of occurrences: for each period q the q words on
one side of the boundary are compared with the q words beyond them (a run of four periods has two on one side); what is
equal, and no power of something shorter, is extended both ways within the symbol by binary search. Stretches are
compared by two hashes (modulo 2^64 and a prime), what is found is compared word by word. The intervals are then
translated to all places at which the symbol was derived, and overlapping intervals of one period are merged.

Scale: no shuffle; a chunk holds some megabytes of text or one document, at some 150 bytes a word. A document of n words
takes n log n steps, a repetitive one less. The result does not depend on how documents are dealt to chunks.

Cases: a null or empty text has no words and no runs. Null and repeated doc_ids give a row each. Words are bytes, compared
exactly. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .textops import U64, Rolling, Words, chunks, mix, numbered, ragged

LEAST, TIMES = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_PRIME, _BASE = U64((1 << 31) - 1), U64(1_103_515_245)
_BLOCK = 1 << 20  # pairs of a boundary and a period that are looked at together


class Stretches:
    """Comparison of stretches of a sequence of numbers."""

    def __init__(self, numbers: np.ndarray):
        value = mix(numbers.astype(U64) + U64(1))
        self.rolling = Rolling(value)
        n = len(numbers)
        self.power = np.ones(n + 1, U64)
        done, step = 1, _BASE
        while done <= n:
            more = min(done, n + 1 - done)
            self.power[done : done + more] = self.power[:more] * step % _PRIME
            done, step = 2 * done, step * step % _PRIME
        self.sums = np.concatenate((np.zeros(1, U64), np.cumsum(value % _PRIME * self.power[:n] % _PRIME) % _PRIME))

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether length numbers from a are those from b; a <= b."""
        same = self.rolling.spans(a, a + length) == self.rolling.spans(b, b + length)
        at = np.flatnonzero(same)
        a, b, length = a[at], b[at], length[at]
        left = (self.sums[a + length] + _PRIME - self.sums[a]) % _PRIME * self.power[b - a] % _PRIME
        same[at] = left == (self.sums[b + length] + _PRIME - self.sums[b]) % _PRIME
        return same

    def longest(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, backward: bool = False) -> np.ndarray:
        """How many numbers from a (or before it) equal those from b (or before it), at most most; a < b."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            half = (low[open_] + high[open_] + 1) // 2
            x, y = (a[open_] - half, b[open_] - half) if backward else (a[open_], b[open_])
            same = self.equal(x, y, half)
            low[open_] = np.where(same, half, low[open_])
            high[open_] = np.where(same, high[open_], half - 1)
        return low


def derivation(numbers: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The rounds of Re-Pair and of the tree above it: of each occurrence of the round's new symbols the symbol (from 0), its begin, boundary and end."""
    n = len(numbers)
    symbol, doc, begin = numbers.astype(np.int64), doc.copy(), np.append(np.arange(n), n)
    new = int(symbol.max(initial=-1)) + 1
    open_ = np.ones(n, bool)  # the pair that begins here may occur twice

    def joined(first: np.ndarray, number: np.ndarray) -> None:
        nonlocal symbol, doc, begin, open_, new
        symbol[first] = new + number
        open_[first] = True
        open_[np.maximum(first - 1, 0)] = True
        keep = np.ones(len(symbol), bool)
        keep[first + 1] = False
        symbol, doc, open_, begin = symbol[keep], doc[keep], open_[keep], np.append(begin[:-1][keep], n)
        new += int(number.max()) + 1

    while True:
        at = np.flatnonzero(open_[:-1] & (doc[:-1] == doc[1:]))
        pair, which, count = np.unique(symbol[at] * new + symbol[at + 1], return_inverse=True, return_counts=True)
        which = which.reshape(-1)
        twice = count > 1
        open_[at] = twice[which]
        if not twice.any():
            break
        order = np.lexsort((mix(pair.astype(U64)), count))
        order = order[twice[order]]
        a, b = pair // new, pair % new
        left, right = np.full(new, -1), np.full(new, -1)
        left[a[order]] = np.arange(len(order))  # the last one stays: the best pair with the symbol on this side
        right[b[order]] = np.arange(len(order))
        own = np.full(len(pair), -1)
        own[order] = np.arange(len(order))
        wins = twice & np.where(a == b, (left[a] == own) & (right[b] == own), (left[a] > right[a]) & (right[b] > left[b]))
        taken = np.flatnonzero(wins[which])
        first, number = at[taken], which[taken]
        same = np.flatnonzero((a == b)[number])  # of c c c c the first and third
        if len(same):
            group = np.flatnonzero(np.diff(first[same], prepend=-9) != 1)
            odd = (first[same] - np.repeat(first[same][group], np.diff(np.append(group, len(same))))) % 2 == 1
            first, number = np.delete(first, same[odd]), np.delete(number, same[odd])
        _, number = np.unique(number, return_inverse=True)
        number = number.reshape(-1)
        yield number, begin[first], begin[first + 1], begin[first + 2]
        joined(first, number)
    while len(symbol) > 1:
        place = np.arange(len(symbol)) - np.searchsorted(doc, doc)
        first = np.flatnonzero((place[:-1] % 2 == 0) & (doc[:-1] == doc[1:]))
        if not len(first):
            return
        number = np.arange(len(first))
        yield number, begin[first], begin[first + 1], begin[first + 2]
        joined(first, number)


def _smallest_factors(n: int) -> np.ndarray:
    factor = np.arange(n + 1)
    for p in range(2, int(n**0.5) + 1):
        if factor[p] == p:
            part = factor[p * p :: p]
            part[part == np.arange(p * p, n + 1, p)] = p
    return factor


def crossing(numbers: np.ndarray, stretches: Stretches, factors: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The node, begin, end and period of what is periodic within [begin, end) and meets the boundary middle, of a length for a run, primitive periods only."""
    found = []
    quarter = (end - begin) // TIMES
    for side, room in enumerate((np.minimum((end - middle) // 2, quarter), np.minimum((middle - begin) // 2, quarter))):
        nodes = np.flatnonzero((room > 0) & (end - begin >= LEAST))
        total = np.cumsum(room[nodes])
        lo = 0
        while lo < len(nodes):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _BLOCK, side="right")))
            part, lo = nodes[lo:hi], hi
            q = ragged(np.ones(len(part), np.int64), room[part])
            node = np.repeat(part, room[part])
            m = middle[node]
            near = np.flatnonzero(numbers[m] == numbers[m + q] if side == 0 else numbers[m - 1] == numbers[m - 1 - q])
            node, q, m = node[near], q[near], m[near]
            x = m if side == 0 else m - 2 * q
            ok = np.flatnonzero(stretches.equal(x, x + q, q))
            node, q, x = node[ok], q[ok], x[ok]
            rest, whole = q.copy(), np.ones(len(q), bool)
            while (more := np.flatnonzero(rest > 1)).size:
                r = factors[rest[more]]
                shorter = q[more] // r
                whole[more] &= ~stretches.equal(x[more], x[more] + shorter, 2 * q[more] - shorter)
                rest[more] //= r
                rest[~whole] = 1
            node, q, x = node[whole], q[whole], x[whole]
            left = stretches.longest(x, x + q, x - begin[node], backward=True)
            right = stretches.longest(x, x + q, end[node] - x - q)
            s, e = x - left, x + right + q
            long = np.flatnonzero(e - s >= np.maximum(LEAST, TIMES * q))
            for i in long:  # word by word, where the hashes were wrong
                if not np.array_equal(numbers[s[i] : e[i] - q[i]], numbers[s[i] + q[i] : e[i]]):
                    differ = begin[node[i]] + np.flatnonzero(numbers[begin[node[i]] : end[node[i]] - q[i]] != numbers[begin[node[i]] + q[i] : end[node[i]]])
                    s[i] = max(differ[differ < x[i]], default=begin[node[i]] - 1) + 1
                    e[i] = min(differ[differ >= x[i]], default=end[node[i]] - q[i]) + q[i]
            long = long[e[long] - s[long] >= np.maximum(LEAST, TIMES * q[long])]
            found.append((node[long], s[long], e[long], q[long]))
    if not found:
        return (np.empty(0, np.int64),) * 4
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def runs_of(numbers: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and period of all runs of a sequence of numbers, none over two documents, by begin and period; doc: the document of each, ascending."""
    pieces = []
    if len(numbers) >= LEAST:
        stretches, factors = Stretches(numbers), _smallest_factors(len(numbers) // TIMES)
        for number, begin, middle, end in derivation(numbers, doc):
            _, model = np.unique(number, return_index=True)
            node, s, e, q = crossing(numbers, stretches, factors, begin[model], middle[model], end[model])
            if not len(node):
                continue
            order = np.argsort(number, kind="stable")
            first = np.searchsorted(number[order], node)
            many = np.searchsorted(number[order], node, side="right") - first
            place = order[ragged(first, many)]  # all occurrences of the symbol of each interval
            shift = begin[place] - np.repeat(begin[model][node], many)
            pieces.append((np.repeat(s, many) + shift, np.repeat(e, many) + shift, np.repeat(q, many)))
    if not pieces:
        return (np.empty(0, np.int64),) * 3
    s, e, q = map(np.concatenate, zip(*pieces, strict=True))
    order = np.lexsort((s, q))
    s, e, q = s[order], e[order], q[order]
    far = q * (len(numbers) + 1)  # periods apart
    last = np.maximum.accumulate(e + far)
    new = np.append(True, s[1:] + far[1:] > last[:-1] - q[1:])
    group = np.flatnonzero(new)
    s, e, q = s[group], np.maximum.reduceat(e, group), q[group]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def planted(ids: list[int | None], first: np.ndarray) -> np.ndarray:
    """For each word the word that stands in its place: one in ten documents, by its doc_id, is periodic from some word on; first: of each document's words."""
    at = np.arange(first[-1])
    for d, i in enumerate(ids):
        h = None if i is None else zlib.crc32(str(i).encode())
        n = int(first[d + 1] - first[d])
        if h is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[first[d] + a : first[d + 1]] = first[d] + a + np.arange(n - a) % p
    return at


def found(docs: DataFrame, changed: Callable[[list, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and period), collapsed: the text's words but those that a run holds after its first period, joined by spaces.

    changed: gives the word that stands in each word's place (see planted).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in chunks(batches):
            words = Words(texts)
            number, _ = numbered(words.data, words.start, words.end)
            at = np.arange(len(words)) if changed is None else changed(table.column("doc_id").to_pylist(), words.first)
            s, e, q = runs_of(number[at], words.doc())
            own = np.searchsorted(words.first, s, side="right") - 1
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, s + q, 1)
            np.add.at(gone, e, -1)
            kept = at[np.cumsum(gone[:-1]) == 0]
            size = np.searchsorted(np.flatnonzero(np.cumsum(gone[:-1]) == 0), words.first)
            raw, begin, stop = words.data.tobytes(), words.start[kept].tolist(), words.end[kept].tolist()
            texts_ = [b" ".join([raw[a:b] for a, b in zip(begin[x:y], stop[x:y], strict=True)]) for x, y in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
            rows = pa.StructArray.from_arrays([pa.array(s - words.first[own]), pa.array(e - s), pa.array(q)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(texts) + 1)), pa.int32()), rows)
            yield from pa.table([table.column("doc_id"), pa.array(words.count.astype(np.int64)), lists, pa.array(texts_, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"]).to_batches()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed binary"
    return runtime.texts_of(docs, "doc_id").mapInArrow(run, schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, one in ten of them made periodic: how many, the longest, digests of all and of what is left without repetitions."""
    rows = found(runtime.table(spark, sf_dir, "documents"), planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") == 0, F.lit("")).otherwise(F.concat(lines, F.lit("\n")))
    rows = rows.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
