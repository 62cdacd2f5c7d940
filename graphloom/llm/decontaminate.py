"""Benchmark decontamination by spaced seeds.

A spaced seed is a hash of the tokens at the 1-positions of a fixed mask; the 0-positions
may differ, so a hit survives substitutions that break every n-gram. The seeds of all
benchmark items are held against those of every document. Around each hit document and item are laid
side by side and the run with the most equal tokens is taken, of those in which at least three
quarters are equal: with ``min_overlap`` equal tokens in it, or four fifths of an item's tokens
if these are fewer, document and item overlap. Besides MASKS (items of 13 tokens or more), each
item has masks of its own length, or of SPAN tokens in a longer one: the span is cut into two
blocks more than substitutions are tolerated in it, and each pair of blocks is a mask, so that
two blocks are always whole. No copy of an item of up to SPAN tokens within the tolerance is
missed, nor SPAN tokens in a row of which at most four differ (tokens that a document does not
have, before its first and after its last, count as different). An item of fewer than
``min_tokens`` tokens is no evidence and is not looked for.

Tokens are words in lower case (A-Z), without what is not a letter or digit at their ends;
words of nothing else are left out.

Scale: the documents are never shuffled. The benchmark is collected only in blocks of at most
``block_bytes`` of text. A larger one takes a pass over the documents for each block; every pass is
written, and its block given up, before the next begins, so memory does not grow with the benchmark.
Repetitive texts: places of a document around which the same tokens stand are one place, and equal
stretches of a document are held against an item once.

Cases: null or empty texts overlap with nothing; rows with a null doc_id are reported with
it; repeated rows or items are reported by themselves, once for each document row and item_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .textops import U64, Words, chunks, hash_spans, lower_ascii, mix, ragged

MASKS = ("1101100101011", "1110010110011", "1011101001101", "1111000011101")
MIN_TOKENS = 8
MIN_OVERLAP = 13
SPAN = 17
SUBSTITUTED = 4  # at most in SPAN tokens
FOLD = 4  # hits for each token of a document, from which on its equal places are folded
BLOCK_BYTES = 4 << 20  # of text; its seeds take some 35 times as much memory
HITS = "doc_id long, item_id long, at long, length long, matched long"
_MULTIPLIER = U64(0xD6E8FEB86659FD93)
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts, the first token of each (and the end), and each token's word number."""
    words = Words(texts)
    data = lower_ascii(words.data)
    alnum = _ALNUM[data]
    place, before = np.append(np.flatnonzero(alnum), len(data)), np.concatenate(([0], np.cumsum(alnum)))
    start, last = place[before[words.start]], place[before[words.end] - 1]
    some = before[words.end] > before[words.start]
    hashes = hash_spans(data, start[some], last[some] + 1)
    number = np.flatnonzero(some)
    first = np.searchsorted(number, words.first)
    return hashes, first, number - np.repeat(words.first[:-1], np.diff(first))


def _seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """One for each position at which the mask fits into all tokens."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, U64)
    h = np.full(n, len(mask), U64)
    for i in range(len(mask)):
        if mask[i] == "1":
            h = h * _MULTIPLIER + hashes[i : i + n]
    return mix(h)


def needed(n: int, min_overlap: int = MIN_OVERLAP) -> int:
    """Equal tokens that an item of n tokens needs."""
    return min(min_overlap, -(-4 * n // 5))


def _masks(n: int) -> list[str]:
    """Masks of n tokens, one of which hits whichever of the tolerated number of tokens differ."""
    blocks = np.array_split(np.arange(n), n - needed(n) + 2)
    return ["".join("1" if i in pair else "0" for i in range(n)) for pair in (set(np.concatenate(two).tolist()) for two in combinations(blocks, 2))]


class Sums:
    """Hashes of any stretch of a sequence, by sums of its members times powers of an odd number."""

    def __init__(self, values: np.ndarray):
        power = np.full(len(values) + 1, _MULTIPLIER)
        power[0] = U64(1)
        self.inverse = np.full(len(values) + 1, U64(pow(int(_MULTIPLIER), -1, 1 << 64)))
        self.inverse[0] = U64(1)
        power, self.inverse = np.cumprod(power), np.cumprod(self.inverse)
        self.total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(values + U64(1)) * power[:-1])))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        end = np.maximum(begin, end)
        return mix((self.total[end] - self.total[begin]) * self.inverse[begin] + (end - begin).astype(U64))


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """The place of the first of each different key, in rising order."""
    order = np.lexsort(keys[::-1])
    lead = np.ones(len(order), bool)
    lead[1:] = False
    for k in keys:
        lead[1:] |= k[order][1:] != k[order][:-1]
    return np.sort(order[lead])


class Seeds:
    """The seeds of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[bytes], min_tokens: int):
        self.ids = ids
        self.hashes, self.first, _ = tokens(texts)
        count = np.diff(self.first)
        looked = count >= min_tokens
        own = [(mask, (np.minimum(count, SPAN) == n) & looked) for n in np.unique(np.minimum(count, SPAN)[looked]).tolist() for mask in _masks(n)]
        self.by_mask = []
        for mask, fits in [*((mask, (count >= len(mask)) & looked) for mask in MASKS), *own]:
            at = ragged(self.first[:-1][fits], (count - len(mask) + 1)[fits])
            seed = _seeds(self.hashes, mask)[at] if len(at) else np.empty(0, U64)
            order = np.argsort(seed, kind="stable")
            seed, at = seed[order], at[order].astype(np.int32)
            bits = min(20, max(10, (16 * len(seed)).bit_length()))
            filter_ = np.zeros(1 << bits, bool)
            filter_[(seed >> U64(64 - bits)).astype(np.int64)] = True
            if len(seed):
                self.by_mask.append((mask, seed, at, filter_, U64(64 - bits)))

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, shift) with a hit, sorted; shift: the document's token number less the item's. Of the shifts at which a document has the same tokens beside an item, the first."""
        found = [np.empty((3, 0), np.int64)]
        # so many tokens that equal none stand before and after each document
        n, pad = np.diff(first), SUBSTITUTED
        padded = np.zeros(len(hashes) + 2 * pad * len(n), U64)
        padded[np.arange(len(hashes)) + pad + 2 * pad * np.repeat(np.arange(len(n)), n)] = hashes
        first = first + 2 * pad * np.arange(len(first))
        sums, longest = None, int(np.diff(self.first).max(initial=0))

        def stretch(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
            """A hash of a document's tokens between two places, which may lie beyond its ends."""
            nonlocal sums
            if sums is None:
                sums = Sums(padded)
            a, b = np.maximum(begin, first[doc]), np.minimum(end, first[doc + 1])
            return sums.of(a, b) ^ mix((a - begin).astype(U64) + U64(1)) ^ mix((end - b).astype(U64) << U64(32))

        for mask, seed, at, filter_, shift in self.by_mask:
            own = _seeds(padded, mask)
            place = np.flatnonzero(filter_[(own >> shift).astype(np.int64)])
            doc = np.searchsorted(first, place, side="right") - 1
            place, doc = place[inner := place + len(mask) <= first[doc + 1]], doc[inner]
            lo, hi = (np.searchsorted(seed, own[place], side=s) for s in ("left", "right"))
            many = np.bincount(doc, hi - lo, len(n)) > FOLD * (first[1:] - first[:-1])  # more hits than tokens
            if many.any():
                around = stretch(doc, place - longest, place + longest + len(mask))
                around[~many[doc]] = np.arange((~many[doc]).sum(), dtype=U64)
                one = _first_of(doc, around)
                place, doc, lo, hi = place[one], doc[one], lo[one], hi[one]
            place, doc, item_at = np.repeat(place, hi - lo), np.repeat(doc, hi - lo), at[ragged(lo, hi - lo)]
            item = np.searchsorted(self.first, item_at, side="right") - 1
            triple = np.stack((doc, item, (place - first[doc] - pad) - (item_at - self.first[item])))
            found.append(triple[:, _first_of(*triple)] if triple.shape[1] else triple)
        doc, item, shift = np.concatenate(found, axis=1)
        order = np.lexsort((shift, item, doc))
        doc, item, shift = doc[order], item[order], shift[order]
        begin = first[doc] + pad + shift
        one = _first_of(doc, item, stretch(doc, begin, begin + np.diff(self.first)[item])) if len(doc) else order
        return doc[one], item[one], shift[one]

    def overlap(self, own: np.ndarray, item: int, shift: int) -> tuple[int, int, int]:
        """First token in the document, tokens and equal tokens of the run with the most equal ones, at least three quarters, of the two laid side by side."""
        other = self.hashes[self.first[item] : self.first[item + 1]]
        lo, hi = max(0, shift), min(len(own), shift + len(other))
        equal = own[lo:hi] == other[lo - shift : hi - shift]
        score = np.concatenate(([0], np.cumsum(np.where(equal, 1, -3))))
        total = np.concatenate(([0], np.cumsum(equal)))
        begin = np.searchsorted(-np.minimum.accumulate(score), -score)  # for each end the first begin with no higher score
        end = int(np.argmax(total - total[begin]))
        inside = int(begin[end]) + np.flatnonzero(equal[begin[end] : end])
        if not len(inside):
            return lo, 0, 0
        return lo + int(inside[0]), int(inside[-1] - inside[0]) + 1, len(inside)


def _overlaps(seeds: Seeds, texts: list[bytes], min_overlap: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Document, item, first word, tokens and equal tokens of the best overlap of each document and item."""
    hashes, first, number = tokens(texts)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for doc, item, shift in zip(*(x.tolist() for x in seeds.hits(hashes, first))):
        at, n, equal = seeds.overlap(hashes[first[doc] : first[doc + 1]], item, shift)
        if equal >= needed(int(seeds.first[item + 1] - seeds.first[item]), min_overlap) and equal > best.get((doc, item), (0, 0, 0))[2]:
            best[doc, item] = (int(number[first[doc] + at]), n, equal)
    for (doc, item), found in best.items():
        yield doc, item, *found


def _blocks(benchmark: DataFrame, block_bytes: int, min_tokens: int) -> Iterator[Seeds]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        table = part.toArrow()
        yield Seeds(table.column("item_id").to_pylist(), [x or b"" for x in table.column("text").to_pylist()], min_tokens)


def _with_last(seeds: Iterator[Seeds]) -> Iterator[tuple[Seeds, bool]]:
    """Each block, one at a time, and whether it is the last."""
    own = next(seeds, None)
    while own is not None:
        following = next(seeds, None)
        yield own, following is None
        own = following


def overlaps(docs: DataFrame, benchmark: DataFrame, min_overlap: int = MIN_OVERLAP, min_tokens: int = MIN_TOKENS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, first word, tokens and equal tokens of the best overlap, for each document and item that have one."""
    spark, passes = docs.sparkSession, []
    texts = runtime.texts_of(docs, F.col("doc_id").cast("long").alias("doc_id"))
    for seeds, last in _with_last(_blocks(benchmark, block_bytes, min_tokens)):
        held = spark.sparkContext.broadcast(seeds)

        def hits(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for table, part in chunks(batches):
                rows = list(_overlaps(held.value, part, min_overlap))
                ids = table.column("doc_id").to_pylist()
                yield pa.record_batch([pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([held.value.ids[r[1]] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3, 4))], names=["doc_id", "item_id", "at", "length", "matched"])

        found = texts.mapInArrow(hits, HITS)
        if not last:
            found = runtime.stored(found, "overlaps")
            held.destroy()
        passes.append(found)
    return reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], HITS)


def without_overlaps(docs: DataFrame, benchmark: DataFrame, min_overlap: int = MIN_OVERLAP, min_tokens: int = MIN_TOKENS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that overlap with no item."""
    for seeds, last in _with_last(_blocks(benchmark, block_bytes, min_tokens)):
        held = docs.sparkSession.sparkContext.broadcast(seeds)

        def clean(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for table, part in chunks(batches):
                keep = np.ones(len(part), bool)
                keep[[r[0] for r in _overlaps(held.value, part, min_overlap)]] = False
                yield from table.filter(pa.array(keep)).to_batches()

        docs = docs.mapInArrow(clean, docs.schema)
        if not last:
            docs = runtime.stored(docs, "no-overlaps")
            held.destroy()
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item: a row for each pair that overlaps."""
    return overlaps(runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "benchmark"))
