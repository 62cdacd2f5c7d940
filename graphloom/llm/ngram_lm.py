"""N-gram language model: a trigram trie in Elias-Fano levels, memory-mapped by the scoring tasks.

Vocabulary. Words of the training documents are counted (map-side first), cut by hash in shards of
about ``VOCABULARY_SHARD``; a shard's level has the rising hashes, of which a word's place is its
id, and the rising sums of counts, of which the differences are the counts.

Trie. Trigrams (w1, w2, w3) are counted in each chunk of text and go, packed, to the shard of their
middle word, so a shard has all that follows its words, after one word or two. Its levels are rising
sequences too:

    contexts   the words w2                 successors  rank(w2) * V + w3, with monotone pointers
    pairs      rank(w2) * V + w1            thirds      base(w1 w2) + r, with monotone bases

r is w3's number among the successors of w2 alone: a third word is looked for not in the vocabulary
but relative to its shorter context. Every key is found by a successor search in its level.

Smoothing is interpolated absolute discounting, by the same ``discount`` on both levels and in every shard, down
to the add-one unigram. The smoothed log10 probabilities and back-off weights are quantised to 8 bits, uniformly
between 0 and the least that so many tokens allow, so the codes do not depend on how the trie is cut.

A word with more than ``SHARD`` training tokens is cut in groups by the hash of what is before it, each
in a shard of its own choosing, so no shard depends on one word. What follows such a word after any first word is
counted before, in shards by the hash of the third: its counts are the same in every group, and a group that
lacks a third word asks there. Such words are fewer than the shards, and their list, with the number of
different words after each, is all the driver holds besides sums.

Scale: one shuffle of words, one of packed trigrams (about 10 bytes for each that differs in its
chunk), one of the packed pairs that begin with such a word. Levels are written to the shared folder and mapped, not loaded: a task pages in what it asks
for. Writing is idempotent, a lost executor costs its tasks alone.

Cases: null and empty texts have one token, the end. Null doc_ids are scored, neither learned from nor
held out. Without training documents every score is that of the unigram, 1 / (0 + 0 + 1). Repeated rows
are learned from and scored as they come.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .elias_fano import EliasFano, map_arrays, write_arrays
from .textops import U64, Words, chunks, lower_ascii, mix, packed_by

FOLDS, HELD_OUT = 7, 2
SHARD = 1_500_000
DISCOUNT = 0.75  # what each seen count gives up to the shorter context
KEY_BITS = 64  # three word numbers of a chunk are packed in one key, if they fit
VOCABULARY_SHARD = 1 << 22
END = U64(0x1F0E2D3C4B5A6978)  # stands for the end's hash
TRIGRAMS = "shard int, second binary, first binary, third binary, times binary"
PAIRS = "shard int, second binary, third binary, times binary"
FOLLOWING = "shard long, path string, word array<long>, n array<long>"
MANIFEST = "shard long, n long, tokens long, path string"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Model:
    """Where the levels are, and the sums that scoring needs."""

    vocabulary: list[tuple[int, str]] = field(default_factory=lambda: [(0, "")])  # words and file of each shard, by hash
    shards: dict[int, str] = field(default_factory=dict)
    n_shards: int = 1
    tokens: int = 0
    words: int = 0
    discount: float = DISCOUNT
    groups: dict[int, int] = field(default_factory=dict)  # id of a frequent word: groups of what is before it, and of what follows it
    counts: dict[int, int] = field(default_factory=dict)  # id of a frequent word: its tokens
    n_following: dict[int, int] = field(default_factory=dict)  # and the different words after it
    following: dict[int, str] = field(default_factory=dict)  # file of each shard of what follows frequent words

    def scale(self) -> tuple[float, float]:
        """Least value and step of the codes: no probability or weight is below that of one count among all tokens."""
        low = float(np.log10(min(self.discount, 1 - self.discount) / max(self.tokens, 1)))
        return low, -low / 255

    def of_frequent(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of frequent words and the numbers of different words after them."""
        word, at = np.unique(words, return_inverse=True)
        return tuple(np.array([x[w] for w in word.tolist()], np.int64)[at] for x in (self.counts, self.n_following))


class Vocabulary:
    def __init__(self, files: tuple[tuple[int, str], ...]):
        self.bits = (len(files) - 1).bit_length()
        self.base = np.concatenate(([0], np.cumsum([n for n, _ in files], dtype=np.int64)))
        self.levels = []
        for _, path in files:
            arrays = map_arrays(path)[0] if path else {}
            self.levels.append((EliasFano.read(arrays, "hash"), EliasFano.read(arrays, "sum")) if path else None)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (that after the last but one: unknown) and count of each hash."""
        key = hashes >> U64(2)
        shard, rest = _place(key, self.bits)
        ids, counts = np.full(len(key), self.base[-1] + 1, np.int64), np.zeros(len(key), np.int64)
        for s in np.unique(shard).tolist():
            if self.levels[s] is None:
                continue
            own = np.flatnonzero(shard == s)
            at = self.levels[s][0].find(rest[own])
            own, at = own[at >= 0], at[at >= 0]
            ids[own] = self.base[s] + at
            counts[own] = self.levels[s][1].get(at + 1) - self.levels[s][1].get(at)
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        for s, level in enumerate(self.levels):
            own = np.flatnonzero((ids >= self.base[s]) & (ids < self.base[s + 1]))
            if len(own):
                at = ids[own] - self.base[s]
                out[own] = level[1].get(at + 1) - level[1].get(at)
        return out


def _place(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and rest of 62-bit keys."""
    return (key >> U64(62 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64), key & U64((1 << (62 - bits)) - 1)


@lru_cache(maxsize=4)
def _vocabulary(files: tuple[tuple[int, str], ...]) -> Vocabulary:
    return Vocabulary(files)


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then the end, and the number of them by text."""
    words = Words(texts)
    h = words.hashes(lower_ascii(words.data))
    return np.insert(h, words.first[1:], END), words.count + 1


def _training(docs: DataFrame) -> DataFrame:
    own = F.col("doc_id").cast("long")
    return docs.where(own.isNotNull() & (F.crc32(own.cast("string").cast("binary")) % FOLDS != HELD_OUT))


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in chunks(batches, limit=8 << 20):
        h, n = np.unique(hashed(texts)[0], return_counts=True)
        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])


def _write_vocabulary(folder: str, bits: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, n = table.column("hash").to_numpy().view(U64) >> U64(2), table.column("n").to_numpy()
        key, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, n).astype(np.int64)
        shard, rest = _place(key, bits)
        path = f"{folder}/vocabulary-{shard[0]}"
        total = np.concatenate(([0], np.cumsum(n)))
        write_arrays(path, EliasFano.of(rest, 1 << (62 - bits)).arrays("hash") | EliasFano.of(total, int(total[-1]) + 1).arrays("sum"))
        yield pa.record_batch([pa.array([int(shard[0])]), pa.array([len(key)]), pa.array([int(total[-1])]), pa.array([path])], names=["shard", "n", "tokens", "path"])

    return write


def _shard_of(second: np.ndarray, other: np.ndarray, groups: dict[int, int], n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each second word with its first (of trigrams) or third (of what follows a frequent word), and the number of groups of it."""
    parts = np.ones(len(second), np.int64)
    if groups:
        words = np.array(sorted(groups))
        at = np.minimum(np.searchsorted(words, second), len(words) - 1)
        parts = np.where(words[at] == second, np.array([groups[w] for w in words.tolist()])[at], 1)
    group = (mix(other.astype(U64) + U64(1)) % parts.astype(U64)).astype(np.int64)
    return (mix(second.astype(U64) * U64(0x9E3779B97F4A7C15) + group.astype(U64)) % U64(n_shards)).astype(np.int64), parts


def _trigrams(texts: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """Ids of the different trigrams of some texts, how often each is there, the training count of its third, each token's trigram and training count, and the tokens by text."""
    h, counts = hashed(texts)
    unique, at = np.unique(h, return_inverse=True)
    ids, times = vocabulary.ids(unique)
    n, begin = len(unique), int(vocabulary.base[-1])
    sequence = np.full(len(h) + 2 * len(counts), n, np.int64)  # two beginnings before each text
    sequence[np.arange(len(h)) + 2 * np.repeat(np.arange(1, len(counts) + 1), counts)] = at
    place = np.arange(len(h)) + 2 * np.repeat(np.arange(len(counts)), counts)
    w = (sequence[place + 1], sequence[place], sequence[place + 2])
    bits = (n + 1).bit_length()
    if 3 * bits <= KEY_BITS:
        width, mask = U64(bits), U64((1 << bits) - 1)
        key = (((w[0].astype(U64) << width) | w[1].astype(U64)) << width) | w[2].astype(U64)
        key, which, many = np.unique(key, return_inverse=True, return_counts=True)
        of = [x.astype(np.int64) for x in (key >> (width + width), (key >> width) & mask, key & mask)]
    else:
        order = np.lexsort((w[2], w[1], w[0]))
        of = [x[order] for x in w]
        lead = _groups(*of)
        many = np.diff(np.append(lead, len(order)))
        which = np.empty(len(order), np.int64)
        which[order] = np.repeat(np.arange(len(lead)), many)
        of = [x[lead] for x in of]
    ids = np.append(ids, begin)
    last = of[2]
    second, first, third = (ids[x] for x in of)
    return second, first, third, many, times[last], which, times[at], counts


def _by_shard(shard: np.ndarray, n_shards: int) -> np.ndarray:
    """A stable order; small integers are sorted by their digits."""
    return np.argsort(shard.astype(np.uint16) if n_shards <= 1 << 16 else shard, kind="stable")


def _count_trigrams(model: Model):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(tuple(model.vocabulary))
        for _, texts in chunks(batches, limit=8 << 20):
            second, first, third, many, *_ = _trigrams(texts, vocabulary)
            shard, _ = _shard_of(second, first, model.groups, model.n_shards)
            order = _by_shard(shard, model.n_shards)  # ids rise with hashes, so each shard's rows are sorted
            shard, arrays = shard[order], [a[order] for a in (second, first, third, many)]
            arrays = [a.astype(np.uint32) if model.words < 1 << 32 or a is arrays[3] else a for a in arrays]
            used = np.bincount(shard, minlength=model.n_shards) > 0
            out = pa.record_batch([pa.array(np.arange(model.n_shards, dtype=np.int32)), *packed_by(shard, model.n_shards, *arrays)], names=[c.split()[0] for c in TRIGRAMS.split(", ")])
            yield out.filter(pa.array(used))

    return count


def _quantised(log10: np.ndarray, low: float, step: float) -> np.ndarray:
    return np.clip(np.rint((log10 - low) / step), 0, 255).astype(np.uint8)


def _count_following(model: Model):
    """The pairs of a frequent word and the next one, by shard."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, frequent = _vocabulary(tuple(model.vocabulary)), np.array(sorted(model.groups))
        for _, texts in chunks(batches, limit=8 << 20):
            h, counts = hashed(texts)
            unique, at = np.unique(h, return_inverse=True)
            ids, _ = vocabulary.ids(unique)
            own = np.isin(ids, frequent)[at]
            own[np.cumsum(counts) - 1] = False  # nothing follows an end
            place = np.flatnonzero(own)
            key, many = np.unique(at[place] * len(unique) + at[place + 1], return_counts=True)
            second, third = ids[key // max(len(unique), 1)], ids[key % max(len(unique), 1)]
            shard, _ = _shard_of(second, third, model.groups, model.n_shards)
            order = _by_shard(shard, model.n_shards)
            shard, arrays = shard[order], [a[order].astype(np.uint32) if model.words < 1 << 32 or a is many else a[order] for a in (second, third, many)]
            used = np.bincount(shard, minlength=model.n_shards) > 0
            out = pa.record_batch([pa.array(np.arange(model.n_shards, dtype=np.int32)), *packed_by(shard, model.n_shards, *arrays)], names=[c.split()[0] for c in PAIRS.split(", ")])
            yield out.filter(pa.array(used))

    return count


def _write_following(folder: str, model: Model):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        shard, kind = table.column("shard")[0].as_py(), np.uint32 if model.words < 1 << 32 else np.int64
        second, third = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c in ("second", "third"))
        times = np.frombuffer(b"".join(table.column("times").to_pylist()), np.uint32)
        v = model.words + 2
        context, rank = np.unique(second, return_inverse=True)
        key = rank * v + third
        order = np.argsort(key, kind="stable")
        run = _groups(key[order])
        key, total = key[order][run], np.concatenate(([0], np.cumsum(np.add.reduceat(times[order].astype(np.int64), run))))
        path = f"{folder}/following-{shard}"
        write_arrays(path, EliasFano.of(context.astype(np.int64), v).arrays("context") | EliasFano.of(key, len(context) * v).arrays("successor") | EliasFano.of(total, int(total[-1]) + 1).arrays("sum"))
        yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([path]), pa.array([context.astype(np.int64)], pa.list_(pa.int64())), pa.array([np.bincount(key // v, minlength=len(context))], pa.list_(pa.int64()))], names=["shard", "path", "word", "n"])

    return write


class Following:
    def __init__(self, path: str):
        arrays = map_arrays(path)[0]
        self.context, self.successor, self.sum = (EliasFano.read(arrays, k) for k in ("context", "successor", "sum"))

    def counts(self, second: np.ndarray, third: np.ndarray, v: int) -> np.ndarray:
        """How often each third word follows the second; not at all: 0."""
        word, at = np.unique(second, return_inverse=True)
        rank = self.context.find(word)[at]
        out = np.zeros(len(second), np.int64)
        own = np.flatnonzero(rank >= 0)
        key, which = np.unique(rank[own] * v + third[own], return_inverse=True)
        place = self.successor.find(key)
        n = np.zeros(len(key), np.int64)
        n[place >= 0] = self.sum.get(place[place >= 0] + 1) - self.sum.get(place[place >= 0])
        out[own] = n[which]
        return out


@lru_cache(maxsize=4096)
def _following(path: str) -> Following:
    return Following(path)


def _times_following(model: Model, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """How often third words follow frequent ones, after any first word."""
    out = np.zeros(len(second), np.int64)
    if not len(second):
        return out
    shard, _ = _shard_of(second, third, model.groups, model.n_shards)
    order = _by_shard(shard, model.n_shards)
    ends = np.searchsorted(shard[order], np.arange(model.n_shards + 1))
    for s, path in model.following.items():
        if len(own := order[ends[s] : ends[s + 1]]):
            out[own] = _following(path).counts(second[own], third[own], model.words + 2)
    return out


def _groups(*keys: np.ndarray) -> np.ndarray:
    """First places of the runs of equal keys."""
    change = np.ones(len(keys[0]), bool)
    change[1:] = False
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _write_shard(folder: str, model: Model):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        shard, kind = table.column("shard")[0].as_py(), np.uint32 if model.words < 1 << 32 else np.int64
        second, first, third = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c in ("second", "first", "third"))
        times = np.frombuffer(b"".join(table.column("times").to_pylist()), np.uint32)
        del table, held
        vocabulary = _vocabulary(tuple(model.vocabulary))
        v, total = model.words + 2, model.tokens + model.words + 1

        context, rank = np.unique(second, return_inverse=True)
        if len(context) * v * v < 1 << 63:
            order = np.argsort((rank * v + first) * v + third)
        else:
            order = np.lexsort((third, first, rank))
        second, first, third, times = (a[order] for a in (second, first, third, times))
        del rank, order
        run = _groups(second, first, third)
        count3 = np.add.reduceat(times.astype(np.int64), run)
        second, first, third = (a[run].astype(np.int64) for a in (second, first, third))

        begin2 = _groups(second)  # contexts of one word
        context = second[begin2]
        rank = np.repeat(np.arange(len(begin2)), np.diff(np.append(begin2, len(second))))
        key2 = rank * v + third
        by_key = np.argsort(key2, kind="stable")
        run = _groups(key2[by_key])
        successor, count2 = key2[by_key][run], np.add.reduceat(count3[by_key], run)
        successor_of = np.empty(len(key2), np.int64)
        successor_of[by_key] = np.repeat(np.arange(len(run)), np.diff(np.append(run, len(key2))))
        pointer = np.searchsorted(successor, np.arange(len(context) + 1) * v)
        n2 = np.diff(pointer)
        total2 = np.add.reduceat(count2, pointer[:-1])
        owner = np.repeat(np.arange(len(context)), n2)
        d2 = d3 = model.discount
        word, at = np.unique(successor % v, return_inverse=True)
        p1 = (vocabulary.counts(word)[at] + 1) / total
        _, parts = _shard_of(context, np.zeros(len(context), np.int64), model.groups, model.n_shards)
        frequent, different = parts > 1, n2.copy()
        if frequent.any():  # what other groups have counts too
            total2[frequent], different[frequent] = model.of_frequent(context[frequent])
            own = np.flatnonzero(frequent[owner])
            count2[own] = _times_following(model, context[owner[own]], successor[own] % v)
        weight2 = d2 * different / total2
        p2 = (count2 - d2) / total2[owner] + weight2[owner] * p1

        pair_begin = _groups(rank, first)
        pair = rank[pair_begin] * v + first[pair_begin]
        n3 = np.diff(np.append(pair_begin, len(first)))
        total3 = np.add.reduceat(count3, pair_begin)
        base = np.concatenate(([0], np.cumsum(n2[rank[pair_begin]])))
        own_pair = np.repeat(np.arange(len(pair)), n3)
        weight3 = d3 * n3 / total3
        relative = successor_of - pointer[rank]
        key3 = base[own_pair] + relative
        p3 = (count3 - d3) / total3[own_pair] + weight3[own_pair] * p2[successor_of]

        arrays, scale = {}, {}
        for name, values in (("p2", p2), ("w2", weight2), ("p3", p3), ("w3", weight3)):
            arrays[name], scale[name] = _quantised(np.log10(values), *model.scale()), list(model.scale())
        for name, values, size in (("context", context, v), ("successor", successor, len(context) * v), ("pointer", pointer, len(successor) + 1), ("pair", pair, len(context) * v), ("base", base, int(base[-1]) + 1), ("third", key3, int(base[-1]) + 1)):
            arrays |= EliasFano.of(values, size).arrays(name)
        path = f"{folder}/shard-{shard}"
        write_arrays(path, arrays, scale=scale)
        yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([len(key3)]), pa.array([int(count3.sum())]), pa.array([path])], names=["shard", "n", "tokens", "path"])

    return write


class Shard:
    def __init__(self, path: str):
        arrays, meta = map_arrays(path)
        self.context, self.successor, self.pointer, self.pair, self.base, self.third = (EliasFano.read(arrays, k) for k in ("context", "successor", "pointer", "pair", "base", "third"))
        self.code = {k: arrays[k] for k in ("p2", "w2", "p3", "w3")}
        self.log10 = {k: low + step * np.arange(256) for k, (low, step) in meta["scale"].items()}

    def value(self, name: str, at: np.ndarray) -> np.ndarray:
        return self.log10[name][self.code[name][at]]

    def score(self, second: np.ndarray, first: np.ndarray, third: np.ndarray, p1: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 P(third | first second); whether the shard has third after second; and the pair's back-off weight where it counts. p1: that of third alone. Equal contexts stand together."""
        out, follows, back = p1.copy(), np.zeros(len(p1), bool), np.zeros(len(p1))
        lead = _groups(second)
        rank = np.repeat(self.context.find(second[lead]), np.diff(np.append(lead, len(second))))
        seen = np.flatnonzero(rank >= 0)
        second, first, third, rank = second[seen], first[seen], third[seen], rank[seen]
        if not len(seen):
            return out, follows, back
        key, at = np.unique(rank * v + third, return_inverse=True)
        follow = self.successor.find(key)[at]
        known = follow >= 0
        below = np.where(known, 0.0, self.value("w2", rank) + p1[seen])
        below[known] = self.value("p2", follow[known])
        lead = _groups(rank, first)
        size = np.diff(np.append(lead, len(rank)))
        pair = self.pair.find(rank[lead] * v + first[lead])
        base = np.zeros(len(lead), np.int64)
        base[pair >= 0] = self.base.get(pair[pair >= 0])
        pair, base = np.repeat(pair, size), np.repeat(base, size)
        third_at = np.full(len(rank), -1, np.int64)
        both = np.flatnonzero(known & (pair >= 0))
        if len(both):
            starts = np.unique(rank[both], return_inverse=True)
            relative = follow[both] - self.pointer.get(starts[0])[starts[1]]
            third_at[both] = self.third.find(base[both] + relative)
        result = below
        unseen = (pair >= 0) & (third_at < 0)
        weight = self.value("w3", pair[unseen])
        result[unseen] += weight
        result[third_at >= 0] = self.value("p3", third_at[third_at >= 0])
        out[seen], follows[seen], back[seen[unseen]] = result, known, weight
        return out, follows, back


@lru_cache(maxsize=4096)
def _shard(path: str) -> Shard:
    return Shard(path)


def fit(docs: DataFrame, shard: int = SHARD, vocabulary_shard: int = VOCABULARY_SHARD, discount: float = DISCOUNT) -> Model:
    """Levels in the shared folder for the training rows of docs."""
    spark = docs.sparkSession
    folder = runtime.fresh_path(spark, "lm")
    training = runtime.texts_of(_training(docs))
    words = runtime.stored(training.mapInArrow(_count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "lm-words")
    n_words, tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    model = Model(tokens=tokens, words=n_words, discount=discount)
    if not tokens:
        return model
    bits = max(0, -(-n_words // vocabulary_shard) - 1).bit_length()
    by_hash = words.withColumn("shard", F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0))
    files = by_hash.repartitionById(1 << bits, F.col("shard")).select("hash", "n").mapInArrow(_write_vocabulary(folder, bits), MANIFEST).collect()
    model.vocabulary = [(0, "")] * (1 << bits)
    for row in files:
        model.vocabulary[row["shard"]] = (row["n"], row["path"])
    model.words = sum(n for n, _ in model.vocabulary)
    model.n_shards = max(1, -(-tokens // shard))
    frequent = words.where(F.col("n") > shard).collect()  # fewer than n_shards
    if frequent:
        ids, counts = _vocabulary(tuple(model.vocabulary)).ids(np.array([r["hash"] for r in frequent]).view(U64))
        model.groups = {int(i): int(-(-n // shard)) for i, n in zip(ids, counts)}
        model.counts = {int(i): int(n) for i, n in zip(ids, counts)}
        model.n_following = dict.fromkeys(model.groups, 0)
        pairs = training.mapInArrow(_count_following(model), PAIRS).repartitionById(model.n_shards, F.col("shard"))
        for row in pairs.mapInArrow(_write_following(folder, model), FOLLOWING).collect():
            model.following[row["shard"]] = row["path"]
            for word, n in zip(row["word"], row["n"]):
                model.n_following[word] += n
    packed = training.mapInArrow(_count_trigrams(model), TRIGRAMS).repartitionById(model.n_shards, F.col("shard"))
    model.shards = {row["shard"]: row["path"] for row in packed.mapInArrow(_write_shard(folder, model), MANIFEST).collect()}
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """For each document its numbers of tokens and its log10 probabilities by the add-one unigram and by the trie."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        vocabulary = _vocabulary(tuple(model.vocabulary))
        v, total = model.words + 2, model.tokens + model.words + 1
        for table, texts in chunks(batches, limit=6 << 20):
            second, first, third, _, seen, which, times, counts = _trigrams(texts, vocabulary)
            unigram = np.log10((seen + 1) / total)
            log10 = unigram.copy()
            shard, parts = _shard_of(second, first, model.groups, model.n_shards)
            order = _by_shard(shard, model.n_shards)
            ends = np.searchsorted(shard[order], np.arange(model.n_shards + 1))
            follows, back = np.zeros(len(seen), bool), np.zeros(len(seen))
            for s, path in model.shards.items():
                if len(own := order[ends[s] : ends[s + 1]]):
                    log10[own], follows[own], back[own] = _shard(path).score(second[own], first[own], third[own], unigram[own], v)
            if len(own := np.flatnonzero((parts > 1) & ~follows)):  # not in this group of a frequent word
                counts2, (total2, different) = _times_following(model, second[own], third[own]), model.of_frequent(second[own])
                low, step = model.scale()
                weight = model.discount * different / total2
                p2 = np.where(counts2 > 0, (counts2 - model.discount) / total2 + weight * ((seen[own] + 1) / total), weight)
                log10[own] = low + step * _quantised(np.log10(p2), low, step) + np.where(counts2 > 0, 0, unigram[own]) + back[own]
            doc = np.repeat(np.arange(len(texts)), counts)
            ids = table.column("doc_id").to_pylist()
            out = [i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids]
            known = np.bincount(doc, times > 0, len(texts)).astype(np.int64)
            base = np.bincount(doc, np.log10((times + 1) / total), len(texts))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out), pa.array(counts), pa.array(known), pa.array(np.full(len(ids), model.tokens)), pa.array(base), pa.array(np.bincount(doc, log10[which], len(texts)))], names=[c.split()[0] for c in SCORES.split(", ")])

    return runtime.texts_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(score, SCORES)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, scored by a model of those whose crc32(doc_id as text) mod 7 is not 2."""
    docs = runtime.table(spark, sf_dir, "documents")
    return scored(docs, fit(docs))
