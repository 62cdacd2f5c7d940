"""Toxicity by a convolutional text classifier over hashed word embeddings, trained here in numpy.

A token is a word in lower case (A-Z) without what is not a letter or digit at its ends. Its
embedding is the sum of those of its features, the whole token and its first 5, 6, 7 and 8 bytes
where it is longer; a feature has two rows of a hashed table, so that two features are alike only
if both rows collide. Filters of widths 1, 2 and 3 run over the tokens, each keeps its largest
value in the document, and a logistic unit makes the score of them.

Training takes every labelled row whose crc32(doc_id as text) mod 5 is not 0, dealt by hash into parts of about
``PART`` rows. In each of ``ROUNDS`` rounds every part is learned from in a task, by stochastic gradients from the same network on; the
changes of each row of the table (and of the filters) are then averaged over the parts that changed it. The output's bias is moved
from equal weights of both kinds to the labels' share of toxic rows, and by ``MISSED``, the cost of a toxic document
that is let through over that of a clean one that is not: a score of 0.5 is where both
weigh the same. On a tenth of the labelled rows that training does not see, a threshold is chosen for each language with the best F1,
among ``BINS`` of them. lang only chooses that threshold: labels, lang, source and doc_id are no inputs of a score.

Scale: documents are read once for the labelled texts, which a bit map of the labels (at most 16 MB) finds, so that few others
are shuffled, and which are stored by part; and once to score; a round reads the stored texts and shuffles what each part changed, at most 9 MB; the model (8 MB) is broadcast.

Cases: null and empty texts get the score of a text without tokens. Rows that repeat a doc_id are learned from once, by the smallest text. Null doc_ids are scored, not
held out and not learned from. Repeated labels count once, toxic if any says so. Without labels
of both kinds every score is the share of toxic labels, 0 without any. An unknown or null lang
has the threshold 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime
from .decontaminate import _ALNUM
from .textops import U64, Words, chunks, hash_spans, lower_ascii, mix

PART = 12_000
CHUNK, CHUNK_BYTES = 5_000, 16 << 20  # rows and bytes of text that a task holds coded at once
ENCODE_BYTES = 1 << 20
FOLDS = 5
MISSED = 3
MOST_BITS = 27
BUCKETS = 1 << 18
DIM = 8
FILTERS = 12
WIDTHS = (1, 2, 3)
PREFIXES = (5, 6, 7, 8)
EPOCHS = 12
ROUNDS, LOCAL = 2, 2  # rounds of all parts, and epochs over each chunk of a part in a round
BINS = 4096
SCORES = "doc_id long, held_out boolean, score double, predicted int, lang string, toxic_for_lang boolean"


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table, 2 for each of 1 + len(PREFIXES) features of a token (row BUCKETS: none), and the number of tokens by text."""
    words = Words(texts)
    data = lower_ascii(words.data)
    alnum = _ALNUM[data]
    place, before = np.append(np.flatnonzero(alnum), len(data)), np.concatenate(([0], np.cumsum(alnum)))
    start, last = place[before[words.start]], place[before[words.end] - 1]
    some = before[words.end] > before[words.start]
    start, end = start[some], last[some] + 1
    counts = np.diff(np.searchsorted(np.flatnonzero(some), words.first))
    rows = np.full((len(start), 2 * (1 + len(PREFIXES))), BUCKETS, np.int32)

    def put(column: int, tokens: np.ndarray | slice, h: np.ndarray, salt: int) -> None:
        h = mix(h + U64(salt))
        rows[tokens, column] = h & U64(BUCKETS - 1)
        rows[tokens, column + 1] = (h >> U64(32)) & U64(BUCKETS - 1)

    put(0, slice(None), hash_spans(data, start, end), 1)
    for i, n in enumerate(PREFIXES):
        longer = np.flatnonzero(end - start > n)
        put(2 + 2 * i, longer, hash_spans(data, start[longer], start[longer] + n), 1 + n)
    return rows, counts


@dataclass
class Network:
    """table: embeddings with a last row of zeros; filters: for each width, (width, DIM, FILTERS) and biases; out: weights and bias."""

    table: np.ndarray
    filters: list[tuple[np.ndarray, np.ndarray]]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def embed(self, rows: np.ndarray) -> np.ndarray:
        e = self.table[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            e += self.table[rows[:, j]]
        return e

    def activations(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every filter at every place, the places' first ones by text, and the embeddings; each text is followed by places without a token."""
        pad = max(WIDTHS) - 1
        length = counts + pad
        first = np.concatenate(([0], np.cumsum(length)))
        e = np.zeros((first[-1] + pad, DIM), np.float32)
        e[np.arange(len(rows)) + np.repeat(np.arange(len(counts)) * pad, counts)] = self.embed(rows)
        n, parts = first[-1], []
        for width, (w, b) in zip(WIDTHS, self.filters):
            a = e[:n] @ w[0] + b
            for k in range(1, width):
                a += e[k : n + k] @ w[k]
                a[first[1:] - k] = -np.inf  # would run into the next text
            parts.append(a)
        return np.concatenate(parts, axis=1), first, e

    def logits(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.empty(0)
        a, first, _ = self.activations(rows, counts)
        return np.maximum(np.maximum.reduceat(a, first[:-1], axis=0), 0) @ self.out + self.bias

    def scores(self, texts: list[bytes], step: int = 1 << 17) -> np.ndarray:
        """In slices of about step tokens."""
        rows, counts = encode(texts)
        out, ends, lo = [], np.cumsum(counts), 0
        while lo < len(counts):
            begin = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, begin + step, side="right")))
            out.append(self.logits(rows[begin : ends[hi - 1]], counts[lo:hi]))
            lo = hi
        return 1 / (1 + np.exp(-np.concatenate(out).astype(np.float64))) if out else np.empty(0)


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.t = rate, {}, 0

    def step(self, name: object, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Updates value, or its rows, in place."""
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= self.rate * (m[at] / (1 - 0.9**self.t)) / (np.sqrt(v[at] / (1 - 0.99**self.t)) + 1e-8)


def fresh(rng: np.random.Generator) -> Network:
    table = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
    table[BUCKETS] = 0
    return Network(table, [(rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32)) for w in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)


def learn(net: Network, adam: _Adam, texts: list[bytes], y: np.ndarray, share: float, epochs: int, batch: int, rng: np.random.Generator) -> None:
    """Changes net in place by epochs over the texts; logistic loss with equal weight for both kinds, of which y > 0 has the share."""
    coded, lo = [], 0
    while lo < len(texts):  # a few texts at once, as what encode holds for a while is far more than what is kept
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= ENCODE_BYTES:
            size, hi = size + len(texts[hi]), hi + 1
        rows, counts = encode(texts[lo:hi])
        coded.extend((rows[e - n : e], np.array([n])) for n, e in zip(counts, np.cumsum(counts)))
        lo = hi
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    bias = np.array([net.bias], np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            rows, counts = np.concatenate([coded[i][0] for i in own]), np.concatenate([coded[i][1] for i in own])
            net.bias = float(bias[0])
            a, first, e = net.activations(rows, counts)
            top = np.stack([first[d] + np.argmax(a[first[d] : first[d + 1]], axis=0) for d in range(len(own))])
            pooled = np.maximum(np.take_along_axis(a, top, axis=0), 0)
            p = 1 / (1 + np.exp(-(pooled @ net.out + net.bias)))
            d_logit = (weight[own] * (p - y[own]) / len(own)).astype(np.float32)
            d_pool = d_logit[:, None] * net.out * (pooled > 0)
            d_out, d_e, adam.t = d_logit @ pooled, np.zeros_like(e), adam.t + 1
            for i, (width, (w, b)) in enumerate(zip(WIDTHS, net.filters)):
                part = slice(i * FILTERS, (i + 1) * FILTERS)
                at, d = top[:, part], d_pool[:, part]
                d_w = np.zeros_like(w)
                for k in range(width):
                    d_w[k] = np.einsum("dfc,df->cf", e[at + k], d)
                    np.add.at(d_e, (at + k).reshape(-1), (d[:, :, None] * w[k].T[None]).reshape(-1, DIM))
                adam.step((i, "w"), w, d_w + 1e-4 * w)
                adam.step((i, "b"), b, d.sum(axis=0))
            token = np.arange(len(rows)) + np.repeat(np.arange(len(counts)) * (max(WIDTHS) - 1), counts)
            hit = np.flatnonzero(np.abs(d_e[token]).sum(axis=1))
            used, inverse = np.unique(rows[hit], return_inverse=True)
            grad = np.zeros((len(used), DIM), np.float32)
            np.add.at(grad, inverse.reshape(-1), np.repeat(d_e[token[hit]], rows.shape[1], axis=0))
            grad[used == BUCKETS] = 0
            adam.step("table", net.table, grad, used)
            adam.step("out", net.out, d_out + 1e-4 * net.out)
            adam.step("bias", bias, d_logit.sum(keepdims=True))
    net.bias = float(bias[0])


def train(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = 32, seed: int = 7) -> Network:
    """A network from the texts alone, in one piece."""
    rng = np.random.default_rng(seed)
    net = fresh(rng)
    learn(net, _Adam(0.01), texts, y, float(y.mean()), epochs, batch, rng)
    return net


def _small(net: Network) -> np.ndarray:
    """All but the table as rows of DIM numbers."""
    flat = np.concatenate([x.reshape(-1) for pair in net.filters for x in pair] + [net.out, np.array([net.bias], np.float32)])
    return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM).astype(np.float32)


def _changed(net: Network, rows: np.ndarray, change: np.ndarray) -> Network:
    """net with changes added to rows of the table and, from BUCKETS + 1 on, to the others."""
    table, small = net.table.copy(), _small(net)
    own = rows <= BUCKETS
    table[rows[own]] += change[own]
    small[rows[~own] - BUCKETS - 1] += change[~own]
    flat, at, filters = small.reshape(-1), 0, []
    for pair in net.filters:
        parts = []
        for x in pair:
            parts.append(flat[at : at + x.size].reshape(x.shape).copy())
            at += x.size
        filters.append(tuple(parts))
    return Network(table, filters, flat[at : at + net.out.size].copy(), float(flat[at + net.out.size]))


def _learn_parts(net: Broadcast[Network], share: float, round_: int):
    """Rows by part: what a pass over each part changes."""

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[int]]]:
        part, texts, y, size = None, [], [], 0
        for batch in batches:
            for p, t, k in zip(*(batch.column(c).to_pylist() for c in ("part", "text", "toxic"))):
                if texts and (p != part or len(texts) >= CHUNK or size >= CHUNK_BYTES):
                    yield part, texts, y
                    texts, y, size = [], [], 0
                part, size = p, size + len(t or b"")
                texts.append(t or b"")
                y.append(k)
        if texts:
            yield part, texts, y

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = net.value
        none = np.empty(0, np.int64)
        for part, of_part in groupby(held(batches), lambda x: x[0]):
            own, adam, rng = _changed(start, none, np.empty((0, DIM), np.float32)), _Adam(0.01), np.random.default_rng((round_, part))
            for _, texts, y in of_part:
                learn(own, adam, texts, (np.array(y) > 0).astype(np.float32), share, LOCAL, 32, rng)
            change = own.table - start.table
            rows = np.flatnonzero(change.any(axis=1))
            rest = _small(own) - _small(start)
            rows, change = np.concatenate((rows, BUCKETS + 1 + np.arange(len(rest)))), np.concatenate((change[rows], rest))
            for lo in range(0, len(rows), 1 << 14):
                s = slice(lo, lo + (1 << 14))
                yield pa.record_batch([pa.array(rows[s].astype(np.int32)), *(pa.array(np.ascontiguousarray(change[s, d])) for d in range(DIM))], names=["row", *(f"d{d}" for d in range(DIM))])

    return work


def _thresholds(scores: DataFrame) -> dict[str, float]:
    """For each lang with 20 rows or more of both kinds the threshold with the best F1, of scores (lang, toxic, score)."""
    bins = scores.where("lang is not null").groupBy("lang", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))
    own, down = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy(F.desc("bin"))
    bins = bins.select("lang", "bin", F.sum("n").over(down).alias("n"), F.sum("hits").over(down).alias("hits"), F.sum("n").over(own).alias("all"), F.sum("hits").over(own).alias("toxic"))
    best = bins.where("all >= 20 and toxic > 0 and toxic < all").groupBy("lang").agg(F.max_by(F.col("bin") / BINS, F.struct(2 * F.col("hits") / (F.col("n") + F.col("toxic")), "bin")).alias("threshold"))
    return {r["lang"]: float(r["threshold"]) for r in best.collect()}


def _among(rows: DataFrame, n: int):
    """Whether a doc_id may be one of the n of rows, by a bit map of their hashes: 16 bits or more for each, at most 2^MOST_BITS in all, beyond which it lets more through."""
    size = min(MOST_BITS, max(10, (16 * n - 1).bit_length()))
    at = rows.select(F.xxhash64("doc_id").bitwiseAND((1 << size) - 1).alias("at"))
    words = at.groupBy(F.expr("cast(shiftright(at, 6) as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    held = rows.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def found(at: pa.Array) -> pa.Array:
        at = at.to_numpy(zero_copy_only=False)
        return pa.array((held.value[at >> 6] >> (at & 63) & 1).astype(bool))

    return lambda name: F.col(name).isNotNull() & found(F.xxhash64(name).bitwiseAND((1 << size) - 1))


def fit(docs: DataFrame, labels: DataFrame, sample_bytes: int | None = None, part: int = PART) -> Network | float:
    """The network, or the share of toxic labels if they are all of one kind. Every label that is not held out is learned from; sample_bytes, where given, is the most text to take."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = runtime.stored(rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0), "toxicity-labels")
    kinds = dict(rows.groupBy("toxic").count().collect())
    n = sum(kinds.values())
    share = kinds.get(1, 0) / max(1, n)
    if share in (0, 1):
        return share
    parts = -(-n // part)
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"), F.lit(None).cast("int").alias("toxic"))
    got = got.where(_among(rows, n)("doc_id")).unionByName(rows, allowMissingColumns=True).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    # texts and labels meet in their part, so texts are shuffled once; hashes of so few numbers would put several parts into one task
    got = got.repartitionById(parts, F.col("part"))
    own = Window.partitionBy("part", "doc_id").orderBy(F.col("toxic").isNull(), "text", "lang")  # the label, then the texts, of which the first is taken
    got = got.withColumns({"label": F.max("toxic").over(own), "nth": F.row_number().over(own)}).where("toxic is null and label is not null and nth = 2")
    got = got.select("doc_id", "text", "lang", F.col("label").alias("toxic"), "part")
    got = got.withColumn("check", F.crc32(F.concat(F.lit("check "), F.col("doc_id").cast("string")).cast("binary")) % 10 == 0)
    got = runtime.stored(got.sortWithinPartitions("part", F.xxhash64(F.lit(1), "doc_id"), "doc_id"), "toxicity-labelled")
    if sample_bytes is not None:
        size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
        got = got.join(got.select("doc_id", size.alias("size")).where(F.col("size") <= sample_bytes), "doc_id", "left_semi").sortWithinPartitions("part")
    of = {(r["check"], r["toxic"]): r["count"] for r in got.groupBy("check", "toxic").count().collect()}
    if any(of.get((True, k), 0) + of.get((False, k), 0) == 0 for k in (0, 1)):
        return share
    checked = all(of.get((False, k), 0) for k in (0, 1))
    learned = got.where("not check") if checked else got
    toxic = sum(x for (c, k), x in of.items() if k == 1 and not (checked and c)) / sum(x for (c, _), x in of.items() if not (checked and c))
    net, names = fresh(np.random.default_rng(7)), [f"d{d}" for d in range(DIM)]
    for round_ in range(ROUNDS):
        held = docs.sparkSession.sparkContext.broadcast(net)
        changes = learned.select("part", "text", "toxic").mapInArrow(_learn_parts(held, toxic, round_), "row int, " + ", ".join(f"{x} float" for x in names))
        mean = changes.groupBy("row").agg(*(F.avg(x).cast("float").alias(x) for x in names)).toArrow()
        net = _changed(net, mean.column("row").to_numpy().astype(np.int64), np.stack([mean.column(x).to_numpy() for x in names], 1))
    net.bias += float(np.log(MISSED * share / (1 - share)))
    if checked:
        net.thresholds = _thresholds(scored(got.where("check"), net).select("doc_id", "score", "lang").join(got.select("doc_id", "toxic"), "doc_id"))
    return net


def scored(docs: DataFrame, model: Network | float) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), lang, toxic_for_lang (by the language's threshold)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for table, texts in chunks(batches):
            s = net.scores(texts) if isinstance(net, Network) else np.full(len(texts), float(net))
            ids, lang = table.column("doc_id").to_pylist(), table.column("lang").to_pylist()
            out = [i is not None and zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids]
            limit = np.array([net.thresholds.get(k, 0.5) if isinstance(net, Network) else 0.5 for k in lang])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(lang, pa.string()), pa.array(s >= limit)], names=["doc_id", "held_out", "score", "predicted", "lang", "toxic_for_lang"])

    return runtime.texts_of(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).mapInArrow(score, SCORES)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, scored by a network trained on the labels that are not held out."""
    docs = runtime.table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, runtime.table(spark, sf_dir, "labels")))
