"""Quality rules: a base rule, then gradient-boosted trees over document statistics.

The trees are trained here (histograms, logistic loss) on a bounded sample of labelled rows,
``SAMPLE`` of them at most, those with the smallest hash of doc_id. On the features named in
``FALLING`` the score can only fall: a split that would let it rise is not taken, and the bounds
that a split sets hold in all below it. The model is five numpy arrays, one entry a node, so all
documents of a chunk walk a tree level in one step.

Scale: documents are read, never shuffled; the sample (16 bytes a row) is broadcast to find its
texts, and only its statistics come to the driver.

Cases: a null or empty text has no words and fails the base rule. Rows with a null doc_id are
judged like others. Repeated labels of a doc_id count as one, quality if any says so. Without
labels of both kinds the base rule alone decides.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .textops import Rolling, U64, Words, chunks, hash_spans, inside, mix

SAMPLE = 20_000
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "exclaims", "pipes", "digits", "stops", "lines", "distinct", "bytes_per_char")
FALLING = ("symbols", "dup_lines", "repeats", "upper", "exclaims", "pipes")


def _lut(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = 1
    return table


_LUTS = {"symbols": _lut(SYMBOLS), "upper": _lut(bytes(range(65, 91))), "exclaims": _lut(b"!"), "pipes": _lut(b"|"), "digits": _lut(bytes(range(48, 58))), "stops": _lut(b".?")}
_NOT_SPACE_START = np.array([(b & 0xC0) != 0x80 and b not in (9, 10, 11, 12, 13, 32) for b in range(256)], dtype=np.uint8)


def statistics(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base rule's counts by name, and a row of FEATURES for each text."""
    words = Words(texts)
    n_docs, n = len(texts), words.count

    def total(table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[words.data[: words.doc_at[-1]]], words.doc_at[:-1], dtype=np.int64) if n_docs else np.empty(0, np.int64)

    chars = total(_NOT_SPACE_START)
    by = {k: total(v) for k, v in _LUTS.items()}

    breaks = np.flatnonzero(words.data[: words.doc_at[-1]] == 10)
    start = np.concatenate(([0], breaks[:-1] + 1)) if len(breaks) else np.empty(0, np.int64)
    some = np.searchsorted(words.start, breaks) > np.searchsorted(words.start, start)
    start, end = start[some], breaks[some]
    line_doc = np.searchsorted(words.doc_at, start, side="right") - 1
    lines = np.bincount(line_doc, minlength=n_docs)
    keys = np.unique(mix(hash_spans(words.data, start, end) + line_doc.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
    dup_lines = lines - np.bincount(line_doc[keys], minlength=n_docs)

    hashes, doc = words.hashes(), words.doc()
    at = np.flatnonzero(inside(words.first, 3, len(words)))
    key = mix(Rolling(hashes).windows(3)[at] + doc[at].astype(U64) * U64(0x9E3779B97F4A7C15)) if len(at) else np.empty(0, U64)
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    again = at[order[np.append(same, False) | np.insert(same, 0, False)]] if len(order) else at
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 3, -1)
    repeated = np.diff(np.concatenate(([0], np.cumsum(np.cumsum(cover)[:-1] > 0)))[words.first])

    first = np.unique(mix(hashes + doc.astype(U64) * U64(0xD6E8FEB86659FD93)), return_index=True)[1]
    distinct = np.bincount(doc[first], minlength=n_docs)
    w, c, length = np.maximum(n, 1), np.maximum(chars, 1), np.diff(words.doc_at) - 1
    features = np.stack((np.log1p(n), chars / w, by["symbols"] / w, dup_lines / np.maximum(lines, 1), repeated / w, by["upper"] / c, by["exclaims"] / w, by["pipes"] / w, by["digits"] / c, by["stops"] / w, lines / w, distinct / w, length / c), axis=1)
    return dict(zip(BASE, (n, chars, by["symbols"], dup_lines, repeated))), features


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


@dataclass
class Trees:
    """Complete binary trees, level by level: node i's children are 2i + 1 and 2i + 2; value holds the leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, falling: tuple[int, ...] = (), n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, leaf: float = 4.0, ridge: float = 2.0) -> Trees:
    """Boosting with logistic loss; falling: features on which the score must not rise."""
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(f)], axis=1)  # code > b: x > cuts[b]
    share = y.mean()
    start = float(np.log(share / (1 - share)))
    margin, inner = np.full(n, start), 2**depth - 1
    features, thresholds, values = [], [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        node = np.zeros(n, np.int64)
        bound = {0: (-np.inf, np.inf)}

        def best(rows: np.ndarray, low: float, high: float) -> tuple | None:
            top, total_g, total_h = None, g[rows].sum(), h[rows].sum()
            for j in range(f):
                m = len(cuts[j])
                if not m:
                    continue
                lg = np.cumsum(np.bincount(code[rows, j], g[rows], m + 1))[:m]
                lh = np.cumsum(np.bincount(code[rows, j], h[rows], m + 1))[:m]
                rg, rh = total_g - lg, total_h - lh
                lv, rv = np.clip(lg / (lh + ridge), low, high), np.clip(rg / (rh + ridge), low, high)
                gain = (2 * lg * lv - (lh + ridge) * lv**2) + (2 * rg * rv - (rh + ridge) * rv**2)
                gain[(lh < leaf / 4) | (rh < leaf / 4)] = -np.inf
                if j in falling:
                    gain[rv > lv] = -np.inf
                b = int(np.argmax(gain))
                if top is None or gain[b] > top[0]:
                    top = (gain[b], j, b, lv[b], rv[b])
            v = float(np.clip(total_g / (total_h + ridge), low, high))
            return top if top and top[0] > 2 * total_g * v - (total_h + ridge) * v**2 + 1e-6 else None

        for i in range(2 * inner + 1):
            if i not in bound:
                continue
            rows, (low, high) = np.flatnonzero(node == i), bound[i]
            found = best(rows, low, high) if i < inner and len(rows) else None
            if found:
                _, j, b, lv, rv = found
                feature[i], threshold[i] = j, cuts[j][b]
                middle = (lv + rv) / 2
                bound[2 * i + 1] = (max(low, middle), high) if j in falling else (low, high)
                bound[2 * i + 2] = (low, min(high, middle)) if j in falling else (low, high)
                node[rows] = 2 * i + 1 + (code[rows, j] > b)
            else:  # all go left down to one leaf
                v = float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high)) * rate if len(rows) else 0.0
                end = i
                while end < inner:
                    end = 2 * end + 1
                value[end - inner] = v
                node[rows] = end
        margin += value[node - inner]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Trees(np.stack(features), np.stack(thresholds), np.stack(values), depth, start)


def _sample_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, texts in chunks(batches):
        x = statistics(texts)[1]
        own = [zlib.crc32(t) for t in texts]
        yield pa.record_batch([table.column("doc_id").combine_chunks().cast(pa.int64()), table.column("quality").combine_chunks(), pa.array(own, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "quality", "own", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees for labels.quality over the documents' statistics; None without rows of both kinds."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = runtime.texts_of(docs, "doc_id").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    features = joined.mapInArrow(_sample_features, "doc_id long, quality int, own long, x array<double>")
    got = features.groupBy("doc_id", "quality").agg(F.min(F.struct("own", "x")).alias("r")).select("quality", "r.x").toPandas()  # one text for a doc_id
    if got.quality.nunique() < 2:
        return None
    x, y = np.stack(got.x.to_numpy()), (got.quality.to_numpy() > 0).astype(float)
    order = np.lexsort((*x.T, y))  # sums do not depend on the order in which rows arrive
    return fit_trees(x[order], y[order], tuple(FEATURES.index(k) for k in FALLING))


def judged(docs: DataFrame, model: Trees | None) -> DataFrame:
    """doc_id, the base rule's counts and verdict, kept, and score (the model's probability of quality)."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in chunks(batches):
            counts, x = statistics(texts)
            failed = base_failed(counts)
            score = 1 / (1 + np.exp(-model.score(x))) if model else np.ones(len(texts))
            yield pa.record_batch([table.column("doc_id").combine_chunks(), *(pa.array(counts[k]) for k in BASE), pa.array(failed), pa.array(~failed & (score >= 0.5)), pa.array(score)], names=["doc_id", *BASE, "base_failed", "kept", "score"])

    return runtime.texts_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(judge, "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, kept boolean, score double")


def kept_rows(docs: DataFrame, model: Trees | None) -> DataFrame:
    """The rows of docs that pass the base rule and the model."""

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in chunks(batches):
            counts, x = statistics(texts)
            ok = ~base_failed(counts)
            if model:
                ok &= model.score(x) >= 0
            yield from table.filter(pa.array(ok)).to_batches()

    return docs.mapInArrow(keep, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, judged by the base rule and by trees fitted to the labels."""
    docs = runtime.table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, runtime.table(spark, sf_dir, "labels")))
