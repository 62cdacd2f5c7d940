"""Phrase collocations: phrases of two and three words whose parts occur together far more often than apart.

A phrase (contiguous words of one piece of text) with count a >= ``LEAST`` is cut after its first k words into parts with
counts l and r; its score is the least floor(10^6 a^2 / (l r)) over its cuts. A candidate whose words lie in a longer one
with at least ``SHARE`` percent of its count is dropped. The best ``TOP`` of each language stay.

Best-first growth with bounds. Counts of words come first, then of pairs of words that both occur often enough. As no
phrase occurs more often than a part of it, a phrase that begins with the pair xy scores at most 10^6 f(xy) / f(x), and xy
itself no more than that: an admissible bound from counts of prefixes. All candidates of score t or more therefore begin
with a pair of bound t or more. A round takes such a t for each language that is not settled, extends the pairs above it
(the frontier) by one more pass over the texts, to the right, and to the left too, as a longer phrase may drop a pair from
either side, and counts the surviving candidates of score t or more. A language is settled as soon as they are ``TOP``:
then all ties at the last place are among them. Otherwise t is lowered, in the end to 0. Languages that are settled
are not extended again.

Scale: a chunk of documents gives the counts of its different words, pairs or triples as numpy arrays, Spark adds them,
before and after the shuffle; hot phrases are a row for each chunk. Which words and pairs may be extended reaches the tasks as
bit maps of at most 2^``BITS`` bits (16 MB), whatever the vocabulary: a bit that two share only lets more phrases be
counted than need be, and joins with the exact tables follow. Triples outside the frontier are never shuffled. Thresholds come from
histograms of the scores (10^6 + 1 values at most for each language). Counts are written to the shared folder, so a lost
executor repeats one step.

Words are counted and joined by 64 bits of hash, for each language; the table of all words shows whether two share them, and then
all is counted again with other hashes. Products are decimals of 38 digits: exact to counts of 10^13.

Cases: null texts are empty; a null language is ``und``. Repeated rows count as often as they are there. A language with
no candidate has no rows; empty tables give none. doc_id and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime
from .textops import U64, chunks, hash_spans, lower_ascii, mix

LEAST, SHARE, TOP = 10, 50, 2000
FIRST, FURTHER = 2, 8  # candidates looked at in the first round, times TOP, and how many times more in each next one
BITS = 27
_BREAK, _SPACE = b".,;:!?\n\x0b\x0c\r", b" \t"
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(_BREAK)], _CLASS[list(_SPACE)] = 2, 1
_WORDS = "lang string, h1 bigint, word binary, n bigint"


class _Chunk:
    """Words of a chunk of texts, in lower case, and which follow each other in a piece."""

    def __init__(self, table: pa.Table, texts: list[bytes], seed: int):
        lang = pc.fill_null(table.column("lang").combine_chunks(), "und").dictionary_encode()
        self.langs, code = lang.dictionary, lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        data = lower_ascii(np.frombuffer(b"\n".join(texts) + b"\n" * 9, np.uint8))
        kind = _CLASS[data]
        edges = np.flatnonzero(np.diff((kind > 0).view(np.int8), prepend=np.int8(1)))
        self.data, self.start, self.end = data, edges[0::2], edges[1::2]
        piece = np.cumsum(kind == 2, dtype=np.int32)[self.start]
        self.follows = piece[:-1] == piece[1:]  # by position of the first
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.lang = code[np.searchsorted(ends, self.start, side="right")]
        self.hash = mix(hash_spans(data, self.start, self.end) + U64(seed))

    def bits(self, *at: np.ndarray) -> np.ndarray:
        """A hash of the language and the words at some positions."""
        return _combined(np.array([_lang_hash(x) for x in self.langs.to_pylist()], U64)[self.lang[at[0]]], *(self.hash[a] for a in at))

    def grouped(self, *at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A position and the count of each different run of a language and words."""
        if not hasattr(self, "number"):
            _, self.number = np.unique(self.hash, return_inverse=True)
            self.number = self.number.reshape(-1) + self.lang * (int(self.number.max(initial=-1)) + 1)
        key = self.number[at[0]]
        for a in at[1:]:
            _, key = np.unique(key, return_inverse=True)
            key = key.reshape(-1) * (int(self.number.max(initial=-1)) + 1) + self.number[a]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        return at[0][first], n

    def rows(self, first: np.ndarray, n: np.ndarray, words: int) -> pa.Table:
        names = pa.DictionaryArray.from_arrays(pa.array(self.lang[first]), self.langs).cast(pa.string())
        return pa.table([names, *(pa.array(self.hash[first + k].view(np.int64)) for k in range(words)), pa.array(n.astype(np.int64))], names=["lang", *(f"h{k + 1}" for k in range(words)), "n"])


def _lang_hash(lang: str) -> int:
    data = lang.encode()
    return int(hash_spans(np.frombuffer(data + b"\0" * 8, np.uint8), np.array([0]), np.array([len(data)]))[0])


def _combined(lang: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    h = lang
    for x in hashes:
        h = mix(h ^ x) + U64(0x9E3779B97F4A7C15)
    return mix(h)


class Bits:
    """A bit map of hashes; of its positions those of other hashes may be set too."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.shift = U64(64 - int(len(words)).bit_length() + 1 - 6)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool)


def _bit_map(rows: DataFrame, words: int) -> Broadcast:
    """The languages and first words of rows as a broadcast bit map of 16 bits for each row, at least 2^16 and at most 2^BITS bits."""
    width = min(max(16, (16 * rows.count()).bit_length()), BITS)
    names = [f"h{k + 1}" for k in range(words)]

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = b.column("lang").dictionary_encode()
            known = np.array([_lang_hash(x) for x in lang.dictionary.to_pylist()], U64)
            h = _combined(known[lang.indices.to_numpy(zero_copy_only=False)], *(b.column(c).to_numpy().view(U64) for c in names))
            at = np.unique(h >> U64(64 - width))
            yield pa.record_batch([pa.array((at >> U64(6)).astype(np.int64)), pa.array((U64(1) << (at & U64(63))).view(np.int64))], names=["w", "b"])

    found = rows.select("lang", *names).mapInArrow(places, "w bigint, b bigint").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (width - 6), U64)
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy().view(U64)
    return rows.sparkSession.sparkContext.broadcast(Bits(bits))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))


def _word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """lang, h1, word, n; clash: another word has h1 too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in chunks(batches):
            c = _Chunk(table, texts, seed)
            first, n = c.grouped(np.arange(len(c.start)))
            raw = c.data.tobytes()
            words = pa.array([raw[a:b] for a, b in zip(c.start[first].tolist(), c.end[first].tolist(), strict=True)], pa.binary())
            yield from c.rows(first, n, 1).add_column(2, "word", words).to_batches()

    rows = _texts(docs).mapInArrow(run, _WORDS)
    return rows.groupBy("lang", "h1").agg(F.min("word").alias("word"), F.sum("n").alias("n"), (F.min("word") != F.max("word")).alias("clash"))


def _phrase_counts(docs: DataFrame, seed: int, often: Broadcast, frontier: Broadcast | None = None) -> DataFrame:
    """lang, h1, h2, n of pairs of frequent words; with a frontier: lang, h1, h2, h3, n of triples of which the first two or the last two words are in it."""
    words = 2 if frontier is None else 3

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in chunks(batches):
            c = _Chunk(table, texts, seed)
            every = np.arange(len(c.start))
            known = often.value.has(c.bits(every))
            pair = np.flatnonzero(c.follows & known[:-1] & known[1:]) if len(every) else every
            at = pair
            if frontier is not None:
                inside = frontier.value.has(c.bits(pair, pair + 1))
                next_ = np.flatnonzero(np.diff(pair) == 1)
                at = pair[next_[inside[next_] | inside[next_ + 1]]]
            if len(at):
                first, n = c.grouped(*(at + k for k in range(words)))
                yield from c.rows(first, n, words).to_batches()

    names = ["lang", *(f"h{k + 1}" for k in range(words))]
    rows = _texts(docs).mapInArrow(run, "lang string, " + ", ".join(f"{c} bigint" for c in names[1:]) + ", n bigint")
    return rows.groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= LEAST)


def _ratio(a: str, l: str, r: str) -> Column:  # noqa: E741
    d = "decimal(13,0)"
    return F.expr(f"cast(1000000 as decimal(7,0)) * (cast({a} as {d}) * cast({a} as {d})) div (cast({l} as {d}) * cast({r} as {d}))")


def _threshold(scored: DataFrame, wanted: Column | int) -> DataFrame:
    """lang, t: the greatest score that at least so many rows of scored (lang, score; and wanted) have or surpass, else 0."""
    histogram = scored.groupBy("lang", "score").agg(F.count("*").alias("rows"))
    above = F.sum("rows").over(Window.partitionBy("lang").orderBy(F.desc("score")))
    return histogram.withColumn("above", above).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("above") >= wanted, F.col("score"))), F.lit(0)).alias("t"))


def mined(docs: DataFrame, top: int = TOP, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    spark = docs.sparkSession
    for seed in range(16):
        words = runtime.stored(_word_counts(docs, seed), "collocation-words")
        if words.where("clash").isEmpty():
            break
    else:
        raise ValueError("words share hashes under all seeds")
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = words.where(F.col("n") >= LEAST)
    often = _bit_map(frequent, 1)
    counts = _phrase_counts(docs, seed, often)
    name = lambda k: frequent.select("lang", F.col("h1").alias(f"h{k}"), F.col("n").alias(f"f{k}"))
    pairs = counts.join(name(1), ["lang", "h1"]).join(name(2), ["lang", "h2"])
    bound = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(13,0)) div cast(f1 as decimal(13,0))")
    pairs = runtime.stored(pairs.select("lang", "h1", "h2", "a", "f1", "f2", _ratio("a", "f1", "f2").alias("score"), bound.alias("bound")), "collocation-pairs")
    part = lambda x, y, f: pairs.select("lang", F.col("h1").alias(f"h{x}"), F.col("h2").alias(f"h{y}"), F.col("a").alias(f))

    open_, settled, looked = None, [], first * top
    while True:
        level = _threshold(pairs if open_ is None else pairs.join(open_, "lang", "left_semi"), looked)
        level = runtime.stored(level, "collocation-levels")
        if level.isEmpty():
            break
        live = pairs.join(level, "lang")
        frontier = _bit_map(live.where("bound >= t"), 2)
        triples = _phrase_counts(docs, seed, often, frontier)
        # every triple of score t or more, and every one that holds a pair of score t or more, is among them
        triples = triples.join(level, "lang").join(part(1, 2, "f12"), ["lang", "h1", "h2"]).join(part(2, 3, "f23"), ["lang", "h2", "h3"])
        triples = triples.join(name(1), ["lang", "h1"]).join(name(3), ["lang", "h3"]).withColumns({"s1": _ratio("a", "f1", "f23"), "s2": _ratio("a", "f12", "f3")})
        triples = runtime.stored(triples.drop("f2"), "collocation-triples")
        heavy = lambda x, y: triples.groupBy("lang", F.col(f"h{x}").alias("h1"), F.col(f"h{y}").alias("h2")).agg(F.max("a").alias("longer"))
        longer = heavy(1, 2).unionByName(heavy(2, 3)).groupBy("lang", "h1", "h2").agg(F.max("longer").alias("longer"))
        two = live.where("score >= t").join(longer, ["lang", "h1", "h2"], "left").where(f"longer is null or 100 * longer < {SHARE} * a")
        two = two.select("lang", "t", "h1", "h2", F.lit(None).cast("bigint").alias("h3"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
        cut = F.when(F.col("s1") <= F.col("s2"), F.struct(F.col("f1").alias("l"), F.col("f23").alias("r"), F.col("s1").alias("score"))).otherwise(F.struct(F.col("f12").alias("l"), F.col("f3").alias("r"), F.col("s2").alias("score")))
        three = triples.withColumn("cut", cut).where("cut.score >= t").select("lang", "t", "h1", "h2", "h3", "a", "cut.l", "cut.r", "cut.score")
        alive = runtime.stored(two.unionByName(three), "collocation-survivors")
        done = runtime.stored(level.join(alive.groupBy("lang").agg(F.count("*").alias("alive")), "lang", "left").select("lang", "t", (F.coalesce("alive", F.lit(0)) >= top).alias("full")), "collocation-settled")
        settled.append(alive.join(done.where("full or t = 0"), "lang", "left_semi").drop("t"))
        open_ = done.where("not full and t > 0").select("lang")
        if open_.isEmpty():
            break
        looked *= FURTHER
    if not settled:
        empty = pairs.limit(0).select("lang", "h1", "h2", F.lit(None).cast("bigint").alias("h3"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
        settled.append(empty)
    found = reduce(DataFrame.unionByName, settled)
    last = _threshold(found, top)
    found = found.join(last, "lang").where("score >= t").drop("t")  # and all ties at the last place
    text = lambda k: frequent.select("lang", F.col("h1").alias(f"h{k}"), F.col("word").cast("string").alias(f"w{k}"))
    found = found.join(text(1), ["lang", "h1"]).join(text(2), ["lang", "h2"]).join(text(3), ["lang", "h3"], "left").join(total, "lang")
    found = found.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", F.col("total").alias("n"), "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of each language of the documents."""
    return mined(runtime.table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, len, unnest(list_transform(generate_series(1, len(w) - len + 1), lambda i: array_to_string(w[i:i + len - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) t(len) WHERE len(w) >= len),
f AS (SELECT lang, len, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3),
c AS (SELECT lang, len, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE len > 1 AND f >= {LEAST}),
k AS (SELECT c.*, unnest(generate_series(1, len - 1)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.len, k.a, k.k, l.f AS l, r.f AS r, ((1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ') AND l.len = k.k JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ') AND r.len = k.len - k.k),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase, len ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE len = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE len = 3) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.phrase = b.phrase AND b.len = 2 WHERE x.a IS NULL OR 100 * x.a < {SHARE} * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
