"""N-gram Jaccard self-join of documents with Bayesian candidate pruning.

Two documents are linked if the Jaccard similarity of their sets of ``SHINGLE``-word
shingles is at least ``threshold``.

1. Documents with the same word sequence are one class; only classes are compared.
2. Each class has 128 MinHash values in 32 bands of 4. A pair at similarity 0.8 shares no
   band with probability (1 - 0.8^4)^32 < 1e-7. Classes that share a band are tied to the
   band's smallest class (a star, never all pairs), and the stars' connected components
   are the candidate groups: no link leaves a group.
3. A group of more than ``BLOCK`` classes is cut in blocks, and each pair of blocks is a
   task of its own, so that no task holds a whole group. A task holds the stored MinHash
   values (512 bytes for a class), not the texts, and compares those of its pairs 16 at a
   time. With m of n values equal and a uniform prior, the similarity's posterior is
   Beta(m + 1, n - m + 1); a pair whose posterior chance of reaching the threshold is under
   ``tolerance`` is dropped. A task returns the classes that have a pair left, not the pairs.
4. Only the texts of those go to their tasks, where the pairs left are verified with the
   exact shingle sets. A task returns its classes' numbers of links and a spanning forest of
   the links, never the pairs; the forests' connected components are the classes of
   near-duplicates.

Comparing the different texts of one group costs time quadratic in their number (spread
over the block pairs). Its MinHash values are shipped once for each of its blocks, its texts
once for each block in which they have a pair left.

Cases: a text of one to four words has one shingle, all of it. A text without words (null
too) is linked to nothing. Rows with a null doc_id get a null class_id and no links. Rows
that repeat a doc_id are one document; rows that repeat a text are copies and count as links
of each other. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import runtime
from .components import connected_components
from .textops import CHUNK_BYTES, Rolling, U64, Words, chunks, inside, ragged

SHINGLE = 5
THRESHOLD = 0.8
TOLERANCE = 1e-9
BANDS, ROWS = 32, 4
STEP = 16
BLOCK = 128
DENSE_FROM = 48  # classes in a task from which sets are intersected by matrix products
_SEED = np.random.default_rng(20240229)
_A = _SEED.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _SEED.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every shingle, in order; a document of fewer than k words has one."""
    values = Rolling(words.hashes())
    starts = np.flatnonzero(inside(words.first, k, len(words)))
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    begin = np.concatenate((starts, words.first[short]))
    end = np.concatenate((starts + k, words.first[short] + words.count[short]))
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    return np.searchsorted(words.first, begin, side="right") - 1, values.spans(begin, end)


def signatures(doc: np.ndarray, shingle: np.ndarray, n_docs: int) -> np.ndarray:
    """MinHash values by document; those of one without shingles are the largest."""
    out = np.full((n_docs, BANDS * ROWS), np.uint32(0xFFFFFFFF))
    if len(doc):
        base = (shingle >> U64(32)).astype(np.uint32)
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        value = np.empty_like(base)
        for i in range(BANDS * ROWS):
            np.multiply(base, _A[i], out=value)
            np.add(value, _B[i], out=value)
            out[doc[starts], i] = np.minimum.reduceat(value, starts)
    return out


def minimum_matches(threshold: float, tolerance: float) -> list[int]:
    """For n = STEP, 2 STEP, ... compared values: with fewer equal ones a pair is dropped."""
    least = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        # P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)
        below, m = 0.0, 0
        while (below := below + math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        least.append(m)
    return least


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, texts in chunks(batches):
        words = Words(texts)
        signature = signatures(*shingles(words), len(texts))
        some = (words.count > 0).tolist()
        content = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() if s else None for t, s in zip(texts, some)]
        values = [v.tobytes() if s else None for v, s in zip(signature, some)]
        kept = [c for c in table.column_names if c != "text"]
        yield pa.record_batch([*(table.column(c).combine_chunks() for c in kept), pa.array(content, pa.binary()), pa.array(values, pa.binary())], names=[*kept, "content", "signature"])


def _bands() -> Column:
    """The hash of each band of a signature, with the band's number."""
    width = 4 * ROWS
    return F.array(*[F.xxhash64(F.lit(b), F.substring("signature", 1 + b * width, width)) for b in range(BANDS)])


def _whole_tasks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by task, in tables of whole tasks and about CHUNK_BYTES at least."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and sum(b.nbytes for b in held) > CHUNK_BYTES:
            task = held[-1].column("task")[-1].as_py()
            first = batch.column("task").to_numpy()
            n = int(np.argmax(first != task)) if (first != task).any() else len(first)
            held.append(batch.slice(0, n))
            if n == len(first):
                continue
            yield pa.Table.from_batches(held)
            held, batch = [], batch.slice(n)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _overlaps_by_search(doc: np.ndarray, code: np.ndarray, n_codes: int, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[i]; doc, code: all sets' members, sorted."""
    keys, begin, out = doc * n_codes + code, np.cumsum(sizes) - sizes, np.zeros(len(a), np.int64)
    swap = sizes[a] > sizes[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    size = np.cumsum(sizes[a])
    for lo, hi in _parts(size, 1 << 20):
        n = sizes[a[lo:hi]]
        want = np.repeat(b[lo:hi], n) * n_codes + code[ragged(begin[a[lo:hi]], n)]
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        out[lo:hi] = np.add.reduceat((keys[at] == want).astype(np.int64), np.cumsum(n) - n)
    return out


def _parts(total: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of which the running total grows by about most."""
    lo = 0
    while lo < len(total):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _overlaps_dense(doc: np.ndarray, code: np.ndarray, n_docs: int) -> np.ndarray:
    """All intersection sizes of n_docs sets, by products of 0/1 matrices; codes in one set only are left out."""
    times = np.bincount(code)
    keep = times[code] > 1
    rank = np.cumsum(times > 1) - 1
    doc, code = doc[keep], rank[code[keep]]
    order = np.argsort(code, kind="stable")
    doc, code, out = doc[order], code[order], np.zeros((n_docs, n_docs), np.float32)
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        i, j = np.searchsorted(code, (lo, lo + 4096))
        tile = np.zeros((n_docs, 4096), np.float32)
        tile[doc[i:j], code[i:j] - lo] = 1
        out += tile @ tile.T
    return out.astype(np.int64)


def _split_tasks(table: pa.Table) -> Iterator[pa.Table]:
    """Large tasks alone, small ones together."""
    task = table.column("task").to_numpy()
    starts = np.append(np.flatnonzero(np.diff(task, prepend=task[0] - 1)), len(task))
    n = np.diff(starts)
    big = n >= DENSE_FROM
    lo = 0
    for i in range(len(n)):
        if big[i] or starts[i + 1] - starts[lo] > 4096:
            if starts[i] > starts[lo]:
                yield table.slice(starts[lo], starts[i] - starts[lo])
            lo = i
        if big[i]:
            yield table.slice(starts[i], n[i])
            lo = i + 1
    if lo < len(n):
        yield table.slice(starts[lo])


def _pairs(task: np.ndarray, rep: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs to compare of rows sorted by task: of different blocks where a task has two, of different classes always."""
    starts = np.flatnonzero(np.diff(task, prepend=task[0] - 1))
    size = np.diff(np.append(starts, len(task)))
    after = np.repeat(np.cumsum(size), size) - np.arange(len(task)) - 1
    a, b = np.repeat(np.arange(len(task)), after), ragged(np.arange(len(task)) + 1, after)
    across = np.repeat(np.minimum.reduceat(block, starts) < np.maximum.reduceat(block, starts), size)
    own = ((block[a] != block[b]) | ~across[a]) & (rep[a] != rep[b])
    return a[own], b[own]


def left_pairs(signature: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """The numbers of the pairs a[i], b[i] that the comparison of MinHash values leaves."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, m in enumerate(least):
        part = slice(i * STEP, (i + 1) * STEP)
        for lo in range(0, len(alive), 1 << 16):
            p = alive[lo : lo + (1 << 16)]
            equal[p] += (signature[a[p], part] == signature[b[p], part]).sum(axis=1)
        alive = alive[equal[alive] >= m]
    return alive


def linked_pairs(words: Words, a: np.ndarray, b: np.ndarray, threshold: float, least: list[int]) -> np.ndarray:
    """Which of the pairs of documents a[i], b[i] are linked."""
    doc, shingle = shingles(words)
    alive = left_pairs(signatures(doc, shingle, len(words.texts)), a, b, least)
    linked = np.zeros(len(a), bool)
    if not len(alive):
        return linked
    used = np.zeros(len(words.texts), bool)
    used[a[alive]] = used[b[alive]] = True
    keep = used[doc]
    doc, code = doc[keep], shingle[keep]
    names, code = np.unique(code, return_inverse=True)
    keys = np.unique(doc * len(names) + code)
    doc, code = keys // len(names), keys % len(names)
    sizes = np.bincount(doc, minlength=len(words.texts))
    if used.sum() >= DENSE_FROM and len(alive) > 4 * used.sum():
        short = np.cumsum(used) - 1
        both = _overlaps_dense(short[doc], code, int(used.sum()))[short[a[alive]], short[b[alive]]]
    else:
        both = _overlaps_by_search(doc, code, len(names), sizes, a[alive], b[alive])
    linked[alive] = both >= threshold * (sizes[a[alive]] + sizes[b[alive]] - both) - 1e-9
    return linked


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compared(least: list[int]):
    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_tasks(batches):
            for part in _split_tasks(table):
                task, rep, block = (part.column(c).to_numpy() for c in ("task", "rep", "block"))
                signature = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(len(task), -1)
                a, b = _pairs(task, rep, block)
                some = np.zeros(len(task), bool)
                alive = left_pairs(signature, a, b, least)
                some[a[alive]] = some[b[alive]] = True
                keep = np.flatnonzero(some)
                again = (np.diff(task[keep]) == 0) & (np.diff(rep[keep]) == 0)  # a doc_id with two texts
                keep = np.delete(keep, np.flatnonzero(again) + 1)
                yield pa.record_batch([pa.array(task[keep]), pa.array(rep[keep]), pa.array(block[keep])], names=["task", "rep", "block"])

    return compared


def _verified(threshold: float, least: list[int]):
    def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_tasks(batches):
            for part in _split_tasks(table):
                yield links_of(part)

    def links_of(table: pa.Table) -> pa.RecordBatch:
        rep, block, copies, task = (table.column(c).to_numpy() for c in ("rep", "block", "copies", "task"))
        texts, seen = table.column("text").to_pylist(), {}
        first = [i for i, k in enumerate(zip(task.tolist(), rep.tolist(), texts)) if seen.setdefault(k, i) == i]
        if len(first) < len(texts):  # rows that repeat a document
            rep, block, copies, task, texts = rep[first], block[first], copies[first], task[first], [texts[i] for i in first]
        words = Words([t or b"" for t in texts])
        a, b = _pairs(task, rep, block)
        linked = linked_pairs(words, a, b, threshold, least) if len(a) else np.zeros(0, bool)
        a, b = a[linked], b[linked]
        links = np.bincount(a, copies[b], len(task)).astype(np.int64) + np.bincount(b, copies[a], len(task)).astype(np.int64)
        root = _roots(len(task), a, b)
        some = np.flatnonzero(links)
        return pa.record_batch([pa.array(rep[some]), pa.array(rep[root[some]]), pa.array(links[some])], names=["rep", "root", "links"])

    return verified


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of all that are linked, directly or through others), n_links (documents linked directly)."""
    return _classed(docs, threshold, tolerance, block).select("doc_id", "class_id", "n_links")


def _classed(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, *more: Column) -> DataFrame:
    """near_duplicates, with the content's digest and more columns of docs."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    asked_of = runtime.texts_of(docs, doc_id, *more)
    names = asked_of.drop("text").columns
    sketch = runtime.stored(asked_of.mapInArrow(_sketches, asked_of.drop("text").schema.add("content", BinaryType()).add("signature", BinaryType())), "jaccard-sketches")
    known = sketch.where("doc_id is not null and content is not null")
    classes = runtime.stored(known.groupBy("content").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("signature").alias("signature")), "jaccard-classes")
    band = classes.select("rep", F.explode(_bands()).alias("band"))
    center = band.groupBy("band").agg(F.min("rep").alias("center"), F.max("rep").alias("last")).where("center < last").select("band", "center")
    ties = band.join(center, "band").where("rep <> center").select(F.col("rep").alias("a"), F.col("center").alias("b"))
    groups = connected_components(ties)
    blocks = groups.groupBy("component").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n_blocks")).checkpoint()  # a table, so that Spark can split a large group's rows in the join
    members = groups.join(blocks, "component").withColumnRenamed("node", "rep").withColumn("block", F.pmod(F.xxhash64("rep"), "n_blocks").cast("int"))
    sketched = members.join(classes.select("rep", "signature"), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    sketched = sketched.withColumn("task", F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other"))).select("task", "rep", "block", "signature")
    least, partitions = minimum_matches(threshold, tolerance), runtime.shuffle_partitions(docs.sparkSession)
    work = sketched.repartition(partitions, "task").sortWithinPartitions("task", "rep")
    asked = runtime.stored(work.mapInArrow(_compared(least), "task long, rep long, block int"), "jaccard-candidates")
    copies = classes.groupBy("rep").agg(F.sum("copies").alias("copies"))
    texts = runtime.texts_of(docs, doc_id).withColumnRenamed("doc_id", "rep").join(asked.join(copies, "rep"), "rep").select("task", "rep", "block", "copies", "text")
    work = texts.repartition(partitions, "task").sortWithinPartitions("task", "rep")
    verified = runtime.stored(work.mapInArrow(_verified(threshold, least), "rep long, root long, links long"), "jaccard-links")
    final = connected_components(verified.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    answer = classes.select("content", "rep", "copies").join(final.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    answer = runtime.stored(answer.select("content", F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "jaccard-answers")
    key = F.coalesce("content", F.col("doc_id").cast("string").cast("binary"), F.lit("").cast("binary"))
    rows = sketch.select(*names, "content", key.alias("key")).join(answer.withColumnRenamed("content", "key"), "key", "left")
    own = F.col("doc_id").isNotNull()
    return rows.select(*names, "content", F.when(own, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(own, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with the smallest doc_id of its near-duplicates and its number of links."""
    return near_duplicates(runtime.table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows whose class has a smaller doc_id, and one row of those with the same doc_id and words; rows with a null doc_id, or without words, stay."""
    copy = F.unhex(F.md5(F.col("text").cast("binary"))).alias("_copy")
    options = {"threshold": THRESHOLD, "tolerance": TOLERANCE, "block": BLOCK} | options
    rows = runtime.stored(_classed(docs, options["threshold"], options["tolerance"], options["block"], copy).select("doc_id", "_copy", "content", "class_id"), "jaccard-rows")
    first = rows.where("class_id = doc_id and content is not null").groupBy("doc_id", "content").agg(F.min("_copy").alias("least"), F.count("*").alias("n")).where("n > 1")
    twice = runtime.stored(first.select("doc_id", "content", "least"), "jaccard-repeats")
    gone = rows.where("class_id < doc_id").select("doc_id", "_copy")
    some = not twice.isEmpty()
    if some:
        gone = gone.unionByName(rows.join(twice, ["doc_id", "content"]).where("_copy > least").select("doc_id", "_copy"))
    kept = docs.withColumn("_copy", copy).join(gone.distinct(), ["doc_id", "_copy"], "left_anti")
    if some:
        again = twice.select("doc_id", F.col("least").alias("_copy"))
        kept = kept.join(again, ["doc_id", "_copy"], "left_anti").unionByName(kept.join(again, ["doc_id", "_copy"], "left_semi").dropDuplicates(["doc_id", "_copy"]))
    return kept.select(*docs.columns)
