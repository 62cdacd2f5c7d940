"""Substring dedup by relative Lempel-Ziv parsing against an index of all documents.

Every document is a reference. Its windows of ``window`` words are gathered in
blocks: a block is a run of consecutive windows that have the same minimiser
(the smallest hash among their ``anchor``-word sequences), so equal passages
give equal blocks but for their two ends. A block goes, as one packed entry, to
the index shard of its minimiser and carries 32 bits for each of its windows;
minimiser and window bits together identify a window by 96 bits. The shard
answers each window with a place (document and word) in the smallest document that holds it.

A document is then parsed from left to right into factors: a factor starts at the
first window not yet parsed that has a place in a smaller document, and is extended as long as
the next windows have their places at the next words of that document. As each window has one place, a
factor ends where a still smaller document holds the next window, even if its own document goes on: it
is not always the longest match, and ``n_factors`` can be above that of a parse that knows all places; the
words removed are the same. A factor is never shorter than
``window`` words. Where one ends, the windows that straddle its boundary are looked at in turn,
and those that any smaller document holds start factors of their own, which may overlap the last
one. Words under a factor are duplicates.

Scale: one pass that counts, one packed shuffle of about 38 bytes for each five words, one of the
duplicate runs, one of the texts. Shards have about ``SHARD_BYTES`` of text each, so their number
grows with the input. Equal blocks of a chunk of text are sent once
(with the smallest document) and the other holders are answered on the spot, so
a passage that a third of all documents hold reaches its shard once a chunk. A minimiser that would
fill a good part of a shard by itself, in ever different surroundings, is dealt over more shards by
its windows' bits, one entry for each window. Such minimisers are found in a sample of all blocks, drawn by
the hash of their words and document, so it makes no difference how they are spread over chunks; the sample decides
only where entries go, not what is found.

Cases: null texts have no words. Rows with a null doc_id lose nothing and are
no reference. Rows that repeat a doc_id are equals (neither is smaller). Order
and ties of rows do not matter; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .textops import LARGE_CHUNK, Rolling, U64, Words, chunks, hash_spans, inside, mix, packed_by, ragged

WINDOW = 13
ANCHOR = 5
SHARD_BYTES = 24 << 20  # of text
HOT = 1 << 15  # blocks of a minimiser, from which on it is dealt over shards
COUNTED = 128  # blocks of a minimiser with HOT of them that are in the sample: its count is right to about a tenth
INDEX = "shard int, anchor binary, windows binary, window binary, holders binary, doc binary, tag binary, at binary, known_doc binary, known_tag binary, known_at binary, known_windows binary, known_ref binary, known_ref_at binary"
RUNS = "doc_id long, tag int, at int, n_windows int, ref long, ref_at int"
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long"


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The leftmost position of the smallest of each width consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at, have = values.copy(), np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        m = len(best) - step
        right = best[step:] < best[:m]
        best, at, have = np.where(right, best[step:], best[:m]), np.where(right, at[step:], at[:m]), have + step
    return at[:n]


def _tags(texts: list[bytes]) -> np.ndarray:
    """16 bits of each text; they tell apart different texts under one doc_id."""
    data = np.frombuffer(b"".join(texts) + b"\0" * 8, np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return (hash_spans(data, ends - np.diff(ends, prepend=0), ends) >> U64(48)).astype(np.uint16)


def blocks_of(words: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """First window, number of windows, minimiser and content of each block, and the hash of every window."""
    values = Rolling(words.hashes())
    ok = inside(words.first, window, len(words))
    if not ok.any():
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64), np.empty(0, U64), np.empty(0, U64))
    grams = values.windows(anchor)
    at = np.where(ok, _sliding_argmin(grams, window - anchor + 1), -1)
    edge = np.flatnonzero(np.diff(at, prepend=-2))
    edge = edge[at[edge] >= 0] if len(edge) else edge
    change = np.flatnonzero(np.diff(at, append=-2)) + 1
    end = change[np.searchsorted(change, edge, side="right")]
    return edge, end - edge, grams[at[edge]], values.spans(edge, end + window - 1), values.windows(window)


def _loads(window: int, anchor: int, every: int):
    """Bytes of text (with a null key), and how many of the chunks' different blocks have each minimiser, of one in every."""

    def loads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for table, texts in chunks(batches, limit=LARGE_CHUNK):
            size += sum(map(len, texts))
            words = Words(texts)
            first, _, key, content, _ = blocks_of(words, window, anchor)
            at = np.unique(content, return_index=True)[1]  # equal blocks are sent once
            ids = table.column("doc_id").to_numpy()[np.searchsorted(words.first, first[at], side="right") - 1]
            drawn = at[mix(content[at] ^ mix(ids.astype(np.int64).view(U64))) % U64(every) == 0]
            keys, n = np.unique(key[drawn], return_counts=True)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n * every)], names=["key", "n"])
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([size])], names=["key", "n"])

    return loads


def _cut(first: np.ndarray, n: np.ndarray, key: np.ndarray, content: np.ndarray, whole: np.ndarray, hot: dict[int, int]) -> tuple[np.ndarray, ...]:
    """Blocks of the minimisers in hot cut in single windows; the number of shards that each block's minimiser is dealt over."""
    parts = np.ones(len(key), np.int64)
    if hot:
        keys = np.array(sorted(hot), np.int64)
        own = key.view(np.int64)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        parts = np.where(keys[at] == own, np.array([hot[k] for k in keys.tolist()])[at], 1)
    if (parts == 1).all():
        return first, n, key, content, parts
    times = np.where(parts > 1, n, 1)
    each, offset = np.repeat(np.arange(len(n)), times), ragged(np.zeros(len(n), np.int64), times)
    single = parts[each] > 1
    first = first[each] + offset
    return first, np.where(single, 1, n[each]), key[each], np.where(single, whole[first], content[each]), parts[each]


def _index_entries(shards: int, hot: dict[int, int], window: int, anchor: int):
    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in chunks(batches, limit=LARGE_CHUNK):
            ids = table.column("doc_id").to_numpy()
            words = Words(texts)
            first, n, key, content, whole = blocks_of(words, window, anchor)
            if not len(first):
                continue
            first, n, key, content, parts = _cut(first, n, key, content, whole, hot)
            doc = np.searchsorted(words.first, first, side="right") - 1
            at, tag, holder = (first - words.first[doc]).astype(np.uint32), _tags(texts)[doc], ids[doc]
            order = np.lexsort((at, holder, content))
            head = np.diff(content[order], prepend=~content[order[:1]]) != 0
            lead = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
            smallest = holder[order][lead]
            known = order[holder[order] > smallest]
            ref, ref_at = smallest[holder[order] > smallest], at[order][lead][holder[order] > smallest]
            asked, group = order[holder[order] == smallest], np.cumsum(head)[holder[order] == smallest]
            lead = np.diff(group, prepend=0) != 0  # the first holder of each different block stands for its content
            spread = mix((whole[first[asked]] >> U64(32)) % parts[asked].astype(U64))  # the same for all where parts is 1
            shard = (((key[asked] >> U64(24)) + spread) % U64(shards)).astype(np.int64)
            to = np.argsort(shard, kind="stable")
            asked, lead, shard = asked[to], lead[to], shard[to]
            entry, entry_shard = asked[lead], shard[lead]
            holders = np.diff(np.append(np.flatnonzero(lead), len(asked))).astype(np.uint32)
            each = whole[ragged(first[entry], n[entry])]
            to = np.argsort(holder[known] % shards, kind="stable")
            known, ref, ref_at = known[to], ref[to], ref_at[to]
            known_shard = holder[known] % shards
            columns = [
                *packed_by(entry_shard, shards, key[entry], n[entry].astype(np.uint8)),
                *packed_by(np.repeat(entry_shard, n[entry]), shards, (each >> U64(32)).astype(np.uint32)),
                *packed_by(entry_shard, shards, holders),
                *packed_by(shard, shards, holder[asked], tag[asked], at[asked]),
                *packed_by(known_shard, shards, holder[known], tag[known], at[known], n[known].astype(np.uint8), ref, ref_at),
            ]
            out = pa.record_batch([pa.array(np.arange(shards, dtype=np.int32)), *columns], names=[c.split()[0] for c in INDEX.split(", ")])
            used = (np.bincount(shard, minlength=shards) + np.bincount(known_shard, minlength=shards)) > 0
            yield out.filter(pa.array(used))

    return entries


def _answers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One index shard: the smallest holder of each window, told to its other holders."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)

    def column(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    out = [(column("known_doc", np.int64), column("known_tag", np.uint16), column("known_at", np.uint32), column("known_windows", np.uint8), column("known_ref", np.int64), column("known_ref_at", np.uint32))]
    key, n, window, holders = column("anchor", U64), column("windows", np.uint8).astype(np.int64), column("window", np.uint32), column("holders", np.uint32).astype(np.int64)
    doc, tag, at = column("doc", np.int64), column("tag", np.uint16), column("at", np.uint32)
    del table, held
    lead = np.cumsum(holders) - holders  # an entry's holders are one document's places in one chunk
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    shared = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) else order
    if len(shared):
        # every window of the entries whose minimiser is not alone
        entry = np.repeat(shared, n[shared])
        offset = ragged(np.zeros(len(shared), np.int64), n[shared])
        bits = window[ragged((np.cumsum(n) - n)[shared], n[shared])]
        holder = doc[lead[entry]]
        order = np.lexsort((at[lead[entry]].astype(np.int64) + offset, holder, bits, key[entry]))
        k, b = key[entry][order], bits[order]
        head = np.concatenate(([True], (k[1:] != k[:-1]) | (b[1:] != b[:-1])))
        source = np.empty(len(order), np.int64)  # the window that stands in the smallest document
        source[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        hit = holder > holder[source]
        source = source[hit]
        ref, ref_at = holder[source], at[lead[entry[source]]].astype(np.int64) + offset[source]
        entry, offset = entry[hit], offset[hit]
        # runs of windows of one entry that stand in a row in one document
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(entry) != 0) | (np.diff(offset) != 1) | (np.diff(ref) != 0) | (np.diff(ref_at) != 1)))) if len(entry) else np.empty(0, np.int64)
        length = np.diff(np.append(cut, len(entry)))
        entry, offset, ref, ref_at = entry[cut], offset[cut], ref[cut], ref_at[cut]
        place = ragged(lead[entry], holders[entry])
        times = holders[entry]
        out.append((doc[place], tag[place], at[place] + np.repeat(offset, times), np.repeat(length, times), np.repeat(ref, times), np.repeat(ref_at, times)))
    for d, t, a, m, r, p in out:
        for i in range(0, len(d), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.record_batch([pa.array(d[s]), pa.array(t[s].astype(np.int32)), pa.array(a[s].astype(np.int32)), pa.array(m[s].astype(np.int32)), pa.array(r[s]), pa.array(p[s].astype(np.int32))], names=["doc_id", "tag", "at", "n_windows", "ref", "ref_at"])


def duplicate_runs(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Runs of consecutive windows of a document that stand in a row in a smaller one: doc_id, tag, at (word), n_windows, ref, ref_at."""
    texts = runtime.texts_of(docs.where("doc_id is not null"), F.col("doc_id").cast("long").alias("doc_id"))
    loads = texts.mapInArrow(_loads(window, anchor, max(1, HOT // COUNTED)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("key").isNull() | (F.col("n") > HOT)).collect()
    shards = max(1, *(-(-r["n"] // SHARD_BYTES) for r in loads if r["key"] is None), runtime.shuffle_partitions(docs.sparkSession))
    hot = {r["key"]: -(-r["n"] // HOT) for r in loads if r["key"] is not None}
    entries = texts.mapInArrow(_index_entries(shards, hot, window, anchor), INDEX)
    return entries.repartitionById(shards, F.col("shard")).mapInArrow(_answers, RUNS)


def _parse(window: int):
    def parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in chunks(batches):
            words = Words(texts)
            runs = table.column("runs").combine_chunks()
            runs = pa.concat_arrays(runs.chunks) if isinstance(runs, pa.ChunkedArray) else runs
            doc = np.repeat(np.arange(len(texts)), runs.value_lengths().fill_null(0).to_numpy())
            flat = runs.flatten()
            tag, at, n, ref, ref_at = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
            own = tag == _tags(texts)[doc] if len(doc) else np.empty(0, bool)
            order = np.lexsort((at[own], doc[own]))
            doc, at, n, ref, ref_at = (x[own][order] for x in (doc, at, n, ref, ref_at))
            starts = np.ones(len(doc), bool)  # a factor goes on while the next window stands at the next word of the same document
            starts[1:] = (np.diff(doc) != 0) | (at[1:] != at[:-1] + n[:-1]) | (np.diff(ref) != 0) | (np.diff(ref_at) != n[:-1])
            start = np.flatnonzero(starts)
            last = np.append(start[1:], len(doc))[: len(start)] - 1
            begin, end = words.first[doc[start]] + at[start], words.first[doc[start]] + at[last] + n[last] + window - 1
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, end, -1)
            gone = np.cumsum(cover)[:-1] > 0
            factors = np.bincount(doc[start], minlength=len(texts))
            removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first])
            digests = []
            for d, text in enumerate(texts):
                own = text.split()
                if removed[d]:
                    own = compress(own, (~gone[words.first[d] : words.first[d + 1]]).tolist())
                digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
            yield pa.record_batch([table.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(words.count), pa.array(removed), pa.array(digests), pa.array(factors)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors"])

    return parsed


def remove_duplicate_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """For each document: n_words, n_removed, the digest of the words kept, and the number of factors."""
    runs = duplicate_runs(docs, window, anchor).groupBy("doc_id").agg(F.collect_list(F.struct("tag", "at", "n_windows", "ref", "ref_at")).alias("runs"))
    texts = runtime.texts_of(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return texts.join(runs, "doc_id", "left").mapInArrow(_parse(window), KEPT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table, against every other."""
    return remove_duplicate_spans(runtime.table(spark, sf_dir, "documents")).drop("n_factors")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM p),
m AS (SELECT k, min(doc_id) AS first_doc FROM g GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN m USING (k) WHERE doc_id > first_doc),
k AS (SELECT w.doc_id, len(ws) AS n_words, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) AS t, count(*) AS n FROM k LEFT JOIN gone ON k.doc_id = gone.doc_id AND k.i = gone.i WHERE gone.i IS NULL GROUP BY k.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
