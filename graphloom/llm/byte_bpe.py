"""Byte-level BPE: texts to token ids and back.

Texts are cut into pre-tokens by the vocabulary's pattern, then each pre-token is looked up in two tiers.

First tier: a minimal perfect hash over the vocabulary (hash and displace: a key's bucket gives the displacement that
sends the bucket's keys to free slots; buckets of one key name their slot). All pre-tokens of a block of text are
hashed, placed and compared with the key in their slot byte by byte, as arrays; most are whole tokens.

Second tier: for the rest, byte pairs are merged, the lowest rank first and the leftmost of equal ranks, with a heap of
candidate merges over a doubly linked list of parts: n log n in the bytes, also where a text is one pre-token. Each
different miss of a block is merged once; the last ``REMEMBERED`` (and up to as many before them) are kept for later ones.

Scale: no shuffle; a task reads its documents as chunks and holds one block of text at a time. The vocabulary (a file of
ranks, some megabytes) is broadcast. Texts are cut into blocks only where a character other
than white space precedes white space; no pre-token spans such a place.

Cases: a null text is the empty one: no ids, no bytes. Null and repeated doc_ids give a row each. Texts are UTF-8, and
decoding gives their bytes back. Empty tables give no rows; other columns are not read. An id that the vocabulary does
not have raises an error.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .textops import U64, chunks, hash_spans, mix, ragged, same_spans

VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK = 1 << 20  # characters of text
REMEMBERED = 1 << 17
_SPREAD = 4  # keys to a bucket
_CUT = regex.compile(r"(?<=\S)(?=\s)")


class PerfectHash:
    """A slot in 0 .. n - 1 for each of n different keys of 64 bits; any other key gets some slot too."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // _SPREAD)
        self.shift = np.zeros(self.buckets, np.int64)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        begin = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(n, bool)
        size = np.diff(begin)
        tries = np.arange(1, 257, dtype=np.int64)
        for b in np.argsort(-size, kind="stable"):
            if size[b] < 2:
                break
            own, base = keys[order[begin[b] : begin[b + 1]]], 0
            while True:
                slots = self._displaced(own[None, :], (tries + base)[:, None])
                ok = free[slots].all(1)
                for i in np.flatnonzero(ok):
                    if len(np.unique(slots[i])) == len(own):
                        free[slots[i]] = False
                        self.shift[b] = tries[i] + base
                        break
                else:
                    base += len(tries)
                    continue
                break
        lone = np.flatnonzero(size == 1)
        self.shift[lone] = -np.flatnonzero(free)[: len(lone)] - 1

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys % U64(self.buckets)).astype(np.int64)

    def _displaced(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(keys + shift.astype(U64) * U64(0x9E3779B97F4A7C15)) % U64(max(self.n, 1))).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        shift = self.shift[self._bucket(keys)]
        return np.where(shift < 0, -shift - 1, self._displaced(keys, shift))


class Vocabulary:
    """A file of ranks (base64 of a token's bytes, a space, its id) and the pattern of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.pattern = regex.compile(pattern)
        self.pairs = {(a, b): self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)}
        tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        ids = np.array([self.ranks[t] for t in tokens], np.int64)
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        data = np.frombuffer(b"".join(tokens) + b"\0" * 8, np.uint8)
        begin = np.cumsum(length) - length
        keys = hash_spans(data, begin, begin + length)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two tokens have one hash")
        self.data, self.hash = data, PerfectHash(keys)
        at = np.empty(len(keys), np.int64)
        at[self.hash.slots(keys)] = np.arange(len(keys))
        self.slot_begin, self.slot_length, self.slot_id = begin[at], length[at], ids[at]
        self.id_begin, self.id_length = np.zeros(ids.max(initial=-1) + 1, np.int64), np.full(ids.max(initial=-1) + 1, -1)
        self.id_begin[ids], self.id_length[ids] = begin, length
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def whole(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The id of each span that is a token, else -1; at least eight bytes must follow the last span."""
        slot = self.hash.slots(hash_spans(data, start, end))
        found = np.full(len(start), -1, np.int64)
        maybe = np.flatnonzero(self.slot_length[slot] == end - start)
        s = slot[maybe]
        same = same_spans(data, start[maybe], self.data, self.slot_begin[s], self.slot_length[s])
        found[maybe[same]] = self.slot_id[s[same]]
        return found

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece by merges, the lowest rank first, the leftmost of equals."""
        n, ranks, pairs = len(piece), self.ranks, self.pairs
        width = n.bit_length() + 1
        low = (1 << width) - 1
        # a candidate merge is one integer: its rank, its begin, its end
        heap = [rank << width + width | i << width | i + 2 for i, rank in enumerate(map(pairs.__getitem__, zip(piece, piece[1:]))) if rank >= 0]  # noqa: B905
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while heap:
            top = pop(heap)
            i, end = top >> width & low, top & low
            j = after[i]
            if not j or j >= end or after[j] != end:
                continue  # one of the two parts is another by now
            after[i], after[j] = end, 0  # j is no part's begin any more
            if end < n:
                before[end] = i
                rank = ranks.get(piece[i : after[end]])
                if rank is not None:
                    push(heap, rank << width + width | i << width | after[end])
            if i:
                left = before[i]
                rank = ranks.get(piece[left:end])
                if rank is not None:
                    push(heap, rank << width + width | left << width | end)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _missed(self, piece: bytes) -> bytes:
        """As merged, as 32-bit integers in a row; what was met lately is remembered."""
        ids = self.young.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            if ids is None:
                ids = np.array(self.merged(piece), np.uint32).tobytes()
            if len(self.young) >= REMEMBERED:
                self.young, self.old = {}, self.young
            if len(piece) <= 256:
                self.young[piece] = ids
        return ids

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; no text is cut here."""
        pieces, count = [], []
        for t in texts:
            pieces += self.pattern.findall(t)
            count.append(len(pieces))
        raw = "".join(texts).encode()
        data = np.frombuffer(raw + b"\0" * 8, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        del pieces
        if len(ends) and len(raw) != ends[-1]:  # from characters to bytes
            ends = np.append(np.flatnonzero((data[: len(raw)] & 0xC0) != 0x80), len(raw))[ends]
        start = np.concatenate((np.zeros(1, np.int64), ends))[:-1]
        found = self.whole(data, start, ends)
        miss = np.flatnonzero(found < 0)
        different: dict[bytes, int] = {}
        which = np.fromiter((different.setdefault(raw[a:b], len(different)) for a, b in zip(start[miss].tolist(), ends[miss].tolist(), strict=True)), np.int64, len(miss))
        own = [self._missed(d) for d in different]
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat, begin = np.frombuffer(b"".join(own), np.uint32), np.cumsum(size) - size
        width = np.ones(len(found), np.int64)
        width[miss] = size[which]
        at = np.concatenate((np.zeros(1, np.int64), np.cumsum(width)))
        ids = np.empty(int(at[-1]), np.uint32)
        hit = np.flatnonzero(found >= 0)
        ids[at[hit]] = found[hit]
        ids[ragged(at[miss], size[which])] = flat[ragged(begin[which], size[which])]
        return np.split(ids, at[np.array(count, np.int64)][:-1])

    def encode_many(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        block: list[str] = []
        owner: list[int] = []
        size = 0
        for i, raw in enumerate(texts):
            text, at = raw.decode("utf-8", "replace"), 0
            while at < len(text):
                cut = _CUT.search(text, at + BLOCK) if len(text) - at > BLOCK else None
                end = cut.start() if cut else len(text)
                if block and size + end - at > BLOCK:
                    for k, ids in zip(owner, self._ids(block), strict=True):
                        parts[k].append(ids)
                    block, owner, size = [], [], 0
                block.append(text[at:end])
                owner.append(i)
                size += end - at
                at = end
        if block:
            for k, ids in zip(owner, self._ids(block), strict=True):
                parts[k].append(ids)
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.empty(0, np.uint32) for p in parts]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.max() >= len(self.id_length) or (self.id_length[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        return np.concatenate([self.data[ragged(self.id_begin[part], self.id_length[part])] for lo in range(0, len(ids), BLOCK) for part in (ids[lo : lo + BLOCK],)] or [np.empty(0, np.uint8)])


def public_vocabulary(spark: SparkSession, name: str = VOCABULARY) -> Broadcast:
    """A public vocabulary for encoded and decoded: some megabytes, whatever the tables hold; sent to each worker once."""
    import public_tokenizers

    return spark.sparkContext.broadcast(Vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN))


def encoded(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """doc_id, ids: each text's ids as little-endian unsigned 32-bit integers in a row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in chunks(batches):
            ids = [x.astype("<u4").tobytes() for x in vocabulary.value.encode_many(texts)]
            yield from pa.table([table.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"]).to_batches()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary"
    return runtime.texts_of(docs, "doc_id").mapInArrow(run, schema)


def decoded(rows: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """doc_id, ids, decoded: and the bytes that the ids (as of encoded) stand for; null ids are none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ids in chunks(batches, "ids"):
            texts = [vocabulary.value.decode(np.frombuffer(x, "<u4")).tobytes() for x in ids]
            yield from table.append_column("decoded", pa.array(texts, pa.binary())).to_batches()

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary"
    return rows.select("doc_id", "ids").mapInArrow(run, schema)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded: how many ids, and digests of the ids and of the bytes that they give."""
    vocabulary = public_vocabulary(spark)
    rows = decoded(encoded(runtime.table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
