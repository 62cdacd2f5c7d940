"""Order-preserving packing of documents into sequences, cut by dynamic programming.

The documents of a partition, in the order in which they are read, are one stream of token ids.
f(j), the least cost of cutting the first j tokens into sequences of at most ``capacity``, is the
least over places i < j of f(i) + padding(j - i) + penalty(j) + ``SEQUENCE``. A sequence is padded
to capacity, except at a power of two. As the padding is linear, the best i of the window
[j - capacity, j) is that with the least f(i) + i, kept at the front of a monotone queue, so each
place costs constant time; powers of two are tried by themselves. Places are the ends of documents (penalty 0), of sentences
(``SENTENCE``) and, where those are further apart than ``SPREAD``, of words or at worst of tokens
(``WORD``). Penalties, and ``SEQUENCE`` for each sequence, are in tokens of padding.

Scale: each partition of the input is packed by itself, in blocks of about ``BLOCK`` tokens of
which the last sequences are carried over, so nothing is shuffled and memory is bounded by a block
and the longest document. At most one sequence of a partition may be short. sequence_id is the
partition's number times 2^40 plus a counter: retried tasks give the same.

Cases: a null or empty text is its end id alone. Null and repeated doc_ids are packed like others.
Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .textops import LARGE_CHUNK, Words, chunks, hash_spans, ragged

CAPACITY = 4096
END_ID = 2
SENTENCE, WORD, SEQUENCE = 12, 48, 8
SPREAD = 64
BLOCK = 1 << 20
PUNCTUATION = b".,;:!?%*#$&|)]\""
VOCABULARY = 1 << 20  # different words a worker remembers before it starts anew
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Numbers:
    """Numbers by hash, in sorted arrays: a tenth of a dict's memory, and given back to the system when dropped."""

    def __init__(self) -> None:
        self.hash, self.number = np.empty(0, np.uint64), np.empty(0, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """-1: not there."""
        if not len(self.hash):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.number[at], -1).astype(np.int64)

    def add(self, h: np.ndarray, number: np.ndarray) -> None:
        order = np.argsort(h)
        at = np.searchsorted(self.hash, h[order])
        self.hash, self.number = np.insert(self.hash, at, h[order]), np.insert(self.number, at, number[order])


def _hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words) + b"\0" * 8, np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return hash_spans(data, np.concatenate(([0], ends[:-1])), ends)


class WordTokenizer:
    """Ids of texts, by words: this tokenizer splits at all white space, so a text's ids are its words' ids in a row.

    Different words are tokenized once and remembered; new ones many to a call, joined by spaces. Where one word's ids
    end is then found by counting pre-tokens: the last id of each has the end-of-word suffix. Words for which the count
    could differ (not normalised, special tokens), and calls in which it does, are tokenized by themselves.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            pattern = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.parts = regex.compile(pattern).findall
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.words = _Numbers()
        self.pieces = _Numbers()  # of words without case and punctuation, and of punctuation
        self.size = 0
        self.flat, self.begin, self.stop = np.empty(1 << 16, np.uint32), np.zeros((1 << 14) + 1, np.int64), np.empty(1 << 14, bool)

    def _ids(self, words: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
        """Some of the words, their ids in a row, and how many are each one's."""
        alone, plain, texts = [], [], []
        for w in words:
            text = w.decode("utf-8", "replace")
            if "<|" not in text and (len(text) == len(w) or unicodedata.is_normalized("NFC", text) and len(text.lower()) == len(text)):
                plain.append(w)
                texts.append(text)
            else:
                alone.append(w)
        for lo in range(0, len(plain), 1024):
            part = texts[lo : lo + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
            last = np.cumsum([len(self.parts(w.lower())) for w in part])
            if last[-1] == len(ends) - 1:
                yield plain[lo : lo + 1024], ids, np.diff(ends[last], prepend=0)
            else:
                alone += plain[lo : lo + 1024]
        for lo in range(0, len(alone), 1024):
            part = alone[lo : lo + 1024]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)]
            yield part, np.array([i for own in ids for i in own], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _learn(self, new: list[bytes]) -> np.ndarray:
        """The numbers of new words. Words apart from punctuation after them and from the case of A-Z are tokenized; those that have it are put together."""
        cores, tails = [], []
        for w in new:
            core = w.rstrip(PUNCTUATION)
            if core and core[-1:].isalnum():
                tail = w[len(core) :]
            else:
                core, tail = w, b""
            cores.append(core.lower())
            tails.append(tail)
        pieces = list(dict.fromkeys(cores) | dict.fromkeys(filter(None, tails)))
        hashes = _hashes(pieces)
        missing = np.flatnonzero(self.pieces.find(hashes) < 0)
        if len(missing):
            by_name, begin, order = dict(zip((pieces[i] for i in missing.tolist()), missing.tolist())), self.size, []
            for words, ids, count in self._ids(list(by_name)):
                order += map(by_name.__getitem__, words)
                self._add(words, ids, count)
            self.pieces.add(hashes[order], np.arange(begin, self.size))
        known = dict(zip(pieces, self.pieces.find(hashes).tolist()))
        number = np.fromiter(map(known.__getitem__, cores), np.int64, len(new))
        apart = [i for i, (w, c) in enumerate(zip(new, cores)) if w != c]
        if apart:
            parts = np.empty(2 * len(apart), np.int64)
            parts[0::2], parts[1::2] = number[apart], [known[tails[i]] if tails[i] else -1 for i in apart]
            n = np.where(parts < 0, 0, self.begin[parts + 1] - self.begin[parts])
            number[apart] = np.arange(self.size, self.size + len(apart))
            self._add([new[i] for i in apart], self.flat[ragged(self.begin[parts], n)], n[0::2] + n[1::2])
        return number

    def _add(self, words: list[bytes], ids: np.ndarray, count: np.ndarray) -> None:
        n, m = self.size, self.size + len(words)
        at, end = self.begin[n], self.begin[n] + len(ids)
        if m > len(self.stop):
            self.begin, self.stop = np.resize(self.begin, 2 * m + 1), np.resize(self.stop, 2 * m)
        if end > len(self.flat):
            self.flat = np.resize(self.flat, 2 * int(end))
        self.flat[at:end] = ids
        self.begin[n + 1 : m + 1] = at + np.cumsum(count)
        self.stop[n:m] = np.fromiter((w.rstrip(b"\"')]").endswith((b".", b"!", b"?")) for w in words), bool, len(words))
        self.size = m

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the number of them by text, and for each id 2 at the end of a sentence, 1 at that of another word, else 0."""
        if self.size > VOCABULARY:
            self.forget()
        words = Words(texts)
        unique, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at = self.words.find(unique)
        if len(missing := np.flatnonzero(at < 0)):
            data, place = words.data.tobytes(), first[missing]
            at[missing] = self._learn([data[a:b] for a, b in zip(words.start[place].tolist(), words.end[place].tolist())])
            self.words.add(unique[missing], at[missing])
        at = at[inverse]
        n = self.begin[at + 1] - self.begin[at]
        ids = self.flat[ragged(self.begin[at], n)]
        mark = np.zeros(len(ids), np.int8)
        last = np.cumsum(n) - 1
        mark[last[n > 0]] = 1
        mark[last[(n > 0) & self.stop[at]]] = 2
        return ids, np.diff(np.concatenate(([0], np.cumsum(n)))[words.first]), mark


def places_of(counts: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where documents of counts tokens (the end id included) may be cut, and the penalties; mark is that of the ids without end ids."""
    ends = np.cumsum(counts)
    penalty = np.full(int(ends[-1]) + 1, -1, np.int32)
    at = np.arange(len(mark)) + np.repeat(np.arange(len(counts)), counts - 1) + 1
    penalty[at[mark == 2]] = SENTENCE
    penalty[ends] = 0
    penalty[0] = 0
    stops = np.flatnonzero(penalty >= 0)
    wide = np.flatnonzero(np.diff(stops) > SPREAD)
    if len(wide):  # the last end of a word in each SPREAD tokens, or a token
        word = np.zeros(len(penalty), bool)
        word[at[mark == 1]] = True
        extra = ragged(np.ones(len(wide), np.int64), (np.diff(stops)[wide] - 1) // SPREAD)
        goal = np.repeat(stops[wide], (np.diff(stops)[wide] - 1) // SPREAD) + extra * SPREAD
        ends_of_words = np.flatnonzero(word)
        if len(ends_of_words):
            near = ends_of_words[np.maximum(np.searchsorted(ends_of_words, goal, side="right") - 1, 0)]
            goal = np.where((near <= goal) & (near > goal - SPREAD), near, goal)
        fresh = goal[penalty[goal] < 0]
        penalty[fresh] = WORD
        stops = np.flatnonzero(penalty >= 0)
    return stops, penalty[stops]


def cut(place: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY) -> tuple[list[int], list[float]]:
    """For every place the place before it at the least cost, and that cost. The first place is 0; neighbours are at most capacity apart."""
    n = len(place)
    cost, back = [0.0] * n, [0] * n
    powers: list[tuple[int, ...]] = [()] * n  # places that are a power of two before
    for power in (1 << k for k in range(capacity.bit_length()) if 1 << k <= capacity):
        at = np.minimum(np.searchsorted(place, place - power), n - 1)
        hit = np.flatnonzero(place[at] == place - power)
        for j, k in zip(hit.tolist(), at[hit].tolist()):
            powers[j] += (k,)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # cost + place, place, number: rising
    for j, (p, extra) in enumerate(zip(place.tolist(), (penalty + SEQUENCE).tolist())):
        if not j:
            continue
        while queue[0][1] < p - capacity:
            queue.popleft()
        best, _, i = queue[0]
        best += capacity - p
        for k in powers[j]:
            if cost[k] < best:
                best, i = cost[k], k
        best += extra
        cost[j], back[j] = best, i
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    return back, cost


def _cuts(place: np.ndarray, penalty: np.ndarray, capacity: int) -> np.ndarray:
    back, _ = cut(place, penalty, capacity)
    out, j = [], len(place) - 1
    while j:
        out.append(int(place[j]))
        j = back[j]
    return np.array(out[::-1], np.int64)


def _pack(path: str, capacity: int, end_id: int):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        sequence = TaskContext.get().partitionId() << 40
        docs: list[tuple] = []  # doc_id, tokens, tokens that are behind the stream's first place
        held: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal docs, held, marks, size, sequence
            counts = np.array([n - gone for _, n, gone in docs], np.int64)
            ids, mark = np.concatenate(held), np.concatenate(marks)
            cuts = _cuts(*places_of(counts, mark), capacity)
            if not last:  # what follows may change the last cuts
                cuts = cuts[: max(1, len(cuts) - 8)]
            total = int(cuts[-1])
            ends = np.cumsum(counts)
            begins = ends - counts
            edge = np.unique(np.concatenate((cuts, ends[ends <= total])))
            begin = np.concatenate(([0], edge[:-1]))
            doc = np.searchsorted(ends, begin, side="right")
            seq = np.searchsorted(cuts, begin, side="right")
            seq_begin = np.concatenate(([0], cuts[:-1]))[seq]
            raw = ids.astype("<u4", copy=False)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), edge.tolist())]
            gone = np.array([g for _, _, g in docs], np.int64)
            all_tokens = np.array([n for _, n, _ in docs], np.int64)
            for lo in range(0, len(edge), 1 << 15):
                s = slice(lo, lo + (1 << 15))
                d = doc[s].tolist()
                yield pa.record_batch([pa.array([docs[i][0] for i in d], pa.int64()), pa.array(begin[s] - begins[doc[s]] + gone[doc[s]]), pa.array(edge[s] - begin[s]), pa.array(crc[s], pa.int64()), pa.array(all_tokens[doc[s]]), pa.array(sequence + seq[s]), pa.array(begin[s] - seq_begin[s])], names=[c.split()[0] for c in PIECES.split(", ")])
            sequence += len(cuts)
            kept = int(np.searchsorted(ends, total, side="right"))
            if kept < len(docs):
                d, n, g = docs[kept]
                into = total - int(begins[kept])
                rest_marks = int((counts[:kept] - 1).sum()) + into
                docs = [(d, n, g + into), *docs[kept + 1 :]]
                held, marks, size = [ids[total:]], [mark[rest_marks:]], len(ids) - total
            else:
                docs, held, marks, size = [], [], [], 0

        for table, texts in chunks(batches, limit=LARGE_CHUNK):
            ids, counts, mark = tokenizer.encode(texts)
            docs += zip(table.column("doc_id").to_pylist(), (counts + 1).tolist(), [0] * len(texts))
            held.append(np.insert(ids, np.cumsum(counts), np.uint32(end_id)))
            marks.append(mark)
            size += len(held[-1])
            if size > BLOCK:
                yield from flush(False)
        if size:
            yield from flush(True)

    return pack


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: where it is in its document and in its sequence. path: the tokenizer's file, on every executor."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return runtime.texts_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_pack(path, capacity, end_id), PIECES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packed(runtime.table(spark, sf_dir, "documents"))
