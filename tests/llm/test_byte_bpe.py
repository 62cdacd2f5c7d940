import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from graphloom.llm import byte_bpe, registry, runtime

from .common import empty, odd, odd_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def row(reference, doc, text):
    ids = reference.encode_ordinary(text or "")
    return doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 20_000])
def test_minimal_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    assert sorted(byte_bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(len(keys)))


def texts():
    rng = random.Random(3)
    letters = ["a", "b", "é", "漢", "😀", "x" * 40, "́"]
    for n in (0, 1, 2, 3, 10, 100, 2000):
        for white in (" ", "\n", " \n \t", " ", "  ", ""):
            yield white.join(rng.choice(["don't", "I'LL", "12", "٣", "!?", "<|endoftext|>", "".join(rng.choices(letters, k=rng.randrange(6)))]) for _ in range(n)) + white * 3
    yield "a" * 30_001
    yield "".join(rng.choices("ab", k=5000))
    yield " " * 5000 + "x"
    yield "".join(chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000)


@pytest.mark.parametrize("block", [1 << 20, 16])
def test_as_the_library(vocabulary, reference, monkeypatch, block):
    monkeypatch.setattr(byte_bpe, "BLOCK", block)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    given = list(texts())
    got = vocabulary.encode_many([t.encode() for t in given])
    for t, ids in zip(given, got, strict=True):
        assert ids.tolist() == reference.encode_ordinary(t)
        assert vocabulary.decode(ids).tobytes() == t.encode()


def test_every_token_decodes_and_is_found_whole(vocabulary, reference):
    for token, rank in vocabulary.ranks.items():
        assert vocabulary.decode(np.array([rank])).tobytes() == token
    data = np.frombuffer(b"".join(vocabulary.ranks) + b"\0" * 8, np.uint8)
    ends = np.cumsum([len(t) for t in vocabulary.ranks])
    assert vocabulary.whole(data, np.append(0, ends[:-1]), ends).tolist() == list(vocabulary.ranks.values())


def test_unknown_id(vocabulary):
    with pytest.raises(ValueError, match="not in the vocabulary"):
        vocabulary.decode(np.array([5, 50256]))


def test_odd_rows(spark, reference):
    v = byte_bpe.public_vocabulary(spark)
    docs = odd(spark).withColumnsRenamed({"rep": "ids", "runs": "decoded"})
    got = byte_bpe.decoded(byte_bpe.encoded(docs, v), v).collect()
    have = sorted(((r.doc_id, len(r.ids) // 4, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded).hexdigest()) for r in got), key=repr)
    assert have == sorted((row(reference, d, t) for d, t, *_ in odd_rows()), key=repr)


def test_empty_table(spark):
    v = byte_bpe.public_vocabulary(spark)
    assert byte_bpe.decoded(byte_bpe.encoded(empty(spark), v), v).collect() == []


def test_query(spark, reference):
    got = sorted(map(tuple, registry.QUERIES["op12_byte_bpe"](spark, SF).collect()))
    docs = runtime.table(spark, SF, "documents").select("doc_id", "text").collect()
    assert got == sorted(row(reference, r.doc_id, r.text) for r in docs)
