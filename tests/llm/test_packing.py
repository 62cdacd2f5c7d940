import random
import zlib

import numpy as np
import pytest

from graphloom.llm.packing import CAPACITY, SEQUENCE, cut, packed
from tests.llm.common import empty, odd, odd_rows, prose

public_tokenizers = pytest.importorskip("public_tokenizers")


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, got):
    want = sorted((repr(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in ((i, ids_of(t)) for i, t, *_ in rows))
    seen = sorted((repr(r.doc_id), r.doc_tokens, r.ids_crc32) for r in got if r.length == r.doc_tokens)
    assert set(seen) <= set(want)
    assert sum(r.length for r in got) == sum(w[1] for w in want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= CAPACITY
    return by


def test_odd_documents(spark):
    got = packed(odd(spark)).collect()
    check(odd_rows(), got)
    texts = {(repr(i), len(ids_of(t))): ids_of(t) for i, t, *_ in odd_rows()}
    for r in got:
        ids = np.array(texts[repr(r.doc_id), r.doc_tokens], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_little_padding(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(1, 900))) for i in range(200)]
    by = check(rows, packed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    sizes = [sum(n for _, n in parts) for parts in by.values()]
    padding = sum(0 if n & (n - 1) == 0 else CAPACITY - n for n in sizes)
    assert padding < 0.01 * sum(sizes)


def test_keeps_the_order(spark):
    rows = [(i, "word " * 300) for i in range(40)]
    got = sorted(packed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_cut_is_optimal(seed):
    rng, capacity = random.Random(seed), 16
    place = [0]
    while place[-1] < 120:
        place.append(place[-1] + rng.randrange(1, 9))
    penalty = [0] + [rng.choice([0, 2, 5]) for _ in place[1:]]
    _, cost = cut(np.array(place), np.array(penalty), capacity)
    best = [0.0]
    for j in range(1, len(place)):
        best.append(min(best[i] + (0 if (n := place[j] - place[i]) & (n - 1) == 0 else capacity - n) + penalty[j] + SEQUENCE for i in range(j) if place[j] - place[i] <= capacity))
    assert cost == pytest.approx(best)


def test_empty_table(spark):
    assert packed(empty(spark)).collect() == []
