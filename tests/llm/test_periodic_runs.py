import hashlib
import random
import zlib

import numpy as np
import pytest

from graphloom.llm import periodic_runs, registry, runtime

from .common import empty, odd, odd_rows, words

SF = "/root/testdata/sf0.001"


def plain(w):
    """(start, length, period) of all runs of a list, period by period."""
    _, w = np.unique(np.array(w, object), return_inverse=True) if len(w) else (None, np.empty(0, int))
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (w[: n - q] == w[q:]).astype(int), [0]))))
        for s, e in zip(edge[::2], edge[1::2] + q, strict=True):
            if e - s >= max(6, 4 * q) and not any(q % d == 0 and (w[s : e - d] == w[s + d : e]).all() for d in range(1, q)):
                out.append((int(s), int(e - s), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_periodic(doc_id, w):
    h = None if doc_id is None else zlib.crc32(b"%d" % doc_id)
    if h is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def left(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row(doc_id, text):
    w = made_periodic(doc_id, words(text))
    runs = plain(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return doc_id, len(runs), *four, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(left(w, runs))


def blocks(rng):
    out = []
    for _ in range(rng.randrange(12)):
        letters = rng.choice([1, 2, 3, 6])
        unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 12))] * rng.choice([1, 1, 2, 4, 5, 7])
        out += unit[: len(unit) - rng.randrange(3)] + [rng.randrange(letters)] * rng.choice([0, 0, 1, 7])
    return out


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    docs = [blocks(rng) for _ in range(rng.randrange(6))]
    docs += docs[:2]  # copies share the grammar
    flat = np.array([x for d in docs for x in d], np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    want, at = [], 0
    for d in docs:
        want += [(at + s, at + s + n, q) for s, n, q in plain(d)]
        at += len(d)
    assert list(zip(*(x.tolist() for x in periodic_runs.runs_of(flat, doc)), strict=True)) == want


@pytest.mark.parametrize("w", [[0] * 30_000, list(range(700)) * 40 + [5], [0, 1] * 9_000 + [0, 0] * 9_000, [bin(i).count("1") % 2 for i in range(1 << 13)]], ids=["one word", "long period", "two", "thue-morse"])
def test_long_sequences(w):
    got = periodic_runs.runs_of(np.array(w), np.zeros(len(w), np.int64))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [(s, s + n, q) for s, n, q in plain(w)]


def test_the_grammar_joins_what_repeats():
    """Each symbol has the same words wherever it is derived, a pair that occurs twice is not left, and a power takes few symbols."""
    w = np.array([1, 2, 3] * 512 + [9] + [1, 2, 3] * 512)
    total = 0
    for number, begin, middle, end in periodic_runs.derivation(w, np.zeros(len(w), np.int64)):
        for k in range(int(number.max()) + 1):
            of = np.flatnonzero(number == k)
            total += 1
            assert len({tuple(w[begin[i] : end[i]]) for i in of}) == 1 and len({middle[i] - begin[i] for i in of}) == 1
    assert total < 30


def test_wrong_hashes_are_found_out(monkeypatch):
    """Equal hashes alone make no run."""
    monkeypatch.setattr(periodic_runs.Stretches, "longest", lambda self, a, b, most, backward=False: most)
    w = [1, 2, 1, 2, 1, 2, 1, 2, 3, 4, 5, 6]
    got = periodic_runs.runs_of(np.array(w), np.zeros(len(w), np.int64))
    assert [tuple(x.tolist()) for x in got] == [(0,), (8,), (2,)]


def test_odd_rows(spark):
    rows = odd_rows()
    got = periodic_runs.found(odd(spark)).collect()
    have = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed).decode()) for r in got), key=repr)
    want = []
    for d, t, *_ in rows:
        w = words(t)
        want.append((d, len(w), plain(w), left(w, plain(w))))
    assert have == sorted(want, key=repr)


def test_empty_table(spark):
    assert periodic_runs.found(empty(spark), periodic_runs.planted).collect() == []


def test_query(spark):
    got = sorted(map(tuple, registry.QUERIES["op13_periodic_runs"](spark, SF).collect()))
    docs = runtime.table(spark, SF, "documents").select("doc_id", "text").collect()
    assert got == sorted(row(r.doc_id, r.text) for r in docs)
