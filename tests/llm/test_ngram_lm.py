import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import ngram_lm
from graphloom.llm.elias_fano import map_arrays
from tests.llm.common import WORD, empty, odd, odd_rows, prose


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), 0]


def brute(rows):
    train = [tokens(t) for i, t, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for t in train:
        c1.update(t)
        t = [1, 1, *t]
        c2.update(zip(t[1:], t[2:]))
        c3.update(zip(t, t[1:], t[2:]))
    n, v = sum(c1.values()), len(c1)

    d2 = d3 = ngram_lm.DISCOUNT
    t2, n2, t3, n3 = Counter(), Counter(), Counter(), Counter()
    for (a, _), x in c2.items():
        t2[a] += x
        n2[a] += 1
    for (a, b, _), x in c3.items():
        t3[a, b] += x
        n3[a, b] += 1

    def p(a, b, w):
        q = (c1[w] + 1) / (n + v + 1)
        if t2[b]:
            q = max(c2[b, w] - d2, 0) / t2[b] + d2 * n2[b] / t2[b] * q
        if t3[a, b]:
            q = max(c3[a, b, w] - d3, 0) / t3[a, b] + d3 * n3[a, b] / t3[a, b] * q
        return q

    out = []
    for i, text, *_ in rows:
        t = tokens(text)
        s = [1, 1, *t]
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        out.append((i, held, len(t), sum(c1[w] > 0 for w in t), n, sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(*s[k : k + 3])) for k in range(len(t)))))
    return out


def compare(rows, got, slack):
    want = sorted(brute(rows), key=lambda r: (repr(r[0]), r[2], r[5]))
    got = sorted(map(tuple, got), key=lambda r: (repr(r[0]), r[2], r[5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(g[6] - w[6]) <= slack * w[2]


def rounding(model):
    """The most that 8-bit codes can take from or add to a token's log10 probability: half a step of each code that is added."""
    step = [{k: x[1] / 2 for k, x in map_arrays(path)[1]["scale"].items()} for path in model.shards.values()]
    return max(max(s["p3"], s["w3"] + max(s["p2"], s["w2"])) for s in step) + 1e-6


def test_against_plain_counts(spark):
    model = ngram_lm.fit(odd(spark))
    compare(odd_rows(), ngram_lm.scored(odd(spark), model).collect(), rounding(model))


def test_many_shards(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 80, 60)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = ngram_lm.fit(docs, shard=700, vocabulary_shard=16)
    assert model.n_shards > 4 and len(model.vocabulary) > 4
    assert rounding(model) < 0.02
    compare(rows, ngram_lm.scored(docs, model).collect(), rounding(model))


def test_frequent_words_are_cut(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("the w%d" % rng.randrange(50) for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = ngram_lm.fit(docs, shard=500)
    assert len(model.groups) == 1 and max(model.groups.values()) > 2
    got = ngram_lm.scored(docs, model).collect()
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)  # logs: better than the base
    compare(rows, got, rounding(model) + 0.02)  # how many words follow a frequent one is estimated from each group


@pytest.mark.parametrize("shard", [40, 150, 500])
def test_scores_do_not_depend_on_shards(spark, shard):
    """However the trie is cut, and whichever words are cut with it, the scores are those of one shard."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"{rng.choice(['the', 'of'])} w{int(rng.expovariate(0.1))}" for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole, cut = ngram_lm.fit(docs, shard=10**9), ngram_lm.fit(docs, shard=shard, vocabulary_shard=8)
    assert not whole.groups and len(cut.groups) >= 2 and max(cut.groups.values()) > 1
    one, many = (sorted((r.doc_id, r.score) for r in ngram_lm.scored(docs, m).collect()) for m in (whole, cut))
    assert [s for _, s in many] == pytest.approx([s for _, s in one], abs=1e-9)
    compare(rows, ngram_lm.scored(docs, cut).collect(), rounding(cut))


def test_many_different_words(monkeypatch):
    """Trigrams whose numbers do not fit in one key are counted as those that do."""
    rng = random.Random(8)
    texts = [prose(rng, 300, 90).encode(), b"", prose(rng, 40, 9).encode()]
    hashes = np.unique(ngram_lm.hashed(texts)[0])

    class Known:
        base = np.array([0, len(hashes)])

        def ids(self, h):
            at = np.searchsorted(hashes, h)
            return at.astype(np.int64), at % 5 + 1

    def counted():
        second, first, third, many, seen, which, times, counts = ngram_lm._trigrams(texts, Known())
        assert (np.bincount(which, minlength=len(many)) == many).all()
        return {k: int(m) for *k, m in zip(second, first, third, many) for k in [tuple(map(int, k))]}, third[which].tolist(), times.tolist(), counts.tolist()

    packed = counted()
    monkeypatch.setattr(ngram_lm, "KEY_BITS", 8)
    assert counted() == packed and sum(packed[0].values()) == sum(packed[3])


def test_nothing_to_learn(spark):
    assert ngram_lm.scored(empty(spark), ngram_lm.fit(empty(spark))).collect() == []
    got = ngram_lm.scored(odd(spark), ngram_lm.fit(empty(spark))).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in got)
