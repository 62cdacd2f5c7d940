import re
from collections import Counter

import numpy as np

from graphloom.llm import quality
from tests.llm.common import empty, odd, odd_rows, prose, words


def base(text):
    w = words(text)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, cover = Counter(three), set()
    for i, x in enumerate(three):
        if times[x] > 1:
            cover |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover), failed


def test_base_rule(spark):
    got = quality.judged(odd(spark), None).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted((repr(i), *base(t)) for i, t, *_ in odd_rows())
    assert all(r.kept != r.base_failed for r in got)


def test_learns_junk(spark):
    import random

    rng = random.Random(2)
    rows = [(i, prose(rng, 90) if i % 3 else prose(rng, 90).replace(" ", "### ")) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 240, 2)] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.kept for r in quality.judged(docs, model).collect()}
    assert got == {i: i % 3 > 0 for i in range(240)}
    assert quality.kept_rows(docs, model).count() == 160


def test_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((np.sin(6 * x[:, 0]) + x[:, 1] + 0.3 * rng.random(600)) > 0.8).astype(float)
    trees = quality.fit_trees(x, y, falling=(0,), n_trees=20)
    line = np.tile([0.0, 0.5, 0.5], (200, 1))
    line[:, 0] = np.linspace(0, 1, 200)
    assert (np.diff(trees.score(line)) <= 1e-12).all()
    free = quality.fit_trees(x, y, n_trees=20)
    assert (np.diff(free.score(line)) > 0).any()
    assert ((free.score(x) > 0) == (y > 0)).mean() > 0.9


def test_scores_against_a_plain_walk():
    rng = np.random.default_rng(3)
    x = rng.random((300, 4))
    trees = quality.fit_trees(x, (x[:, 0] + x[:, 2] > 1).astype(float), falling=(1,), n_trees=7)
    x[:20] = np.round(x[:20], 1)
    x[20:24] = [[0.0] * 4, [1.0] * 4, [np.inf] * 4, [-np.inf] * 4]
    for row, got in zip(x.tolist(), trees.score(x).tolist()):
        want = trees.start
        for feature, threshold, value in zip(trees.feature.tolist(), trees.threshold.tolist(), trees.value.tolist()):
            node = 0
            for _ in range(trees.depth):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            want += value[node - len(feature)]
        assert abs(got - want) < 1e-9


def test_no_labels_and_empty(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.fit(odd(spark), labels) is None
    assert quality.fit(empty(spark), labels) is None
    assert quality.judged(empty(spark), None).collect() == []
    assert quality.kept_rows(odd(spark), None).columns == odd(spark).columns
