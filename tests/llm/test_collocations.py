import random
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import collocations

from .common import empty, odd, odd_rows

SCHEMA = "doc_id long, text string, lang string, h1 string, n int, score int, word string, a int, bound string"


def plain(rows, top=collocations.TOP):
    """rows: (lang, text). Every phrase counted, every candidate scored."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= 10}
    longer = Counter()
    for (lang, p), a in candidates.items():
        if len(p) == 3:
            for part in (p[:2], p[1:]):
                longer[lang, part] = max(longer[lang, part], a)
    found = {}
    for (lang, p), a in candidates.items():
        if len(p) == 2 and longer[lang, p] and 100 * longer[lang, p] >= 50 * a:
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out = []
    for lang, rows_ in found.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows_)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def corpus(seed, n=400):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(60)]
    fixed = ["New  York City", "in Order to", "ü x\ty", "a b", "b c", "a b c", "of the", "z z z z", "Ab.Cd"]
    rows = []
    for i in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(names) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ", ", "\n", "; "]) for w in words)
        rows.append((i, rng.choice([text, text, text.upper()]), rng.choice(["en", "en", "fr", None, "und", ""]), "h", 1, 2, "w", 3, "b"))
    return rows + [(1, None, "en", *rows[0][3:]), (2, "", None, *rows[0][3:]), (3, "only few words here", "xx", *rows[0][3:])] + rows[:5]


@pytest.mark.parametrize(("seed", "top", "first"), [(1, 2000, 2), (2, 30, 1), (3, 7, 1), (4, 1, 1), (5, 200, 2)])
def test_as_counting_everything(spark, seed, top, first):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(collocations.mined(docs, top, first)) == plain([(r[2], r[1]) for r in rows], top)


def test_rounds_go_on_until_ties_are_settled(spark, monkeypatch):
    """The best pairs are all dropped for longer phrases, so that the first thresholds are too high."""
    monkeypatch.setattr(collocations, "FURTHER", 2)
    rng = random.Random(5)
    lines = [f"p{i} q{i} r{i}" for i in range(30) for _ in range(12)] + [f"s{i} t{i} u{rng.randrange(9)}" for i in range(40) for _ in range(11)] + [f"s{i} x" for i in range(40) for _ in range(3)]
    rows = [(i, line, "en", *corpus(0, 1)[0][3:]) for i, line in enumerate(lines)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for top in (5, 31, 50):
        assert result(collocations.mined(docs, top, 1)) == plain([("en", x) for x in lines], top)


def test_bit_maps_shared_by_all_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITS", 6)
    rows = corpus(6, 200)
    assert result(collocations.mined(spark.createDataFrame(rows, SCHEMA), 20, 1)) == plain([(r[2], r[1]) for r in rows], 20)


def test_clashing_hashes_are_counted_again(spark, monkeypatch):
    """The hashes of the first seed have four bits."""
    good = collocations.hash_spans
    init = collocations._Chunk.__init__

    def poor(self, table, texts, seed):
        init(self, table, texts, seed)
        if seed == 0:
            self.hash = self.hash & np.uint64(15)

    monkeypatch.setattr(collocations._Chunk, "__init__", poor)
    rows = [("en", "a b " * 12), ("en", " ".join(f"w{i}" for i in range(40)))]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    assert good is collocations.hash_spans and result(collocations.mined(docs)) == plain(rows)


def test_exact_scores_of_great_counts(spark):
    rows = [(10**12 - 7, 10**12 - 3, 10**12), (10, 10**12, 10), (999_999_999_989, 10**12, 999_999_999_999), (3 * 10**12, 3 * 10**12, 3 * 10**12)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations._ratio("a", "l", "r").alias("score"))
    assert [r.score for r in df.collect()] == [10**6 * a * a // (l * r) for a, l, r in rows]  # noqa: E741


def test_odd_rows(spark):
    rows = odd_rows() * 4
    docs = odd(spark)
    docs = docs.union(docs).union(docs).union(docs)
    assert result(collocations.mined(docs)) == plain([(r[2], r[1]) for r in rows])


def test_empty_table(spark):
    assert collocations.mined(empty(spark)).collect() == []
