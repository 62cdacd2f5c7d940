import random

from graphloom.llm.components import connected_components
from graphloom.llm.jaccard_join import minimum_matches, near_duplicates, one_of_each
from tests.llm.common import empty, odd, odd_rows, prose, words


def brute(rows, t=0.8):
    sets = {}
    for i, text, *_ in rows:
        w = words(text)
        if i is not None:
            sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    ids = sorted(sets)
    links, root = {i: 0 for i in ids}, {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        links[i] += len(sets[i]) - 1 if sets[i][0] else 0
        for j in ids:
            if i < j:
                a, b = sets[i][0], sets[j][0]
                if a and b and len(a & b) >= t * len(a | b):
                    links[i] += len(sets[j])
                    links[j] += len(sets[i])
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "e%d" % rng.randrange(10**6)
    return " ".join(w)


def test_against_brute_force(spark):
    got = near_duplicates(odd(spark)).collect()
    want = brute(odd_rows())
    assert {r.doc_id: (r.class_id, r.n_links) for r in got if r.doc_id is not None} == want
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)] * 2
    assert len(got) == len(odd_rows())


def test_large_group_in_blocks(spark):
    rng = random.Random(3)
    base = prose(rng, 100)
    rows = [(i, edited(rng, base, rng.randrange(4))) for i in range(120)] + [(1000 + i, prose(rng, 60)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for block in (16, 1000):
        got = near_duplicates(docs, block=block).collect()
        assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want


def test_chain_of_links_is_one_class(spark):
    w = ["w%d" % i for i in range(100)]
    rows = [(k, " ".join(w[4 * k : 4 * k + 60])) for k in range(8)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute(rows)


def test_one_of_each(spark):
    kept = one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    want = {i for i, (c, _) in brute(odd_rows()).items() if c == i}
    assert {r.doc_id for r in kept.collect()} == want | {None}


def test_one_of_each_with_repeated_ids(spark):
    rng = random.Random(8)
    base, own = prose(rng, 60), prose(rng, 60)
    rows = [(3, base), (7, base), (7, own), (3, base), (3, base.replace(" ", "  ")), (None, base), (9, None), (9, None)]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), " ".join((r.text or "").split())) for r in kept) == sorted([("3", base), ("7", own), ("None", base), ("9", ""), ("9", "")])


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).collect() == []
    assert one_of_each(empty(spark)).collect() == []


def test_bounds():
    least = minimum_matches(0.8, 1e-9)
    assert least == sorted(least) and 0 < least[0] < 16 and least[-1] < 102


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}
