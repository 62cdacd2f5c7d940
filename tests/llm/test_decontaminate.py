import random
import time

from graphloom.llm.decontaminate import MIN_TOKENS, Seeds, _overlaps, overlaps, without_overlaps
from tests.llm.common import empty, odd, prose

RNG = random.Random(11)
ITEMS = [(1, " ".join("t%d" % RNG.randrange(10**6) for _ in range(40))), (2, " ".join("u%d" % RNG.randrange(10**6) for _ in range(20))), (3, "short item"), (4, None), (5, ""), (6, "Nine Tokens, here: we go again and again now")]


def documents(rng):
    a, b = ITEMS[0][1].split(), ITEMS[1][1].split()
    swapped = list(a)
    for i in range(4, 40, 9):
        swapped[i] = "other"
    return [
        (1, prose(rng, 50) + " " + " ".join(a) + " " + prose(rng, 50)), (2, prose(rng, 300)), (3, " ".join(swapped)), (4, " ".join(b).upper().replace(" ", " ; ")), (5, " ".join(a[:8]) + " " + prose(rng, 30)),
        (6, None), (7, ""), (8, "x " + " ".join(a[10:30]) + " y " + " ".join(b)), (9, "so: nine tokens here we go again and again now!"), (10, "short item " * 30), (None, " ".join(a)),
    ]


def test_overlaps(spark):
    docs = spark.createDataFrame(documents(RNG), "doc_id long, text string").repartition(2)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = {(1, 1), (3, 1), (4, 2), (8, 1), (8, 2), (9, 6), (None, 1)}
    assert {(r.doc_id, r.item_id) for r in overlaps(docs, items).collect()} == want
    assert {(r.doc_id, r.item_id) for r in overlaps(docs, items, block_bytes=150).collect()} == want
    for kept in (without_overlaps(docs, items), without_overlaps(docs, items, block_bytes=150)):
        assert {r.doc_id for r in kept.collect()} == {2, 5, 6, 7, 10}


def test_substitutions_are_counted(spark):
    docs = spark.createDataFrame(documents(random.Random(1)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in overlaps(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert got[3, 1].matched == 36 and got[3, 1].length == 40
    assert (got[1, 1].at, got[1, 1].length) == (50, 40)


def test_odd_and_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert overlaps(odd(spark), items).collect() == []
    assert without_overlaps(odd(spark), items).count() == odd(spark).count()
    assert overlaps(empty(spark), items).collect() == []
    assert overlaps(odd(spark), items.where("false")).collect() == []
    assert without_overlaps(odd(spark), items.where("false")).columns == odd(spark).columns


def brute(doc, item):
    """The most equal tokens of a run, three quarters of them equal, at any shift."""
    best = 0
    for shift in range(-len(item), len(doc)):
        equal = [0 <= i + shift < len(doc) and doc[i + shift] == w for i, w in enumerate(item)]
        best = max([best, *(sum(equal[i:j]) for i in range(len(item)) for j in range(i + 1, len(item) + 1) if 4 * sum(equal[i:j]) >= 3 * (j - i) and max(0, -shift) <= i and j <= min(len(item), len(doc) - shift))])
    return best


def test_short_items_with_substitutions():
    rng = random.Random(5)
    items = [["i%dx%d" % (n, k) for k in range(n)] for n in range(8, 21)]
    docs, of = [], []
    for item in items:
        for _ in range(40):
            copy = list(item)
            for i in rng.sample(range(len(item)), rng.randrange(4)):
                copy[i] = "other"
            cut = rng.choice((0, 0, 0, 1, 2))
            docs.append(prose(rng, rng.choice((0, 9))).split() + copy[cut:] + prose(rng, rng.choice((0, 9))).split())
            of.append(item)
    seeds = Seeds(list(range(len(items))), [" ".join(x).encode() for x in items], MIN_TOKENS)
    got = {(d, i): equal for d, i, _, _, equal in _overlaps(seeds, [" ".join(x).encode() for x in docs], 13)}
    want = {(d, items.index(item)): brute(docs[d], item) for d, item in enumerate(of)}
    assert got == {k: equal for k, equal in want.items() if equal >= min(13, -(-4 * len(items[k[1]]) // 5))}
    assert len(got) > 300


def test_one_substitution_near_the_start(spark):
    item = ["v%d" % k for k in range(15)]
    docs = spark.createDataFrame([(1, " ".join([*item[:2], "other", *item[3:]]))], "doc_id long, text string")
    got = overlaps(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.length, r.matched) for r in got] == [(15, 14)]


def found(docs, items):
    seeds = Seeds(list(range(len(items))), [" ".join(x).encode() for x in items], MIN_TOKENS)
    return {(d, i): (at, n, equal) for d, i, at, n, equal in _overlaps(seeds, [" ".join(x).encode() for x in docs], 13)}


def test_repetitive_texts_against_brute_force():
    rng = random.Random(3)
    items = [["a"] * 30, ["a", "b"] * 12, [rng.choice("ab") for _ in range(24)], ["a"] * 12 + ["c"] + ["a"] * 12]
    docs = [["a"] * 90, ["a", "b"] * 50, ["b"] * 40 + ["a"] * 14, ["c", *["a"] * 11] * 6, [rng.choice("ab") for _ in range(80)], ["a"] * 3]
    want = {(d, i): brute(doc, item) for d, doc in enumerate(docs) for i, item in enumerate(items)}
    got = found(docs, items)
    enough = {k: n for k, n in want.items() if n >= 13}
    assert {k: v[2] for k, v in got.items()} == enough


def test_a_million_equal_tokens():
    began = time.perf_counter()
    got = found([["a"] * 1_000_000, [*"xyz"] * 100_000], [["a"] * 1000, [*"xyz"] * 300])
    assert got == {(0, 0): (0, 1000, 1000), (1, 1): (0, 900, 900)}
    assert time.perf_counter() - began < 60
