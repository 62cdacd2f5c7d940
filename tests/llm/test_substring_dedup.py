import hashlib

from graphloom.llm.substring_dedup import remove_duplicate_spans
from tests.llm.common import empty, odd, odd_rows, words


def brute(rows, window=13):
    first = {}
    for i, text, *_ in rows:
        w = words(text)
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text, *_ in rows:
        w = words(text)
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    for seed in (0, 1):
        got = remove_duplicate_spans(odd(spark, seed)).drop("n_factors").collect()
        assert sorted(map(tuple, got), key=repr) == brute(odd_rows(seed))


def test_many_small_documents(spark):
    import random

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(300)]
    got = remove_duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).drop("n_factors").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_same_id_with_different_texts(spark):
    rows = [(1, "a b c d e f g h i j k l m n"), (2, "z " * 3 + "a b c d e f g h i j k l m"), (2, "q r s t u v w x y z 1 2 3 4")]
    got = remove_duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string")).drop("n_factors").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_factors(spark):
    a, b = " ".join("a%d" % i for i in range(20)), " ".join("b%d" % i for i in range(20))
    rows = [(1, a), (2, b), (3, f"{a} {b} x y z")]
    got = {r.doc_id: r for r in remove_duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[3].n_removed, got[3].n_factors, got[1].n_factors) == (40, 2, 0)


def test_empty_table(spark):
    assert remove_duplicate_spans(empty(spark)).collect() == []


def test_hot_minimisers_are_dealt_over_shards(spark, monkeypatch):
    """A phrase in ever different surroundings, some of which are shared: blocks of it are cut in windows, with the same answers."""
    import random

    from graphloom.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "HOT", 20)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 4000)
    rng = random.Random(9)
    around = [[" ".join("w%d" % rng.randrange(10**6) for _ in range(9)) for _ in range(60)] for _ in range(2)]
    rows = [(i, f"{rng.choice(around[0])} the very same five words {rng.choice(around[1])}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = remove_duplicate_spans(docs).drop("n_factors").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    texts = [t.encode() for _, t in rows]
    first, n, key, content, whole = substring_dedup.blocks_of(substring_dedup.Words(texts))
    hot = {int(k): 3 for k in key.view("int64")[:5]}
    cut = substring_dedup._cut(first, n, key, content, whole, hot)
    assert cut[1].sum() == n.sum() and (cut[1][cut[4] > 1] == 1).all() and len(cut[0]) > len(first)


def test_factors_follow_one_document(spark):
    """Two passages of document 1, in the other order: two factors, though the same document has both."""
    a, b = " ".join("a%d" % i for i in range(20)), " ".join("b%d" % i for i in range(20))
    got = {r.doc_id: r for r in remove_duplicate_spans(spark.createDataFrame([(1, f"{a} x {b}"), (2, f"{b} {a}"), (3, f"{a} x {b}")], "doc_id long, text string")).collect()}
    assert (got[2].n_removed, got[2].n_factors) == (40, 2) and (got[3].n_removed, got[3].n_factors) == (41, 1)


def test_hot_minimisers_spread_thin_are_counted():
    """A phrase 15 times in each of many chunks, in ever different surroundings: the sample finds it and nothing else."""
    import random

    import pyarrow as pa

    from graphloom.llm.substring_dedup import _loads

    rng = random.Random(3)

    def counts(phrase, chunk, every):
        around = lambda: " ".join("w%d" % rng.randrange(10**9) for _ in range(8))
        batch = pa.record_batch([pa.array(range(chunk * 15, chunk * 15 + 15), pa.int64()), pa.array([f"{around()} {phrase} {around()}" for _ in range(15)])], names=["doc_id", "text"])
        return [(k, n) for out in _loads(13, 5, every)([batch]) for k, n in zip(*(c.to_pylist() for c in out.columns), strict=True)]

    # a phrase whose hash is small enough to be the minimiser of windows around it
    phrase, hot = next((f"the very same words {i}", k) for i in range(100) for k, n in counts(f"the very same words {i}", 0, 1) if k is not None and n == 15)
    total = {}
    for chunk in range(400):
        for k, n in counts(phrase, chunk, 16):
            total[k] = total.get(k, 0) + n
    assert total.pop(None) > 0
    assert abs(total.pop(hot) / 6000 - 1) < 0.25
    assert max(total.values()) <= 16 * 4
