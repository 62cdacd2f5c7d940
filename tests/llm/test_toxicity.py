import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import toxicity
from tests.llm.common import empty, odd, odd_rows, prose

BAD = ["vile", "rotten", "fiend"]


def test_learns_words(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        w = prose(rng, 60).split()
        if i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w), ["en", "fr"][i % 2]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(500)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum((r.predicted == 1) == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_lang_and_source_are_no_inputs(spark):
    net = toxicity.train([b"vile word", b"good word"] * 10, __import__("numpy").array([1, 0] * 10, "float32"), epochs=2)
    rows = [(1, "a vile thing", "en"), (2, "a vile thing", "xx"), (3, "a vile thing", None)]
    got = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string, lang string"), net).collect()
    assert len({r.score for r in got}) == 1


def test_odd_and_empty(spark):
    labels = spark.createDataFrame([(1, 0), (3, 1), (1, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    for model in (toxicity.fit(odd(spark), labels), toxicity.fit(odd(spark), labels.where("toxic = 0")), toxicity.fit(odd(spark), labels.where("false"))):
        got = toxicity.scored(odd(spark), model).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
        assert toxicity.scored(empty(spark), model).collect() == []


def test_forward_pass_against_plain_python():
    """Every filter at every place of every text, one number at a time; texts shorter than the filters too."""
    net = toxicity.train([b"vile word here", b"good word there now"] * 10, np.array([1, 0] * 10, "float32"), epochs=1)
    texts = [b"a vile and rotten word, here!", b"", b"one", b"-- !!", b"two words", b"Vile VILE vileness vilenesses"]
    got = net.scores(texts, step=3)
    for text, score in zip(texts, got):
        rows, _ = toxicity.encode([text])
        e = [[sum(float(net.table[r][d]) for r in row) for d in range(toxicity.DIM)] for row in rows.tolist()]
        e += [[0.0] * toxicity.DIM] * (max(toxicity.WIDTHS) - 1)
        pooled = []
        for width, (w, b) in zip(toxicity.WIDTHS, net.filters):
            for f in range(toxicity.FILTERS):
                at = [b[f] + sum(w[k][d][f] * e[i + k][d] for k in range(width) for d in range(toxicity.DIM)) for i in range(len(e) - width + 1)]
                pooled.append(max([0.0, *at]))
        logit = net.bias + sum(float(o) * p for o, p in zip(net.out, pooled))
        assert abs(score - 1 / (1 + math.exp(-logit))) < 1e-5


def test_repeated_ids_and_bytes_are_bounded(spark):
    rows = [(i % 40, f"{'vile' if i % 40 % 2 else 'good'} text {i % 7}", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert isinstance(toxicity.fit(docs, labels), toxicity.Network)
    assert isinstance(toxicity.fit(docs, labels, sample_bytes=5), float)  # no text fits: the share of toxic labels


def test_every_label_is_learned_from(spark):
    """A word that only a few of many toxic rows have is learned, whichever rows they are."""
    rng, n = random.Random(5), 6800
    by_hash = [r.id for r in spark.range(n).where("id % 2 = 1").orderBy(F.xxhash64("id")).collect() if zlib.crc32(str(r.id).encode()) % 5]
    few = set(by_hash[2500:])
    assert len(few) > 100
    rows = []
    for i in range(n):
        w = prose(rng, 12).split()
        if i % 2:
            w.insert(rng.randrange(len(w)), "zyxgrue" if i in few else BAD[0])
        rows.append((i, " ".join(w), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    score = {r.doc_id: r.score for r in toxicity.scored(docs, net).collect()}
    assert sum(score[i] >= 0.5 for i in few) >= 0.9 * len(few)
    assert sum(score[i] >= 0.5 for i in range(0, n, 2)) <= 0.1 * n / 2


def test_parts_are_learned_from_together(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 300)
    rng = random.Random(6)
    rows = [(i, " ".join([*prose(rng, 12).split(), BAD[i % 3]][i % 2 :]) if i % 2 else prose(rng, 12), "en") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    net, again = (toxicity.fit(d, labels, part=600) for d in (docs, docs.repartition(5)))
    got = toxicity.scored(docs, net).collect()
    assert sum((r.predicted == 1) == (r.doc_id % 2 == 1) for r in got) >= 0.9 * len(got)
    assert np.allclose(again.out, net.out, atol=1e-4)


def test_learning_codes_a_few_texts_at_once(monkeypatch):
    """What is held while texts are coded does not grow with their number, and a cut into slices changes nothing."""
    texts = [prose(random.Random(i), 40).encode() for i in range(60)] + [b"", b"vile"]
    y, nets, sizes, encode = np.arange(len(texts)) % 2, [], [], toxicity.encode
    monkeypatch.setattr(toxicity, "encode", lambda x: sizes.append(sum(map(len, x))) or encode(x))
    for limit in (1 << 30, 1500):
        monkeypatch.setattr(toxicity, "ENCODE_BYTES", limit)
        nets.append(toxicity.train(texts, y.astype("float32"), epochs=1))
    assert max(sizes[1:]) <= 1500 < sizes[0]
    assert np.array_equal(nets[0].out, nets[1].out) and np.array_equal(nets[0].table, nets[1].table)


def test_each_part_has_a_task(spark, monkeypatch):
    """No task holds several parts, and no part is in several tasks."""
    held, stored = {}, toxicity.runtime.stored

    def seen(df, name):
        if name == "toxicity-labelled":
            held.update({r.p: r.parts for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.collect_set("part").alias("parts")).collect()})
        return stored(df, name)

    monkeypatch.setattr(toxicity.runtime, "stored", seen)
    docs = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'good'} text {i}", "en") for i in range(400)], "doc_id long, text string, lang string")
    toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int"), part=50)
    assert len(held) > 4 and all(len(parts) == 1 for parts in held.values()) and len({parts[0] for parts in held.values()}) == len(held)


def test_few_unlabelled_texts_are_shuffled(spark, monkeypatch):
    """Every labelled id is let through by the bit map, few others are; a map that is too small changes no result."""
    rows = spark.range(0, 4000, 4).withColumnRenamed("id", "doc_id")
    among = spark.range(4000).withColumnRenamed("id", "doc_id").where(toxicity._among(rows, 1000)("doc_id"))
    got = {r.doc_id for r in among.collect()}
    assert set(range(0, 4000, 4)) <= got and len(got) < 1400
    docs = spark.createDataFrame([(i % 600, f"{'vile' if i % 2 else 'good'} text {i}", "en") for i in range(900)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id int, toxic int")
    nets = [toxicity.fit(docs, labels)]
    monkeypatch.setattr(toxicity, "MOST_BITS", 7)
    nets.append(toxicity.fit(docs, labels))
    assert np.array_equal(nets[0].out, nets[1].out)
