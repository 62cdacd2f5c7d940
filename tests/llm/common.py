"""Documents with every oddity, and words."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, runs string, rep string, task int, key string, shard int, content string, X string"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, size=400):
    return " ".join("w%d" % rng.randrange(size) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def odd_rows(seed=0):
    rng = random.Random(seed)
    base, passage = prose(rng, 300), prose(rng, 40)
    texts = [
        base, base, base.replace("w1", "w2", 3), prose(rng, 120) + " " + passage + " " + prose(rng, 80), passage, passage + " tail", None, "", " \n\t ", "one", "one two three four", "a b c d e f g h i j k l m", "a b c d e f g h i j k l m",
        "x" * 100_000, prose(rng, 20_000, 5000), "é ü ñ 漢字 " * 30, "same " * 200, "line one\nline one\nline two\n\n\nline one", prose(rng, 13), prose(rng, 12),
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], "src%d" % (i % 2), len(t) if t else None, "r", None, i, "k", 1, None, "x") for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, base, "en", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None), (-5, passage, "en", "s", 1, "", "", 1, "", 1, "", "")]
    return rows


def odd(spark, seed=0):
    return spark.createDataFrame(odd_rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
