"""The pipeline against plain Python for the stages that plain Python can decide, and row counts for all."""

import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import decontaminate, pseudonyms, quality
from tests.llm.test_jaccard_join import brute
from tests.llm.test_quality import base

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
public_tokenizers = pytest.importorskip("public_tokenizers")


def test_names():
    assert len(corpus_pipeline.STAGES) == 5 and len({n for n, _ in corpus_pipeline.STAGES}) == 5


def test_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    x = quality.statistics([t.encode() for _, t in rows])[1]
    rows = [r for r, s in zip(rows, model.score(x)) if not base(r[1])[-1] and s >= 0]
    classes = brute(rows)
    rows = [r for r in rows if classes[r[0]][0] == r[0]]
    items = [decontaminate.tokens([r.text.encode()])[0].tolist() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    five = {tuple(t[i : i + 13]) for t in items for i in range(len(t) - 12)}

    def clean(text):
        t = decontaminate.tokens([text.encode()])[0].tolist()
        return not any(tuple(t[i : i + 13]) in five for i in range(len(t) - 12))

    rows = [r for r in rows if clean(r[1])]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*t.encode(pseudonyms.replace(text, pseudonyms.EXAMPLE_KEY)[0], add_special_tokens=False).ids, 2] for i, text in rows}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in got) == sum(map(len, want.values()))


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
