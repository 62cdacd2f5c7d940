import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.elias_fano import EliasFano, map_arrays, write_arrays
from graphloom.llm.textops import Rolling, Words, chunks, inside


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60), min_size=1, max_size=8))
def test_words_are_those_of_split(texts):
    w = Words(texts)
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)] == [x for t in texts for x in t.split()]
    assert w.count.tolist() == [len(t.split()) for t in texts]
    names = [x for t in texts for x in t.split()]
    h = w.hashes().tolist()
    assert len(set(zip(names, h))) == len(set(names)) == len(set(h))


def test_long_words_differ():
    a, b = b"x" * 5000, b"x" * 4999 + b"y"
    h = Words([a + b" " + b + b" " + a]).hashes()
    assert h[0] == h[2] != h[1]


def test_hashes_do_not_depend_on_neighbours():
    alone, long = Words([b"some words here"]).hashes(), Words([b"x" * 2000 + b" some words here"]).hashes()
    both = Words([b"some words here " + b"y" * 700, b"x" * 2000]).hashes()
    assert alone.tolist() == long.tolist()[1:] == both.tolist()[:3] and long[0] == both[4]


def test_windows_stay_in_documents():
    w = Words([b"a b c", b"", b"a b", b"b c a b c"])
    ok = inside(w.first, 3, len(w))
    r = Rolling(w.hashes())
    assert np.flatnonzero(ok).tolist() == [0, 5, 6, 7]
    assert (r.windows(3)[0] == r.windows(3)[7]) and r.windows(3)[0] != r.windows(3)[5]
    assert (r.spans(np.arange(8), np.arange(8) + 3) == r.windows(3)).all()


def test_chunks_keep_rows():
    table = pa.table({"text": ["a" * n for n in (5, 100, 0, 50, 3)] + [None], "i": range(6)})
    parts = list(chunks(table.to_batches(max_chunksize=2), limit=60))
    assert [i for t, _ in parts for i in t["i"].to_pylist()] == list(range(6))
    assert [len(x) for _, texts in parts for x in texts] == [5, 100, 0, 50, 3, 0]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 10**6), max_size=300), st.lists(st.integers(0, 10**6 + 5), max_size=50))
def test_elias_fano(values, asked):
    values = np.array(sorted(values), np.int64)
    e = EliasFano.of(values, 10**6 + 1)
    assert (e.get(np.arange(len(values))) == values).all()
    place = {v: i for i, v in enumerate(values.tolist())}
    asked = np.array(asked + values.tolist(), np.int64)
    assert e.find(asked).tolist() == [place.get(v, -1) for v in asked.tolist()]


def test_elias_fano_with_repeats_and_runs(tmp_path):
    e = EliasFano.of(np.array([0, 0, 3, 3, 3, 9]), 10)
    assert e.get(np.arange(6)).tolist() == [0, 0, 3, 3, 3, 9]
    run = np.concatenate((np.arange(3000), [10**9, 10**9 + 5]))
    e = EliasFano.of(run, 10**10)
    write_arrays(f"file://{tmp_path}/a/b", e.arrays("e"), note=1)
    arrays, meta = map_arrays(f"file://{tmp_path}/a/b")
    assert meta == {"note": 1} and (EliasFano.read(arrays, "e").find(run) == np.arange(len(run))).all()
