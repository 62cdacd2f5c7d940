import random

import pytest

from graphloom.streaming.stored import EDGES, change_closure, closure_of_changes, committed, merge_detections, stored

C = f"{EDGES}, withdrawn boolean"


def plain(edges):
    out = set()
    for p, a in {(p, a) for p, a, _ in edges}:
        todo, seen = [a], set()
        while todo:
            v = todo.pop()
            for q, x, y in edges:
                if q == p and x == v and y not in seen:
                    seen.add(y)
                    todo.append(y)
        out |= {(p, a, b) for b in seen}
    return sorted(out)


def rows(spark, folder, name):
    return sorted(map(tuple, stored(spark, folder, name, EDGES).select("package_id", "src", "dst").collect()))


def batches(seed, n=10):
    """Changes, and the edges that are there after each of them."""
    rng = random.Random(seed)
    edges, out = set(), []
    for number in range(n):
        ps = ["a", "b"] if number % 2 else ["a", "b", "c"]
        new = {(p, rng.randrange(9), rng.randrange(9)) for p in ps for _ in range(6 if number == 0 else 2)}
        gone = {e for e in sorted(edges) if e[0] in ps and rng.random() < 0.25} | {("a", 100, 101)}
        edges = (edges | new) - gone
        out.append(([(*e, False) for e in sorted(new)] + [(*e, True) for e in sorted(gone)] + [(*e, False) for e in sorted(new)[:1]], sorted(edges)))
    return out


@pytest.mark.parametrize(("seed", "small", "n"), [(0, 100_000, 10), (1, 0, 3)])
def test_batches_with_withdrawals_equal_a_full_run(spark, tmp_path, seed, small, n):
    folder = f"file://{tmp_path}/kept"
    for number, (changes, edges) in enumerate(batches(seed, n)):
        change_closure(spark, folder, number, spark.createDataFrame(changes, C).repartition(2), small)
        assert rows(spark, folder, "edges") == edges
        assert rows(spark, folder, "closure") == plain(edges)
    assert committed(spark, folder) == list(range(n))


def test_cycle_is_cut_and_closed(spark, tmp_path):
    folder = f"file://{tmp_path}/kept"
    ring = [("p", i, (i + 1) % 5) for i in range(5)]
    change = lambda n, e, gone: change_closure(spark, folder, n, spark.createDataFrame([(*x, gone) for x in e], C))
    change(0, ring, False)
    assert len(rows(spark, folder, "closure")) == 25
    change(1, ring[4:], True)
    assert rows(spark, folder, "closure") == plain(ring[:4])
    change(1, ring[:1], True)  # committed already
    assert rows(spark, folder, "closure") == plain(ring[:4])
    change(2, [*ring[4:], (None, 1, 2), ("p", None, 1)], False)
    assert len(rows(spark, folder, "closure")) == 25


def test_a_batch_that_was_lost_halfway_is_run_again(spark, tmp_path):
    """Its rows were written, its commit was not."""
    folder = f"file://{tmp_path}/kept"
    change_closure(spark, folder, 0, spark.createDataFrame([("p", 1, 2, False)], C))
    spark.createDataFrame([("p", 7, 8)], EDGES).write.parquet(f"{folder}/closure/batch=1")
    spark.createDataFrame([("p",)], "package_id string").write.parquet(f"{folder}/packages/batch=1")
    assert rows(spark, folder, "closure") == [("p", 1, 2)]
    change_closure(spark, folder, 1, spark.createDataFrame([("p", 2, 3, False)], C))
    assert rows(spark, folder, "closure") == [("p", 1, 2), ("p", 1, 3), ("p", 2, 3)]


def test_stream_of_changes(spark, tmp_path):
    folder, changes = f"file://{tmp_path}/kept", f"file://{tmp_path}/changes"
    for number, (rows_, edges) in enumerate(batches(5, 3)):
        spark.createDataFrame(rows_, C).coalesce(1).write.mode("append").parquet(changes)
        closure_of_changes(spark, changes, folder, f"file://{tmp_path}/checkpoint").awaitTermination()
        assert committed(spark, folder) == list(range(number + 1))
        assert rows(spark, folder, "closure") == plain(edges)


def test_detections_are_merged(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/found", "package_id string, sink string"
    put = lambda n, packages, found: merge_detections(folder, n, spark.createDataFrame([(p,) for p in packages], "package_id string"), spark.createDataFrame(found, schema))
    read = lambda: sorted(map(tuple, stored(spark, folder, "detections", schema).select("package_id", "sink").collect()))
    assert read() == []
    put(0, ["a", "b"], [("a", "exec"), ("b", "eval"), ("a", "exec")])
    put(1, ["b", "c"], [("c", "exec")])
    put(1, ["b", "c"], [("c", "exec")])
    assert read() == [("a", "exec"), ("c", "exec")]


def test_only_large_packages_read_their_closure(spark, tmp_path, monkeypatch):
    """Small packages are closed anew from their edges; a large one beside them changes with what changed; all are right."""
    from graphloom.streaming import stored as module

    seen, updated = [], module.updated
    monkeypatch.setattr(module, "updated", lambda edges, *rest: seen.extend(r[0] for r in edges.select("package_id").distinct().collect()) or updated(edges, *rest))
    folder = f"file://{tmp_path}/kept"
    edges = [("big", i, (7 * i + 1) % 12) for i in range(12)] + [("few", 1, 2), ("few", 2, 3)]
    change = lambda n, e, gone: change_closure(spark, folder, n, spark.createDataFrame([(*x, gone) for x in e], C), 12)
    change(0, edges, False)
    change(1, [edges[0], edges[-1]], True)
    assert rows(spark, folder, "closure") == plain(edges[1:-1])
    assert set(seen) == {"big"}
