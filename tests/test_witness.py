import random

import pytest

from graphloom.operators import contraction
from graphloom.operators.witness import shortest_paths

E = "package_id string, edge_id long, src long, dst long"
S = "package_id string, origin long, node long"


def plain(edges, seeds, goals):
    """Every path of each length, the least of the first length that arrives."""
    out = []
    for p, o, goal in set(goals):
        best = {n: [] for q, x, n in seeds if (q, x) == (p, o)}
        done = dict(best)
        while best:
            nxt = {}
            for v, path in best.items():
                for q, i, a, b in edges:
                    if q == p and a == v and b not in done:
                        nxt[b] = min(nxt.get(b, [*path, i]), [*path, i])
            done |= nxt
            best = nxt
        if goal in done:
            out.append((p, o, goal, done[goal]))
    return sorted(out)


def run(spark, edges, seeds, goals, small=100_000):
    got = shortest_paths(spark.createDataFrame(edges, E).repartition(2), spark.createDataFrame(seeds, S), spark.createDataFrame(goals, S), small)
    return sorted(map(tuple, got.select("package_id", "origin", "node", "path").collect()))


@pytest.mark.parametrize(("seed", "small"), [*((i, 100_000) for i in range(6)), (6, 0), (7, 0)])
def test_random_graphs(spark, seed, small):
    rng = random.Random(seed)
    edges, k = [], 0
    for p, n, m in (("a", 12, 30), ("b", 6, 6), ("c", 25, 30)):
        for _ in range(m):
            edges.append((p, rng.choice([k, k, 3]), rng.randrange(n), rng.randrange(n)))  # ids need not be unique
            k += 1
    seeds = [("a", 1, 0), ("a", 1, 1), ("a", 2, 5), ("b", 1, 0), ("c", -4, 3), ("d", 1, 9), ("a", 1, 0)]
    goals = [(p, o, v) for p, o in (("a", 1), ("a", 2), ("b", 1), ("c", -4), ("a", 99)) for v in range(0, 25, 2)] + [("d", 1, 9), ("d", 1, 8), ("a", 1, 2)]
    assert run(spark, edges, seeds, goals, small) == plain(edges, seeds, goals)


def test_ten_thousand_hops_by_all_executors(spark, monkeypatch):
    """A chain: fewer than 40 rounds of contraction, and one of relaxing and one that finds nothing."""
    taken = []
    good = contraction.contracted

    def counted(*args):
        core, out = good(*args)
        taken.append(len(out))
        return core, out

    monkeypatch.setattr("graphloom.operators.witness.contracted", counted)
    n = 10_000
    edges = spark.range(n).selectExpr("'p' package_id", "id * 7 edge_id", "id src", "id + 1 dst")
    got = shortest_paths(edges, spark.createDataFrame([("p", 1, 0)], S), spark.createDataFrame([("p", 1, n)], S), small=10).collect()
    assert len(got) == 1 and got[0].path == [7 * i for i in range(n)]
    assert 0 < taken[0] < 40


def test_ten_thousand_hops_in_a_task(spark):
    n = 10_000
    edges = spark.range(n).selectExpr("'p' package_id", "id edge_id", "id src", "id + 1 dst")
    got = shortest_paths(edges, spark.createDataFrame([("p", 1, 0)], S), spark.createDataFrame([("p", 1, n), ("p", 1, 0)], S)).collect()
    assert sorted((r.node, r.path) for r in got) == [(0, []), (n, list(range(n)))]


def test_nulls_and_empty_tables(spark):
    edges = spark.createDataFrame([("p", None, 1, 2), (None, 1, 1, 2), ("p", 1, 1, None)], E)
    one = spark.createDataFrame([("p", 1, 1), ("p", 1, None), ("p", 1, 2)], S)
    assert shortest_paths(edges, one.where("node = 1"), one).where("node = 2").collect() == []
    assert shortest_paths(edges.where("false"), one.where("false"), one.where("false")).collect() == []
