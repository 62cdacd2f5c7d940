import random

import pytest

from graphloom.operators.components import strong_components

E = "package_id string, src long, dst long"
N = "package_id string, node long"


def plain(edges, nodes=()):
    """By what each node reaches, and the longest ways between components."""
    out = []
    for p in {x[0] for x in (*edges, *nodes)}:
        step = {}
        for q, a, b in edges:
            if q == p:
                step.setdefault(a, set()).add(b)
                step.setdefault(b, set())
        for q, a in nodes:
            if q == p:
                step.setdefault(a, set())
        reach = {}
        for v in step:
            seen, todo = {v}, [v]
            while todo:
                for w in step[todo.pop()] - seen:
                    seen.add(w)
                    todo.append(w)
            reach[v] = seen
        of = {v: min(w for w in reach[v] if v in reach[w]) for v in step}
        below = {c: {of[w] for v in step if of[v] == c for w in step[v]} - {c} for c in set(of.values())}
        level, left = {}, set(below)
        while left:
            for c in [c for c in left if below[c] <= set(level)]:
                level[c] = max((level[x] + 1 for x in below[c]), default=0)
                left.remove(c)
        out += [(p, v, of[v], level[of[v]]) for v in step]
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.select("package_id", "node", "component", "level").collect()))


@pytest.mark.parametrize("seed", range(8))
def test_random_graphs_in_tasks(spark, seed):
    rng = random.Random(seed)
    edges = [(f"p{p}", rng.randrange(-3, n), rng.randrange(n)) for p, n in enumerate((3, 8, 20, 40)) for _ in range(rng.choice([n, n // 2, 2 * n]))]
    nodes = [("p0", 77), ("lone", -1), ("p1", 1)]
    got = strong_components(spark.createDataFrame(edges, E).repartition(3), spark.createDataFrame(nodes, N))
    assert rows(got) == plain(edges, nodes)


@pytest.mark.parametrize(("seed", "small"), [(1, 3), (2, 9)])
def test_random_graphs_by_all_executors(spark, seed, small):
    rng = random.Random(seed)
    edges = [(p, rng.randrange(n), rng.randrange(n)) for p, n, m in (("a", 14, 18), ("b", 9, 12), ("c", 3, 2)) for _ in range(m)]
    nodes = [("a", 99)]
    assert rows(strong_components(spark.createDataFrame(edges, E), spark.createDataFrame(nodes, N), small)) == plain(edges, nodes)


def test_long_chain_of_cycles_by_all_executors(spark):
    """A chain of 50 nodes, each third in a cycle with the next: some rounds of splitting, levels by contraction."""
    edges = [("p", i, i + 1) for i in range(50)] + [("p", i + 1, i) for i in range(0, 50, 3)] + [("p", 40, 200), ("p", 200, 201)]
    assert rows(strong_components(spark.createDataFrame(edges, E), small=45)) == plain(edges)


def test_a_deep_graph_in_a_task(spark):
    n = 60_000
    edges = spark.range(n).selectExpr("'p' package_id", "id src", "(id + 1) dst").unionByName(spark.createDataFrame([("p", 59_990, 30_000)], E))
    got = strong_components(edges).where("node in (0, 30000, 40000, 59990, 59991, 60000)")
    assert rows(got) == [("p", 0, 0, 30_010), ("p", 30_000, 30_000, 10), ("p", 40_000, 30_000, 10), ("p", 59_990, 30_000, 10), ("p", 59_991, 59_991, 9), ("p", 60_000, 60_000, 0)]


def test_nulls_and_empty_tables(spark):
    edges = spark.createDataFrame([("p", 1, None), (None, 1, 2), ("p", None, 2), ("p", 5, 5), ("p", 5, 5)], E)
    assert rows(strong_components(edges)) == [("p", 5, 5, 0)]
    assert rows(strong_components(edges.where("false"))) == []
