import random

import pytest

from graphloom.operators.dataflow import reaching_definitions

E = "package_id string, src long, dst long"
D = "package_id string, node long, variable string"


def plain(edges, definitions):
    """Each definition is followed alone until its variable is defined again."""
    out = set()
    for p, d, x in set(definitions):
        todo, seen = [d], set()
        while todo:
            v = todo.pop()
            for q, a, b in edges:
                if q == p and a == v and b not in seen:
                    seen.add(b)
                    if (p, b, x) not in definitions:
                        todo.append(b)
        out |= {(p, v, x, d) for v in seen}
    return sorted(out)


def run(spark, edges, definitions, small=100_000):
    got = reaching_definitions(spark.createDataFrame(edges, E).repartition(2), spark.createDataFrame(definitions, D), small)
    return sorted(map(tuple, got.select("package_id", "node", "variable", "definition").collect()))


@pytest.mark.parametrize(("seed", "small"), [*((i, 100_000) for i in range(6)), (6, 0)])
def test_random_graphs(spark, seed, small):
    rng = random.Random(seed)
    edges = [(p, rng.randrange(n), rng.randrange(n)) for p, n, m in (("a", 15, 22), ("b", 5, 4), ("c", 30, 32)) for _ in range(m)]
    definitions = [(p, rng.randrange(n), rng.choice("xyz")) for p, n in (("a", 15), ("b", 5), ("c", 30), ("none", 3)) for _ in range(n // 3)]
    assert run(spark, edges, definitions + definitions[:2], small) == plain(edges, definitions)


@pytest.mark.parametrize("small", [0, 100_000])
def test_branch_and_loop(spark, small):
    """x = 1; y = 2; while (..) { if (..) x = 3; else y = 4 } z = x + y"""
    edges = [("p", a, b) for a, b in ((1, 2), (2, 3), (3, 4), (4, 5), (4, 6), (5, 7), (6, 7), (7, 3), (3, 8))]
    definitions = [("p", 1, "x"), ("p", 2, "y"), ("p", 5, "x"), ("p", 6, "y"), ("p", 8, "z")]
    got = run(spark, edges, definitions, small)
    assert got == plain(edges, definitions)
    assert {(x, d) for _, v, x, d in got if v == 8} == {("x", 1), ("x", 5), ("y", 2), ("y", 6)}
    assert {(x, d) for _, v, x, d in got if v == 2} == {("x", 1)}


def test_long_chain_without_definitions_by_all_executors(spark):
    """200 hops in the rounds of the contraction."""
    edges = [("p", i, i + 1) for i in range(200)]
    assert run(spark, edges, [("p", 0, "x"), ("p", 150, "x"), ("p", 10, "y")], 0) == plain(edges, [("p", 0, "x"), ("p", 150, "x"), ("p", 10, "y")])


def test_nulls_and_empty_tables(spark):
    edges = [("p", 1, 2), ("p", None, 2), (None, 1, 2), ("p", 2, None)]
    assert run(spark, edges, [("p", 1, "x"), ("p", 1, None), ("p", None, "x")]) == [("p", 2, "x", 1)]
    assert run(spark, [], [("p", 1, "x")]) == []
