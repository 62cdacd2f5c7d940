import random

import pytest

from graphloom.operators.dominators import dominators, frontiers, versions

E = "package_id string, src long, dst long"
R = "package_id string, node long"
D = "package_id string, node long, variable string"


def led_to(edges, roots, without=None):
    todo = [r for r in roots if r != without]
    seen = set(todo)
    while todo:
        v = todo.pop()
        for a, b in edges:
            if a == v and b != without and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def plain(edges, roots):
    """By taking each node out: {node: its strict dominators}."""
    every = led_to(edges, roots)
    lost = {x: every - led_to(edges, roots, x) for x in every}
    return {v: {x for x in every if x != v and v in lost[x]} for v in every}


def nearest(strict):
    return {v: max(s, key=lambda x: len(strict[x])) if s else None for v, s in strict.items()}


def plain_frontiers(edges, strict):
    return {(x, w) for p, w in edges if p in strict and w in strict for x in strict[p] | {p} if x not in strict[w]}


def of(rows, package):
    return [r[1:] if len(r) > 2 else r[1] for r in rows if r[0] == package]


def run(spark, edges, roots, small):
    e, r = spark.createDataFrame(edges, E).repartition(2), spark.createDataFrame(roots, R)
    idoms = dominators(e, r, small)
    got = sorted(map(tuple, idoms.select("package_id", "node", "idom").collect()), key=repr)
    return got, sorted(map(tuple, frontiers(e, idoms, small).select("package_id", "node", "join").collect()))


@pytest.mark.parametrize(("seed", "small"), [*((i, 100_000) for i in range(5)), (5, 0)])
def test_random_graphs(spark, seed, small):
    rng = random.Random(seed)
    sizes = [("a", 14, 20), ("b", 5, 5), ("c", 25, 60)]
    edges = [(p, rng.randrange(n), rng.randrange(n)) for p, n, m in sizes for _ in range(m)] + [("d", i, i + 1) for i in range(9)] + [("d", 8, 2), ("d", 0, 6)]
    roots = [("a", 0), ("a", 3), ("b", 1), ("c", 0), ("c", 0), ("d", 0), ("none", 7)]
    got, fronts = run(spark, edges + edges[:3], roots, small)
    want, fronts_wanted = [], []
    for p in "a b c d none".split():
        strict = plain(of(edges, p), of(roots, p))
        want += [(p, v, x) for v, x in nearest(strict).items()]
        fronts_wanted += [(p, *x) for x in plain_frontiers(of(edges, p), strict)]
    assert got == sorted(want, key=repr)
    assert fronts == sorted(fronts_wanted)


def plain_versions(edges, roots, definitions):
    """Joins are added until each node is left with one version of each variable that a dominator has made."""
    strict = plain(edges, roots)
    fronts = plain_frontiers(edges, strict)
    joins = set()
    while True:
        made = {(v, x) for v, x in definitions if v in strict} | joins
        more = {(w, x) for v, x in made for a, w in fronts if a == v} - joins
        if not more:
            break
        joins |= more
    out = set()
    for v in strict:
        for x in {x for _, x in definitions}:
            if (v, x) in joins:
                out.add((v, x, v, True))
                continue
            for u in sorted(strict[v], key=lambda u: -len(strict[u])):
                if (u, x) in definitions:
                    out.add((v, x, u, False))
                    break
                if (u, x) in joins:
                    out.add((v, x, u, True))
                    break
    return sorted(out)


def version_rows(spark, edges, roots, definitions, small=100_000):
    got = versions(spark.createDataFrame([("p", *e) for e in edges], E), spark.createDataFrame([("p", r) for r in roots], R), spark.createDataFrame([("p", *d) for d in definitions], D), small)
    return sorted(tuple(r) for r in got.select("node", "variable", "version", "is_join").collect())


@pytest.mark.parametrize("small", [0, 100_000])
def test_two_branches_and_a_loop(spark, small):
    """x = 1; y = 2; while (..) { if (..) x = 3; else y = 4 } z = x + y"""
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (4, 6), (5, 7), (6, 7), (7, 3), (3, 8)]
    definitions = [(1, "x"), (2, "y"), (5, "x"), (6, "y"), (8, "z")]
    got = version_rows(spark, edges, [1], definitions, small)
    assert got == plain_versions(edges, [1], definitions)
    assert {(x, v, j) for n, x, v, j in got if n == 8} == {("x", 3, True), ("y", 3, True)}
    assert {(x, v, j) for n, x, v, j in got if n == 7} == {("x", 7, True), ("y", 7, True)}
    assert {(x, v, j) for n, x, v, j in got if n == 3} == {("x", 3, True), ("y", 3, True)}
    assert {(x, v, j) for n, x, v, j in got if n == 2} == {("x", 1, False)}


@pytest.mark.parametrize("seed", range(4))
def test_versions_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(20)]
    definitions = [(rng.randrange(12), rng.choice("xyz")) for _ in range(6)]
    assert version_rows(spark, edges, [0, 5], definitions) == plain_versions(edges, [0, 5], definitions)


def test_deep_package_in_one_task(spark):
    """20,000 nodes in a row and a loop over all of them."""
    n = 20_000
    edges = [("p", i, i + 1) for i in range(n)] + [("p", n, 1)]
    e, r = spark.createDataFrame(edges, E), spark.createDataFrame([("p", 0)], R)
    got = {r.node: r.idom for r in dominators(e, r).collect()}
    assert got == {0: None, **{i + 1: i for i in range(n)}}


def test_nulls_and_empty_tables(spark):
    edges = [("p", 1, 2), ("p", None, 2), (None, 1, 2), ("p", 2, None), ("p", 2, 2)]
    got, fronts = run(spark, edges, [("p", 1), ("p", None), (None, 1)], 100_000)
    assert got == [("p", 1, None), ("p", 2, 1)] and fronts == [("p", 2, 2)]
    assert run(spark, [], [], 100_000) == ([], [])
    assert version_rows(spark, [(1, 2)], [1], [(1, None), (None, "x")]) == []


def test_edges_of_versions_are_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("p", 1, 2), ("p", 1, 3), ("p", 2, 4), ("p", 3, 4)]
    edges = spark.createDataFrame(rows, "package_id string, src long, dst long")
    edges = edges.mapInArrow(counted, edges.schema)
    roots = spark.createDataFrame([("p", 1)], "package_id string, node long")
    made = spark.createDataFrame([("p", 2, "x"), ("p", 3, "x")], "package_id string, node long, variable string")
    got = {tuple(r) for r in versions(edges, roots, made).collect()}
    assert got == {("p", 4, "x", 4, True)}
    assert seen.value == len(rows)
