import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators.regular import alt, many, matches, maybe, prefixes, seq, step
from graphloom.plans import param_types
from tests import graphs

E = "package_id string, src long, dst long, name string"


def words(k):
    return ["".join(w) for n in range(k + 1) for w in itertools.product("abA", repeat=n)]


@pytest.mark.parametrize(("make", "text"), [
    (lambda a, b, r: seq(a, many(b), a), "ab*a"), (lambda a, b, r: many(alt(seq(a, b), r)), "(ab|A)*"), (lambda a, b, r: many(alt(a, b), 1), "(a|b)+"), (lambda a, b, r: seq(maybe(a), maybe(b), many(r, 1)), "a?b?A+"), (lambda a, b, r: maybe(a), "a?"),
])
@pytest.mark.parametrize("small", [0, 10_000])
def test_patterns(spark, make, text, small):
    """Against every word of up to six edges on a graph in which no longer ones are needed; A: a backward."""
    import re

    rng = random.Random(len(text))
    edges = [("p", rng.randrange(-2, 3), rng.randrange(-2, 3), rng.choice("ab")) for _ in range(7)]
    pattern = make(step(F.col("name") == "a"), step(F.col("name") == "b"), step(F.col("name") == "a", backward=True))
    want = set()
    for word in words(6):
        if re.fullmatch(text, word):
            for origin, seed in ((1, 0), (2, -2)):
                at = {seed}
                for x in word:
                    at = {(b if x != "A" else a) for _, a, b, n in edges for v in at if n == x.lower() and v == (a if x != "A" else b)}
                want |= {("p", origin, v) for v in at}
    seeds = spark.createDataFrame([("p", 1, 0), ("p", 2, -2)], "package_id string, origin long, node long")
    got = matches(spark.createDataFrame(edges, E), seeds, pattern, small)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_ids_too_large_for_the_states(spark):
    one = spark.createDataFrame([("p", 1 << 62, 1, "a")], E)
    seeds = spark.createDataFrame([("p", 1, 1)], "package_id string, origin long, node long")
    with pytest.raises(Exception, match="too large"):
        matches(one, seeds, step(F.col("name") == "a")).collect()


K = "package_id string, src long, dst long, kind string, name string"
S = "package_id string, origin string, node long"


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.package_id, r.origin, tuple(r.prefix)), []).append(r.node)
    assert all(len(x) == len(set(x)) for x in out.values())
    return {k: sorted(v) for k, v in out.items()}


def trails(edges, seeds):
    """All prefixes of an acyclic graph."""
    out = {}
    for origin, seed in seeds:
        todo = [((), seed, False)]
        seen = set(todo)
        while todo:
            prefix, v, done = todo.pop()
            out.setdefault(("p", origin, prefix), set()).add(v)
            for _, a, b, kind, name in edges:
                if a == v:
                    x = ((*prefix, name) if kind == "read" and not done else prefix, b, done or kind == "end")
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(("seed", "small"), [(1, 10_000), (2, 10_000), (3, 10_000), (4, 0)])
def test_prefixes_without_cycles(spark, seed, small):
    rng = random.Random(seed)
    edges = []
    for _ in range(16):
        a, b = sorted(rng.sample(range(9), 2))
        edges.append(("p", a, b, rng.choice(["stay", "read", "read", "end"]), rng.choice("xyz")))
    seeds = [("o", 0), ("o", 1), ("q", 2)]
    got = prefixes(spark.createDataFrame(edges, K), spark.createDataFrame([("p", *s) for s in seeds], S), small)
    assert collected(got) == trails(edges, seeds)


def complete(n, name="{a}{b}"):
    return [("p", a, b, "read", name.format(a=a, b=b)) for a in range(n) for b in range(n)]


@pytest.mark.parametrize("small", [0, 10_000])
def test_full_cycle_of_five(spark, small):
    """Every property of five objects leads to each of them: each object is opened once, 25 reads are 25 prefixes."""
    got = collected(prefixes(spark.createDataFrame(complete(5), K), spark.createDataFrame([("p", "o", 0)], S), small))
    want = {("p", "o", ()): [0]}
    want |= {("p", "o", (f"0{b}",)): [b] for b in range(5)}
    want |= {("p", "o", (f"0{a}", f"{a}{b}")): [b] for a in range(1, 5) for b in range(5)}
    assert got == want


@pytest.mark.parametrize("small", [0, 10_000])
def test_both_ways_agree_on_cycles(spark, small):
    """Two cycles, the second entered over two names, stays inside and between, an end."""
    edges = [("p", 0, 1, "read", "a"), ("p", 1, 0, "stay", None), ("p", 1, 2, "read", "b"), ("p", 0, 2, "read", "c"), ("p", 2, 3, "read", None), ("p", 3, 2, "read", "d"), ("p", 3, 4, "stay", None), ("p", 4, 3, "read", "e"), ("p", 4, 5, "end", None), ("p", 5, 0, "read", "f")]
    got = collected(prefixes(spark.createDataFrame(edges, K), spark.createDataFrame([("p", "o", 0)], S), small))
    inner = lambda *to: {to: [2], (*to, "*"): [0, 1, 2, 3, 4, 5], (*to, "*", "d"): [2], (*to, "*", "e"): [0, 1, 2, 3, 4, 5]}
    want = {(): [0], ("a",): [0, 1]} | inner("c") | inner("a", "b")
    assert {k[2]: v for k, v in got.items()} == want


def test_a_large_full_cycle_ends(spark):
    got = prefixes(spark.createDataFrame(complete(60), K), spark.createDataFrame([("p", "o", 0)], S))
    assert got.count() == 1 + 60 * 60


def test_parameter_trees_of_a_full_cycle(spark):
    nodes = [(1, "VariableDeclarator", "f"), *((10 + i, "PDG_OBJECT", f"3.o{i}-o1") for i in range(5))]
    edges = [(1, 10, "REF", "param", None, {"param_index": 0})] + [(10 + a, 10 + b, "PDG", "SO", f"p{b}") for a in range(5) for b in range(5)]
    trees = param_types.parameter_trees(graphs.graph(spark, nodes, edges), spark.createDataFrame([("p", 1)], "package_id string, fn long"))
    assert sorted(len(r.prefix) for r in trees.collect()) == [0] + [1] * 5 + [2] * 20
