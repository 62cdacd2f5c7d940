import random

import pytest

from graphloom.operators.points_to import points_to

S = "package_id string, kind string, target long, source long, property string"


def plain(statements):
    """All rules over all sets until nothing changes."""
    out = []
    for p in {s[0] for s in statements}:
        own = [s[1:] for s in statements if s[0] == p]
        of = {}
        while True:
            size = sum(map(len, of.values()))
            for kind, t, s, prop in own:
                if kind == "new":
                    of.setdefault((t, None), set()).add(s)
                elif kind == "copy":
                    of.setdefault((t, None), set()).update(of.get((s, None), ()))
                elif kind == "write":
                    for o in list(of.get((t, None), ())):
                        of.setdefault((o, prop), set()).update(of.get((s, None), ()))
                else:
                    for o in list(of.get((s, None), ())):
                        for (h, q), inside in list(of.items()):
                            if h == o and q is not None and ("*" in (q, prop) or q == prop):
                                of.setdefault((t, None), set()).update(inside)
            if sum(map(len, of.values())) == size:
                break
        out += [(p, h, q, o) for (h, q), inside in of.items() for o in inside]
    return sorted(out, key=repr)


def run(spark, statements, small=100_000):
    got = points_to(spark.createDataFrame(statements, S).repartition(2), small)
    return sorted(map(tuple, got.select("package_id", "holder", "property", "object").collect()), key=repr)


@pytest.mark.parametrize(("seed", "small"), [*((i, 100_000) for i in range(8)), (8, 0), (9, 0)])
def test_random_programs(spark, seed, small):
    """Objects from 100 on, so that no variable has an object's number."""
    rng = random.Random(seed)
    rows = []
    for p, n in (("a", 30), ("b", 12), ("c", 6)):
        for _ in range(n):
            kind = rng.choice(["new", "copy", "write", "read"])
            source = 100 + rng.randrange(6) if kind == "new" else rng.randrange(8)
            rows.append((p, kind, rng.randrange(8), source, rng.choice(["p", "q", "*"]) if kind in ("write", "read") else None))
    assert run(spark, rows + rows[:3], small) == plain(rows)


@pytest.mark.parametrize("small", [0, 100_000])
def test_nested_properties(spark, small):
    """a = {}, b = {}; a.p = b; c = a; d = {}; c.p.q = d by way of t = c.p; then u = b.q is d, and so is a.p.q."""
    rows = [("p", "new", 1, 101, None), ("p", "new", 2, 102, None), ("p", "write", 1, 2, "p"), ("p", "copy", 3, 1, None), ("p", "new", 4, 104, None), ("p", "read", 5, 3, "p"), ("p", "write", 5, 4, "q"), ("p", "read", 6, 2, "q"), ("p", "read", 7, 1, "p"), ("p", "read", 8, 7, "q"), ("p", "read", 9, 1, None)]
    got = {(h, q): o for _, h, q, o in run(spark, rows, small)}
    assert got == {(1, None): 101, (2, None): 102, (3, None): 101, (4, None): 104, (5, None): 102, (6, None): 104, (7, None): 102, (8, None): 104, (9, None): 102, (101, "p"): 102, (102, "q"): 104}


def test_nulls_and_empty_tables(spark):
    rows = [("p", "new", 1, 101, "x"), ("p", None, 1, 5, None), (None, "new", 1, 5, None), ("p", "copy", None, 1, None), ("p", "copy", 2, 1, None)]
    assert run(spark, rows) == [("p", 1, None, 101), ("p", 2, None, 101)]
    assert points_to(spark.createDataFrame([], S)).collect() == []
