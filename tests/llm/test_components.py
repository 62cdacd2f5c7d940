import random

import pytest

from graphloom.llm.components import connected_components


def by_hand(edges):
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


_RANDOM = random.Random(5)
CASES = {
    "empty": [],
    "loops": [(1, 1), (2, 2)],
    "star": [(9, 1), (1, 7), (8, 1), (8, 1)],
    "star around its largest": [(9, 1), (9, 7), (8, 9)],
    "chain": [(i, i + 1) for i in range(40)],
    "shared child": [(5, 1), (5, 2), (6, 2), (-3, 6)],
    "random": [(_RANDOM.randrange(-60, 60), _RANDOM.randrange(-60, 60)) for _ in range(70)],
}


@pytest.mark.parametrize("name", CASES)
def test_against_union(spark, name):
    edges = CASES[name]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == by_hand(edges)
