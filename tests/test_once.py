"""What several rules share is evaluated once."""

from graphloom.operators.match import first_match
from graphloom.plans import protocol
from tests import graphs


def test_first_match_evaluates_each_branch_once(spark):
    """Three branches are three scans; a key with a null has no match, rows that repeat stay."""
    branch = lambda n, *keys: spark.range(n).selectExpr(f"explode(array({', '.join(keys)})) as key", "cast(id as int) as x")
    found = first_match([branch(1, "'a'", "'a'", "cast(null as string)"), branch(2, "'a'", "'b'"), branch(3, "'b'", "'c'")], ["key"])
    assert found._jdf.queryExecution().sparkPlan().toString().count("Range (") == 3
    assert sorted(map(tuple, found.select("key", "x").collect())) == [("a", 0), ("a", 0), ("b", 0), ("b", 1), ("c", 0), ("c", 1), ("c", 2)]


def test_shared_tables_are_written_once(spark):
    g = graphs.graph(spark, *graphs.exported_eval())
    assert protocol.parent_functions(g) is protocol.parent_functions(g)
    assert protocol.properties(g) is protocol.properties(g)
    assert [tuple(r) for r in protocol.parent_functions(g).collect()] == [("p", 1, 4)]
