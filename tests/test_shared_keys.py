"""Queries over items of which several rows share an order and a number."""

import os
import shutil

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_queries import SF, TABLES, values

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """The tables with further items: a returned one and one that was kept under one key, and two bulk ones that were returned under another."""
    folder = str(tmp_path_factory.mktemp("shared-keys"))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {'old' if t == 'lineitem' else t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        if t not in ("lineitem", "part"):
            shutil.copy(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    part = con.execute("SELECT max(p_partkey) + 1 FROM part").fetchone()[0]
    con.execute(f"COPY (SELECT * FROM read_parquet('{SF}/part.parquet') UNION ALL SELECT * REPLACE (p_partkey + {part} AS p_partkey) FROM read_parquet('{SF}/part.parquet') WHERE p_partkey < 3) TO '{folder}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE OR REPLACE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet')")
    rich = con.execute("SELECT min(o_orderkey) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 9000").fetchone()[0]
    one = "SELECT * REPLACE ({order} AS l_orderkey, {number}::INTEGER AS l_linenumber, {part} AS l_partkey, {flag} AS l_returnflag, {quantity} AS l_quantity) FROM (SELECT * FROM old LIMIT 1)"
    quantity = con.execute("SELECT column_type FROM (DESCRIBE old) WHERE column_name = 'l_quantity'").fetchone()[0]
    more = [one.format(order=o, number=n, part=p, flag=f"'{f}'", quantity=f"{q}::{quantity}") for o, n, p, f, q in ((rich, 900, part, "R", 1), (rich, 900, part + 1, "N", 1), (rich, 901, 0, "R", 46), (rich, 901, 1, "R", 47), (10**9, 1, part + 2, "R", 1))]
    con.execute(f"COPY (SELECT * FROM old UNION ALL {' UNION ALL '.join(more)}) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet')")
    return folder, con


@pytest.mark.parametrize("name", ["exists_pattern", "taint_reach_intra"])
def test_rows_that_share_a_key(spark, shared, name):
    """A flag counts for the row that has it, an item that is there twice once, and a part's item needs no order."""
    folder, con = shared
    got, want = entry.queries()[name](spark, folder).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert values(got, sorted(want.columns)) == values(want, sorted(want.columns))
