from __future__ import annotations

import os

import duckdb
import pytest

from lodestone.llm import queries
from tests.test_entry import plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["op11_octopus_manifest", "op12_multiset_fingerprints", "op13_automaton_collocations", "url_rules", "mix_targets", "shard_sizes"])
def test_query_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    made = queries.QUERIES[name](spark, SF).toPandas()
    wanted = con.sql(queries.ORACLES[name]).df()
    assert sorted(made.columns) == sorted(wanted.columns) and plain(made) == plain(wanted)
