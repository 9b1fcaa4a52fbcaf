"""Queries over the smallest tables, against SQL or rules that hold for every row."""

import os

import duckdb
import pytest

from corpusloom.llm import queries as llm

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, name):
    rows = llm.queries()[name](spark, FOLDER).collect()
    if name in llm.oracle_sql():
        con = duckdb.connect()
        for t in os.listdir(FOLDER):
            con.execute(f"create view {t.split('.')[0]} as select * from '{FOLDER}/{t}'")
        assert sorted(map(tuple, rows)) == sorted(con.sql(llm.oracle_sql()[name]).fetchall())
    if name.endswith("_found"):
        assert len(set(map(tuple, rows))) == len(rows)
