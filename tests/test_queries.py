"""Every core query over the smallest tables, against its SQL where there is one."""

import math
import os

import duckdb
import pytest

from corpusloom.plans import core

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, db, name):
    df = core.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in core.oracle_sql():
        found = db.sql(core.oracle_sql()[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert rows == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


def test_byte_sizes_of_large_files(spark, tmp_path):
    sizes = {"a": 1023, "b": 1024, "c": 1048575, "d": 1048576, "e": 1610612736}
    spark.createDataFrame(list(sizes.items()), "path string, size_bytes int").write.parquet(str(tmp_path / "source_files.parquet"))
    got = {r["path"]: r["size"] for r in core.byte_sizes(spark, str(tmp_path)).collect()}
    assert got == {"a": "1023 B", "b": "1.0 KB", "c": "1024.0 KB", "d": "1.0 MB", "e": "1.5 GB"}


def test_entry_without_llm():
    import __spark_entry__

    assert core.queries().keys() <= __spark_entry__.queries().keys()
