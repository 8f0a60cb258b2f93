"""Each registered query against its SQL, on the small tables."""

import glob
import os

import duckdb
import pytest

from fileloom.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(table):
    def plain(x):
        if x is None or x != x:
            return None
        return round(float(x), 9) if isinstance(x, float) else x

    return sorted((tuple(plain(x) for _, x in sorted(r.items())) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(file)[:-8]} as select * from '{file}'")
    got = [r.asDict() for r in QUERIES[name](spark, DATA).collect()]
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert rows(got) == rows([dict(zip(columns, r, strict=True)) for r in found.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1


def test_metadata_queries_stay_in_codegen(spark):
    plan = QUERIES["fit_dimensions"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan
