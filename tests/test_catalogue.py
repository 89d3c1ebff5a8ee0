"""Every query against its SQL in DuckDB, over the smallest tables."""

import glob
import os
import re

import duckdb
import pytest

from tarn.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def shown(rows):
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_against_sql(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, FOLDER)
    names = sorted(frame.columns)
    found = duck.execute(catalogue.SQL[name])
    have = [d[0] for d in found.description]
    assert sorted(have) == names
    rows = found.fetchall()
    assert shown(frame.select(*names).collect()) == shown([r[have.index(n)] for n in names] for r in rows)


def test_entry_reads_only(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name, column", [("filter_eq", "event_type"), ("filter_neq", "event_type"), ("filter_gt", "value"), ("filter_in", "event_type"), ("filter_between", "value"), ("filter_prefix", "p_name"), ("dnf_or_where", "event_type"), ("log_live_filtered_by_id_first", "id")])
def test_filters_reach_the_scan(spark, name, column):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan)[1]
    assert re.search(rf"\w+\({column}", pushed), pushed


def test_unneeded_columns_are_not_read(spark):
    plan = catalogue.QUERIES["count_by_value"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string>" in plan
