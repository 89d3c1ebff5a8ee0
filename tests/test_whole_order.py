"""Places in whole orders, against the rows sorted in Python and against SQL."""

import glob
import os

import duckdb
import pytest

from tarn.operators.query import QueryBuilder
from tarn.plans import catalogue

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_places_of_all_rows(spark, direction):
    rows = [(f"{i * 7919 % 5000:05d}", i % 13) for i in range(5000)]
    frame = spark.createDataFrame(rows, "id string, v int").repartition(7)
    got = {r.id: r.rn for r in QueryBuilder(frame).order_by("v", direction).numbered().collect()}
    ordered = sorted(rows, key=lambda r: (r[1] if direction == "asc" else -r[1], r[0]))
    assert got == {r[0]: n for n, r in enumerate(ordered, 1)}
    assert QueryBuilder(frame.limit(0)).numbered().collect() == []


def whole(spark, name, total, folder=FOLDER):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    frame = catalogue.QUERIES[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({catalogue.SQL[name]})").fetchall()
    rows = sorted(map(tuple, frame.collect()))
    assert rows == sorted(want) and len(rows) == total


@pytest.mark.parametrize("name", ["json_order_mixed", "json_order_mixed_desc"])
def test_values_of_all_types_have_places(spark, name):
    whole(spark, name, 10_000)


@pytest.mark.parametrize("name, total", [("log_compacted_order", 1206), ("queue_pending_order", 531)])
def test_every_live_row_has_a_place(spark, name, total):
    whole(spark, name, total, "/root/testdata/sf0.1")
