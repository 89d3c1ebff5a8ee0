"""Rows of other databases by their own SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_rows(spark: SparkSession, url: str, sql: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A query's rows through JDBC; with a key and its bounds the read is dealt to so many connections."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if key is None or bounds is None or parts < 2:
        return reader.option("query", sql).load()
    dealt = {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return reader.option("dbtable", f"({sql}) q").options(**dealt).load()
