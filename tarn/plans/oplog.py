"""An append-only log of operations in Parquet: the one storage that documents, logs and queues share.

A commit is a folder of rows (commit, row, op, id, data, ...); (commit, row) is the append position. Rows are numbered as
they are written, in the order of the given frame or of the named columns, so a position never changes afterwards.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tarn.functions import ids
from tarn.sources.store import Conflict, Result, Versions

POSITION = ("commit", "row")
BASE = T.StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("commit", "long"), ("row", "long"), ("op", "string"), ("id", "string"), ("data", "string"))]})


class OpLog:
    """The commits of one log. `extra` are columns beside the base ones; a file holds at most `rows_per_file` rows, and about
    `bytes_per_file` bytes of records (0: any)."""

    def __init__(self, spark: SparkSession, root: str, extra: tuple[tuple[str, T.DataType], ...] = (), rows_per_file: int = 0, bytes_per_file: int = 0):
        self.spark, self.root, self.versions, self.rows_per_file, self.bytes_per_file = spark, root, Versions(spark, root), rows_per_file, bytes_per_file
        self.schema = T.StructType([*BASE.fields, *(T.StructField(n, t) for n, t in extra)])

    def folders(self) -> list[dict]:
        return self.versions.latest()[1].get("folders", [])

    def read(self) -> DataFrame:
        paths = [self.versions.files.at(f["path"]) for f in self.folders()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, frame: DataFrame) -> tuple[str, int]:
        folder, most = f"commit-{uuid.uuid4().hex}", self.rows_per_file
        if self.bytes_per_file:  # rows of the mean size fill a file
            mean = frame.agg(F.avg(F.octet_length("id") + F.coalesce(F.octet_length("data"), F.lit(0)))).first()[0]
            fit = max(1, int(self.bytes_per_file // max(mean or 1, 1)))
            most = min(most, fit) if most else fit
        frame.write.option("maxRecordsPerFile", most).parquet(self.versions.files.at(folder))
        return folder, self.spark.read.schema(self.schema).parquet(self.versions.files.at(folder)).count()

    def append(self, frame: DataFrame, order: tuple[Column | str, ...] = (), after: int | None = None) -> int:
        """Adds the frame's operations as one commit, all or none; returns their number.

        Operations that were chosen from the log's state name the version they saw in `after`: they are refused with Conflict if
        another writer came in between. Others are added behind that writer's."""
        if after is None:
            return self.exclusively(lambda number: self.append(frame, order, number))
        number, content = self.versions.latest()
        if number != after:
            raise Conflict(f"{self.root} has version {number}, not {after}")
        commit = content.get("next", 0)
        if order:
            frame = frame.repartitionByRange(*order).sortWithinPartitions(*order)
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in (*frame.columns, *POSITION)]
        rows = frame.select("*", *missing, F.lit(commit).cast("long").alias("commit"), F.monotonically_increasing_id().alias("row"))
        folder, n = self._write(rows.select(*self.schema.names))
        self._commit(number, {"next": commit + 1, "folders": [*content.get("folders", []), {"path": folder, "rows": n}]}, folder)
        return n

    def _commit(self, number: int, content: dict, folder: str) -> None:
        try:
            self.versions.commit(number, content)
        except Conflict:
            self.versions.files.delete(folder)
            raise

    def exclusively(self, step: Callable[[int], Result]) -> Result:
        return self.versions.exclusively(step)

    def history(self) -> DataFrame:
        """All operations, with the number of each among its id's, from 1: `version`."""
        place = Window.partitionBy("id").orderBy(*POSITION)
        return self.read().withColumn("version", F.row_number().over(place))

    def latest(self, condition: Column | None = None) -> DataFrame:
        """The last operation of every id. The condition may only concern ids: it is applied to all versions."""
        rows = self.read() if condition is None else self.read().where(condition)
        rest = [c for c in self.schema.names if c != "id"]
        last = rows.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(*POSITION)).alias("x"))
        return last.select("id", *[F.col(f"x.{c}").alias(c) for c in rest])

    def live(self, condition: Column | None = None) -> DataFrame:
        """The records whose last operation is a put."""
        return self.latest(condition).where("op = 'put'")

    def replace(self, made: Callable[[], DataFrame]) -> int:
        """Makes the frame, with its positions, the whole log. It is made anew if another writer came in between, so no commit is
        lost; old folders stay for readers of older versions."""

        def step(after: int) -> int:
            number, content = self.versions.latest()
            if number != after:
                raise Conflict(f"{self.root} has version {number}, not {after}")
            folder, n = self._write(made().select(*self.schema.names))
            self._commit(number, {"next": content.get("next", 0), "folders": [{"path": folder, "rows": n}]}, folder)
            return n

        return self.exclusively(step)

    def sweep(self, keep: int = 2, seconds: float = 86_400) -> dict:
        return self.versions.sweep(keep, seconds)

    def bytes(self) -> int:
        return sum(self.versions.files.size(f["path"]) for f in self.folders())

    def zones(self) -> DataFrame:
        """file, n, least and greatest id of each data file."""
        return self.read().groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("greatest"))


def put_rows(frame: DataFrame) -> DataFrame:
    return frame.select(F.lit("put").alias("op"), "id", "data")


def delete_rows(frame: DataFrame) -> DataFrame:
    return frame.select(F.lit("delete").alias("op"), "id", F.lit(None).cast("string").alias("data"))


def older(cutoff_ms: int) -> Column:
    """Ids whose time is at or before the cutoff."""
    return ids.ms_column(F.col("id")) <= cutoff_ms
