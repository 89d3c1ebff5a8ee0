"""Structured Streaming over logs: tails, a running queue, and periodic mirror pushes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tarn.functions import ids
from tarn.plans.mirror import Mirror


def tail(spark: SparkSession, folder: str, schema: T.StructType | str, after: str | None = None) -> DataFrame:
    """Rows of Parquet files as they appear below a folder; with `after`, only ids beyond it."""
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    return rows if after is None else rows.where(F.col("id") > after)


def event_time(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Rows with the time in their ids as `event_time`, and a watermark on it."""
    return rows.withColumn("event_time", F.timestamp_millis(ids.ms_column(F.col("id")))).withWatermark("event_time", late)


def windowed_counts(rows: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return event_time(rows, late).groupBy(F.window("event_time", width)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


STATE = "state string, pos long, ts long"


def queue_states(events: DataFrame) -> DataFrame:
    """The state of every job after each micro-batch in which it had events (id, seq, op, done, ts), in the order of seq."""

    def step(key: tuple, parts: Iterable[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state, pos, ts = held.get if held.exists else ("none", None, None)
        for e in pd.concat(list(parts)).sort_values("seq").itertuples():
            if e.op == "enqueue":
                state, pos, ts = "pending", e.seq, None
            elif e.op == "complete":
                state, pos, ts = ("done", None, e.ts) if e.done is True or e.done == 1 else ("none", None, None)
            elif e.op == "claim" and state == "pending":
                state, pos, ts = "processing", None, e.ts
            elif e.op == "requeue" and state == "processing":
                state, pos, ts = "pending", e.seq, None
            elif e.op == "purge" and state == "done":
                state, pos, ts = "none", None, None
        pos, ts = (None if v is None else int(v) for v in (pos, ts))
        held.update((state, pos, ts))
        yield pd.DataFrame({"id": [key[0]], "state": [state], "pos": pd.array([pos], "Int64"), "ts": pd.array([ts], "Int64")})

    return events.groupBy("id").applyInPandasWithState(step, f"id string, {STATE}", STATE, "update", "NoTimeout")


def push_stream(rows: DataFrame, mirror: Mirror, name: str, checkpoint: str) -> StreamingQuery:
    """Flushes the ids of each micro-batch into the mirror until what is there has been read."""

    def batch(frame: DataFrame, _: int) -> None:
        changed = frame.select("id").distinct().persist()
        if not changed.isEmpty():
            mirror.flush(name, changed)
        changed.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
