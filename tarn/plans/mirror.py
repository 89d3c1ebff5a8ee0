"""Collections as SQL tables: pushed by difference, checked, pulled back, and queried with Spark SQL.

A mirror table has id, hash, the schema's typed columns and data. A push joins the source with the table once on id and
writes the next version of the table; readers keep the one they opened.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import ids
from tarn.operators.schema import Schema
from tarn.plans.collections import Collection
from tarn.sources.records import is_object
from tarn.sources.store import VersionedTable

RESERVED = {"id", "hash", "data"}
SPARK = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}


class MirrorError(ValueError):
    """A collection or table that the mirror cannot hold."""


def row_hash(frame: DataFrame) -> DataFrame:
    """The frame with the hash of each record's text: the order of keys and 1 or 1.0 make a difference."""
    return frame.withColumn("hash", F.sha2("data", 256))


def differences(source: DataFrame, target: DataFrame) -> DataFrame:
    """id and action (insert, update, delete, unchanged) of every id, from id and hash on both sides."""
    s, t = source.select("id", F.col("hash").alias("new")), target.select("id", F.col("hash").alias("old"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") == F.col("new"), "unchanged").otherwise("update")
    return s.join(t, "id", "full_outer").select("id", action.alias("action"))


class Mirror:
    """Collections registered under names, with a table each below the root."""

    def __init__(self, spark: SparkSession, root: str, prefix: str = ""):
        if not re.fullmatch(r"[A-Za-z0-9_]*", prefix):
            raise MirrorError(f"bad prefix: {prefix!r}")
        self.spark, self.root, self.prefix = spark, root.rstrip("/"), prefix
        self.sources: dict[str, tuple[Collection, Schema]] = {}

    def table(self, name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
            raise MirrorError(f"bad name: {name!r}")
        return self.prefix + name.replace("-", "_")

    def collection(self, store: Collection, name: str, schema: Schema | None = None) -> Mirror:
        schema = schema or Schema(name)
        for field, f in schema.fields.items():
            if f.type == "mixed":
                if f.indexed():
                    raise MirrorError(f"{field} has no column to index")
            elif field.lower() in RESERVED or not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", field):
                raise MirrorError(f"bad column: {field!r}")
        if any(self.table(n) == self.table(name) and n != name for n in self.sources):
            raise MirrorError(f"two collections share the table {self.table(name)}")
        self.sources[name] = (store, schema)
        return self

    def _columns(self, schema: Schema) -> list[T.StructField]:
        return [T.StructField(n, SPARK[f.type]) for n, f in schema.fields.items() if f.type in SPARK]

    def _held(self, name: str) -> VersionedTable:
        _, schema = self.sources[name]
        fields = [T.StructField("id", T.StringType()), T.StructField("hash", T.StringType()), *self._columns(schema), T.StructField("data", T.StringType())]
        return VersionedTable(self.spark, f"{self.root}/{self.table(name)}", T.StructType(fields))

    def _source(self, name: str) -> DataFrame:
        store, schema = self.sources[name]
        return row_hash(schema.typed(store.frame().select("id", "data")))

    def _names(self, name: str | None) -> list[str]:
        if name is not None and name not in self.sources:
            raise MirrorError(f"unknown collection: {name}")
        return [name] if name else list(self.sources)

    def install(self) -> None:
        """Makes every table that is not there, and a view of each by its name."""
        for name in self.sources:
            held = self._held(name)
            if not held.versions.latest()[0]:
                held.versions.commit(0, {})
            held.read().createOrReplaceTempView(self.table(name))

    def uninstall(self) -> None:
        for name in self.sources:
            self.spark.catalog.dropTempView(self.table(name))
            self._held(name).versions.files.delete("")

    def push(self, name: str | None = None) -> dict:
        """Makes the tables equal to their collections; a table without differences is not written."""
        total = dict.fromkeys(("inserted", "updated", "deleted", "unchanged"), 0)
        words = {"insert": "inserted", "update": "updated", "delete": "deleted", "unchanged": "unchanged"}
        for n in self._names(name):
            held = self._held(n)

            def step(after: int, n: str = n, held: VersionedTable = held) -> dict:
                source = self._source(n)
                found = {words[r.action]: r["count"] for r in differences(source, held.read()).groupBy("action").count().collect()}
                if any(found.get(k) for k in ("inserted", "updated", "deleted")):
                    held.replace(source, after)
                return found

            found = held.versions.exclusively(step)
            total = {k: v + found.get(k, 0) for k, v in total.items()}
        self.install()
        return total

    def rebuild(self, name: str | None = None) -> dict:
        """Empties the tables, then pushes."""
        for n in self._names(name):
            held = self._held(n)
            held.replace(self.spark.createDataFrame([], held.schema))
        return self.push(name)

    def flush(self, name: str, id_list: Iterable[str] | DataFrame) -> dict:
        """Brings only the given ids up to date; an id that the collection lacks counts as deleted."""
        self._names(name)
        wanted = id_list if isinstance(id_list, DataFrame) else self.spark.createDataFrame([(i,) for i in id_list], "id string")
        wanted = wanted.select("id").distinct()
        held = self._held(name)

        def step(after: int) -> int:
            store = self._source(name).join(wanted, "id", "left_semi")
            rest = held.read().join(wanted, "id", "left_anti")
            held.replace(rest.unionByName(store), after)
            return store.count()

        upserted = held.versions.exclusively(step)
        self.install()
        return {"upserted": upserted, "deleted": wanted.count() - upserted}

    def pull(self, name: str | None = None) -> dict:
        """Puts rows whose text differs back into their collections; nothing is deleted there."""
        total = {"written": 0, "unchanged": 0}
        for n in self._names(name):
            store, _ = self.sources[n]
            rows = self._held(n).read().select("id", "data")
            if bad := rows.where(~ids.valid_column(F.col("id")) | ~is_object(F.col("data"))).limit(1).collect():
                raise MirrorError(f"{n}: bad row {bad[0].id}")
            both = row_hash(rows).join(row_hash(store.frame().select("id", "data")).select("id", F.col("hash").alias("old")), "id", "left")
            changed = both.where(F.col("old").isNull() | (F.col("old") != F.col("hash"))).select("id", "data")
            written = changed.count()
            total["unchanged"] += rows.count() - written
            total["written"] += store.put_frame(changed, ("id",)) if written else 0
        return total

    def verify(self) -> dict:
        """Missing, stale and orphaned rows of all tables."""
        stats, errors = dict.fromkeys(("records", "rows", "missing", "stale", "orphaned"), 0), []
        for n in self.sources:
            found = {r.action: r["count"] for r in differences(self._source(n), self._held(n).read()).groupBy("action").count().collect()}
            missing, stale, orphaned = (found.get(k, 0) for k in ("insert", "update", "delete"))
            records = sum(found.values()) - orphaned
            for k, v in (("records", records), ("rows", records - missing + orphaned), ("missing", missing), ("stale", stale), ("orphaned", orphaned)):
                stats[k] += v
            errors += [f"{n}: {v} {k}" for k, v in (("missing", missing), ("stale", stale), ("orphaned", orphaned)) if v]
        return {"ok": not errors, "errors": errors, "stats": stats}

    def sql(self, text: str) -> DataFrame:
        """Any Spark SQL over the tables."""
        self.install()
        return self.spark.sql(text)
