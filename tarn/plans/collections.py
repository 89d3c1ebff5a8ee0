"""Collections of records: documents (the last value of an id, by id) and logs (the last value, by append position)."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.functions import ids
from tarn.functions.jsonc import compact
from tarn.operators.query import QueryBuilder, RecordQuery
from tarn.operators.schema import Schema, SchemaError
from tarn.plans.cache import MemoryCache, NullCache
from tarn.plans.oplog import POSITION, OpLog, delete_rows, older, put_rows
from tarn.sources.records import before_first_bad, enveloped, is_object, read_framed_log, read_json_lines, write_json_lines

RECORDS = "id string, data string"


def as_records(spark: SparkSession, rows: Iterable[dict], make: ids.Uuid7) -> DataFrame:
    """id and data of dictionaries: {"id", "data"} envelopes, or bare objects that get an id."""
    out = []
    for row in rows:
        id_ = row["id"] if isinstance(row.get("id"), str) else make()
        data = row["data"] if isinstance(row.get("data"), dict) else row
        out.append((ids.checked(id_), compact(data)))
    return spark.createDataFrame(out, RECORDS).coalesce(1)


class Collection:
    """What documents and logs share. Records are frames of id and data (JSON text)."""

    natural: tuple[str, ...] = ("id",)

    def __init__(self, spark: SparkSession, root: str, make_id: ids.Uuid7 | None = None, cache: MemoryCache | NullCache | None = None):
        self.spark, self.log, self.make_id, self.cache = spark, OpLog(spark, root), make_id or ids.Uuid7(), cache or NullCache()

    def put(self, data: dict, id_: str | None = None) -> str:
        id_ = ids.checked(id_) if id_ else self.make_id()
        self.put_many([{"id": id_, "data": data}])
        return id_

    def put_many(self, rows: Iterable[dict]) -> int:
        """All of them or none."""
        return self.put_frame(as_records(self.spark, rows, self.make_id))

    def put_frame(self, frame: DataFrame, order: tuple = ()) -> int:
        return self.log.append(put_rows(frame), order)

    def delete(self, id_: str) -> None:
        """Adds a tombstone, whether the id is known or not."""
        self.log.append(delete_rows(self.spark.createDataFrame([(ids.checked(id_),)], "id string")))

    def delete_frame(self, frame: DataFrame) -> int:
        return self.log.append(delete_rows(frame.select("id").distinct()))

    def get(self, id_: str) -> Row | None:
        """The live record of the id, from the cache where that holds it for the log's version."""
        key = f"{self.log.versions.latest()[0]}:{ids.checked(id_)}"
        if (text := self.cache.get(key)) is not None:
            return Row(id=id_, data=text)
        found = self.log.live(F.col("id") == id_).select("id", "data").first()
        if found:
            self.cache.set(key, found.data)
        return found

    def frame(self) -> DataFrame:
        """All live records, with their positions."""
        return self.log.live().select("id", "data", *POSITION)

    def query(self) -> QueryBuilder:
        return QueryBuilder(self.frame(), "json", self.natural)

    def stream(self, query: RecordQuery | None = None) -> DataFrame:
        """Live records that the query lets through, in the collection's order. What concerns ids is applied to all versions
        and reaches the scan; what concerns data only to the last version. A corrupt record among those whose id fits stops
        the read unless the query has a callback for it; files that the scan reads go to the query's other callback."""
        query = query or RecordQuery()
        condition = query.id_condition()
        live = self.log.live(condition).select("id", "data", *POSITION)
        if query.on_open:
            scan = self.log.read() if condition is None else self.log.read().where(condition)
            for r in scan.select(F.input_file_name().alias("file")).distinct().orderBy("file").toLocalIterator():
                query.on_open(r.file)
        if query.on_error:
            for r in live.where(~is_object(F.col("data"))).select("id").toLocalIterator():
                query.on_error(r.id, "not an object")
            live = live.where(is_object(F.col("data")))
        else:  # the read itself stops there; a condition, so that no projection drops it
            live = live.where(F.when(is_object(F.col("data")), True).otherwise(F.raise_error(F.concat(F.lit("corrupt record "), "id")).cast("boolean")))
        return replace(query, on_open=None).apply(live, "json", self.natural).select("id", "data")

    def corrupt(self) -> DataFrame:
        return self.log.live().where(~is_object(F.col("data")) | ~ids.valid_column(F.col("id"))).select("id", "data")

    def compact(self) -> dict:
        """Rewrites the live records in their positions; tombstones and old versions go."""
        return {"ok": True, "records": self.log.replace(lambda: self.log.live().sortWithinPartitions(*self.natural))}

    def export_json_lines(self, path: str) -> int:
        frame = self.frame().select("id", "data")
        write_json_lines(frame, path)
        return self.spark.read.text(path).count()


class DocumentStore(Collection):
    """The last value of every id, in the order of ids, with an optional schema."""

    def __init__(self, spark: SparkSession, root: str, schema: Schema | None = None, name: str = "default", make_id: ids.Uuid7 | None = None, cache: MemoryCache | NullCache | None = None):
        super().__init__(spark, root, make_id, cache)
        if schema and schema.collection != name:
            raise SchemaError(f"the schema is for {schema.collection}, not for {name}")
        self.schema = schema

    def put_frame(self, frame: DataFrame, order: tuple = ()) -> int:
        """Checks types, required and unique fields before anything is written. Unique fields are checked against the version that
        the commit follows, so two writers cannot both bring a value in."""
        if self.schema and (bad := self.schema.invalid(frame).limit(1).collect()):
            raise SchemaError(f"{bad[0].id}: {bad[0].errors[0]}")
        if not self.schema or not any(f.unique for f in self.schema.fields.values()):
            return super().put_frame(frame, order)

        def step(after: int) -> int:
            last = frame.withColumn("n", F.monotonically_increasing_id()).groupBy("id").agg(F.max_by("data", "n").alias("data"))
            kept = self.frame().select("id", "data").join(last.select("id"), "id", "left_anti")
            if twice := self.schema.duplicates(kept.unionAll(last)).limit(1).collect():
                raise SchemaError(f"{twice[0].field} {twice[0].value} is not unique")
            return self.log.append(put_rows(frame), order, after)

        return self.log.exclusively(step)

    def import_json_lines(self, path: str) -> int:
        good, bad = read_json_lines(self.spark, path, int(time.time() * 1000))
        if found := bad.limit(1).collect():
            raise SchemaError(f"{found[0].location}: {found[0].error}")
        return self.put_frame(good)

    def stats(self) -> dict:
        live = self.log.live()
        row = live.agg(F.count(F.lit(1)).alias("n"), F.sum((~is_object(F.col("data"))).cast("long")).alias("bad")).first()
        indexes = sorted(n for n, f in self.schema.fields.items() if f.indexed()) if self.schema else []
        return {"records": row.n, "bytes": self.log.bytes(), "corrupt": row.bad or 0, "indexes": indexes}

    def verify(self) -> dict:
        """Corrupt records, and records that break the schema or a unique field."""
        errors = [f"{r.id}: corrupt" for r in self.corrupt().orderBy("id").limit(100).collect()]
        if self.schema and not errors:
            errors += [f"{r.id}: {e}" for r in self.schema.invalid(self.frame()).limit(100).collect() for e in r.errors]
            errors += [f"{r.field} {r.value}: {r.n} records" for r in self.schema.duplicates(self.frame()).limit(100).collect()]
        return {"ok": not errors, "errors": errors, "stats": self.stats()}

    health = verify

    def repair(self) -> dict:
        """Moves corrupt records to a quarantine beside the data and clusters the rest anew."""
        bad = self.corrupt()
        n = bad.count()
        if n:
            bad.write.mode("append").parquet(self.log.versions.files.at("quarantine"))
            self.log.replace(lambda: self.log.live().join(self.corrupt().select("id"), "id", "left_anti"))
        return {"ok": True, "quarantined": n, "reindexed": self.reindex()}

    def reindex(self) -> dict:
        """Rewrites the live records in ranges of ids, so that a scan skips files and row groups by id."""
        n = self.log.replace(lambda: self.log.live().repartitionByRange("id").sortWithinPartitions("id"))
        return {"fields": sorted(self.schema.fields) if self.schema else [], "entries": n}


class EventLog(Collection):
    """The last value of every id, in the order in which it was appended."""

    natural = POSITION

    def state(self) -> DataFrame:
        """id, op and position of the last operation of every id."""
        return self.log.latest().select("id", "op", *POSITION, (F.col("op") == "delete").alias("deleted")).orderBy("id")

    def deleted(self) -> DataFrame:
        return self.log.latest().where("op = 'delete'").select("id")

    def stats(self) -> dict:
        row = self.log.latest().agg(F.sum((F.col("op") == "put").cast("long")).alias("live"), F.sum((F.col("op") == "delete").cast("long")).alias("gone")).first()
        return {"segments": len(self.log.folders()), "records": row.live or 0, "deleted": row.gone or 0, "bytes": self.log.bytes()}

    def verify(self) -> dict:
        """Manifest counts against the files, the state against a replay of all operations in order, and corrupt records."""
        errors = []
        for f in self.log.folders():
            try:
                n = self.spark.read.parquet(self.log.versions.files.at(f["path"])).count()
            except AnalysisException:
                n = -1
            if n != f["rows"]:
                errors.append(f"{f['path']}: {n} rows instead of {f['rows']}")
        if not errors:
            replayed = self.log.history().withColumn("last", F.max("version").over(Window.partitionBy("id"))).where("version = last").select("id", "op", *POSITION)
            drift = self.log.latest().select("id", "op", *POSITION)
            drift = drift.exceptAll(replayed).unionAll(replayed.exceptAll(drift))
            errors += [f"{r.id}: state drift" for r in drift.limit(100).collect()]
        errors += [] if errors else [f"{r.id}: corrupt" for r in self.corrupt().limit(100).collect()]
        return {"ok": not errors, "errors": errors, "stats": {} if errors and "rows" in errors[0] else self.stats()}

    health = verify

    def repair(self) -> dict:
        """Corrupt records are dropped from the log."""
        bad = self.corrupt()
        if not bad.isEmpty():
            self.log.replace(lambda: self.log.live().join(self.corrupt().select("id"), "id", "left_anti"))
        return {"ok": True, "stats": self.stats()}

    recover = repair

    def retain(self) -> Retention:
        return Retention(self)

    def import_framed(self, good: DataFrame) -> int:
        """Appends the operations of framed log lines (file, line, op, id, data) in their order."""
        return self.log.append(good.select("op", "id", "data", "file", "line"), ("file", "line"))

    def recover_framed(self, path: str) -> int:
        """Appends what framed log files hold before their first bad line; each file is cut there, as a torn write leaves it."""
        return self.import_framed(before_first_bad(*read_framed_log(self.spark, path)))


@dataclass(frozen=True)
class Retention:
    """Deletes records by the time in their ids."""

    log: EventLog
    cutoff: int | None = None

    def older_than_days(self, days: int, now_ms: int | None = None) -> Retention:
        if days < 1:
            raise ValueError("at least one day")
        return self.older_than_ms(days * 86_400_000, now_ms)

    def older_than_ms(self, ms: int, now_ms: int | None = None) -> Retention:
        if ms < 0:
            raise ValueError("an age is not negative")
        return Retention(self.log, (int(time.time() * 1000) if now_ms is None else now_ms) - ms)

    def compact(self) -> int:
        """Deletes what is at or before the cutoff, rewrites the log, and returns the number deleted."""
        if self.cutoff is None:
            raise ValueError("retention needs a cutoff")
        n = self.log.log.live(older(self.cutoff)).count()
        if n:
            self.log.delete_frame(self.log.log.live(older(self.cutoff)))
        self.log.compact()
        return n


__all__ = ["Collection", "DocumentStore", "EventLog", "Retention", "as_records", "enveloped"]
