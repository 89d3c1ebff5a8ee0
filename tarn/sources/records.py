"""Record files, JSON lines and framed logs as frames, and back."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import ids
from tarn.functions.frames import unframed_column
from tarn.functions.jsonc import canonical_column

ENVELOPE = "id string, data string"
LOG_OPERATIONS = ("put", "delete")
QUEUE_OPERATIONS = ("enqueue", "claim", "complete", "requeue", "purge")


def is_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def member(text: Column, name: str) -> Column:
    """The JSON text of an object's member, as it was written where that can be had: 1.0 stays 1.0."""
    return F.get_json_object(text, f"$.{name}")


def enveloped(frame: DataFrame, text: str = "value", payload: str = "data") -> DataFrame:
    """id and data of JSON objects: a string id is kept, else null; data is the payload if that is an object, else all.

    The payload's text is cut out by its own parser, so numbers keep their form."""
    value = F.try_parse_json(F.col(text))
    id_ = F.variant_get(value, "$.id", "variant")
    inner = F.variant_get(value, f"$.{payload}", "variant")
    named = F.when(F.schema_of_variant(id_) == "STRING", F.try_variant_get(id_, "$", "string"))
    whole = F.col(text)
    nested = F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False))
    return frame.select("*", named.alias("id"), F.when(nested, member(whole, payload)).otherwise(whole).alias("data"))


def with_new_ids(frame: DataFrame, first_ms: int) -> DataFrame:
    """Records without an id get one from a time, their place and 30 random bits of this import: places are unique within an
    import, and the bits tell imports of one millisecond apart."""
    place = F.monotonically_increasing_id()
    # a place takes 62 bits at most; its high bits move the time on, so the order of places is the order of ids
    salt = secrets.randbits(30)
    low = F.shiftright(place, 26).bitwiseAND(F.lit((1 << 14) - 1)), place.bitwiseAND(F.lit((1 << 26) - 1))
    ms = F.lit(first_ms) + F.shiftright(place, 40)
    # 12 bits, 14 bits and 48 bits of the version, variant and last group
    made = F.format_string("%08x-%04x-7%03x-%04x-%012x", (ms / 65536).cast("long"), ms % 65536, F.lit(salt >> 18), F.lit(0x8000) + low[0], low[1] * F.lit(1 << 18) + F.lit(salt & ((1 << 18) - 1)))
    return frame.withColumn("id", F.coalesce("id", made))


def read_record_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(good: id, data; bad: location, error) of a folder of files that hold one record each, comments allowed.

    A record is good if it is an object whose id is a UUID version 7 and the file's name; data that is no object is {}."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    strict = F.when(is_object(F.col("value")), F.col("value"))
    files = files.select("file", name.alias("name"), F.coalesce(strict, canonical_column(F.when(strict.isNull(), F.col("value")))).alias("text"))
    value = F.try_parse_json("text")
    id_ = F.try_variant_get(value, "$.id", "string")
    nested = F.coalesce(F.schema_of_variant(F.variant_get(value, "$.data", "variant")).startswith("OBJECT"), F.lit(False))
    checked = files.withColumns({"id": id_, "data": F.when(nested, member(F.col("text"), "data")).otherwise("{}")})
    error = F.when(F.col("text").isNull(), "not an object").when(~ids.valid_column(F.col("id")), "no valid id").when(F.col("id") != F.col("name"), "the id is not the file's name")
    checked = checked.withColumn("error", error)
    return checked.where("error is null").select("id", "data"), checked.where("error is not null").select(F.col("file").alias("location"), "error")


def read_json_lines(spark: SparkSession, path: str, first_ms: int) -> tuple[DataFrame, DataFrame]:
    """(good: id, data; bad: location, error) of JSON lines; blank lines are skipped, records without an id get one."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    good = is_object(F.col("value"))
    bad = lines.where(~good).select(F.input_file_name().alias("location"), F.concat(F.lit("not an object: "), F.substring("value", 1, 80)).alias("error"))
    return with_new_ids(enveloped(lines.where(good)).select("id", "data"), first_ms), bad


def read_framed_log(spark: SparkSession, path: str, payload: str = "data", operations: tuple[str, ...] | None = None, now: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good: file, line, op, id, data, done, ts; bad: file, line, error) of framed log files; `line` orders a file's lines: the
    start of the block that was read and the row. A queue's events have their data under "payload", and done and ts; a
    missing ts is `now`; those are null in other logs. An operation that is not listed and an id that is no UUID version 7 are bad.

    Files are read by lines in blocks, so a file of any length is read by many tasks."""
    operations = operations or (LOG_OPERATIONS if payload == "data" else QUEUE_OPERATIONS)
    lines = spark.read.option("lineSep", "\n").text(path)
    block = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    whole = lines.select(F.col("_metadata.file_path").alias("file"), block.alias("line"), "value")
    framed = whole.where("value <> ''").withColumn("body", unframed_column(F.col("value")))
    value = F.try_parse_json("body")
    framed = framed.withColumns({"op": F.try_variant_get(value, "$.op", "string"), "id": F.try_variant_get(value, "$.id", "string")})
    fine = F.coalesce(F.col("body").isNotNull() & F.col("op").isin(*operations) & ids.valid_column(F.col("id")), F.lit(False))
    more = [F.try_variant_get(value, "$.done", "boolean").alias("done"), F.coalesce(F.try_variant_get(value, "$.ts", "bigint"), F.lit(now).cast("long")).alias("ts")]
    good = framed.where(fine).select("file", "line", "op", "id", member(F.col("body"), payload).alias("data"), *more)
    error = F.when(F.col("body").isNull(), "broken frame").when(F.col("op").isNull() | F.col("id").isNull(), "no op or id").when(~F.col("op").isin(*operations), "unknown op").otherwise("no valid id")
    return good, framed.where(~fine).select("file", "line", error.alias("error"))


def before_first_bad(good: DataFrame, bad: DataFrame) -> DataFrame:
    """The lines of each file that come before its first bad one: what a torn tail leaves."""
    first = bad.groupBy("file").agg(F.min("line").alias("torn"))
    return good.join(first, "file", "left").where("torn is null or line < torn").drop("torn")


def json_lines(frame: DataFrame) -> DataFrame:
    """One column of JSON lines, in the order of ids."""
    quoted = F.to_json(F.struct("id"))
    return frame.orderBy("id").select(F.concat(F.regexp_replace(quoted, r"\}$", ""), F.lit(',"data":'), "data", F.lit("}")).alias("value"))


def write_json_lines(frame: DataFrame, path: str) -> None:
    json_lines(frame).write.text(path)
