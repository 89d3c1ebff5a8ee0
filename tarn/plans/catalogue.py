"""Every operator of the library as a query over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import ids
from tarn.functions.jsonc import canonical_column
from tarn.operators.query import QueryBuilder, RecordQuery, placed
from tarn.operators.schema import Schema
from tarn.plans.collections import DocumentStore, EventLog
from tarn.plans.jobqueue import JobQueue, fold
from tarn.plans.mirror import Mirror, differences, row_hash
from tarn.plans.oplog import OpLog
from tarn.sources.records import enveloped, json_lines
from tarn.sources.store import scratch
from tarn.streaming.streams import push_stream, queue_states, tail, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Frames. Ids of events are made from their time and number, alike in both engines.
MS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000"
ID_SQL = "printf('%08x-%04x-7000-8000-%012x', (epoch_us(ts)//1000)//65536, (epoch_us(ts)//1000)%65536, event_id)"
EVENTS_SQL = f"(SELECT {ID_SQL} AS id, * FROM events)"
FIRST_MS_SQL = "(SELECT min(epoch_us(ts)//1000) FROM events)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("id", ids.made_column(F.expr(MS), F.col("event_id")))


def typed(frame: DataFrame) -> QueryBuilder:
    return QueryBuilder(frame)


def plain(spark: SparkSession, d: str, name: str, key: str) -> QueryBuilder:
    """A table whose key is the id: filters on columns reach the scan as they are."""
    return QueryBuilder(table(spark, d, name), natural=(key,))


def json_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON records whose field f is missing, null, a number, a string, true or a list."""
    k = F.col("event_id") % 6
    data = (
        F.when(k == 0, "{}").when(k == 1, '{"f":null}').when(k == 2, F.concat(F.lit('{"f":'), F.col("user_id").cast("string"), F.lit("}")))
        .when(k == 3, F.concat(F.lit('{"f":"'), "event_type", F.lit('"}'))).when(k == 4, '{"f":true}').otherwise('{"f":[1,2]}')
    )
    return events(spark, d).select("id", data.alias("data"), "event_id")


def json_query(spark: SparkSession, d: str) -> QueryBuilder:
    return QueryBuilder(json_events(spark, d), "json")


J_SQL = f"""(SELECT id, event_id, j, json_type(j, '$.f') AS t, json_extract_string(j, '$.f') AS s FROM (SELECT {ID_SQL} AS id, event_id,
  CASE event_id % 6 WHEN 0 THEN '{{}}' WHEN 1 THEN '{{"f":null}}' WHEN 2 THEN '{{"f":' || user_id || '}}' WHEN 3 THEN '{{"f":"' || event_type || '"}}'
  WHEN 4 THEN '{{"f":true}}' ELSE '{{"f":[1,2]}}' END AS j FROM events))"""
RANK_SQL = "CASE WHEN t = 'VARCHAR' THEN 0 WHEN t IN ('UBIGINT','BIGINT','DOUBLE') THEN 1 WHEN t = 'ARRAY' THEN 2 WHEN t IS NULL OR t = 'NULL' THEN 4 WHEN t = 'BOOLEAN' THEN 5 ELSE 6 END"


# A: sources and scans.
@query(f"SELECT id, event_type, value FROM {EVENTS_SQL}")
def scan_all_by_id(spark, d):
    return typed(events(spark, d)).get().select("id", "event_type", "value")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def point_get_by_id(spark, d):
    return plain(spark, d, "orders", "o_orderkey").where("o_orderkey").eq(77).matching().select("o_orderkey", "o_totalprice")


@query(f"SELECT id, event_id FROM {EVENTS_SQL} WHERE event_id = 42")
def point_get_by_made_id(spark, d):
    wanted = events(spark, d).where("event_id = 42").select("id")
    return events(spark, d).join(wanted, "id", "left_semi").select("id", "event_id")


@query(f"SELECT id, event_id FROM {EVENTS_SQL} WHERE epoch_us(ts)//1000 BETWEEN 1704153600000 AND 1704758400000")
def time_range_inclusive(spark, d):
    return RecordQuery().time_range_ms(1704153600000, 1704758400000).apply(events(spark, d)).select("id", "event_id")


@query(f"SELECT id, event_id FROM {EVENTS_SQL} WHERE epoch_us(ts)//1000 >= 1704758400000")
def time_range_open_end(spark, d):
    return RecordQuery().time_range_ms(since=1704758400000).apply(events(spark, d)).select("id", "event_id")


CURSOR = ids.bounds(1704500000000)[0]


@query(f"SELECT id, event_id FROM {EVENTS_SQL} WHERE id > '{CURSOR}' AND event_type = 'click' ORDER BY id LIMIT 100")
def stream_after_eq_limit(spark, d):
    return RecordQuery().after(CURSOR).where_equal("event_type", "view").where_equal("event_type", "click").limit(100).apply(events(spark, d)).select("id", "event_id")


# C: conditions on columns.
def _events_where(build: Callable[[QueryBuilder], QueryBuilder]) -> Query:
    return lambda spark, d: build(plain(spark, d, "events", "event_id")).matching().select("event_id", "event_type", "value")


def _filter(name: str, sql: str, build: Callable[[QueryBuilder], QueryBuilder]) -> None:
    f = _events_where(build)
    f.__name__ = name
    query(f"SELECT event_id, event_type, value FROM events WHERE {sql}")(f)


_filter("filter_eq", "event_type = 'purchase'", lambda q: q.where("event_type").eq("purchase"))
_filter("filter_neq", "event_type IS DISTINCT FROM 'purchase'", lambda q: q.where("event_type").neq("purchase"))
_filter("filter_in", "event_type IN ('click', 'error')", lambda q: q.where("event_type").in_(["click", "error"]))
_filter("filter_in_nothing", "false", lambda q: q.where("event_type").in_([]))
_filter("filter_not_in", "event_type NOT IN ('click', 'error')", lambda q: q.where("event_type").not_in(["click", "error"]))
_filter("filter_gt", "value > 50", lambda q: q.where("value").gt(50))
_filter("filter_gte", "user_id >= 100", lambda q: q.where("user_id").gte(100))
_filter("filter_lt", "value < 10.5", lambda q: q.where("value").lt(10.5))
_filter("filter_lte", "user_id <= 20", lambda q: q.where("user_id").lte(20))
_filter("filter_between", "value BETWEEN 20 AND 30", lambda q: q.where("value").between(20, 30))
_filter("filter_and_chain", "event_type = 'view' AND value > 20 AND user_id < 90", lambda q: q.where("event_type").eq("view").where("value").gt(20).where("user_id").lt(90))
_filter("dnf_or_where", "event_type = 'error' OR value > 90", lambda q: q.where("event_type").eq("error").or_where(lambda b: b.where("value").gt(90)))
_filter("dnf_and_after_or", "(event_type = 'error' AND user_id < 50) OR (value > 90 AND user_id < 50)", lambda q: q.where("event_type").eq("error").or_where(lambda b: b.where("value").gt(90)).where("user_id").lt(50))
_filter("dnf_and_where_flatten", "event_type = 'view' AND value > 20 AND user_id < 90", lambda q: q.where("event_type").eq("view").and_where(lambda b: b.where("value").gt(20).or_where(lambda c: c.where("user_id").lt(90))))
_filter("dnf_empty_group_matches_all", "true", lambda q: q.or_where(lambda b: b.where("event_type").eq("view")))
_filter("typed_strict_types", "false", lambda q: q.where("event_type").eq(5))
_filter("typed_exists", "true", lambda q: q.where("value").exists())
_filter("typed_missing", "false", lambda q: q.where("value").missing())


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'cold')")
def filter_prefix(spark, d):
    return plain(spark, d, "part", "p_partkey").where("p_name").prefix("cold").matching().select("p_partkey", "p_name")


# Conditions on JSON records.
def _json(name: str, sql: str, build: Callable[[QueryBuilder], QueryBuilder]) -> None:
    f = lambda spark, d: build(json_query(spark, d)).matching().select("event_id")
    f.__name__ = name
    query(f"SELECT event_id FROM {J_SQL} WHERE {sql}")(f)


NUMBER_SQL = "t IN ('UBIGINT','BIGINT')"
_json("json_exists", "t IS NOT NULL", lambda q: q.where("f").exists())
_json("json_missing", "t IS NULL", lambda q: q.where("f").missing())
_json("json_eq_null", "t = 'NULL'", lambda q: q.where("f").eq(None))
_json("json_eq_int", f"{NUMBER_SQL} AND s = '7'", lambda q: q.where("f").eq(7))
_json("json_eq_float_is_no_int", "false", lambda q: q.where("f").eq(7.0))
_json("json_eq_true", "t = 'BOOLEAN'", lambda q: q.where("f").eq(True))
_json("json_eq_list", "t = 'ARRAY'", lambda q: q.where("f").eq([1, 2]))
_json("json_neq_string", "t IS NULL OR NOT (t = 'VARCHAR' AND s = 'view')", lambda q: q.where("f").neq("view"))
_json("json_in_with_null", "t = 'NULL' OR (t = 'VARCHAR' AND s = 'click')", lambda q: q.where("f").in_([None, "click"]))
_json("json_not_in", "t IS NULL OR NOT (t = 'NULL' OR (t = 'VARCHAR' AND s = 'click'))", lambda q: q.where("f").not_in([None, "click"]))
_json("json_gt_mixed", f"t IS NOT NULL AND ({RANK_SQL} > 1 OR ({NUMBER_SQL} AND s::BIGINT > 50))", lambda q: q.where("f").gt(50))
_json("json_lte_string", "t = 'VARCHAR' AND s <= 'error'", lambda q: q.where("f").lte("error"))
_json("json_between", f"{NUMBER_SQL} AND s::BIGINT BETWEEN 10 AND 40", lambda q: q.where("f").between(10, 40))
_json("json_prefix", "t = 'VARCHAR' AND starts_with(s, 'v')", lambda q: q.where("f").prefix("v"))
_json("json_id_condition", f"id > '{CURSOR}' AND t IS NULL", lambda q: q.where("id").gt(CURSOR).where("f").missing())


# F: order, limits, pages.
@query(f"SELECT event_id, row_number() OVER (ORDER BY k, n, s, id) AS rn FROM (SELECT *, {RANK_SQL} AS k, CASE WHEN {NUMBER_SQL} THEN s::DOUBLE END AS n, CASE WHEN t = 'VARCHAR' THEN s END AS s2 FROM {J_SQL})".replace("k, n, s, id", "k, n, s2, id"))
def json_order_mixed(spark, d):
    return json_query(spark, d).order_by("f").numbered().select("event_id", "rn")


@query(f"SELECT event_id, row_number() OVER (ORDER BY k DESC, n DESC, s2 DESC, id) AS rn FROM (SELECT *, {RANK_SQL} AS k, CASE WHEN {NUMBER_SQL} THEN s::DOUBLE END AS n, CASE WHEN t = 'VARCHAR' THEN s END AS s2 FROM {J_SQL})")
def json_order_mixed_desc(spark, d):
    return json_query(spark, d).order_by("f", "DESC").numbered().select("event_id", "rn")


def _top(direction: str) -> Query:
    def f(spark, d):
        return typed(events(spark, d)).where("event_type").eq("purchase").order_by("user_id", direction).limit(50).numbered().select("event_id", "user_id", "rn")

    f.__name__ = "order_asc_limit" if direction == "asc" else "order_desc_limit_stable_ties"
    return f


for _direction in ("asc", "desc"):
    query(f"SELECT event_id, user_id, row_number() OVER (ORDER BY user_id {_direction}, id) AS rn FROM {EVENTS_SQL} WHERE event_type = 'purchase' ORDER BY rn LIMIT 50")(_top(_direction))


@query(f"SELECT id, event_id FROM {EVENTS_SQL} WHERE id > '{CURSOR}' ORDER BY id LIMIT 100")
def cursor_page(spark, d):
    return typed(events(spark, d)).cursor(CURSOR).page(100).get().select("id", "event_id")


@query(f"SELECT id, event_id FROM {EVENTS_SQL} WHERE id > '{CURSOR}' ORDER BY value DESC, id LIMIT 20")
def cursor_ordered(spark, d):
    return typed(events(spark, d)).cursor(CURSOR).order_by("value", "desc").limit(20).get().select("id", "event_id")


@query(f"SELECT id, event_id FROM {EVENTS_SQL} WHERE event_type = 'error' ORDER BY id LIMIT 1")
def first_match(spark, d):
    q = typed(events(spark, d)).where("event_type").eq("error").limit(7)
    return q.limit(1).get().select("id", "event_id")


# G: counts.
@query("SELECT count(*) AS n FROM events WHERE event_type = 'click' AND value > 10")
def count_filtered(spark, d):
    return one_row(spark, n=typed(events(spark, d)).where("event_type").eq("click").where("value").gt(10).count())


@query("SELECT least(count(*), 25) AS n FROM events WHERE event_type = 'click'")
def count_limited(spark, d):
    return one_row(spark, n=typed(events(spark, d)).where("event_type").eq("click").order_by("value").limit(25).count())


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_by_value(spark, d):
    return plain(spark, d, "events", "event_id").counts_by("event_type")


@query("SELECT count(*) AS records, count(*) FILTER (event_id % 6 = 4) AS corrupt FROM events")
def stats_collection(spark, d):
    store = DocumentStore(spark, scratch(spark, "documents"))
    store.put_frame(json_events(spark, d).select("id", F.when(F.expr("event_id % 6 = 4"), '{"f":').otherwise(F.col("data")).alias("data")))
    found = store.stats()
    return one_row(spark, records=found["records"], corrupt=found["corrupt"])


@query("SELECT CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'null' WHEN 2 THEN CAST(user_id AS VARCHAR) WHEN 3 THEN event_type ELSE 'true' END AS f, count(*) AS n FROM events WHERE event_id % 6 <> 5 GROUP BY 1")
def count_by_json_value(spark, d):
    return json_query(spark, d).counts_by("f")


# L: functions of ids.
@query(f"SELECT event_id, epoch_us(ts)//1000 AS ms FROM {EVENTS_SQL}")
def uuid_timestamp_ms(spark, d):
    return events(spark, d).select("event_id", ids.ms_column(F.col("id")).alias("ms"))


ODD_ID = "CASE event_id % 4 WHEN 0 THEN id WHEN 1 THEN upper(id) WHEN 2 THEN id || chr(10) ELSE replace(id, '-7', '-4') END"


@query(f"SELECT event_id, regexp_full_match(lower({ODD_ID}), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-7[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}') AS valid FROM {EVENTS_SQL}")
def uuid_validate(spark, d):
    return events(spark, d).select("event_id", ids.valid_column(F.expr(ODD_ID)).alias("valid"))


@query(f"SELECT substr(id, 25, 2) AS shard, count(*) AS n FROM {EVENTS_SQL} GROUP BY 1")
def shard_histogram(spark, d):
    return events(spark, d).groupBy(ids.shard_column(F.col("id")).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def partition_daily(spark, d):
    return events(spark, d).groupBy(ids.day_column(F.col("id")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1")
def partition_monthly(spark, d):
    return events(spark, d).groupBy(ids.month_column(F.col("id")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


# B: the log. An event puts its user's record, an error deletes it.
LOG_SQL = "(SELECT user_id AS id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, event_type, value FROM events)"
LAST_SQL = f"(SELECT * FROM {LOG_SQL} QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"


def log_rows(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), op.alias("op"), "event_type", "value")


START_MS = 1700000000000


def made(number: Column) -> Column:
    """A record's id from a number, and back."""
    return ids.made_column(F.lit(START_MS), number)


def number_of(id_: Column) -> Column:
    return F.conv(F.substring(id_, 25, 12), 16, 10).cast("long")


def logged(spark: SparkSession, d: str, **options: int) -> EventLog:
    """An event log in the shared folder, written in two commits."""
    log = EventLog(spark, scratch(spark, "log"))
    log.log = OpLog(spark, log.log.root, **options)
    rows = log_rows(spark, d).select(made(F.col("id")).alias("id"), "op", "seq", F.to_json(F.struct("seq", "op", "event_type", "value")).alias("data"))
    middle = rows.agg(F.expr("(min(seq) + max(seq)) div 2")).first()[0]
    for part in (rows.where(F.col("seq") <= middle), rows.where(F.col("seq") > middle)):
        log.log.append(part, ("seq",))
    return log


def unlogged(frame: DataFrame, *names: str) -> DataFrame:
    kinds = {"seq": "bigint", "event_type": "string", "value": "double", "op": "string"}
    value = F.parse_json("data")
    return frame.select(number_of(F.col("id")).alias("id"), *[F.variant_get(value, f"$.{n}", kinds[n]).alias(n) for n in names])


def one_row(spark: SparkSession, **values: int) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} long" for n in values))


@query(f"SELECT id, seq, event_type, value FROM {LAST_SQL} WHERE op = 'put'")
def log_live_view(spark, d):
    return unlogged(logged(spark, d).stream(), "seq", "event_type", "value")


@query(f"SELECT id, seq FROM {LAST_SQL} WHERE op = 'put' AND event_type = 'view'")
def log_live_filtered_after_overwrite(spark, d):
    return unlogged(logged(spark, d).stream(RecordQuery().where_equal("event_type", "view")), "seq")


@query(f"SELECT id, seq FROM {LAST_SQL} WHERE op = 'put' AND id > 100")
def log_live_filtered_by_id_first(spark, d):
    after = spark.range(1).select(made(F.lit(100))).first()[0]
    return unlogged(logged(spark, d).stream(RecordQuery().after(after)), "seq")


@query(f"SELECT id, seq, event_type FROM {LAST_SQL} WHERE op = 'put' AND event_type <> 'click'")
def log_query_builder(spark, d):
    return unlogged(logged(spark, d).query().where("event_type").neq("click").get(), "seq", "event_type")


@query(f"SELECT id, seq FROM {LAST_SQL} WHERE id IN (7, 42) AND op = 'put'")
def log_point_read(spark, d):
    log = logged(spark, d)
    found = [log.get(r[0]) for r in spark.range(1).select(F.explode(F.array(made(F.lit(7)), made(F.lit(42))))).collect()]
    return unlogged(spark.createDataFrame([tuple(r) for r in found if r], "id string, data string"), "seq")


@query(f"SELECT count(*) AS deleted FROM {LAST_SQL} WHERE op = 'delete'")
def log_deleted_count(spark, d):
    return logged(spark, d).deleted().agg(F.count(F.lit(1)).alias("deleted"))


@query(f"SELECT count(*) FILTER (op = 'put') AS records, count(*) FILTER (op = 'delete') AS deleted, count(*) FILTER (op = 'put') AS counted FROM {LAST_SQL}")
def log_stats(spark, d):
    log = logged(spark, d)
    found = log.stats()
    return one_row(spark, records=found["records"], deleted=found["deleted"], counted=log.query().count())


@query(f"SELECT id, seq, row_number() OVER (ORDER BY seq) AS rn FROM {LAST_SQL} WHERE op = 'put'")
def log_compacted_order(spark, d):
    log = logged(spark, d)
    log.compact()
    return unlogged(log.query().numbered(), "seq").join(log.query().numbered().select(number_of(F.col("id")).alias("id"), "rn"), "id")


@query(f"SELECT CAST(count(*) AS BIGINT) AS kept, CAST(count(*) AS BIGINT) AS in_files, 0::BIGINT AS deleted FROM {LAST_SQL} WHERE op = 'put'")
def log_compaction(spark, d):
    log = logged(spark, d)
    kept = log.compact()["records"]
    return one_row(spark, kept=kept, in_files=log.log.read().count(), deleted=log.stats()["deleted"])


@query(f"SELECT event_id FROM {EVENTS_SQL} WHERE epoch_us(ts)//1000 > 1704500000000")
def log_retention(spark, d):
    log = EventLog(spark, scratch(spark, "log"))
    log.put_frame(events(spark, d).select("id", F.to_json(F.struct("event_id")).alias("data")), ("id",))
    log.retain().older_than_ms(0, now_ms=1704500000000).compact()
    return log.stream().select(F.variant_get(F.parse_json("data"), "$.event_id", "bigint").alias("event_id"))


@query(f"SELECT id, op, seq, op = 'delete' AS deleted FROM {LAST_SQL}")
def log_state_index(spark, d):
    log = logged(spark, d)
    found = log.state().join(log.log.read().select("commit", "row", "data"), ["commit", "row"])
    return found.select(number_of(F.col("id")).alias("id"), "op", F.variant_get(F.parse_json("data"), "$.seq", "bigint").alias("seq"), "deleted")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events")
def log_version_numbers(spark, d):
    found = logged(spark, d).log.history()
    return found.select(number_of(F.col("id")).alias("user_id"), F.variant_get(F.parse_json("data"), "$.seq", "bigint").alias("event_id"), "version")


@query("SELECT count(*) AS n, CAST(1000 AS BIGINT) AS most, min(user_id) AS least, max(user_id) AS greatest FROM events")
def segment_zone_map(spark, d):
    """Files of 1,000 rows at most, and what their zones say of ids."""
    found = logged(spark, d, rows_per_file=1000).log.zones()
    return found.agg(F.sum("n").alias("n"), F.max(F.when(F.col("n") > 1000, F.col("n")).otherwise(1000)).alias("most"), number_of(F.min("least")).alias("least"), number_of(F.max("greatest")).alias("greatest"))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS large FROM events")
def segment_roll_by_bytes(spark, d):
    """Segments of about 16 KiB: none holds twice that."""
    log = logged(spark, d, bytes_per_file=16_384).log
    sizes = log.read().groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("id") + F.octet_length("data")).alias("bytes"))
    return sizes.agg(F.sum("n").alias("n"), F.count(F.when(F.col("bytes") > 32_768, 1)).alias("large"))


@query("SELECT true AS ok, CAST(0 AS BIGINT) AS errors, CAST(count(*) AS BIGINT) AS torn FROM events WHERE event_id >= 0.75 * (SELECT max(event_id) FROM events)")
def log_verify_and_recover(spark, d):
    """Framed files whose tail is torn: the lines before are recovered, and the log agrees with its replay."""
    from tarn.functions.frames import framed_column

    rows = log_rows(spark, d).select("seq", F.to_json(F.struct(F.lit("put").alias("op"), made(F.col("seq")).alias("id"), F.struct("seq").alias("data"))).alias("body"))
    last = rows.agg(F.max("seq")).first()[0]
    line = F.when(F.col("seq") >= 0.75 * last, F.expr("substr(line, 1, length(line) - 3)")).otherwise(F.col("line"))
    path = scratch(spark, "framed")
    rows.withColumn("line", framed_column(F.col("body"))).select(line.alias("value"), "seq").repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.text(path)
    log = EventLog(spark, scratch(spark, "log"))
    kept, checked = log.recover_framed(path), log.verify()
    return spark.createDataFrame([(checked["ok"], len(checked["errors"]), rows.count() - kept)], "ok boolean, errors long, torn long")


# Documents through the store.
DOC_SQL = """(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 11 <> 0)"""


def order_records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))


def as_documents(frame: DataFrame) -> DataFrame:
    return frame.select(made(F.col("k")).alias("id"), F.to_json(F.struct("s", "p")).alias("data"))


ORDER_SCHEMA = Schema("orders").string("s", index=True).float("p", range=True).required(["s"])


def stored(spark: SparkSession, d: str) -> DocumentStore:
    """Orders as documents: all put, every fifth put again, every eleventh deleted."""
    store, orders = DocumentStore(spark, scratch(spark, "documents"), ORDER_SCHEMA, "orders"), order_records(spark, d)
    store.put_frame(as_documents(orders))
    store.put_frame(as_documents(orders.where("k % 5 = 0").withColumn("s", F.lit("X"))))
    store.delete_frame(as_documents(orders.where("k % 11 = 0")))
    return store


def as_orders(frame: DataFrame) -> DataFrame:
    value = F.parse_json("data")
    return frame.select(number_of(F.col("id")).alias("k"), F.variant_get(value, "$.s", "string").alias("s"), F.variant_get(value, "$.p", "double").alias("p"))


@query(f"SELECT k, s, p FROM {DOC_SQL}")
def doc_upsert_and_delete(spark, d):
    return as_orders(stored(spark, d).stream())


@query(f"SELECT k, s, p FROM {DOC_SQL} WHERE s = 'X' AND p > 100000")
def doc_query_builder(spark, d):
    return as_orders(stored(spark, d).query().where("s").eq("X").where("p").gt(100000).get())


@query(f"SELECT k, s, p FROM {DOC_SQL} WHERE k IN (5, 22, 77, 100)")
def doc_point_read(spark, d):
    store = stored(spark, d)
    found = [store.get(r[0]) for r in spark.createDataFrame([(5,), (22,), (77,), (100,)], "k long").select(made(F.col("k"))).collect()]
    return as_orders(spark.createDataFrame([tuple(r) for r in found if r], "id string, data string"))


@query(f"SELECT k, s, p FROM {DOC_SQL}")
def doc_compact_and_reindex(spark, d):
    store = stored(spark, d)
    store.compact()
    store.reindex()
    return as_orders(store.log.read().where("op = 'put'"))


@query(f"SELECT count(*) AS records, 0::BIGINT AS corrupt, count(*) AS counted, count(*) FILTER (s = 'X') AS x, true AS ok FROM {DOC_SQL}")
def doc_stats_and_verify(spark, d):
    store = stored(spark, d)
    checked, q = store.verify(), store.query()
    found = [(checked["stats"]["records"], checked["stats"]["corrupt"], q.count(), q.where("s").eq("X").count(), checked["ok"])]
    return spark.createDataFrame(found, "records long, corrupt long, counted long, x long, ok boolean")


@query(f"SELECT s, count(*) AS n FROM {DOC_SQL} GROUP BY s")
def doc_counts_by(spark, d):
    return stored(spark, d).query().counts_by("s")


@query(f"SELECT k, s, p FROM {DOC_SQL}")
def schema_typed_projection(spark, d):
    return ORDER_SCHEMA.typed(stored(spark, d).frame()).select(number_of(F.col("id")).alias("k"), "s", "p")


@query("SELECT count(*) FILTER (o_orderkey % 8 <> 0) AS records, count(*) FILTER (o_orderkey % 8 = 0) AS quarantined, count(*) FILTER (o_orderkey % 8 = 0) AS told, true AS ok FROM orders")
def doc_corrupt_and_repair(spark, d):
    """Every eighth record is cut: a read that goes on tells of them, a repair moves them."""
    store = DocumentStore(spark, scratch(spark, "documents"))
    store.put_frame(as_documents(order_records(spark, d)).withColumn("data", F.expr("CASE WHEN conv(substr(id, 25), 16, 10) % 8 = 0 THEN substr(data, 1, 9) ELSE data END")))
    told = []
    store.stream(RecordQuery().continue_on_error(lambda id_, error: told.append(id_))).count()
    moved = store.repair()["quarantined"]
    checked = store.verify()
    return spark.createDataFrame([(checked["stats"]["records"], moved, len(told), checked["ok"])], "records long, quarantined long, told long, ok boolean")


@query("SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders")
def doc_export_and_import(spark, d):
    """JSON lines written by one store and read by another: ids stay."""
    one, two = (DocumentStore(spark, scratch(spark, "documents")) for _ in range(2))
    one.put_frame(as_documents(order_records(spark, d)))
    path = scratch(spark, "lines")
    one.export_json_lines(path)
    two.import_json_lines(path)
    return as_orders(two.stream())


@query("SELECT count(*) AS n, 2 * count(*) AS records, 2 * count(*) AS valid FROM nation")
def doc_import_makes_ids(spark, d):
    """Records without ids, imported twice: every one gets an id of its own."""
    path = scratch(spark, "lines")
    table(spark, d, "nation").select(F.to_json(F.struct("n_name")).alias("value")).write.text(path)
    store = DocumentStore(spark, scratch(spark, "documents"))
    n = store.import_json_lines(path)
    store.import_json_lines(path)
    return store.frame().agg(F.lit(n).cast("long").alias("n"), F.countDistinct("id").alias("records"), F.count(F.when(ids.valid_column(F.col("id")), 1)).alias("valid"))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey % 4 <> 0")
def record_files_decode(spark, d):
    """One file for a record, with a comment and a trailing comma; every fourth is cut."""
    from tarn.sources.records import read_record_files
    from tarn.sources.store import Files

    rows = table(spark, d, "nation").select("n_nationkey", "n_name", made(F.col("n_nationkey").cast("long")).alias("id")).collect()  # 25 rows at any size
    files = Files(spark, scratch(spark, "records"))
    for r in rows:
        text = f'{{ // a nation\n"id": "{r.id}", "data": {{"k": {r.n_nationkey}, "name": "{r.n_name}",}},}}'
        files.create(f"{r.id}.json", text[:-9] if r.n_nationkey % 4 == 0 else text)
    good, _ = read_record_files(spark, files.root)
    value = F.parse_json("data")
    return good.select(F.variant_get(value, "$.k", "int").alias("k"), F.variant_get(value, "$.name", "string").alias("name"))


@query("SELECT 4::BIGINT AS commits, 3::BIGINT AS folders, count(*) AS records FROM nation")
def store_sweep(spark, d):
    """Four versions, of which the last stays when it is swept."""
    store = DocumentStore(spark, scratch(spark, "documents"))
    for _ in range(3):
        store.put_frame(table(spark, d, "nation").select(made(F.col("n_nationkey").cast("long")).alias("id"), F.to_json(F.struct("n_name")).alias("data")))
    store.compact()
    commits = store.log.versions.latest()[0]
    swept = store.log.sweep(keep=1, seconds=-60)
    return one_row(spark, commits=commits, folders=swept["folders"], records=store.query().count())


@query("SELECT count(*) AS n, count(*) AS distinct_ids, count(*) AS valid FROM nation")
def uuid_generate(spark, d):
    make = ids.Uuid7()
    rows = [(make(),) for _ in range(table(spark, d, "nation").count())]
    frame = spark.createDataFrame(rows, "id string")
    return frame.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("distinct_ids"), F.count(F.when(ids.valid_column(F.col("id")), 1)).alias("valid"))


# H: the queue. A user is a job.
QUEUE_SQL = """WITH RECURSIVE q AS (SELECT user_id, event_id, event_type, epoch_us(ts)//1000000 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, 'none' AS st, -1::BIGINT AS pos, -1::BIGINT AS since FROM q UNION ALL
  SELECT q.user_id, q.rn,
    CASE WHEN event_type='signup' THEN 'pending' WHEN event_type='click' AND st='pending' THEN 'processing' WHEN event_type='purchase' THEN 'done'
         WHEN event_type='error' AND st='processing' THEN 'pending' WHEN event_type='view' AND st='done' THEN 'none' ELSE st END,
    CASE WHEN event_type='signup' OR (event_type='error' AND st='processing') THEN event_id ELSE pos END,
    CASE WHEN event_type='purchase' OR (event_type='click' AND st='pending') THEN sec ELSE since END
  FROM f JOIN q ON q.user_id=f.user_id AND q.rn=f.rn+1),
s AS (SELECT user_id AS id, st AS state, CASE WHEN st='pending' THEN pos END AS pos, CASE WHEN st IN ('processing','done') THEN since END AS ts
  FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC)=1) """
NOW = 1706000000


def jobs(spark: SparkSession, d: str) -> DataFrame:
    names = {"signup": "enqueue", "click": "claim", "purchase": "complete", "error": "requeue", "view": "purge"}
    op = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    seconds = F.expr(MS.replace("div 1000", "div 1000000"))
    return fold(table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), op.alias("op"), F.lit(True).alias("done"), seconds.alias("ts"), F.col("props").alias("payload")))


@query(QUEUE_SQL + "SELECT state, count(*) AS n FROM s WHERE state <> 'none' GROUP BY state")
def queue_fold_counts(spark, d):
    return jobs(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(QUEUE_SQL + "SELECT id, state, pos, ts FROM s WHERE state <> 'none'")
def queue_fold_states(spark, d):
    return jobs(spark, d).select("id", "state", "pos", "ts")


@query(QUEUE_SQL + "SELECT id, pos, row_number() OVER (ORDER BY pos) AS rn FROM s WHERE state = 'pending'")
def queue_pending_order(spark, d):
    return placed(jobs(spark, d).where("state = 'pending'").select("id", "pos"), [F.col("pos")])


JOB_SQL = f"('{START_MS // 65536:08x}-{START_MS % 65536:04x}-7000-8000-' || printf('%012x', id))"


def queued(spark: SparkSession, d: str) -> JobQueue:
    """A queue in the shared folder whose log holds the events of all users' jobs."""
    names = {"signup": "enqueue", "click": "claim", "purchase": "complete", "error": "requeue", "view": "purge"}
    op = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    rows = table(spark, d, "events").select(made(F.col("user_id")).alias("id"), "event_id", op.alias("op"), F.lit(True).alias("done"), F.expr(MS.replace("div 1000", "div 1000000")).alias("ts"), F.to_json(F.struct("event_id")).alias("data"))
    queue = JobQueue(spark, scratch(spark, "queue"))
    queue.log.append(rows, ("event_id",))
    return queue


def states(queue: JobQueue) -> DataFrame:
    return queue.jobs().select(number_of(F.col("id")).alias("id"), "state", "ts")


#: Behind all events, so that what is claimed or done has aged; the middle of those states' times.
LATER, AGE = 1706700000, 50_000


@query(QUEUE_SQL + "SELECT id, row_number() OVER (ORDER BY pos) AS place FROM s WHERE state = 'pending' ORDER BY pos LIMIT 10")
def queue_claim_many(spark, d):
    claimed = queued(spark, d).claim_many(10, now=LATER)
    frame = spark.createDataFrame([(r.id, i + 1) for i, r in enumerate(claimed)], "id string, place long")
    return frame.select(number_of(F.col("id")).alias("id"), "place")


@query(QUEUE_SQL + f"SELECT id, CASE WHEN n <= 10 THEN 'processing' ELSE state END AS state, CASE WHEN n <= 10 THEN {LATER} ELSE ts END AS ts FROM (SELECT *, CASE WHEN state = 'pending' THEN row_number() OVER (PARTITION BY state ORDER BY pos) END AS n FROM s) WHERE state <> 'none'")
def queue_states_after_claims(spark, d):
    """Two claimers after one another: five jobs each, none twice."""
    one = queued(spark, d)
    two = JobQueue(spark, one.log.root)
    one.claim_many(5, now=LATER)
    two.claim_many(5, now=LATER)
    return states(one)


@query(QUEUE_SQL + f"SELECT id, CASE WHEN late THEN 'pending' ELSE state END AS state, CASE WHEN late THEN NULL ELSE ts END AS ts FROM (SELECT *, coalesce(state = 'processing' AND {LATER} - ts >= {AGE}, false) AS late FROM s) WHERE state <> 'none'")
def queue_requeue_timed_out(spark, d):
    queue = queued(spark, d)
    queue.requeue_timed_out(AGE, now=LATER)
    return states(queue)


@query(QUEUE_SQL + f"SELECT id, state, ts FROM s WHERE state <> 'none' AND NOT (state = 'done' AND {LATER} - ts >= {AGE})")
def queue_purge_done(spark, d):
    queue = queued(spark, d)
    queue.purge_done(AGE, now=LATER)
    return states(queue)


@query(QUEUE_SQL + f"SELECT id, CASE WHEN state = 'processing' AND id % 3 = 0 THEN 'done' ELSE state END AS state, CASE WHEN state = 'processing' AND id % 3 = 0 THEN {LATER} ELSE ts END AS ts FROM s WHERE state <> 'none'")
def queue_complete_many(spark, d):
    queue = queued(spark, d)
    wanted = table(spark, d, "events").where("user_id % 3 = 0").select(made(F.col("user_id"))).distinct()
    queue.complete_many([r[0] for r in wanted.collect()], now=LATER)  # the caller's list
    return states(queue)


@query(QUEUE_SQL + "SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'processing') AS processing, count(*) FILTER (state = 'done') AS done, true AS ok FROM s")
def queue_counts_and_verify(spark, d):
    queue = queued(spark, d)
    found, checked = queue.counts(), queue.verify()
    return spark.createDataFrame([(found["pending"], found["processing"], found["done"], checked["ok"])], "pending long, processing long, done long, ok boolean")


@query(QUEUE_SQL + "SELECT id, state, ts FROM s WHERE state <> 'none'")
def queue_compact(spark, d):
    queue = queued(spark, d)
    queue.compact()
    return states(queue)


@query("SELECT n_nationkey AS k, n_name AS name, 'pending' AS state FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey, n_name, 'processing' FROM nation WHERE n_nationkey % 5 = 0 AND n_nationkey >= 10")
def queue_enqueue_claim_complete(spark, d):
    """Jobs enqueued, every fifth first; those claimed, and two of them completed and forgotten."""
    queue = JobQueue(spark, scratch(spark, "queue"))
    rows = table(spark, d, "nation").orderBy(F.expr("n_nationkey % 5 <> 0"), "n_nationkey").collect()  # 25 rows at any size
    queue.enqueue_many([{"payload": {"k": r.n_nationkey, "name": r.n_name}} for r in rows], now=1)
    claimed = queue.claim_many(4, now=2) + [queue.claim(now=3)]
    queue.complete_many([c.id for c in claimed[:2]], keep_done=False, now=4)
    value = F.parse_json("payload")
    return queue.jobs().select(F.variant_get(value, "$.k", "int").alias("k"), F.variant_get(value, "$.name", "string").alias("name"), "state")


@query(QUEUE_SQL + "SELECT id, state, ts FROM s WHERE state <> 'none'")
def queue_framed_codec(spark, d):
    """The events as framed lines, read back by blocks and replayed."""
    from tarn.functions.frames import framed_column

    body = F.to_json(F.struct("op", "id", F.struct("commit").alias("payload"), "done", "ts"))
    path = scratch(spark, "framed")
    queued(spark, d).log.read().repartitionByRange("commit", "row").sortWithinPartitions("commit", "row").select(framed_column(body).alias("value")).write.text(path)
    queue = JobQueue(spark, scratch(spark, "queue"))
    queue.recover_framed(path)
    return states(queue)


# Streams: each reads what is there and ends.
def _streamed(frame: DataFrame, mode: str, last: str | None = None) -> DataFrame:
    """What a stream tells until its input is read: all rows, or the last batch's row of each key."""
    spark, out = frame.sparkSession, scratch(frame.sparkSession, "streamed")
    write = lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)
    frame.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    if last is None:
        return rows.drop("batch")
    rest = [c for c in frame.columns if c != last]
    return rows.groupBy(last).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(last, *[f"x.{c}" for c in rest])


@query("SELECT user_id AS id, event_id AS seq FROM events WHERE user_id > 100")
def stream_tail_after(spark, d):
    log = logged(spark, d).log
    after = spark.range(1).select(made(F.lit(100))).first()[0]
    return unlogged(_streamed(tail(spark, log.root, log.schema, after).select("id", "data"), "append"), "seq")


@query(QUEUE_SQL + "SELECT id, state, ts FROM s WHERE state <> 'none'")
def stream_queue_states(spark, d):
    log = queued(spark, d).log
    rows = tail(spark, log.root, log.schema).select("id", "op", "done", "ts", F.variant_get(F.parse_json("data"), "$.event_id", "bigint").alias("seq"))
    found = _streamed(queue_states(rows), "update", "id")
    return found.where("state <> 'none'").select(number_of(F.col("id")).alias("id"), "state", "ts")


@query("SELECT epoch_us(date_trunc('day', ts)) AS start, count(*) AS n FROM events GROUP BY 1")
def stream_windowed_counts(spark, d):
    path = scratch(spark, "events")
    events(spark, d).select("id").write.parquet(path)
    found = _streamed(windowed_counts(tail(spark, path, "id string"), "1 day"), "update", "start")
    return found.select(F.unix_micros("start").alias("start"), "n")


@query(f"SELECT k, s, p FROM {DOC_SQL}")
def stream_mirror_push(spark, d):
    store = stored(spark, d)
    mirror = Mirror(spark, scratch(spark, "mirror"), "streamed_").collection(store, "orders", ORDER_SCHEMA)
    mirror.install()
    push_stream(tail(spark, store.log.root, store.log.schema), mirror, "orders", scratch(spark, "stream")).awaitTermination()
    return mirror.sql("SELECT id, s, p FROM streamed_orders").select(number_of(F.col("id")).alias("k"), "s", "p")


# Schemas.
SCHEMA = Schema("events").string("f").required(["f"])
UNIQUE = Schema("events").string("f", unique=True)


@query(f"SELECT event_id, CASE WHEN t IS NULL THEN 'f is required' ELSE 'f is not of type string' END AS error FROM {J_SQL} WHERE t IS NULL OR t NOT IN ('VARCHAR', 'NULL')")
def schema_violations(spark, d):
    return SCHEMA.invalid(json_events(spark, d)).select("event_id", F.explode("errors").alias("error"))


@query(f"SELECT CASE t WHEN 'NULL' THEN 'null' ELSE s END AS value, count(*) AS n FROM {J_SQL} WHERE t IN ('NULL', 'VARCHAR', 'UBIGINT', 'BIGINT', 'BOOLEAN') GROUP BY t, s HAVING count(*) > 1")
def unique_violations(spark, d):
    found = UNIQUE.duplicates(json_events(spark, d))
    return found.select(F.element_at(F.split("value", ":", 2), -1).alias("value"), "n")


# The mirror: two states of the orders, compared by the hash of their text.
MIRROR_SQL = """(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 11 <> 0) s
FULL OUTER JOIN (SELECT o_orderkey AS id, o_orderstatus AS v FROM orders WHERE o_orderkey % 13 <> 0) t ON s.id = t.id"""
ACTION_SQL = "CASE WHEN t.id IS NULL THEN 'insert' WHEN s.id IS NULL THEN 'delete' WHEN s.v = t.v THEN 'unchanged' ELSE 'update' END"


def mirrored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"))
    source = orders.where("id % 11 <> 0").withColumn("v", F.when(F.expr("id % 7 = 0"), "X").otherwise(F.col("v")))
    as_text = lambda f: row_hash(f.withColumn("data", F.to_json(F.struct("v"))))
    return as_text(source), as_text(orders.where("id % 13 <> 0"))


@query(f"SELECT {ACTION_SQL} AS action, count(*) AS n FROM {MIRROR_SQL} GROUP BY 1")
def mirror_push_diff(spark, d):
    return differences(*mirrored(spark, d)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) FILTER (a = 'insert') AS missing, count(*) FILTER (a = 'update') AS stale, count(*) FILTER (a = 'delete') AS orphaned, count(*) FILTER (a <> 'delete') AS records, count(*) FILTER (a <> 'insert') AS row_count FROM (SELECT {ACTION_SQL} AS a FROM {MIRROR_SQL})")
def mirror_verify_drift(spark, d):
    n = lambda c: F.count(F.when(F.expr(c), 1))
    found = differences(*mirrored(spark, d))
    return found.agg(n("action = 'insert'").alias("missing"), n("action = 'update'").alias("stale"), n("action = 'delete'").alias("orphaned"), n("action <> 'delete'").alias("records"), n("action <> 'insert'").alias("row_count"))


MIRROR_SCHEMA = Schema("m").string("v", index=True)


def mirror_state(spark: SparkSession, d: str) -> tuple[Mirror, DocumentStore]:
    """A mirror that holds the older state, and its collection brought to the newer one."""
    store = DocumentStore(spark, scratch(spark, "documents"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"))
    documents = lambda f: f.select(made(F.col("id")).alias("id"), F.to_json(F.struct("v")).alias("data"))
    store.put_frame(documents(orders.where("id % 13 <> 0")))
    mirror = Mirror(spark, scratch(spark, "mirror"), "held_").collection(store, "m", MIRROR_SCHEMA)
    mirror.push()
    store.put_frame(documents(orders.where("id % 11 <> 0 and (id % 7 = 0 or id % 13 = 0)").withColumn("v", F.when(F.expr("id % 7 = 0"), "X").otherwise(F.col("v")))))
    store.delete_frame(documents(orders.where("id % 11 = 0")))
    return mirror, store


def mirror_rows(mirror: Mirror) -> DataFrame:
    return mirror.sql("SELECT id, v FROM held_m").select(number_of(F.col("id")).alias("id"), "v")


@query(f"SELECT count(*) FILTER (a = 'insert') AS inserted, count(*) FILTER (a = 'update') AS updated, count(*) FILTER (a = 'delete') AS deleted, count(*) FILTER (a = 'unchanged') AS unchanged, count(*) FILTER (a <> 'delete') AS again, true AS ok FROM (SELECT {ACTION_SQL} AS a FROM {MIRROR_SQL})")
def mirror_push_counts(spark, d):
    mirror, _ = mirror_state(spark, d)
    found, again, ok = mirror.push(), mirror.push(), mirror.verify()["ok"]
    return spark.createDataFrame([(*found.values(), again["unchanged"], ok)], ", ".join(f"{n} long" for n in (*found, "again")) + ", ok boolean")


@query(f"SELECT s.id, s.v FROM {MIRROR_SQL} WHERE s.id IS NOT NULL")
def mirror_push_rows(spark, d):
    mirror, _ = mirror_state(spark, d)
    mirror.push()
    return mirror_rows(mirror)


FLUSHED_SQL = "SELECT l_orderkey FROM lineitem WHERE l_quantity > 49"


@query(f"SELECT coalesce(s.id, t.id) AS id, CASE WHEN coalesce(s.id, t.id) IN ({FLUSHED_SQL}) THEN s.v ELSE t.v END AS v FROM {MIRROR_SQL} WHERE CASE WHEN coalesce(s.id, t.id) IN ({FLUSHED_SQL}) THEN s.id ELSE t.id END IS NOT NULL")
def mirror_flush_ids(spark, d):
    """Only the given ids are brought up to date."""
    mirror, _ = mirror_state(spark, d)
    mirror.flush("m", table(spark, d, "lineitem").where("l_quantity > 49").select(made(F.col("l_orderkey")).alias("id")).distinct())
    return mirror_rows(mirror)


@query(f"SELECT count(*) FILTER (here) AS upserted, count(*) FILTER (NOT here) AS deleted FROM (SELECT DISTINCT l_orderkey, l_orderkey % 11 <> 0 AS here FROM lineitem WHERE l_quantity > 49)")
def mirror_flush_counts(spark, d):
    mirror, _ = mirror_state(spark, d)
    found = mirror.flush("m", table(spark, d, "lineitem").where("l_quantity > 49").select(made(F.col("l_orderkey")).alias("id")).distinct())
    return one_row(spark, **found)


@query(f"SELECT coalesce(t.id, s.id) AS id, CASE WHEN t.id IS NULL THEN s.v ELSE t.v END AS v FROM {MIRROR_SQL}")
def mirror_pull_merge(spark, d):
    """What the collection holds after the mirror's rows came back: nothing is deleted there."""
    mirror, store = mirror_state(spark, d)
    mirror.pull()
    return store.frame().select(number_of(F.col("id")).alias("id"), F.variant_get(F.parse_json("data"), "$.v", "string").alias("v"))


@query(f"SELECT count(*) FILTER (s.id IS NOT NULL) AS inserted, count(*) FILTER (s.id IS NOT NULL) AS table_rows, 0::BIGINT AS tables_after FROM {MIRROR_SQL}")
def mirror_rebuild_and_uninstall(spark, d):
    mirror, _ = mirror_state(spark, d)
    inserted, rows = mirror.rebuild()["inserted"], mirror_rows(mirror).count()
    mirror.uninstall()
    return one_row(spark, inserted=inserted, table_rows=rows, tables_after=int(spark.catalog.tableExists("held_m")))


@query("SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0")
def sql_row_source(spark, d):
    """A query's rows as records of a store."""
    table(spark, d, "orders").createOrReplaceTempView("tarn_source")
    store = DocumentStore(spark, scratch(spark, "documents"))
    rows = spark.sql("SELECT o_orderkey AS k, o_orderstatus AS s FROM tarn_source WHERE o_orderkey % 2 = 0")
    store.put_frame(rows.select(made(F.col("k")).alias("id"), F.to_json(F.struct("s")).alias("data")))
    return store.stream().select(number_of(F.col("id")).alias("k"), F.variant_get(F.parse_json("data"), "$.s", "string").alias("s"))


def _sql(name: str, text: str) -> None:
    """The same text in both engines, over views of the tables."""

    def f(spark, d):
        local = text
        for t in ("orders", "customer", "lineitem", "part", "nation", "region", "supplier"):
            if f"{{{t}}}" in text:
                view = f"tarn_{t}"
                table(spark, d, t).createOrReplaceTempView(view)
                local = local.replace(f"{{{t}}}", view)
        return spark.sql(local)

    f.__name__ = name
    query(text.replace("{", "").replace("}", ""))(f)


_sql("mirror_sql_join_group", "SELECT c.c_mktsegment AS segment, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment")
_sql("mirror_sql_indexed_count", "SELECT count(*) AS n FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
_sql("mirror_sql_substring_search", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%re%'")
_sql("mirror_sql_left_join", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
_sql("mirror_sql_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
_sql("mirror_sql_anti", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
_sql("mirror_sql_window", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM {orders}")
_sql("mirror_sql_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}")
_sql("mirror_sql_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier}")
_sql("mirror_sql_except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey AS k FROM {supplier} WHERE s_suppkey % 3 = 0")
_sql("mirror_sql_rollup", "SELECT r_name, n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
_sql("mirror_sql_having", "SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} WHERE l_quantity > 10 GROUP BY l_suppkey HAVING count(*) > 20")


# Import and export.
@query(f"SELECT id, event_id FROM {EVENTS_SQL}")
def jsonl_export_rows(spark, d):
    lines = json_lines(events(spark, d).select("id", F.to_json(F.struct("event_id", "value")).alias("data")))
    value = F.parse_json("value")
    return lines.select(F.variant_get(value, "$.id", "string").alias("id"), F.variant_get(value, "$.data.event_id", "bigint").alias("event_id"))


@query(f"SELECT CASE WHEN event_id % 2 = 0 THEN id END AS id, event_id, event_id % 2 = 1 AS bare FROM {EVENTS_SQL}")
def jsonl_import_roundtrip(spark, d):
    data = F.to_json(F.struct("event_id", F.lit(5).alias("id")))
    envelope = F.concat(F.lit('{"id":"'), "id", F.lit('","data":'), data, F.lit("}"))
    lines = events(spark, d).select(F.when(F.expr("event_id % 2 = 0"), envelope).otherwise(data).alias("value"))
    value = F.parse_json("data")
    return enveloped(lines).select("id", F.variant_get(value, "$.event_id", "bigint").alias("event_id"), F.col("id").isNull().alias("bare"))


@query("SELECT event_id, user_id AS f FROM events")
def jsonc_decode(spark, d):
    text = F.concat(F.lit('{ // a comment\n "f": '), F.col("user_id").cast("string"), F.lit(', /* "f": 0, */ "url": "http://x//y", }'))
    clean = table(spark, d, "events").select("event_id", canonical_column(text).alias("data"))
    return clean.select("event_id", F.variant_get(F.parse_json("data"), "$.f", "bigint").alias("f"))


@query("SELECT event_id, event_id % 3 <> 0 AS good FROM events")
def framed_log_decode(spark, d):
    from tarn.functions.frames import frame, unframed_column

    whole, broken = frame('{"op":"put","id":"x"}').rstrip("\n"), frame('{"op":"put","id":"x"}').rstrip("\n").replace("put", "pot")
    lines = table(spark, d, "events").select("event_id", F.when(F.expr("event_id % 3 = 0"), broken).otherwise(whole).alias("line"))
    return lines.select("event_id", unframed_column(F.col("line")).isNotNull().alias("good"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The dearest purchases: a filter that reaches the scan, and a top-k."""
    return typed(events(spark, d)).where("event_type").eq("purchase").where("value").gte(10).order_by("value", "desc").limit(50).get()
