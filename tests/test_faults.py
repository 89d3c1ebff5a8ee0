"""Writers that meet, corrupt and torn input, and what is left behind."""

import json

import pytest
from pyspark.sql import functions as F

from tarn.functions import frames, ids
from tarn.operators.query import RecordQuery
from tarn.operators.schema import Schema, SchemaError
from tarn.plans.cache import MemoryCache
from tarn.plans.collections import DocumentStore, EventLog
from tarn.plans.jobqueue import JobQueue
from tarn.plans.oplog import OpLog
from tarn.sources import records
from tarn.sources.store import Conflict, Versions


def made(i, ms=1_700_000_000_000):
    return ids.bounds(ms + i)[0][:-4] + f"{i:04x}"


def overtaken(log, other):
    """The log's next commit comes after the other writer's, which was made between its reading and its writing."""
    append, done = log.append, []

    def late(frame, order=(), after=None):
        if not done:
            done.append(other())
        return append(frame, order, after)

    log.append = late
    return done


def test_two_claimers_get_different_jobs(spark, tmp_path):
    a, b = JobQueue(spark, str(tmp_path / "q")), JobQueue(spark, str(tmp_path / "q"))
    a.enqueue_many([{"id": made(i), "payload": {"n": i}} for i in range(3)], now=1)
    taken = overtaken(a.log, lambda: [j.id for j in b.claim_many(2, now=2)])
    assert [j.id for j in a.claim_many(2, now=3)] == [made(2)] and taken == [[made(0), made(1)]]
    assert b.counts() == {"pending": 0, "processing": 3, "done": 0} and b.verify()["ok"]
    again = overtaken(a.log, lambda: b.complete_many([made(0)], now=4))
    assert a.complete_many([made(0), made(1)], now=4) == 1 and again == [1] and b.counts()["done"] == 2
    assert a.purge_done(now=5) == 2 and a.requeue_timed_out(1, now=9) == 1 and b.counts() == {"pending": 1, "processing": 0, "done": 0}


def test_two_writers_cannot_both_bring_a_unique_value(spark, tmp_path):
    schema = Schema("posts").string("slug", unique=True)
    a, b = (DocumentStore(spark, str(tmp_path / "d"), schema, "posts") for _ in range(2))
    overtaken(a.log, lambda: b.put({"slug": "x"}, made(1)))
    with pytest.raises(SchemaError):
        a.put({"slug": "x"}, made(2))
    assert [r.id for r in a.frame().collect()] == [made(1)]


def test_compaction_loses_no_commit(spark, tmp_path):
    a, b = EventLog(spark, str(tmp_path / "l")), EventLog(spark, str(tmp_path / "l"))
    a.put({"n": 1}, made(1))
    live, done = a.log.live, []

    def slow(condition=None):
        found = live(condition)
        if not done:
            done.append(b.put({"n": 2}, made(2)))
        return found

    a.log.live = slow
    assert a.compact()["records"] == 2 and [r.id for r in b.frame().orderBy("id").collect()] == [made(1), made(2)]


def test_a_version_is_made_once(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.files.create("x/a", "1") and not v.files.create("x/a", "2") and v.files.read("x/a") == "1"
    v.commit(0, {})
    with pytest.raises(Conflict):
        v.exclusively(lambda n: v.commit(n - 1, {}), tries=2)


def test_corrupt_records_stop_a_read(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "l"))
    log.put({"a": 1}, made(1))
    log.put_frame(spark.createDataFrame([(made(2), "{oops")], "id string, data string"))
    with pytest.raises(Exception, match=f"corrupt record {made(2)}"):
        log.stream().collect()
    with pytest.raises(Exception, match="corrupt record"):
        log.stream(RecordQuery().where_equal("a", 1)).count()
    assert log.stream(RecordQuery().time_range_ms(until=ids.timestamp_ms(made(1)))).count() == 1
    told = []
    assert log.stream(RecordQuery().continue_on_error(lambda i, e: told.append(i))).count() == 1 and told == [made(2)]


def test_opened_files_are_those_of_the_scan(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "l"))
    log.put({"a": 1}, made(1))
    log.put({"a": 1}, made(2))
    seen = []
    assert log.stream(RecordQuery().after(made(1)).on_segment_open(seen.append)).count() == 1
    assert len(seen) == 1 and seen[0].endswith(".parquet") and str(tmp_path) in seen[0]


def test_imports_of_one_millisecond_make_different_ids(spark, tmp_path, monkeypatch):
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"a": i}) + "\n" for i in range(50)))
    monkeypatch.setattr("time.time", lambda: 1_700_000_000.0)
    store = DocumentStore(spark, str(tmp_path / "d"))
    assert [store.import_json_lines(str(tmp_path / "in.jsonl")) for _ in range(3)] == [50] * 3
    got = [r.id for r in store.frame().collect()]
    assert len(set(got)) == 150 and all(map(ids.is_valid, got))
    frame = spark.range(0, 1000, 1, 7).select(F.lit(None).cast("string").alias("id"), "id")
    assert records.with_new_ids(frame.toDF("id", "n"), 5).select("id").distinct().count() == 1000


def test_unique_values_are_numbers_not_spellings(spark, tmp_path):
    schema = Schema("n").mixed("x", unique=True)
    rows = ["1.5", "1.5e0", "1", "1.0", "10e-1", "-0.0", "0.0", "true", '"1"', "null", "null", "[1]", "[1]"]
    frame = spark.createDataFrame([(made(i), f'{{"x":{v}}}') for i, v in enumerate(rows)], "id string, data string")
    assert sorted((r.value, r.n) for r in schema.duplicates(frame).collect()) == [("float:0.0", 2), ("float:1.0", 2), ("float:1.5", 2), ("null:null", 2)]


def test_torn_tails_are_cut(spark, tmp_path):
    line = lambda **e: frames.frame(json.dumps(e))
    good = [line(op="put", id=made(i), data={"n": i}) for i in range(4)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a").write_text("".join(good[:2]) + good[2][:-9])
    (tmp_path / "log" / "b").write_text(good[3] + line(op="put", id="no id", data={}) + good[2])
    log = EventLog(spark, str(tmp_path / "l"))
    assert log.recover_framed(str(tmp_path / "log")) == 3 and [r.id for r in log.stream().collect()] == [made(0), made(1), made(3)]
    events = [line(op="enqueue", id=made(1), payload={"n": 1}, ts=5), line(op="claim", id=made(1)), line(op="jump", id=made(1), ts=6), line(op="complete", id=made(1), done=True, ts=7)]
    (tmp_path / "queue").write_text("".join(events))
    queue = JobQueue(spark, str(tmp_path / "q"))
    assert queue.recover_framed(str(tmp_path / "queue"), now=100) == 2 and queue.jobs().first().ts == 100 and queue.counts()["processing"] == 1
    _, bad = records.read_framed_log(spark, str(tmp_path / "queue"), "payload", ("enqueue", "claim", "complete"))
    assert [r.error for r in bad.collect()] == ["unknown op"]
    assert queue.verify()["ok"] and queue.repair(1, now=200)["requeued"] == 1


def test_long_framed_files_are_read_in_blocks(spark, tmp_path):
    lines = [frames.frame(json.dumps({"op": "put", "id": made(i % 300), "data": {"n": i}})) for i in range(3000)]
    (tmp_path / "seg").write_text("".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        log = EventLog(spark, str(tmp_path / "l"))
        assert log.recover_framed(str(tmp_path / "seg")) == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [json.loads(r.data)["n"] for r in log.stream().collect()] == list(range(2700, 3000)) and log.verify()["ok"]


def test_files_hold_so_many_bytes(spark, tmp_path):
    log = OpLog(spark, str(tmp_path / "o"), bytes_per_file=400)
    log.append(spark.createDataFrame([("put", made(i), "x" * 64) for i in range(20)], "op string, id string, data string").coalesce(1))
    assert sorted(r.n for r in log.zones().collect()) == [4] * 5


def test_history_and_counts(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "l"))
    for n in (1, 1.0, None, "x", [1]):
        log.put({"n": n}, made(1))
    log.put({}, made(2))
    assert [(r.version, r.data) for r in log.log.history().where(F.col("id") == made(1)).orderBy("version").collect()][1] == (2, '{"n":1.0}')
    every = log.query()
    assert [tuple(r) for r in every.counts_by("n").collect()] == [(None, 1)] and every.candidate_count() == 2
    typed = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    from tarn.operators.query import QueryBuilder

    assert {tuple(r) for r in QueryBuilder(typed).counts_by("id").collect()} == {("a", 2), (None, 1)}


def test_sweeping_and_caches(spark, tmp_path):
    cache = MemoryCache()
    store = DocumentStore(spark, str(tmp_path / "d"), cache=cache)
    for n in range(4):
        store.put({"n": n}, made(1))
    assert json.loads(store.get(made(1)).data) == {"n": 3} == json.loads(store.get(made(1)).data) and store.get(made(2)) is None
    store.put({"n": 9}, made(1))
    assert json.loads(store.get(made(1)).data) == {"n": 9}
    store.compact()
    assert store.log.sweep(1) == {"manifests": 0, "parts": 0, "folders": 0}  # too young
    assert store.log.sweep(1, seconds=-5) == {"manifests": 5, "parts": 0, "folders": 5}
    assert store.frame().count() == 1 and store.put({"n": 10}, made(1)) and store.stats()["records"] == 1
