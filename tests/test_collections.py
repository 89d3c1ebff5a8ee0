"""Stores against models in Python: random operations, imports, repairs, retention, the command line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tarn.__main__ import run
from tarn.functions import frames, ids, jsonc
from tarn.operators.query import RecordQuery
from tarn.operators.schema import Schema, SchemaError
from tarn.plans.cache import FrameCache, MemoryCache, NullCache
from tarn.plans.collections import DocumentStore, EventLog
from tarn.sources import records
from tarn.plans.oplog import OpLog
from tarn.sources.store import StoreError, Versions, namespace, partition_folder


def made(i, ms=1_700_000_000_000):
    return ids.bounds(ms + i)[0][:-4] + f"{i:04x}"


def contents(frame):
    return [(r.id, json.loads(r.data)) for r in frame.collect()]


def test_documents_follow_a_model(spark, tmp_path):
    draw, model, store = random.Random(7331), {}, DocumentStore(spark, str(tmp_path / "d"))
    for _ in range(14):
        kind = draw.random()
        some = [made(draw.randrange(36)) for _ in range(draw.randrange(1, 5))]
        if kind < 0.65:
            rows = [{"id": i, "data": {"slot": draw.randrange(9), "f": draw.choice([1, 1.0, None, "x", [1]])}} for i in dict.fromkeys(some)]
            store.put_many(rows)
            model |= {r["id"]: r["data"] for r in rows}
        elif kind < 0.9:
            store.delete(some[0])
            model.pop(some[0], None)
        else:
            assert store.compact() == {"ok": True, "records": len(model)}
        assert contents(store.stream()) == sorted(model.items())
    some = next(iter(model))
    assert json.loads(store.get(some).data) == model[some] and store.get(made(99)) is None
    assert store.stats()["records"] == len(model) and store.verify()["ok"]
    assert '"f":1.0' in "".join(r.data for r in store.frame().collect()) or all(d["f"] != 1.0 for d in model.values())


def test_log_keeps_append_order(spark, tmp_path):
    draw, model, log = random.Random(9719), {}, EventLog(spark, str(tmp_path / "l"))
    for step in range(12):
        if draw.random() < 0.75:
            rows = [{"id": made(draw.randrange(20)), "data": {"n": step * 10 + k}} for k in range(4)]
            log.put_many(rows)
            for r in rows:
                model.pop(r["id"], None)
                model[r["id"]] = r["data"]
        else:
            log.delete(i := made(draw.randrange(22)))
            model.pop(i, None)
        if step == 8:
            log.compact()
        assert contents(log.stream()) == list(model.items())
    assert contents(log.query().where("n").gte(40).get()) == [x for x in model.items() if x[1]["n"] >= 40]
    low, high = sorted(model)[2], sorted(model)[-2]
    q = RecordQuery().time_range_ms(ids.timestamp_ms(low), ids.timestamp_ms(high)).limit(5)
    assert contents(log.stream(q)) == [x for x in model.items() if ids.timestamp_ms(low) <= ids.timestamp_ms(x[0]) <= ids.timestamp_ms(high)][:5]
    assert log.verify()["ok"] and log.stats()["records"] == len(model)
    seen = []
    log.stream(RecordQuery().after(low).on_segment_open(seen.append)).count()
    assert seen


def test_an_overwritten_version_does_not_come_back(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "l"))
    log.put({"kind": "old"}, made(1))
    log.put({"kind": "new"}, made(1))
    assert contents(log.stream(RecordQuery().where_equal("kind", "old"))) == [] == contents(log.query().where("kind").eq("old").get())


def test_retention(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "l"))
    log.put_many([{"id": made(i), "data": {"i": i}} for i in range(10)])
    with pytest.raises(ValueError):
        log.retain().compact()
    with pytest.raises(ValueError):
        log.retain().older_than_days(0)
    assert log.retain().older_than_ms(1000, now_ms=1_700_000_001_004).compact() == 5
    assert [d["i"] for _, d in contents(log.stream())] == [5, 6, 7, 8, 9] and log.stats()["deleted"] == 0


SCHEMA = Schema("posts").string("slug", unique=True).int("views", index=True).float("score", range=True).bool("on").required(["slug"])


def test_schema(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "d"), SCHEMA, "posts")
    store.put({"slug": "a", "views": 1, "score": 2, "on": True, "free": [1]}, made(1))
    for bad in ({"views": 1}, {"slug": 5}, {"slug": "b", "views": 1.0}, {"slug": "b", "views": True}, {"slug": "a"}, {"slug": "b", "score": "x"}):
        with pytest.raises(SchemaError):
            store.put(bad, made(2))
        if bad != {"slug": "a"}:
            with pytest.raises(SchemaError):
                SCHEMA.validate(bad)
    store.put({"slug": "a", "views": None}, made(1))  # its own value does not count
    store.put({"slug": None}, made(3))
    with pytest.raises(SchemaError):
        store.put({"slug": None}, made(4))
    assert store.stats() | {"bytes": 0} == {"records": 2, "bytes": 0, "corrupt": 0, "indexes": ["score", "slug", "views"]}
    with pytest.raises(SchemaError):
        DocumentStore(spark, str(tmp_path / "e"), SCHEMA, "pages")
    assert SCHEMA.int("slug").fields["slug"].unique and Schema("x").required(["n"]).fields["n"].type == "mixed"
    row = SCHEMA.typed(spark.createDataFrame([("1", '{"slug":5,"views":2,"score":3,"on":true}')], "id string, data string")).first()
    assert (row.slug, row.views, row.score, row.on) == (None, 2, 3.0, True)


def test_json_lines(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "d"))
    (tmp_path / "in.jsonl").write_text(f'{{"id":"{made(1)}","data":{{"a":1.0}}}}\n\n{{"a":2,"id":7}}\n{{"b":"é/\\n"}}\n')
    assert store.import_json_lines(str(tmp_path / "in.jsonl")) == 3
    got = contents(store.stream())
    assert got[0] == (made(1), {"a": 1.0}) and [d for _, d in got[1:]] == [{"a": 2, "id": 7}, {"b": "é/\n"}] and all(ids.is_valid(i) for i, _ in got)
    assert store.export_json_lines(str(tmp_path / "out")) == 3
    again = DocumentStore(spark, str(tmp_path / "e"))
    assert again.import_json_lines(str(tmp_path / "out")) == 3 and contents(again.stream()) == got
    (tmp_path / "bad.jsonl").write_text("[1]\n")
    with pytest.raises(SchemaError):
        store.import_json_lines(str(tmp_path / "bad.jsonl"))


def test_record_files(spark, tmp_path):
    (tmp_path / "r").mkdir()
    files = {made(1): f'{{"id":"{made(1)}","data":{{"a":1.0,}}, // note\n}}', made(2): f'{{"id":"{made(2)}"}}', made(3): f'{{"id":"{made(1)}","data":{{}}}}', made(4): "nothing", made(5): "[]"}
    for name, text in files.items():
        (tmp_path / "r" / f"{name}.json").write_text(text)
    good, bad = records.read_record_files(spark, str(tmp_path / "r"))
    assert sorted((r.id, r.data) for r in good.collect()) == [(made(1), '{"a":1.0}'), (made(2), "{}")]
    assert sorted(r.error for r in bad.collect()) == ["not an object", "not an object", "the id is not the file's name"]


def test_framed_log(spark, tmp_path):
    lines = [frames.frame(json.dumps({"op": "put", "id": made(i), "data": {"n": i}})) for i in range(5)]
    (tmp_path / "seg").write_text("".join(lines[:3]) + lines[3].replace('"n": 3', '"n": 4') + lines[4])
    good, bad = records.read_framed_log(spark, str(tmp_path / "seg"))
    assert good.count() == 4 and [(r.line.row, r.error) for r in bad.collect()] == [(3, "broken frame")]
    log = EventLog(spark, str(tmp_path / "l"))
    assert log.import_framed(records.before_first_bad(good, bad)) == 3
    assert [d["n"] for _, d in contents(log.stream())] == [0, 1, 2]
    event = frames.frame(json.dumps({"op": "complete", "id": made(1), "payload": {"a": 1.0}, "done": True, "ts": 7}))
    (tmp_path / "queue").write_text(event)
    row = records.read_framed_log(spark, str(tmp_path / "queue"), "payload")[0].first()
    assert (row.op, row.data, row.done, row.ts) == ("complete", '{"a":1.0}', True, 7)
    assert frames.unframe(lines[0]) and frames.unframe("5\tx\t{}") is None and frames.unframe("no frame") is None


def test_corrupt_records(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "d"))
    store.put({"a": 1}, made(1))
    store.put_frame(spark.createDataFrame([(made(2), "{oops")], "id string, data string"))
    assert not store.verify()["ok"] and store.stats()["corrupt"] == 1
    told = []
    assert contents(store.stream(RecordQuery().continue_on_error(lambda i, e: told.append(i)))) == [(made(1), {"a": 1})] and told == [made(2)]
    assert store.repair()["quarantined"] == 1 and store.verify()["ok"] and contents(store.stream()) == [(made(1), {"a": 1})]


def test_versions_do_not_overwrite_each_other(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.commit(0, {"x": 1}) == 1 and v.latest() == (1, {"x": 1})
    with pytest.raises(StoreError):
        v.commit(0, {"x": 2})
    assert v.latest() == (1, {"x": 1}) and namespace("a b//c..") == "a-b-c" and namespace("/") == "records"


def test_files_hold_so_many_rows(spark, tmp_path):
    log = OpLog(spark, str(tmp_path / "o"), rows_per_file=4)
    log.append(spark.createDataFrame([("put", made(i), "{}") for i in range(10)], "op string, id string, data string").coalesce(1))
    zones = sorted((r.least, r.greatest, r.n) for r in log.zones().collect())
    assert [n for *_, n in zones] == [4, 4, 2] and zones[0][:2] == (made(0), made(3))
    assert partition_folder(1_700_000_000_000, "daily") == "2023-11-14" and partition_folder(1_700_000_000_000, "monthly") == "2023-11"
    with pytest.raises(ValueError):
        partition_folder(0, "weekly")


def test_commands(spark, tmp_path):
    DocumentStore(spark, f"{tmp_path}/default").put({"a": 1}, made(1))
    assert run(spark, "stats", str(tmp_path))["records"] == 1 and run(spark, "verify", str(tmp_path))["ok"]
    assert run(spark, "compact", str(tmp_path)) == {"ok": True, "records": 1} and run(spark, "reindex", str(tmp_path))["entries"] == 1
    with pytest.raises(ValueError):
        run(spark, "reindex", str(tmp_path), "q", "queue")


def test_ids(spark):
    make = ids.Uuid7()
    many = [make(1_700_000_000_000) for _ in range(2000)] + [make(1_700_000_000_001)]
    assert many == sorted(many) and len(set(many)) == 2001 and all(map(ids.is_valid, many)) and ids.timestamp_ms(many[0]) == 1_700_000_000_000
    assert not ids.is_valid(many[0] + "\n") and ids.is_valid(many[0].upper())
    low, high = ids.bounds(1_700_000_000_000)
    assert low <= many[0] <= high
    for bad in (-1, 1 << 48):
        with pytest.raises(ids.IdError):
            make(bad)
    frame = spark.createDataFrame([(i,) for i in many[:3]], "id string")
    row = frame.select(ids.ms_column(F.col("id")), ids.valid_column(F.col("id")), ids.shard_column(F.col("id")), ids.day_column(F.col("id")), ids.month_column(F.col("id"))).first()
    assert tuple(row) == (1_700_000_000_000, True, many[0][24:26], "2023-11-14", "2023-11")


def test_jsonc():
    assert jsonc.decode('{"a": "// no", /* x */ "b": [1, 2,], }') == {"a": "// no", "b": [1, 2]}
    assert jsonc.compact({"a": 1.0, "b": "é/"}) == '{"a":1.0,"b":"é/"}'
    for bad in ("[1]", "{", '{"a": /* x }', '{"a",, }', "1"):
        with pytest.raises(jsonc.JsoncError):
            jsonc.decode(bad)
    draw = random.Random(24691)
    for _ in range(80):
        value = {f"k{i}": draw.choice([draw.randrange(-9, 9), draw.random(), None, True, 'q"\\,]}/*', [1, {"x": ",}"}]]) for i in range(3)}
        noisy = jsonc.pretty(value).replace("\n}", ", // end\n}").replace("{\n", "{ /* c */\n", 1)
        assert jsonc.decode(noisy) == value


def test_caches(spark, tmp_path):
    c = MemoryCache(max_entries=2, max_bytes=10)
    c.set("a", "12345")
    c.set("b", "1234")
    assert c.get("a") == "12345"
    c.set("c", "1")
    assert c.get("b") is None and c.get("a") and c.get("c")
    c.set("d", "x" * 11)
    c.clear_prefix("a")
    assert c.get("d") is None and c.get("a") is None and NullCache().get("a") is None
    old = MemoryCache(ttl=0)
    old.set("a", "1")
    assert old.get("a") is None
    log = EventLog(spark, str(tmp_path / "l"))
    log.put({"a": 1}, made(1))
    for mode, after in (("STAT", 2), ("HASH", 3), ("TRUST", 4)):
        held = FrameCache(log.log, mode)
        assert held.live().count() == after - 1
        log.put({"a": 1}, made(after))
        assert held.live().count() == (after - 1 if mode == "TRUST" else after)
    with pytest.raises(ValueError):
        FrameCache(log.log, "NONE")
