"""The queue against a state machine in Python, the mirror against its counts, and the streams against batch results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tarn.functions import ids
from tarn.operators.schema import Schema
from tarn.plans.collections import DocumentStore
from tarn.plans.jobqueue import JobQueue, fold
from tarn.plans.mirror import Mirror, MirrorError
from tarn.streaming.streams import push_stream, queue_states, tail, windowed_counts


def made(i, ms=1_700_000_000_000):
    return ids.bounds(ms + i)[0][:-4] + f"{i:04x}"


def replayed(events):
    jobs = {}
    for seq, op, id_, done, ts in events:
        state = jobs.get(id_, ("none", None, None))
        if op == "enqueue":
            state = ("pending", seq, None)
        elif op == "complete":
            state = ("done", None, ts) if done else ("none", None, None)
        elif op == "claim" and state[0] == "pending":
            state = ("processing", None, ts)
        elif op == "requeue" and state[0] == "processing":
            state = ("pending", seq, None)
        elif op == "purge" and state[0] == "done":
            state = ("none", None, None)
        jobs[id_] = state
    return {k: v for k, v in jobs.items() if v[0] != "none"}


def random_events(seed, n=600):
    draw = random.Random(seed)
    ops = ["enqueue", "claim", "claim", "complete", "requeue", "requeue", "purge"]
    return [(i, draw.choice(ops), f"j{draw.randrange(45)}", draw.random() < 0.6, 1000 + i) for i in range(n)]


@pytest.mark.parametrize("seed", [1933, 2, 3])
def test_fold_against_replay(spark, seed):
    events = random_events(seed)
    frame = spark.createDataFrame([(*e, f'{{"n":{e[0]}}}') for e in events], "seq long, op string, id string, done boolean, ts long, payload string").repartition(5)
    got = {r.id: (r.state, r.pos, r.ts) for r in fold(frame).collect()}
    assert got == replayed(events)


def test_queue(spark, tmp_path):
    q = JobQueue(spark, str(tmp_path / "q"))
    names = q.enqueue_many([{"id": made(3), "payload": {"n": 3}}, {"id": made(1), "payload": "no object"}, {"task": "x"}], now=10)
    assert names[:2] == [made(3), made(1)] and q.counts() == {"pending": 3, "processing": 0, "done": 0}
    assert [(j.id, json.loads(j.payload)) for j in q.claim_many(2, now=20)] == [(made(3), {"n": 3}), (made(1), {})]
    with pytest.raises(ValueError):
        q.claim_many(0)
    assert q.requeue_timed_out(11, now=30) == 0 and q.requeue_timed_out(10, now=30) == 2
    assert [r.id for r in q.pending().collect()] == [names[2], made(1), made(3)] or [r.id for r in q.pending().collect()] == [names[2], made(3), made(1)]
    assert json.loads(q.claim(now=31).payload) == {"task": "x"}
    assert q.complete_many([names[2], names[2], made(1)], now=40) == 1 and q.counts() == {"pending": 2, "processing": 0, "done": 1}
    q.claim(now=41)
    before = sorted(map(str, q.jobs().select("id", "state", "ts", "payload").collect()))
    order = [r.id for r in q.pending().collect()]
    q.compact()
    assert sorted(map(str, q.jobs().select("id", "state", "ts", "payload").collect())) == before and [r.id for r in q.pending().collect()] == order
    assert q.purge_done(5, now=44) == 0 and q.purge_done(5, now=45) == 1 and q.counts() == {"pending": 1, "processing": 1, "done": 0}
    assert q.verify()["ok"] and q.repair(3600, now=50)["requeued"] == 0
    with pytest.raises(ids.IdError):
        q.complete_many(["x"])


PRODUCTS = Schema("products").string("slug", unique=True).string("name", index=True).float("price", range=True).bool("active")
PURCHASES = Schema("purchases").string("product_id", index=True).int("amount", range=True)


def test_mirror(spark, tmp_path):
    products, purchases = DocumentStore(spark, f"{tmp_path}/p"), DocumentStore(spark, f"{tmp_path}/o")
    products.put_many([{"id": made(i), "data": {"slug": s, "name": s, "price": p, "active": True, "tags": [1]}} for i, (s, p) in enumerate([("my-plugin", 9.5), ("my-theme", 4)])])
    purchases.put_many([{"id": made(10 + i), "data": {"product_id": made(i % 2), "amount": 1000 + i}} for i in range(6)])
    m = Mirror(spark, f"{tmp_path}/m", "x_").collection(products, "products", PRODUCTS).collection(purchases, "purchases", PURCHASES)
    assert m.push() == {"inserted": 8, "updated": 0, "deleted": 0, "unchanged": 0}
    assert m.push() == {"inserted": 0, "updated": 0, "deleted": 0, "unchanged": 8} and m.verify()["ok"]
    text = "SELECT p.slug, count(*) AS n, sum(o.amount) AS total FROM x_products p JOIN x_purchases o ON p.id = o.product_id GROUP BY p.slug ORDER BY 2, 1"
    assert [tuple(r) for r in m.sql(text).collect()] == [("my-plugin", 3, 3006), ("my-theme", 3, 3009)]
    assert [r.price for r in m.sql("SELECT price FROM x_products ORDER BY price").collect()] == [4.0, 9.5]
    products.put({"slug": "my-plugin", "price": 10, "active": "yes"}, made(0))
    purchases.delete(made(10))
    purchases.put({"product_id": None, "amount": 1}, made(30))
    assert m.verify()["stats"] == {"records": 8, "rows": 8, "missing": 1, "stale": 1, "orphaned": 1}
    assert m.flush("purchases", [made(10), made(30), made(30), made(99)]) == {"upserted": 1, "deleted": 2}
    assert m.push() == {"inserted": 0, "updated": 1, "deleted": 0, "unchanged": 7}
    assert m.sql("SELECT active FROM x_products WHERE slug = 'my-plugin'").first().active is None
    other = DocumentStore(spark, f"{tmp_path}/other")
    m.sources["purchases"] = (other, PURCHASES)
    assert m.pull("purchases") == {"written": 6, "unchanged": 0} and m.pull("purchases") == {"written": 0, "unchanged": 6}
    assert m.rebuild("products")["inserted"] == 2
    m.uninstall()
    for bad in (lambda: m.collection(products, "a b"), lambda: Mirror(spark, "x", "-"), lambda: m.collection(products, "z", Schema("z").string("hash")), lambda: m.collection(products, "z", Schema("z").mixed("q", index=True)), lambda: m.push("none")):
        with pytest.raises(MirrorError):
            bad()
    with pytest.raises(MirrorError):
        Mirror(spark, "x").collection(products, "a-b").collection(products, "a_b")


def drained(frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return frame.sparkSession.table(name)


def test_streams(spark, tmp_path):
    store = DocumentStore(spark, f"{tmp_path}/s")
    store.put_many([{"id": made(i), "data": {"n": i}} for i in range(6)])
    store.put_many([{"id": made(i, 1_700_009_000_000), "data": {"n": i}} for i in range(4)])
    rows = tail(spark, f"{tmp_path}/s", store.log.schema, after=made(2))
    assert sorted(r.id for r in drained(rows.select("id"), "tailed").collect())[:3] == [made(3), made(4), made(5)]
    counts = drained(windowed_counts(tail(spark, f"{tmp_path}/s", store.log.schema)), "windows", "update")
    assert sorted(r.n for r in counts.collect()) == [4, 6]
    m = Mirror(spark, f"{tmp_path}/m").collection(store, "docs", Schema("docs").int("n"))
    m.install()
    push_stream(tail(spark, f"{tmp_path}/s", store.log.schema), m, "docs", f"{tmp_path}/c").awaitTermination()
    assert m.verify()["ok"] and m.sql("SELECT count(*) AS n FROM docs").first().n == 10


def test_streamed_queue(spark, tmp_path):
    events = random_events(5, 200)
    spark.createDataFrame(events, "seq long, op string, id string, done boolean, ts long").write.parquet(f"{tmp_path}/e")
    rows = spark.readStream.schema("seq long, op string, id string, done boolean, ts long").parquet(f"{tmp_path}/e")
    got = drained(queue_states(rows), "jobs", "update").where(F.col("state") != "none")
    assert {r.id: (r.state, r.pos, r.ts) for r in got.collect()} == replayed(events)
