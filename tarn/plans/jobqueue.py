"""A job queue whose state follows from its events.

States: none, pending, processing, done. Enqueue makes a job pending from any state; complete ends it from any state, as
done or as none; between those, a claim takes pending to processing, a requeue takes processing to pending, and a purge
takes done to none. So a job's state follows from its last enqueue or complete and the claims, requeues and purges after
it: a few minima and maxima by id. They are partial aggregates, so a job with any number of events is folded by all tasks
and nothing is collected per job.
"""

from __future__ import annotations

import time
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import ids
from tarn.functions.jsonc import compact
from tarn.plans.oplog import POSITION, OpLog
from tarn.sources.records import QUEUE_OPERATIONS, before_first_bad, read_framed_log

EXTRA = (("done", T.BooleanType()), ("ts", T.LongType()))


def fold(events: DataFrame, position: str = "seq") -> DataFrame:
    """id, state, pos (of pending jobs), ts (of processing and done ones) and payload of every job that is not none.

    Events have id, op, done, ts, payload and a position that orders them."""
    p = F.col(position)
    ends = F.when(F.col("op").isin("enqueue", "complete"), p)
    last = events.groupBy("id").agg(
        F.max(ends).alias("at"),
        F.max_by(F.struct("op", "done", "ts"), ends).alias("end"),
        F.max_by("payload", F.when(F.col("op") == "enqueue", p)).alias("payload"),
    )
    last = last.where("at is not null")
    tail = events.where(F.col("op").isin("claim", "requeue", "purge")).join(last.select("id", "at"), "id").where(p > F.col("at"))
    tail = tail.select("id", "op", "ts", p.alias("p"))
    ranges = tail.groupBy("id").agg(*[F.max(F.when(F.col("op") == o, F.col("p"))).alias(o) for o in ("claim", "requeue", "purge")])
    # of claims in a row only the first counts, and so of requeues
    first = tail.join(ranges, "id").groupBy("id").agg(
        F.min_by("ts", F.when((F.col("op") == "claim") & ((F.col("p") > F.col("requeue")) | F.col("requeue").isNull()), F.col("p"))).alias("claimed"),
        F.min(F.when((F.col("op") == "requeue") & (F.col("p") > F.col("claim")), F.col("p"))).alias("back"),
    )
    all_ = last.join(ranges, "id", "left").join(first, "id", "left")
    enqueued = F.col("end.op") == "enqueue"
    busy = enqueued & F.col("claim").isNotNull() & (F.col("requeue").isNull() | (F.col("claim") > F.col("requeue")))
    done = ~enqueued & F.coalesce(F.col("end.done"), F.lit(False)) & F.col("purge").isNull()
    state = F.when(busy, "processing").when(enqueued, "pending").when(done, "done")
    pos = F.when(state == "pending", F.coalesce("back", "at"))
    ts = F.when(state == "processing", F.col("claimed")).when(state == "done", F.col("end.ts"))
    return all_.select("id", state.alias("state"), pos.alias("pos"), ts.alias("ts"), F.when(state != "done", F.col("payload")).alias("payload")).where("state is not null")


def replayed(events: DataFrame) -> DataFrame:
    """id, state and ts of every job that is not none, by running its events in order. A check: a job's events meet in one task."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state, ts = "none", None
        for e in rows.sort_values(["commit", "row"]).itertuples():
            if e.op == "enqueue":
                state, ts = "pending", None
            elif e.op == "complete":
                state, ts = ("done", e.ts) if e.done is True or e.done == 1 else ("none", None)
            elif e.op == "claim" and state == "pending":
                state, ts = "processing", e.ts
            elif e.op == "requeue" and state == "processing":
                state, ts = "pending", None
            elif e.op == "purge" and state == "done":
                state, ts = "none", None
        return pd.DataFrame({"id": [key[0]], "state": [state], "ts": pd.array([None if ts is None else int(ts)], "Int64")})

    rows = events.select("id", "op", "done", "ts", "seq.commit", "seq.row")
    return rows.groupBy("id").applyInPandas(run, "id string, state string, ts long").where("state <> 'none'")


class JobQueue:
    """First in, first out. Times are seconds; `now` may be given so that a run can be repeated."""

    def __init__(self, spark: SparkSession, root: str, make_id: ids.Uuid7 | None = None):
        self.spark, self.make_id = spark, make_id or ids.Uuid7()
        self.log = OpLog(spark, root, EXTRA)

    def events(self) -> DataFrame:
        return self.log.read().select("id", "op", "done", "ts", F.col("data").alias("payload"), F.struct(*POSITION).alias("seq"))

    def jobs(self) -> DataFrame:
        return fold(self.events())

    def _add(self, rows: Iterable[tuple], now: int | None, after: int | None = None) -> int:
        rows = [(op, id_, data, done, int(time.time()) if now is None else now) for op, id_, data, done in rows]
        return self.log.append(self.spark.createDataFrame(rows, "op string, id string, data string, done boolean, ts long").coalesce(1), after=after) if rows else 0

    def _add_frame(self, op: str, frame: DataFrame, now: int, order: tuple, after: int) -> int:
        return self.log.append(frame.withColumns({"op": F.lit(op), "done": F.lit(None).cast("boolean"), "ts": F.lit(now).cast("long"), "data": F.lit(None).cast("string")}), order, after)

    def enqueue(self, payload: object, id_: str | None = None, now: int | None = None) -> str:
        id_ = ids.checked(id_) if id_ else self.make_id()
        self.enqueue_many([{"id": id_, "payload": payload}], now)
        return id_

    def enqueue_many(self, jobs: Iterable[dict], now: int | None = None) -> list[str]:
        """Jobs are {"id", "payload"} envelopes or bare objects; a payload that is no object is {}."""
        rows = []
        for job in jobs:
            id_ = job["id"] if isinstance(job.get("id"), str) else self.make_id()
            payload = job["payload"] if "payload" in job else job
            payload = {k: v for k, v in payload.items() if isinstance(k, str)} if isinstance(payload, dict) else {}
            rows.append(("enqueue", ids.checked(id_), compact(payload), None))
        self._add(rows, now)
        return [r[1] for r in rows]

    def enqueue_frame(self, frame: DataFrame, order: tuple = (), now: int | None = None) -> int:
        """Jobs from a frame of id and data."""
        return self.log.append(frame.select("id", "data", F.lit("enqueue").alias("op"), F.lit(int(time.time()) if now is None else now).cast("long").alias("ts"), *[c for c in order if isinstance(c, str) and c not in ("id", "data")]), order)

    def pending(self) -> DataFrame:
        return self.jobs().where("state = 'pending'").orderBy("pos")

    def claim_many(self, n: int, now: int | None = None) -> list[Row]:
        """The n jobs that have been pending longest, by place, now processing. A claim that another writer overtakes is made again,
        so no job is given twice."""
        if n < 1:
            raise ValueError("claim at least one job")

        def step(after: int) -> list[Row]:
            jobs = self.pending().limit(n).select("id", "payload").collect()
            self._add([("claim", j.id, None, None) for j in jobs], now, after)
            return jobs

        return self.log.exclusively(step)

    def claim(self, now: int | None = None) -> Row | None:
        return next(iter(self.claim_many(1, now)), None)

    def complete_many(self, id_list: Iterable[str], keep_done: bool = True, now: int | None = None) -> int:
        """Ends those of the jobs that are processing; returns their number."""
        wanted = self.spark.createDataFrame([(i,) for i in dict.fromkeys(map(ids.checked, id_list))], "id string")

        def step(after: int) -> int:
            found = self.jobs().where("state = 'processing'").join(wanted, "id", "left_semi").select("id").collect()
            return self._add([("complete", r.id, None, keep_done) for r in found], now, after)

        return self.log.exclusively(step)

    def complete(self, id_: str, keep_done: bool = True, now: int | None = None) -> None:
        self.complete_many([id_], keep_done, now)

    def requeue_timed_out(self, seconds: int, now: int | None = None) -> int:
        """Jobs claimed at least so long ago go to the end."""
        at = int(time.time()) if now is None else now

        def step(after: int) -> int:
            late = self.jobs().where((F.col("state") == "processing") & (F.lit(at) - F.col("ts") >= seconds)).select("id", F.col("ts").alias("since"))
            return 0 if late.isEmpty() else self._add_frame("requeue", late, at, ("since", "id"), after)

        return self.log.exclusively(step)

    def purge_done(self, older_than: int = 0, now: int | None = None) -> int:
        """Forgets done jobs of at least that age; 0 forgets all."""
        at = int(time.time()) if now is None else now

        def step(after: int) -> int:
            done = self.jobs().where("state = 'done'")
            done = done if older_than == 0 else done.where(F.lit(at) - F.col("ts") >= older_than)
            return 0 if done.isEmpty() else self._add_frame("purge", done.select("id"), at, ("id",), after)

        return self.log.exclusively(step)

    def import_framed(self, good: DataFrame) -> int:
        """Appends the events of framed log lines in their order."""
        return self.log.append(good.select("op", "id", "data", "done", "ts", "file", "line"), ("file", "line"))

    def recover_framed(self, path: str, now: int | None = None) -> int:
        """Appends what a queue's framed log files hold before their first bad line; each file is cut there."""
        return self.import_framed(before_first_bad(*read_framed_log(self.spark, path, "payload", QUEUE_OPERATIONS, int(time.time()) if now is None else now)))

    def counts(self) -> dict:
        found = {r.state: r.n for r in self.jobs().groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {s: found.get(s, 0) for s in ("pending", "processing", "done")}

    def stats(self) -> dict:
        return self.counts() | {"bytes": self.log.bytes()}

    def verify(self) -> dict:
        """Events that no queue writes, and jobs whose folded state is not that of a replay, event by event."""
        bad = self.log.read().where(~F.col("op").isin(*QUEUE_OPERATIONS) | ~ids.valid_column(F.col("id")) | F.col("ts").isNull())
        errors = [f"{r.commit}:{r.row}: {r.op} {r.id}" for r in bad.limit(100).collect()]
        if not errors:
            state, folded = replayed(self.events()), self.jobs().select("id", "state", "ts")
            drift = folded.exceptAll(state).unionAll(state.exceptAll(folded))
            errors += [f"{r.id}: state drift" for r in drift.limit(100).collect()]
        return {"ok": not errors, "errors": errors, "stats": self.stats()}

    def repair(self, timeout: int = 3600, now: int | None = None) -> dict:
        return {"ok": True, "requeued": self.requeue_timed_out(timeout, now), "stats": self.stats()}

    def compact(self) -> dict:
        """Only what the jobs' states need stays: an enqueue and a claim, or a done complete, in their places."""

        def made() -> DataFrame:
            rows, jobs = self.log.read(), self.jobs().select("id", "state", F.col("pos").alias("at"), F.col("ts").alias("since"), F.col("payload"))
            return _needed(rows, jobs)

        return {"ok": True, "records": self.log.replace(made)}


def _needed(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    last = rows.groupBy("id").agg(F.max(F.struct(*POSITION)).alias("end"))
    known = jobs.join(last, "id")
    place = F.coalesce("at", "end")
    enqueue = known.where("state <> 'done'").select(F.col("id"), F.lit("enqueue").alias("op"), F.col("payload").alias("data"), F.lit(None).cast("boolean").alias("done"), F.lit(0).cast("long").alias("ts"), place.alias("p"))
    end = known.where("state <> 'pending'").select("id", F.when(F.col("state") == "done", "complete").otherwise("claim").alias("op"), F.lit(None).cast("string").alias("data"), F.when(F.col("state") == "done", True).alias("done"), F.col("since").alias("ts"), F.struct(F.col("end.commit").alias("commit"), (F.col("end.row") + F.lit(1 << 60)).alias("row")).alias("p"))
    both = enqueue.unionAll(end)
    return both.select("id", "op", "data", "done", "ts", F.col("p.commit").alias("commit"), F.col("p.row").alias("row"))
