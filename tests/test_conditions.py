"""Conditions and order over JSON records against the rules in Python, on seeded random queries."""

import functools
import json
import random

import pytest

from tarn.functions import values
from tarn.functions.ids import bounds
from tarn.operators.predicates import Condition, QueryError, matches
from tarn.operators.query import QueryBuilder, RecordQuery

VALUES = [None, True, False, 0, 1, 5, -3, 2**60, 2**60 + 1, 1.0, 5.5, -0.25, 1e-7, "", "a", "alpha", "alpine", "Z", "é", "10", [], [1], [1, 2], ["a"], {"x": 1}, {"x": 1, "y": [2.0]}, {"y": [2.0], "x": 1}]
FIELDS = ["a", "b.c", 'q"t', "id"]


def records(seed, n=120):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        data = {f: draw.choice(VALUES) for f in FIELDS[:3] if draw.random() < 0.8}
        out.append((bounds(1_700_000_000_000 + i * 7)[0][:-3] + f"{i:03x}", data))
    return out


def condition(draw, ids):
    field = draw.choice(FIELDS)
    pool = ids + ["x"] if field == "id" else VALUES
    op = draw.choice(["eq", "neq", "in", "not_in", "gt", "gte", "lt", "lte", "between", "exists", "missing", "prefix"])
    if op in ("in", "not_in"):
        return Condition(field, op, tuple(draw.choice(pool) for _ in range(draw.randrange(4))))
    if op == "between":
        return Condition(field, op, (draw.choice(pool), draw.choice(pool)))
    return Condition(field, op, draw.choice(["a", "al", "", 5, "0"]) if op == "prefix" else None if op in ("exists", "missing") else draw.choice(pool))


def ordered(rows, field, down):
    value = lambda r: r[0] if field == "id" else r[1].get(field, values.MISSING)
    rows = sorted(rows, key=lambda r: r[0])
    return sorted(rows, key=functools.cmp_to_key(lambda a, b: values.compare(value(a), value(b)) * (-1 if down else 1)))


@pytest.fixture(scope="module")
def frame(spark):
    rows = records(1)
    return rows, spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False)) for i, d in rows], "id string, data string").repartition(3).cache()


def test_every_condition_alone(frame):
    rows, df = frame
    draw = random.Random(2)
    cases = [condition(draw, [r[0] for r in rows]) for _ in range(220)]
    from tarn.operators.predicates import condition_column

    for at in range(0, len(cases), 20):
        part = cases[at : at + 20]
        got = df.select("id", *[condition_column(df, c, "json").alias(f"c{i}") for i, c in enumerate(part)]).collect()
        data = dict(rows)
        for r in got:
            for i, c in enumerate(part):
                assert r[f"c{i}"] == matches(c, r.id, data[r.id]), (c, data[r.id])


@pytest.mark.parametrize("seed", range(12))
def test_random_queries(frame, seed):
    rows, df = frame
    draw = random.Random(seed)
    ids = [r[0] for r in rows]
    groups = [[]]
    q = QueryBuilder(df, "json")
    for _ in range(draw.randrange(4)):
        kind, c, e = draw.choice(["where", "and", "or"]), condition(draw, ids), condition(draw, ids)
        if kind == "where":
            q, groups = q.with_condition(c), [[*g, c] for g in groups]
        elif kind == "and":
            q = q.and_where(lambda b, c=c, e=e: b.with_condition(c).or_where(lambda x: x.with_condition(e)))
            groups = [[*g, c, e] for g in groups]
        else:
            q = q.or_where(lambda b, c=c, e=e: b.with_condition(c).with_condition(e))
            groups = [*groups, [c, e]]
    cursor = draw.choice([None, ids[30]])
    field, down, limit = draw.choice(FIELDS[:2]), draw.random() < 0.5, draw.choice([None, 1, 10])
    want = [r for r in rows if (cursor is None or r[0] > cursor) and any(all(matches(c, *r) for c in g) for g in groups)]
    n = len(want)
    want = ordered(want, field, down)[:limit]
    q = q.order_by(field, "desc" if down else "asc")
    q = q.cursor(cursor) if cursor else q
    q = q.limit(limit) if limit else q
    assert [r.id for r in q.get().collect()] == [i for i, _ in want]
    assert q.count() == min(n, limit or n)
    first = q.first()
    assert (first.id if first else None) == (want[0][0] if want else None)


def test_comparator_is_antisymmetric():
    for a in VALUES:
        for b in VALUES:
            assert values.compare(a, b) == -values.compare(b, a)
    order = ["z", 10, [1], False, None, True, {"a": 1}]
    assert all(values.compare(a, b) < 0 for i, a in enumerate(order) for b in order[i + 1 :])
    assert values.compare([1], [1, 2]) < 0 and not values.identical(1, 1.0) and not values.identical({"a": 1, "b": 2}, {"b": 2, "a": 1})


def test_typed_nulls_and_types(spark):
    rows = [("1", None, None, True), ("2", "a", 5, None), ("3", "b", -1, False)]
    q = QueryBuilder(spark.createDataFrame(rows, "id string, s string, n int, b boolean"))
    ids = lambda x: [r.id for r in x.get().collect()]
    assert ids(q.where("n").gt(0)) == ["1", "2"] and ids(q.where("n").lt(10)) == ["2", "3"] and ids(q.where("n").neq(5)) == ["1", "3"]
    assert ids(q.where("s").eq(None)) == ["1"] and ids(q.where("s").in_([None, "a"])) == ["1", "2"] and ids(q.where("s").not_in(["a"])) == ["1", "3"]
    assert ids(q.where("s").eq(5)) == [] and ids(q.where("s").gt(5)) == ["1"] and ids(q.where("b").gte(False)) == ["1", "2", "3"] and ids(q.where("b").gt(False)) == ["1", "2"]
    assert ids(q.order_by("n")) == ["3", "2", "1"] and ids(q.order_by("n", "desc")) == ["1", "2", "3"] and ids(q.order_by("b")) == ["3", "2", "1"]
    assert ids(q.where("nowhere").missing()) == ["1", "2", "3"] and ids(q.where("nowhere").exists()) == []


def test_bad_queries():
    q = QueryBuilder()
    for bad in (lambda: q.where(""), lambda: q.limit(0), lambda: q.order_by("a", "up"), lambda: q.or_where(lambda b: None), lambda: Condition("a", "like", 1), lambda: RecordQuery().limit(0), lambda: RecordQuery().where_equal("a", [1])):
        with pytest.raises(QueryError):
            bad()
    with pytest.raises(ValueError):
        RecordQuery().after("x")
