"""Immutable queries over a collection: the fluent builder and the plain streaming filter."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.functions import ids
from tarn.functions.values import Field
from tarn.operators.predicates import Condition, Groups, QueryError, condition_column, groups_column, order_columns
from tarn.sources.store import scratch


#: monotonically_increasing_id() has the row's number within its partition in so many bits.
ROW_BITS = 33


def placed(frame: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """Every row with its place from 1 in the whole order. Runs: rows are dealt by range, sorted and stored in the checkpoint folder;
    a row's place is its number within its partition after the counts of those before."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(frame.sparkSession, "places"))
    shuffled = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.repartitionByRange(shuffled, *order).sortWithinPartitions(*order)
    # stored, so that the rows counted are the rows numbered: bounds come from a sample
    rows = dealt.withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__at", ROW_BITS)
    offsets, before = [0] * max(1, rows.rdd.getNumPartitions()), 0
    for p, n in sorted(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets[p], before = before, before + n
    first = F.array(*[F.lit(n).cast("long") for n in offsets])
    return rows.withColumn(name, F.get(first, part.cast("int")) + F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1).drop("__at")


@dataclass(frozen=True)
class QueryBuilder:
    """A query over a frame with an `id`; in "json" mode with the record's JSON text in `data`.

    `natural` names the columns of the collection's own order, which also break ties in either direction. Nothing runs
    until the frame that get() returns is used; first() and count() run."""

    frame: DataFrame | None = None
    mode: str = "typed"
    natural: tuple[str, ...] = ("id",)
    groups: Groups = ((),)
    order: tuple[str, bool] | None = None
    most: int | None = None
    after: str | None = None

    def where(self, field: str) -> FieldBuilder:
        if not field:
            raise QueryError("a condition needs a field")
        return FieldBuilder(self, field)

    def with_condition(self, condition: Condition) -> QueryBuilder:
        """The condition joins every alternative so far."""
        return replace(self, groups=tuple((*g, condition) for g in self.groups))

    def _branch(self, build: Callable[[QueryBuilder], QueryBuilder]) -> QueryBuilder:
        branch = build(QueryBuilder(mode=self.mode))
        if not isinstance(branch, QueryBuilder):
            raise QueryError("the callback must return a query")
        return branch

    def and_where(self, build: Callable[[QueryBuilder], QueryBuilder]) -> QueryBuilder:
        """All conditions of the branch, alternatives too, join every alternative so far."""
        flat = tuple(c for g in self._branch(build).groups for c in g)
        return replace(self, groups=tuple((*g, *flat) for g in self.groups))

    def or_where(self, build: Callable[[QueryBuilder], QueryBuilder]) -> QueryBuilder:
        """The branch's alternatives follow those so far; a query without conditions so far goes on matching everything."""
        return replace(self, groups=self.groups + self._branch(build).groups)

    def order_by(self, field: str, direction: str = "asc") -> QueryBuilder:
        """One key; a second call replaces the first."""
        if not field or direction.lower() not in ("asc", "desc"):
            raise QueryError(f"cannot order by {field!r} {direction!r}")
        return replace(self, order=(field, direction.lower() == "desc"))

    def limit(self, n: int) -> QueryBuilder:
        if n < 1:
            raise QueryError("a limit is at least 1")
        return replace(self, most=n)

    page = limit

    def cursor(self, id_: str) -> QueryBuilder:
        """Only records whose id is greater."""
        return replace(self, after=id_)

    def condition(self) -> Column:
        """The whole filter as one Column."""
        found = groups_column(self.frame, self.groups, self.mode)
        return found if self.after is None else (F.col("id") > self.after) & found

    def matching(self) -> DataFrame:
        """The matching records in no order and without the limit."""
        unfiltered = self.after is None and any(not g for g in self.groups)
        return self.frame if unfiltered else self.frame.where(self.condition())

    def _keyed(self) -> tuple[DataFrame, list[Column], list[str]]:
        """The matches with their order's keys as columns, so that sorting compares values and derives none."""
        found, keys, names = self.matching(), [], []
        if self.order is not None:
            field, down = self.order
            columns = order_columns(self.frame, field, self.mode)
            names = [f"__key_{i}" for i in range(len(columns))]
            found = found.withColumns(dict(zip(names, columns, strict=True)))
            keys = [F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n in names]
        return found, [*keys, *(F.col(c).asc() for c in self.natural)], names

    def get(self) -> DataFrame:
        """The matching records in order. With a limit Spark takes the top rows of each partition instead of sorting all."""
        found, order, names = self._keyed()
        found = found.orderBy(*order)
        return (found if self.most is None else found.limit(self.most)).drop(*names)

    def numbered(self, name: str = "rn") -> DataFrame:
        """What get() returns, with each record's place from 1. One task places a limited query's; a whole order is placed by range, at once."""
        found, order, names = self._keyed()
        if self.most is None:
            return placed(found, order, name).drop(*names)
        return found.orderBy(*order).limit(self.most).withColumn(name, F.row_number().over(Window.orderBy(*order))).drop(*names)

    def first(self) -> Row | None:
        return next(iter(replace(self, most=1).get().collect()), None)

    def count(self) -> int:
        """The number of matches, at most the limit; the order does not matter."""
        found = self.matching().select("id")
        return (found if self.most is None else found.limit(self.most)).count()

    def counts_by(self, field: str) -> DataFrame:
        """The number of matches for each value of a field: the value as it is, or a JSON record's scalar as text with null for a
        missing field and "null" for an explicit null; lists and objects are left out."""
        found = self.matching()
        if self.mode != "json" or field == "id":
            return found.groupBy(field).agg(F.count(F.lit(1)).alias("n"))
        x = Field(field, F.col("data"))
        text = F.coalesce(x.string, x.integer.cast("string"), x.number.cast("string"), x.boolean.cast("string"), F.when(x.is_null, "null"))
        return found.where(~F.coalesce(x.is_list | x.is_object, F.lit(False))).groupBy(text.alias(field)).agg(F.count(F.lit(1)).alias("n"))

    def candidate_count(self) -> int:
        """The number of records that the conditions leave, without order and limit. There are no indexes that would give it sooner."""
        return self.matching().select("id").count()

    def explain(self) -> dict:
        """What the query asks for, and the plan Spark makes of it."""
        plan = self.get()._jdf.queryExecution().executedPlan().toString()
        conditions = [[(c.field, c.operator) for c in g] for g in self.groups]
        return {"mode": self.mode, "groups": conditions, "order": self.order, "limit": self.most, "cursor": self.after, "plan": plan}


@dataclass(frozen=True)
class FieldBuilder:
    """The operators of one field; each returns the query with the condition added."""

    query: QueryBuilder
    field: str

    def _add(self, operator: str, value: object = None) -> QueryBuilder:
        return self.query.with_condition(Condition(self.field, operator, value))

    def eq(self, value: object) -> QueryBuilder:
        return self._add("eq", value)

    def neq(self, value: object) -> QueryBuilder:
        return self._add("neq", value)

    def in_(self, values: Iterable) -> QueryBuilder:
        return self._add("in", tuple(values))

    def not_in(self, values: Iterable) -> QueryBuilder:
        return self._add("not_in", tuple(values))

    def gt(self, value: object) -> QueryBuilder:
        return self._add("gt", value)

    def gte(self, value: object) -> QueryBuilder:
        return self._add("gte", value)

    def lt(self, value: object) -> QueryBuilder:
        return self._add("lt", value)

    def lte(self, value: object) -> QueryBuilder:
        return self._add("lte", value)

    def between(self, low: object, high: object) -> QueryBuilder:
        return self._add("between", (low, high))

    def exists(self) -> QueryBuilder:
        return self._add("exists")

    def missing(self) -> QueryBuilder:
        return self._add("missing")

    def prefix(self, text: str) -> QueryBuilder:
        return self._add("prefix", text)


@dataclass(frozen=True)
class RecordQuery:
    """A streaming filter: a cursor, a time range of ids, equalities and a limit, in the collection's own order."""

    after_id: str | None = None
    since: int | None = None
    until: int | None = None
    equals: tuple[tuple[str, object], ...] = ()
    most: int | None = None
    on_error: Callable[[str, str], None] | None = None
    on_open: Callable[[str], None] | None = None

    def after(self, id_: str) -> RecordQuery:
        return replace(self, after_id=ids.checked(id_))

    def time_range_ms(self, since: int | None = None, until: int | None = None) -> RecordQuery:
        """Both ends included, either open."""
        return replace(self, since=since, until=until)

    def where_equal(self, field: str, value: object) -> RecordQuery:
        """The last value given for a field holds."""
        if not field or isinstance(value, (list, dict, tuple)):
            raise QueryError("equality takes a field and a scalar or null")
        return replace(self, equals=(*((f, v) for f, v in self.equals if f != field), (field, value)))

    def limit(self, n: int) -> RecordQuery:
        if n < 1:
            raise QueryError("a limit is at least 1")
        return replace(self, most=n)

    def continue_on_error(self, callback: Callable[[str, str], None]) -> RecordQuery:
        """Corrupt records go to callback(location, error) instead of stopping the read."""
        return replace(self, on_error=callback)

    def on_segment_open(self, callback: Callable[[str], None]) -> RecordQuery:
        """Called with each file that the filtered scan reads."""
        return replace(self, on_open=callback)

    def id_condition(self) -> Column | None:
        """The part that only concerns ids: it may be applied before versions of a record are told apart."""
        parts = [] if self.after_id is None else [F.col("id") > self.after_id]
        if self.since is not None:
            parts.append(F.col("id") >= ids.bounds(self.since)[0])
        if self.until is not None:
            parts.append(F.col("id") <= ids.bounds(self.until)[1])
        return reduce(lambda a, b: a & b, parts) if parts else None

    def apply(self, frame: DataFrame, mode: str = "typed", natural: tuple[str, ...] = ("id",)) -> DataFrame:
        found = self.id_condition()
        frame = frame if found is None else frame.where(found)
        for field, value in self.equals:
            frame = frame.where(condition_column(frame, Condition(field, "eq", value), mode))
        if self.on_open:
            for file in sorted(r.f for r in frame.select(F.input_file_name().alias("f")).distinct().collect()):
                self.on_open(file)
        ordered = frame.orderBy(*natural)
        return ordered if self.most is None else ordered.limit(self.most)
