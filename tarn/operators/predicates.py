"""Conditions on fields, in disjunctive normal form, as two-valued Columns.

Two modes give the same rules: "json" reads fields out of a JSON text and tells missing from null; "typed" reads columns,
where every field exists and a null cell is an explicit null. Typed conditions keep the forms that Parquet scans accept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.values import FALSE, LIST, MISSING, NULL, NUMBER, OBJECT, STRING, TRUE, Field, compare, identical, rank, with_fields

OPERATORS = ("eq", "neq", "in", "not_in", "gt", "gte", "lt", "lte", "between", "exists", "missing", "prefix")


class QueryError(ValueError):
    """A query that cannot be built."""


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: object = None

    def __post_init__(self) -> None:
        if not self.field:
            raise QueryError("a condition needs a field")
        if self.operator not in OPERATORS:
            raise QueryError(f"unknown operator: {self.operator}")


Groups = tuple[tuple[Condition, ...], ...]


def matches(condition: Condition, id_: str, data: dict) -> bool:
    """The rule of a condition in Python: the reference model of the Columns."""
    value = id_ if condition.field == "id" else data.get(condition.field, MISSING)
    here, op, want = value is not MISSING, condition.operator, condition.value
    same = lambda w: here and identical(value, w)
    if op == "eq":
        return same(want)
    if op == "neq":
        return not same(want)
    if op == "in":
        return any(map(same, want))
    if op == "not_in":
        return not any(map(same, want))
    if op in ("exists", "missing"):
        return here == (op == "exists")
    if op == "prefix":
        return here and isinstance(value, str) and isinstance(want, str) and value.startswith(want)
    if not here:
        return False
    if op == "between":
        return compare(value, want[0]) >= 0 and compare(value, want[1]) <= 0
    sign = compare(value, want)
    return {"gt": sign > 0, "gte": sign >= 0, "lt": sign < 0, "lte": sign <= 0}[op]


def json_condition(condition: Condition, field: Field) -> Column:
    op, want = condition.operator, condition.value
    if op in ("eq", "neq", "in", "not_in"):
        wanted = [want] if op in ("eq", "neq") else list(want)
        found = reduce(lambda a, b: a | b, [field.equals(w) for w in wanted], F.lit(False))
        return found if op in ("eq", "in") else ~found
    if op == "exists":
        return field.exists
    if op == "missing":
        return ~field.exists
    if op == "prefix":
        return F.coalesce(field.string.startswith(want), F.lit(False)) if isinstance(want, str) else F.lit(False)
    if op == "between":
        return field.exists & ~field.under(want[0]) & ~field.over(want[1])
    return {"gt": field.over(want), "gte": field.exists & ~field.under(want), "lt": field.under(want), "lte": field.exists & ~field.over(want)}[op]


def type_rank(kind: T.DataType) -> int | None:
    """The rank of a column's values; None for booleans, which have two."""
    if isinstance(kind, T.BooleanType):
        return None
    if isinstance(kind, T.NumericType):
        return NUMBER
    if isinstance(kind, (T.ArrayType,)):
        return LIST
    return OBJECT if isinstance(kind, (T.MapType, T.StructType, T.VariantType)) else STRING


def _typed_same(x: Column, kind: T.DataType, want: object) -> Column:
    if want is None:
        return x.isNull()
    mine, theirs = type_rank(kind), rank(want)
    fits = theirs in (TRUE, FALSE) if mine is None else mine == theirs
    return x.eqNullSafe(F.lit(want)) if fits else F.lit(False)


def _typed_beside(x: Column, kind: T.DataType, want: object, over: bool, equal: bool) -> Column:
    """Whether the cell is greater (or less), or equal if so asked; a null cell has the rank of null."""
    theirs, mine = rank(want), type_rank(kind)
    null = (NULL > theirs if over else NULL < theirs) or (equal and theirs == NULL)
    if mine is None:
        cell = lambda v: (rank(v) > theirs if over else rank(v) < theirs) or (equal and rank(v) == theirs)
        alike = reduce(lambda a, b: a | b, [x.eqNullSafe(F.lit(v)) for v in (False, True) if cell(v)], F.lit(False))
    elif mine != theirs:
        alike = x.isNotNull() if (mine > theirs) == over else F.lit(False)
    else:
        w = F.lit(want)
        alike = x.isNotNull() & ((x >= w if equal else x > w) if over else (x <= w if equal else x < w))
    return x.isNull() | alike if null else alike


def typed_condition(condition: Condition, x: Column, kind: T.DataType) -> Column:
    op, want = condition.operator, condition.value
    if op in ("eq", "neq"):
        same = _typed_same(x, kind, want)
        return same if op == "eq" else ~same
    if op in ("in", "not_in"):
        same = reduce(lambda a, b: a | b, [_typed_same(x, kind, w) for w in want], F.lit(False))
        plain = [w for w in want if w is not None]
        if plain and all(rank(w) == type_rank(kind) for w in plain):
            same = x.isNotNull() & x.isin(plain)
            if len(plain) < len(list(want)):
                same = same | x.isNull()
        return same if op == "in" else ~same
    if op in ("exists", "missing"):
        return F.lit(op == "exists")
    if op == "prefix":
        return x.isNotNull() & x.startswith(want) if isinstance(want, str) and isinstance(kind, T.StringType) else F.lit(False)
    if op == "between":
        return _typed_beside(x, kind, want[0], True, True) & _typed_beside(x, kind, want[1], False, True)
    return _typed_beside(x, kind, want, op in ("gt", "gte"), op in ("gte", "lte"))


def condition_column(frame: DataFrame, condition: Condition, mode: str) -> Column:
    """A condition on a frame of typed columns, or of id and data (JSON text)."""
    return groups_column(frame, ((condition,),), mode)


def needs_python(condition: Condition) -> bool:
    """Whether a JSON condition compares lists or objects."""
    wanted = condition.value if condition.operator in ("in", "not_in", "between") else (condition.value,)
    return condition.operator not in ("exists", "missing", "prefix") and any(rank(w) in (LIST, OBJECT) for w in wanted)


def _column(frame: DataFrame, condition: Condition, fields: dict[str, Field] | None) -> Column:
    if fields is not None and condition.field != "id":
        return json_condition(condition, fields[condition.field])
    if condition.field not in frame.columns:  # a typed frame lacks the field altogether
        return F.lit(condition.operator in ("neq", "not_in", "missing"))
    return typed_condition(condition, frame[condition.field], frame.schema[condition.field].dataType)


def groups_column(frame: DataFrame, groups: Groups, mode: str) -> Column:
    """Any group of which all conditions hold; a group without conditions holds."""

    def build(fields: dict[str, Field] | None) -> Column:
        parts = [reduce(lambda a, b: a & b, [_column(frame, c, fields) for c in g]) if g else F.lit(True) for g in groups]
        return reduce(lambda a, b: a | b, parts)

    conditions = [c for g in groups for c in g if c.field != "id"]
    if mode != "json":
        return build(None)
    names = list(dict.fromkeys(c.field for c in conditions))
    if not names or any(map(needs_python, conditions)):
        return build({n: Field(n, F.col("data")) for n in names})
    shared = [c for c in groups[0] if c.field == "id" and all(c in g for g in groups)]
    found = with_fields(names, F.col("data"), build)
    # what every alternative asks of the id stands beside the rest, where the scan can see it
    return reduce(lambda a, b: a & b, [*(_column(frame, c, None) for c in shared), found])


def order_columns(frame: DataFrame, field: str, mode: str) -> list[Column]:
    """Columns whose ascending order is the field's."""
    if mode == "json" and field != "id":
        return Field(field, F.col("data")).keys(nested=True)
    if field not in frame.columns:
        return [F.lit(NULL)]
    mine = type_rank(frame.schema[field].dataType)
    x = frame[field]
    if mine is None:
        return [F.when(x.isNull(), NULL).when(x, TRUE).otherwise(FALSE)]
    return [F.when(x.isNull(), NULL).otherwise(mine), x]


__all__ = ["Condition", "Groups", "QueryError", "condition_column", "groups_column", "matches", "order_columns"]
