"""Values of JSON records: presence, strict equality, and one order over all types.

A field is missing, null or has a value. Values of all types are ordered: strings, numbers, lists, false, null, true,
objects; a missing field is ordered as null. Equality is strict, so 1 is not 1.0, while both are ordered alike.
Strings are compared by bytes, lists and objects by their pretty text.

`Field` gives the Columns of one field of a JSON record; `rank`, `compare` and `identical` are the same rules in Python.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.jsonc import pretty

STRING, NUMBER, LIST, FALSE, NULL, TRUE, OBJECT = range(7)
MISSING = object()


def rank(value: object) -> int:
    if value is None or value is MISSING:
        return NULL
    if isinstance(value, bool):
        return TRUE if value else FALSE
    if isinstance(value, str):
        return STRING
    if isinstance(value, (int, float)):
        return NUMBER
    return LIST if isinstance(value, (list, tuple)) else OBJECT


def compare(a: object, b: object) -> int:
    """-1, 0 or 1."""
    x, y = rank(a), rank(b)
    if x == y:
        if x == STRING:
            a, b = a.encode(), b.encode()
        elif x in (LIST, OBJECT):
            a, b = pretty({"value": a}).encode(), pretty({"value": b}).encode()
        elif x != NUMBER:
            return 0
        x, y = a, b
    return (x > y) - (x < y)


def identical(a: object, b: object) -> bool:
    """Equality that tells types apart, in lists and objects too, and the order of an object's keys."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return list(a) == list(b) and all(identical(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(identical, a, b))
    return a == b


def _nested(name: str, shape) -> Column:
    def texts(parts: Iterator[tuple[pd.Series]]) -> Iterator[pd.Series]:
        def one(text: str | None) -> str | None:
            value = json.loads(text).get(name) if text else None
            return shape(value) if isinstance(value, (list, dict)) else None

        for part in parts:
            yield part.map(one)

    texts.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(texts, "string")


def member(value: Column, name: str) -> Column:
    """The top-level field of a parsed object, as a variant."""
    if '"' in name or "\\" in name:  # no path can name it
        return F.element_at(F.try_variant_get(value, "$", "map<string,variant>"), name)
    return F.variant_get(value, f'$["{name}"]', "variant")


class Field:
    """The Columns of a top-level field of the JSON text in `data`; x is the field and kind its schema, if they are at hand."""

    def __init__(self, name: str, data: Column, x: Column | None = None, kind: Column | None = None):
        self.name, self.data = name, data
        self.x = member(F.parse_json(data), name) if x is None else x
        self.exists = self.x.isNotNull()
        kind = F.schema_of_variant(self.x) if kind is None else kind
        self.is_string, self.is_bool = kind == "STRING", kind == "BOOLEAN"
        self.is_int, self.is_float = kind == "BIGINT", kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
        self.is_null = self.exists & (kind == "VOID")
        self.is_list, self.is_object = kind.startswith("ARRAY"), kind.startswith("OBJECT")

    def _as(self, kind: str) -> Column:
        return F.try_variant_get(self.x, "$", kind)

    @property
    def string(self) -> Column:
        return F.when(self.is_string, self._as("string"))

    @property
    def number(self) -> Column:
        return F.when(self.is_int | self.is_float, self._as("double"))

    @property
    def integer(self) -> Column:
        return F.when(self.is_int, self._as("bigint"))

    @property
    def boolean(self) -> Column:
        return F.when(self.is_bool, self._as("boolean"))

    def text(self) -> Column:
        """The pretty text of a list or object."""
        return _nested(self.name, lambda v: pretty({"value": v}))(F.when(self.is_list | self.is_object, self.data))

    def rank(self) -> Column:
        return (
            F.when(self.is_string, STRING)
            .when(self.is_int | self.is_float, NUMBER)
            .when(self.is_list, LIST)
            .when(self.is_bool, F.when(self.boolean, TRUE).otherwise(FALSE))
            .when(self.is_object, OBJECT)
            .otherwise(NULL)
        )

    def keys(self, nested: bool = False) -> list[Column]:
        """Columns whose order is the values' order: rank, number, integer, string, and the text of lists and objects if asked for."""
        exact = F.coalesce(self.integer, F.when(F.abs(self.number) < float(1 << 63), self.number.try_cast("bigint")))
        return [self.rank(), self.number, exact, self.string, *([self.text()] if nested else [])]

    def equals(self, other: object) -> Column:
        kind = rank(other)
        if other is None:
            found = self.is_null
        elif isinstance(other, bool):
            found = self.is_bool & (self.boolean == other)
        elif kind == STRING:
            found = self.is_string & (self.string == other)
        elif isinstance(other, int):
            found = self.is_int & (self.integer == F.lit(other)) if -(1 << 63) <= other < 1 << 63 else F.lit(False)
        elif kind == NUMBER:
            found = self.is_float & (self.number == F.lit(other))
        else:
            compacted = json.dumps(other, ensure_ascii=False)
            found = (self.is_list | self.is_object) & (_nested(self.name, lambda v: json.dumps(v, ensure_ascii=False))(F.when(self.is_list | self.is_object, self.data)) == compacted)
        return F.coalesce(found, F.lit(False))

    def over(self, other: object) -> Column:
        """Whether the value is greater."""
        return self._beside(other, lambda a, b: a > b, lambda a, b: a > b)

    def under(self, other: object) -> Column:
        return self._beside(other, lambda a, b: a < b, lambda a, b: a < b)

    def _beside(self, other: object, ranks, same) -> Column:
        kind = rank(other)
        if kind == STRING:
            alike = same(self.string, F.lit(other))
        elif kind == NUMBER:
            alike = same(self.number, F.lit(float(other)))
            if isinstance(other, int) and -(1 << 63) <= other < 1 << 63:
                alike = F.when(self.is_int, same(self.integer, F.lit(other))).otherwise(alike)
        elif kind in (LIST, OBJECT):
            alike = same(self.text(), F.lit(pretty({"value": other})))
        else:
            alike = F.lit(False)
        mine = self.rank()
        return self.exists & (ranks(mine, F.lit(kind)) | ((mine == kind) & F.coalesce(alike, F.lit(False))))


def with_fields(names: list[str], data: Column, build) -> Column:
    """build(fields by name) with the text parsed, and each field taken and described, once a row.

    A filter evaluates what it repeats; binding the parsed value to a lambda's argument does not. Functions in Python
    cannot stand in a lambda."""
    parsed = F.array(F.parse_json(data))
    taken = F.transform(parsed, lambda v: F.struct(*[member(v, n).alias(f"x{i}") for i, n in enumerate(names)]))
    kinds = F.transform(taken, lambda s: F.struct(s.alias("s"), *[F.schema_of_variant(s[f"x{i}"]).alias(f"k{i}") for i in range(len(names))]))
    found = F.transform(kinds, lambda b: build({n: Field(n, data, b["s"][f"x{i}"], b[f"k{i}"]) for i, n in enumerate(names)}))
    return F.get(found, F.lit(0))
