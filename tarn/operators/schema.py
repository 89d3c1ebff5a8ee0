"""Optional schemas: typed fields, flags, and validation of records in one pass."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.values import Field, with_fields

TYPES = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean", "mixed": "variant"}


class SchemaError(ValueError):
    """A record that its schema does not allow."""


@dataclass(frozen=True)
class SchemaField:
    type: str
    required: bool = False
    index: bool = False
    unique: bool = False
    range: bool = False

    def indexed(self) -> bool:
        return self.index or self.unique or self.range


@dataclass(frozen=True)
class Schema:
    """Fields of a collection by name. Declaring a field again changes its type and keeps its flags; undeclared fields are free."""

    collection: str
    fields: dict[str, SchemaField] = field(default_factory=dict)

    def _declared(self, name: str, kind: str, **flags: bool) -> Schema:
        old = self.fields.get(name, SchemaField(kind))
        return replace(self, fields={**self.fields, name: replace(old, type=kind, **flags)})

    def string(self, name: str, **flags: bool) -> Schema:
        return self._declared(name, "string", **flags)

    def int(self, name: str, **flags: bool) -> Schema:
        return self._declared(name, "int", **flags)

    def float(self, name: str, **flags: bool) -> Schema:
        return self._declared(name, "float", **flags)

    def bool(self, name: str, **flags: bool) -> Schema:
        return self._declared(name, "bool", **flags)

    def mixed(self, name: str, **flags: bool) -> Schema:
        return self._declared(name, "mixed", **flags)

    def required(self, names: Iterable[str]) -> Schema:
        """Marks fields required; a field not declared yet becomes a mixed one."""
        fields = dict(self.fields)
        for name in names:
            fields[name] = replace(fields.get(name, SchemaField("mixed")), required=True)
        return replace(self, fields=fields)

    def validate(self, data: dict) -> None:
        """Raises for the first field that is missing or of another type; an explicit null satisfies both."""
        kinds = {"string": (str,), "int": (int,), "float": (int, float), "bool": (bool,)}
        for name, f in self.fields.items():
            if f.required and name not in data:
                raise SchemaError(f"{self.collection}.{name} is required")
            value = data.get(name)
            if value is None or f.type == "mixed":
                continue
            if not isinstance(value, kinds[f.type]) or (isinstance(value, bool) and f.type != "bool"):
                raise SchemaError(f"{self.collection}.{name} is not of type {f.type}")

    def violations(self, frame: DataFrame) -> Column:
        """An array of messages for each record (JSON text in `data`): empty where it is valid."""
        checked = {n: f for n, f in self.fields.items() if f.required or f.type != "mixed"}
        if not checked:
            return F.array().cast("array<string>")

        def build(fields: dict[str, Field]) -> Column:
            found = []
            for name, f in checked.items():
                x = fields[name]
                if f.required:
                    found.append(F.when(~x.exists, F.lit(f"{name} is required")))
                fits = {"string": x.is_string, "int": x.is_int, "float": x.is_int | x.is_float, "bool": x.is_bool}.get(f.type)
                if fits is not None:
                    found.append(F.when(x.exists & ~F.coalesce(x.is_null, F.lit(False)) & ~F.coalesce(fits, F.lit(False)), F.lit(f"{name} is not of type {f.type}")))
            return F.array_compact(F.array(*found))

        return with_fields(list(checked), F.col("data"), build)

    def invalid(self, frame: DataFrame) -> DataFrame:
        """The records that break the schema, with their messages in `errors`."""
        return frame.withColumn("errors", self.violations(frame)).where(F.size("errors") > 0)

    def duplicates(self, frame: DataFrame) -> DataFrame:
        """field, value and n of every value that two records share in a unique field; two explicit nulls count, lists do not."""
        out = []
        for name, f in self.fields.items():
            if f.unique:
                x = Field(name, F.col("data"))
                scalar = x.exists & ~x.is_list & ~x.is_object
                # 1.5 and 1.5e0 are one float whatever type their text parses to; 1 and 1.0 differ
                kind = F.when(x.is_string, "string").when(x.is_int, "int").when(x.is_float, "float").when(x.is_bool, "bool").otherwise("null")
                value = F.concat_ws(":", kind, F.coalesce(x.string, x.integer.cast("string"), (x.number + F.lit(0.0)).cast("string"), x.boolean.cast("string"), F.lit("null")))
                out.append(frame.where(scalar).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(name).alias("field"), "value", "n"))
        return reduce(DataFrame.unionAll, out) if out else frame.sparkSession.createDataFrame([], "field string, value string, n long")

    def typed(self, frame: DataFrame, booleans: str = "boolean") -> DataFrame:
        """id, the declared columns but mixed ones, and data. A value of another type is null; an int counts as a float."""
        columns = []
        for name, f in self.fields.items():
            x = Field(name, F.col("data"))
            value = {"string": x.string, "int": x.integer, "float": x.number, "bool": x.boolean}.get(f.type)
            if value is not None:
                columns.append((value.cast("int") if f.type == "bool" and booleans == "int" else value).alias(name))
        return frame.select("id", *columns, "data")
