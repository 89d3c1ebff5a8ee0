"""JSON with comments and trailing commas: decoded strictly where it is strict, stripped first where it is not."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class JsoncError(ValueError):
    """A text whose root is not an object, or that is no JSON with comments."""


def strip(text: str) -> str:
    """The text without comments and without commas before a closing bracket; strings stay as they are."""
    out: list[str] = []
    at, n, comma = 0, len(text), None
    while at < n:
        c = text[at]
        if c == '"':
            end = at + 1
            while end < n and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            out.append(text[at : end + 1])
            at, comma = end + 1, None
        elif text.startswith("//", at):
            ends = [e for e in (text.find("\n", at), text.find("\r", at)) if e >= 0]
            at = min(ends, default=n)
        elif text.startswith("/*", at):
            end = text.find("*/", at + 2)
            if end < 0:
                raise JsoncError("a comment does not end")
            out.append(" ")
            at = end + 2
        else:
            if c in "]}" and comma is not None:
                out[comma] = ""
            if c == ",":
                comma = len(out)
            elif not c.isspace():
                comma = None
            out.append(c)
            at += 1
    return "".join(out)


def decode(text: str) -> dict:
    """The object that the text holds."""
    try:
        value = json.loads(text)
    except ValueError:
        try:
            value = json.loads(strip(text))
        except ValueError as e:
            raise JsoncError(str(e)) from e
    if not isinstance(value, dict):
        raise JsoncError("the root is not an object")
    return value


def compact(value: object) -> str:
    """One line, nothing escaped that need not be; 1.0 stays 1.0 and keys keep their order."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def pretty(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, indent=4)


def canonical_column(text: Column) -> Column:
    """Each text decoded and written compactly; null where it holds no object. Only comments and commas need Python."""

    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else compact(decode(t))
            except JsoncError:
                return None

        for part in parts:
            yield part.map(one)

    clean.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(clean, "string")(text)
