"""Framed log lines: byte length, xxh32 of the JSON, and the JSON, parted by tabs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


def frame(json_text: str) -> str:
    raw = json_text.encode()
    return f"{len(raw)}\t{xxhash.xxh32_hexdigest(raw)}\t{json_text}\n"


def unframe(line: str) -> str | None:
    """The JSON of a line, or None if length or checksum do not hold."""
    parts = line.rstrip("\n").split("\t", 2)
    if len(parts) < 3 or not (parts[0].isascii() and parts[0].isdigit()):
        return None
    raw = parts[2].encode()
    return parts[2] if int(parts[0]) == len(raw) and parts[1].lower() == xxhash.xxh32_hexdigest(raw) else None


def _sums(text: Column) -> Column:
    def sums(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: None if t is None else xxhash.xxh32_hexdigest(t.encode()))

    sums.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(sums, "string")(text)


def framed_column(text: Column) -> Column:
    """The line of each JSON text, without the newline that a text file puts behind it."""
    return F.concat_ws("\t", F.octet_length(text).cast("string"), _sums(text), text)


def unframed_column(line: Column) -> Column:
    """The JSON of each line, null where the frame is broken. Lengths are compared in the JVM; only checksums need Python."""
    parts = F.split(line, "\t", 3)
    size, claimed, body = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    whole = size.rlike(r"\A[0-9]+\z") & (F.octet_length(body) == size.try_cast("int"))
    return F.when(whole & (F.lower(claimed) == _sums(body)), body)
