"""Time-sortable UUID version 7 ids: made on the driver, read and bounded as Columns."""

from __future__ import annotations

import os
import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_MS = 0xFFFFFFFFFFFF
PATTERN = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
_VALID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", re.I)


class IdError(ValueError):
    """An id or a time that no UUID version 7 can have."""


class Uuid7:
    """A generator whose ids ascend within a process: ids of one millisecond count up from random bits."""

    def __init__(self) -> None:
        self._ms, self._low = -1, 0

    def __call__(self, ms: int | None = None) -> str:
        now = int(time.time() * 1000) if ms is None else ms
        if not 0 <= now <= MAX_MS:
            raise IdError(f"milliseconds out of range: {now}")
        # the 74 bits beside time, version and variant are one number
        self._low = self._low + 1 if now == self._ms else int.from_bytes(os.urandom(10)) >> 7
        self._ms, low = now, self._low & ((1 << 74) - 1)
        number = now << 80 | 7 << 76 | (low >> 62) << 64 | 2 << 62 | (low & ((1 << 62) - 1))
        text = f"{number:032x}"
        return "-".join((text[:8], text[8:12], text[12:16], text[16:20], text[20:]))


def is_valid(text: str) -> bool:
    return bool(_VALID.fullmatch(text))


def checked(text: str) -> str:
    if not is_valid(text):
        raise IdError(f"not a UUID version 7: {text!r}")
    return text


def timestamp_ms(text: str) -> int:
    return int(checked(text)[:8] + text[9:13], 16)


def bounds(ms: int) -> tuple[str, str]:
    """The least and the greatest id of a millisecond."""
    if not 0 <= ms <= MAX_MS:
        raise IdError(f"milliseconds out of range: {ms}")
    time_part = f"{ms:012x}"
    head = f"{time_part[:8]}-{time_part[8:]}"
    return f"{head}-7000-8000-000000000000", f"{head}-7fff-bfff-ffffffffffff"


# Columns.
def valid_column(id_: Column) -> Column:
    return F.coalesce(id_.rlike(PATTERN), F.lit(False))


def ms_column(id_: Column) -> Column:
    return F.conv(F.concat(F.substring(id_, 1, 8), F.substring(id_, 10, 4)), 16, 10).cast("long")


def shard_column(id_: Column) -> Column:
    """One of 256 buckets, from the first two characters of the last group."""
    return F.substring(id_, 25, 2)


def day_column(id_: Column) -> Column:
    """The UTC day, whatever the session's time zone is."""
    return F.date_add(F.lit("1970-01-01").cast("date"), (ms_column(id_) / 86_400_000).cast("int")).cast("string")


def month_column(id_: Column) -> Column:
    return F.substring(day_column(id_), 1, 7)


def made_column(ms: Column, number: Column) -> Column:
    """An id from milliseconds and a number that is unique among them."""
    return F.format_string("%08x-%04x-7000-8000-%012x", (ms / 65536).cast("long"), ms % 65536, number)
