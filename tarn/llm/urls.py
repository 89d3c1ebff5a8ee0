"""URL rules by a sorted array of digests (operator 5).

A rule is a host and a path prefix; it fits the host itself and its subdomains, and the longest rule that fits a URL
decides. The rule strings are stored in one file: their sorted 64-bit xxhash keys, each string's place, its verdict, and
the strings. Tasks memory-map the file from the shared folder, form every host suffix and path prefix of a rule's length
that a URL has, look all of them up by one vectorised binary search, and compare the stored string at each hit, so a
collision of digests never decides. The list may hold any number of rules: it is mapped and never copied to a task, and
URLs are neither shuffled nor joined.

Defined results: a URL that is null or has no '://' has an empty host and path and no rule; where no rule fits, the
verdict is `default`; a repeated rule keeps its last verdict, so two rules that fit a URL never have one length of host and
path each, and of those with one total length the longer host decides; URLs of any length are judged whole; repeated rows
give repeated results; an empty table gives no rows, and without rules every URL gets the default; other columns pass by
unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import read_file, shared_folder, write_file

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT = "allow"
VERDICTS = ("allow", "block")
HOST, PATH = re.compile(r"[^/?#]*"), re.compile(r"[^?#]*")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


class Digests:
    """The rules' file: rules, distinct path lengths, keys, ends of strings, verdicts, path lengths, strings."""

    def __init__(self, raw: memoryview):
        n, m = np.frombuffer(raw[:16], "<i8").tolist()
        at = 16
        views = []
        for count, kind in ((n, "<u8"), (n, "<u8"), (m, "<i8"), (n, "u1")):
            size = count * np.dtype(kind).itemsize
            views.append(np.frombuffer(raw[at : at + size], kind))
            at += size
        self.keys, self.ends, self.lengths, self.verdicts = views
        self.strings = raw[at:]

    @staticmethod
    def to_bytes(rules: Iterable[tuple[str, str, str]]) -> bytes:
        kept = sorted((digest(s), s, VERDICTS.index(v)) for s, v in {h.translate(LOWER) + p: v for h, p, v in rules}.items())
        lengths = sorted({len(p) for _, p, _ in rules})
        strings = [s.encode() for _, s, _ in kept]
        head = np.array([len(kept), len(lengths)], "<i8").tobytes()
        keys = np.array([k for k, _, _ in kept], "<u8").tobytes()
        ends = np.cumsum([len(s) for s in strings], dtype=np.uint64).astype("<u8").tobytes()
        return head + keys + ends + np.array(lengths, "<i8").tobytes() + np.array([v for _, _, v in kept], "u1").tobytes() + b"".join(strings)

    def string(self, i: int) -> str:
        return bytes(self.strings[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])]).decode()

    def find(self, texts: list[str]) -> list[int]:
        """The place of each text among the rules, or -1."""
        keys = np.array([digest(t) for t in texts], np.uint64)
        at = np.searchsorted(self.keys, keys)
        out = []
        for text, i, key in zip(texts, at.tolist(), keys.tolist(), strict=True):
            while i < len(self.keys) and int(self.keys[i]) == key and self.string(i) != text:
                i += 1
            out.append(i if i < len(self.keys) and int(self.keys[i]) == key else -1)
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path), both empty without '://'."""
    _, sign, rest = (url or "").partition("://")
    host = HOST.match(rest)[0] if sign else ""
    return host.translate(LOWER), PATH.match(rest[len(host) :])[0] if sign else ""


def suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def judged(urls: list[str | None], digests: Digests, default: str) -> tuple[list[str], list[str], list[str | None], list[str]]:
    """Host, path, rule and verdict of every URL."""
    parts = [split_url(u) for u in urls]
    texts, of = [], []
    for i, (host, path) in enumerate(parts):
        prefixes = [path[:n] for n in digests.lengths.tolist() if n <= len(path)]
        own = [s + p for s in suffixes(host) for p in prefixes] if host else []
        texts += own
        of += [i] * len(own)
    rules: list[str | None] = [None] * len(urls)
    verdicts = [default] * len(urls)
    for i, text, at in zip(of, texts, digests.find(texts) if texts else [], strict=True):
        if at >= 0 and len(text) > len(rules[i] or ""):
            rules[i], verdicts[i] = text, VERDICTS[int(digests.verdicts[at])]
    return [h for h, _ in parts], [p for _, p in parts], rules, verdicts


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    file = f"{shared_folder(pages.sparkSession, 'url-rules')}/digests"
    write_file(file, Digests.to_bytes(list(rules)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(read_file(file))
        for batch in batches:
            columns = judged(batch.column(1).to_pylist(), digests, default)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "verdict"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return chosen.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
