"""Removal of repeated strings by a suffix index that grows column by column (operator 7).

A byte is removed if some string of LENGTH bytes that covers it also starts earlier, in a document before or in its own.

1. Every LENGTH-byte window has a minimizer, its SEED-byte window with the least hash (the first of equals), which depends
   on the window's bytes alone. Consecutive windows with the same minimizer form a fragment; equal windows lie in
   fragments whose minimizers are equal, so fragments are dealt by their minimizer and no pair of windows is parted.
2. Of fragments that are equal as a whole, all but the first are removed whole. A minimizer that is left with one
   fragment is done; that settles most of the text. Each task does so for its own fragments before it sends them on.
3. The bytes of the other fragments are fetched from the texts and cut to what, to either side of the minimizer, occurs
   twice; those in which a window still fits go on. Each batch of them is indexed as a collection: starting from the empty suffixes, each round puts one more symbol
   before every fragment's suffix, from its last byte to its first. The new suffixes' places follow from the ranks of their
   symbols in the collection's Burrows-Wheeler transform, and the common prefix with their neighbours from the least one
   between two occurrences of the symbol. Transform and common prefixes live in two files that are read and written from
   start to end each round, in the shared folder. A run of common prefixes of LENGTH or more is a set of equal windows; all
   but the first are removed.
4. A minimizer with more than MOST fragments is not indexed in one place: its windows are dealt by their own hashes, each
   task's repeats counted once.

Texts are shuffled by document twice, for 3 and for the result; the rest travels as binary blocks. Strings are told apart
by 64-bit hashes in 1, 2 and 4, and by their bytes in 3.

Defined results: a null or empty text has no bytes; rows are ordered by doc_id, nulls first, and rows of one id by their
text, each row counting as a document of its own; a text of any length is read in pieces that overlap by a window; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import MIX_A, U64, Rolling, filesystem, flat, keep, mixed, repeated, shared_folder, slices

LENGTH, SEED = 100, 32
PIECE, FLUSH, BATCH, MOST = 1 << 20, 1 << 20, 30_000, 20_000
#: The step in which a fragment's reach beside its minimizer is told.
STEP = 4
PLACE_BITS = U64(24)
BYTE_HASH = mixed(np.arange(1, 257, dtype=U64) * MIX_A)
#: Columns of the blocks: fragments by minimizer, fragments to fetch, fragments with their bytes, windows, removed spans.
FRAGMENTS = {"m": "<u8", "h": "<u8", "row": "<i8", "start": "<u4", "size": "u1", "at": "u1"}
WANTED = {"m": "<u8", "row": "<i8", "start": "<u4", "size": "u1", "at": "u1", "many": "u1"}
BYTES = {"m": "<u8", "row": "<i8", "start": "<u4", "size": "u1", "at": "u1"}
WINDOWS = {"h": "<u8", "row": "<i8", "start": "<u4"}
SPANS = {"row": "<i8", "start": "<u4", "end": "<u4"}
KINDS = {"fragments": FRAGMENTS, "wanted": WANTED, "bytes": BYTES, "windows": WINDOWS, "spans": SPANS}
SCHEMA = "bucket long, kind string, n long, data binary, more binary"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
Columns = dict[str, np.ndarray]


def stacked(parts: list[Columns]) -> Columns:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def taken(columns: Columns, at: np.ndarray) -> Columns:
    return {k: v[at] for k, v in columns.items()}


def blocks(kind: str, columns: Columns, key: np.ndarray, buckets: int, sizes: np.ndarray | None = None, content: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows of a block each bucket, its columns one after the other; content has the bytes of all rows in order."""
    bucket = (mixed(key.astype(U64)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    if sizes is not None:
        ends = np.cumsum(sizes)
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[b] : cuts[b + 1]]
        more = None
        if sizes is not None:
            own = sizes[at]
            to = np.cumsum(own)
            more = content[np.arange(to[-1]) + np.repeat(ends[at] - own - to + own, own)].tobytes()
        yield b, kind, len(at), b"".join(columns[c][at].astype(t).tobytes() for c, t in KINDS[kind].items()), more


def opened(kind: str, n: int, data: bytes) -> Columns:
    out, at = {}, 0
    for c, t in KINDS[kind].items():
        out[c] = np.frombuffer(data, t, n, at)
        at += n * np.dtype(t).itemsize
    return out


def batches_of(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows as Arrow batches of bounded size."""
    held, size = [], 0
    types = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=NAMES)

    for row in rows:
        held.append(row)
        size += len(row[3]) + len(row[4] or b"")
        if size > 8 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def fragments(data: np.ndarray, offsets: np.ndarray) -> Columns:
    """The fragments of the texts; `text` is the text's number and `start` the place in it."""
    width = LENGTH - SEED + 1
    rolling = Rolling(BYTE_HASH[data])
    hashes = rolling.windows(SEED)
    if len(hashes) < width:
        return {k: np.zeros(0, np.int64) for k in ("m", "h", "text", "start", "size", "at")}
    least = (hashes >> PLACE_BITS << PLACE_BITS) | np.arange(len(hashes), dtype=U64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    least = np.minimum(least[: len(hashes) - width + 1], least[rest : rest + len(hashes) - width + 1])
    place = (least & ((U64(1) << PLACE_BITS) - U64(1))).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int64)
    sizes = np.diff(offsets)
    enough = sizes >= LENGTH
    np.add.at(inside, offsets[:-1][enough], 1)
    np.add.at(inside, offsets[1:][enough] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[: len(place)] > 0)
    text = np.searchsorted(offsets, at, side="right") - 1
    new = np.flatnonzero(np.r_[True, (place[at][1:] != place[at][:-1]) | (text[1:] != text[:-1])]) if len(at) else np.zeros(0, np.int64)
    start, last = at[new], at[np.r_[new[1:], len(at)] - 1] if len(at) else at
    return {"m": hashes[place[start]], "h": rolling.spans(start, last + LENGTH), "text": text[new], "start": start - offsets[text[new]], "size": last + LENGTH - start, "at": place[start] - start}


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, place in it, bytes, offsets): runs of whole texts, or an overlapping piece of a long one."""
    data, offsets = flat(column)
    first = 0
    for text in [*np.flatnonzero(np.diff(offsets) > 4 * PIECE).tolist(), len(column)]:
        if text > first:
            yield first, 0, data[offsets[first] : offsets[text]], offsets[first : text + 1] - offsets[first]
        first = text + 1
        if text == len(column):
            return
        whole = data[offsets[text] : offsets[text + 1]]
        for at in range(0, len(whole), PIECE):
            part = whole[at : at + PIECE + LENGTH - 1]
            yield text, at, part, np.array([0, len(part)])


def later(keys: list[np.ndarray], columns: Columns) -> tuple[np.ndarray, np.ndarray]:
    """(order, which of the ordered rows equal the one before in all keys); of equal ones the earliest place comes first."""
    order = np.lexsort((columns["start"], columns["row"], *keys[::-1]))
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    return order, same


def as_spans(columns: Columns, sizes: np.ndarray | int) -> Columns:
    """Removed spans, those that touch in one row made one."""
    start = columns["start"].astype(np.int64)
    order = np.lexsort((start, columns["row"]))
    row, start, end = columns["row"][order], start[order], (start + sizes)[order]
    if not len(row):
        return {"row": row, "start": start, "end": end}
    # ends never fall within a row, once the greatest so far is taken; rows are kept apart by a large step
    group = np.cumsum(np.r_[False, row[1:] != row[:-1]])
    reach = np.maximum.accumulate(end + group * (1 << 33)) - group * (1 << 33)
    new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] > reach[:-1])]
    first = np.flatnonzero(new)
    return {"row": row[first], "start": start[first], "end": reach[np.r_[first[1:], len(row)] - 1]}


class Collection:
    """The Burrows-Wheeler transform and common prefixes of a collection of strings, built column by column.

    Files hold one byte a suffix, in the suffixes' order: the symbol before it (0 before a whole string), and the length
    that it shares with the suffix before, at most 255."""

    def __init__(self, content: np.ndarray, sizes: np.ndarray, folder: str):
        self.files, self.path = filesystem(f"{folder}/{uuid.uuid4().hex}")
        self.files.create_dir(self.path, recursive=True)
        known = np.unique(content)
        code = np.zeros(256, np.uint8)
        code[known] = np.arange(1, len(known) + 1)  # UTF-8 has no more than 243 different bytes
        self.content, self.sizes, self.n = code[content], sizes, len(sizes)
        self.begin = np.cumsum(sizes) - sizes
        try:
            self._build()
        finally:
            self.files.delete_dir(self.path)

    def _read(self, name: str) -> np.ndarray:
        with self.files.open_input_stream(f"{self.path}/{name}", compression=None) as f:
            return np.frombuffer(f.read(), np.uint8)

    def _write(self, name: str, values: np.ndarray) -> None:
        with self.files.open_output_stream(f"{self.path}/{name}", compression=None) as f:
            f.write(pa.py_buffer(values))

    def _build(self) -> None:
        n = self.n
        self._write("symbols", self.content[self.begin + self.sizes - 1])
        self._write("common", np.zeros(n, np.uint8))
        strings, place = np.arange(n), np.arange(n)  # of the strings that go on: in order of the places of their suffixes
        for length in range(1, int(self.sizes.max()) + 1):
            symbols, common = self._read("symbols"), self._read("common")
            order = np.argsort(symbols, kind="stable")
            ended = int(np.searchsorted(symbols[order[: 4 * n]], 1)) if len(order) else 0
            fresh = np.zeros(len(symbols), bool)
            fresh[place] = True
            rank = np.flatnonzero(fresh[order])  # of the new suffixes among all occurrences, in the new order
            strings = strings[np.searchsorted(place, order[rank])]
            place = n + rank - ended
            # common prefixes of the new suffixes and of those after them: one more than the least between two occurrences
            touched = np.unique(np.r_[rank, rank[rank + 1 < len(order)] + 1])
            touched = touched[touched >= ended]
            before = np.maximum(touched - 1, 0)
            alike = (touched > ended) & (symbols[order[before]] == symbols[order[touched]])
            value = np.zeros(len(touched), np.int64)
            value[alike] = 1 + self._least(common, order[before[alike]] + 1, order[touched[alike]])
            left = self.sizes[strings] > length
            new = np.where(left, self.content[np.where(left, self.begin[strings] + self.sizes[strings] - length - 1, 0)], 0).astype(np.uint8)
            old = np.ones(len(symbols) + len(place), bool)
            old[place] = False
            grown, shared = np.empty(len(old), np.uint8), np.zeros(len(old), np.uint8)
            grown[old], grown[place], shared[old] = symbols, new, common
            shared[n + touched - ended] = np.minimum(value, 255)
            self._write("symbols", grown)
            self._write("common", shared)
            strings, place = strings[left], place[left]
            if not len(strings):
                break
        self.symbols, self.common = self._read("symbols"), self._read("common")

    @staticmethod
    def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of values[first..last] for each pair, by minima over spans that double."""
        level = np.frexp(last - first + 1)[1] - 1
        out, table = np.zeros(len(first), np.int64), values
        order = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[order], np.arange(int(level.max(initial=0)) + 2))
        for k in range(len(cuts) - 1):
            at = order[cuts[k] : cuts[k + 1]]
            out[at] = np.minimum(table[first[at]], table[last[at] + 1 - (1 << k)])
            if k + 2 < len(cuts):
                table = np.minimum(table[: -(1 << k)], table[1 << k :])
        return out

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set of equal windows, string, place in it) of every window that has an equal one."""
        order = np.argsort(self.symbols, kind="stable")
        ended = int((self.symbols == 0).sum())
        follow = np.zeros(len(order), np.int32)
        follow[order[ended:]] = self.n + np.arange(len(order) - ended)
        group = np.cumsum(self.common < length)
        # only suffixes beside one with a long common prefix have equals
        near = self.common >= length
        near[:-1] |= near[1:]
        found, strings, at = [], np.arange(self.n), np.arange(self.n)
        for size in range(1, int(self.sizes.max()) + 1):
            go = self.sizes[strings] >= size
            strings, at = strings[go], follow[at[go]]
            if size >= length:
                good = near[at]
                found.append((group[at[good]], strings[good], self.sizes[strings[good]] - size))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def reach(rolling: Rolling, seed: np.ndarray, room: np.ndarray, side: int) -> np.ndarray:
    """How far beside each fragment's minimizer another one may be equal: the bytes up to the first step at which none is."""
    out, alive = np.full(len(seed), STEP - 1), np.arange(len(seed))
    for far in range(STEP, LENGTH - SEED + STEP, STEP):
        alive = alive[room[alive] >= far]
        at = seed[alive]
        alive = alive[repeated(rolling.spans(at - far, at + SEED) if side < 0 else rolling.spans(at, at + SEED + far))]
        out[alive] = far + STEP - 1
    return np.minimum(out, room)


def equal_windows(columns: Columns, content: np.ndarray, folder: str) -> Columns:
    """The removed spans among fragments that share minimizers."""
    sizes, seed = columns["size"].astype(np.int64), columns["at"].astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    rolling = Rolling(BYTE_HASH[content])
    # a fragment is cut to what may be equal elsewhere, and goes on if a window fits
    left = reach(rolling, begin + seed, seed, -1)
    right = reach(rolling, begin + seed, sizes - seed - SEED, 1)
    begin, sizes = begin + seed - left, left + SEED + right
    starts = columns["start"].astype(np.int64) + seed - left
    at = np.flatnonzero(sizes >= LENGTH)
    at = at[np.argsort(columns["m"][at], kind="stable")]
    out = []
    while len(at):
        cut = min(BATCH, len(at))
        cut = int(np.searchsorted(columns["m"][at], columns["m"][at[cut - 1]], side="right"))
        own, at = at[:cut], at[cut:]
        ends = np.cumsum(sizes[own])
        part = content[np.arange(ends[-1]) + np.repeat(begin[own] - ends + sizes[own], sizes[own])]
        group, string, place = Collection(part, sizes[own], folder).windows(LENGTH)
        found = {"row": columns["row"][own][string], "start": starts[own][string] + place}
        order, same = later([group], found)
        out.append(as_spans(taken(found, order[same]), LENGTH))
    return stacked(out) if out else {"row": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "end": np.zeros(0, np.int64)}


# The distributed steps. A row's number stands for its document: it orders documents and is unique.
def numbered(documents: DataFrame) -> DataFrame:
    """row, doc_id and text. The number is doc_id itself where ids are unique and none is null; else a rank."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    unique = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty()
    if unique:
        return rows.select(F.col("doc_id").alias("row"), "doc_id", "text")
    order = (F.col("doc_id").asc_nulls_first(), F.col("text").asc())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, n + batch.num_rows) + part), *batch.columns], names=["row", "doc_id", "text"])
            n += batch.num_rows

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return keep(dealt.mapInArrow(count, "row long, doc_id long, text string"), "rows")


def fragment_blocks(rows: DataFrame, buckets: int) -> DataFrame:
    """Fragments by minimizer; of a task's equal ones the first, the others as removed spans."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []

        def flush() -> Iterator[tuple]:
            columns = stacked(held)
            held.clear()
            order, same = later([columns["m"], columns["h"]], columns)
            gone, first = taken(columns, order[same]), taken(columns, np.sort(order[~same]))
            spans = as_spans(gone, gone["size"])
            yield from blocks("fragments", first, first["m"], buckets)
            yield from blocks("spans", spans, spans["row"], buckets)

        def all_rows() -> Iterator[tuple]:
            for batch in batches:
                for part, column in slices(batch, most=PIECE):
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    for text, place, data, offsets in pieces(column):
                        found = fragments(data, offsets)
                        text = found.pop("text") + text
                        held.append(found | {"row": ids[text], "start": found["start"] + place})
                    if sum(len(h["m"]) for h in held) > FLUSH:
                        yield from flush()
            if held:
                yield from flush()

        yield from batches_of(all_rows())

    return rows.select("row", "text").mapInArrow(run, SCHEMA)


def gathered(batches: Iterable[pa.RecordBatch]) -> tuple[dict[str, Columns], list[bytes]]:
    """The partition's blocks by kind, and the bytes that came with them."""
    parts, more = defaultdict(list), []
    for batch in batches:
        for _, kind, n, data, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts[kind].append(opened(kind, n, data))
            if content:
                more.append(content)
    return {k: stacked(v) for k, v in parts.items()}, more


def meet(blocks_by_minimizer: DataFrame, buckets: int, most: int) -> DataFrame:
    """Removed spans of equal fragments, and the fragments whose bytes are wanted, by document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, _ = gathered(batches)

        def rows() -> Iterator[tuple]:
            if "spans" in found:
                yield from blocks("spans", found["spans"], found["spans"]["row"], buckets)
            if "fragments" not in found:
                return
            columns = found["fragments"]
            twice = repeated(columns["m"])
            columns = taken(columns, np.flatnonzero(twice))
            order, same = later([columns["m"], columns["h"]], columns)
            gone, first = taken(columns, order[same]), taken(columns, order[~same])
            spans = as_spans(gone, gone["size"])
            yield from blocks("spans", spans, spans["row"], buckets)
            start = np.flatnonzero(np.r_[True, first["m"][1:] != first["m"][:-1]]) if len(first["m"]) else np.zeros(0, np.int64)
            count = np.diff(np.r_[start, len(first["m"])])
            many = np.repeat(count, count)
            first["many"] = many > most
            wanted = taken(first, np.flatnonzero(many > 1))
            yield from blocks("wanted", wanted, wanted["row"], buckets)

        yield from batches_of(rows())

    return blocks_by_minimizer.repartition(int(blocks_by_minimizer.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket").mapInArrow(run, SCHEMA)


MIXED = SCHEMA + ", row long, doc_id long, text string"


def with_texts(rows: DataFrame, blocks_by_row: DataFrame, buckets: int) -> DataFrame:
    """The blocks and the documents of a bucket in one partition, blocks first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            bucket = (mixed(batch.column(0).to_numpy(zero_copy_only=False).astype(U64)) % U64(buckets)).astype(np.int64)
            empty = [pa.array([None] * n, t) for t in (pa.string(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *empty, *batch.columns], names=[*NAMES, *batch.schema.names])

    texts = rows.select("row", "doc_id", "text").mapInArrow(run, MIXED)
    marks = blocks_by_row.selectExpr(*NAMES, "cast(null as long) row", "cast(null as long) doc_id", "cast(null as string) text")
    dealt = texts.unionAll(marks).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket")
    return dealt.sortWithinPartitions("bucket", F.col("kind").asc_nulls_last())


class ByRow:
    """Blocks that came before their documents, looked up by the documents' numbers."""

    def __init__(self, kind: str):
        self.kind, self.parts, self.columns = kind, [], None

    def add(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Takes the blocks of a batch and returns its documents."""
        block = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        for n, data in zip(batch.column(2).filter(pa.array(block)).to_pylist(), batch.column(3).filter(pa.array(block)).to_pylist(), strict=True):
            self.parts.append(opened(self.kind, n, data))
        if block.any():
            self.columns = None
        return batch.filter(pa.array(~block)).select(["row", "doc_id", "text"])

    def of(self, ids: np.ndarray) -> tuple[Columns, np.ndarray, np.ndarray]:
        """(columns ordered by row, first of each id, end of each id)."""
        if self.columns is None:
            dtypes = KINDS[self.kind]
            columns = stacked(self.parts) if self.parts else {c: np.zeros(0, t) for c, t in dtypes.items()}
            self.columns = taken(columns, np.lexsort((columns["start"], columns["row"])))
            self.parts = [self.columns]
        row = self.columns["row"]
        return self.columns, np.searchsorted(row, ids), np.searchsorted(row, ids, side="right")


def fetched(dealt: DataFrame, buckets: int) -> DataFrame:
    """The wanted fragments with their bytes, or their windows' hashes where a minimizer has too many, by minimizer or hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = ByRow("wanted")

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for part, column in slices(marks.add(batch)):
                    data, offsets = flat(column)
                    columns, low, high = marks.of(part.column(0).to_numpy(zero_copy_only=False))
                    count = high - low
                    ends = np.cumsum(count)
                    if not len(ends) or not ends[-1]:
                        continue
                    own = taken(columns, np.arange(ends[-1]) + np.repeat(low - ends + count, count))
                    begin = np.repeat(offsets[:-1], count) + own["start"]
                    few, size = np.flatnonzero(own["many"] == 0), own["size"].astype(np.int64)
                    if len(few):
                        to = np.cumsum(size[few])
                        content = data[np.arange(to[-1]) + np.repeat(begin[few] - to + size[few], size[few])]
                        yield from blocks("bytes", taken(own, few), own["m"][few], buckets, size[few], content)
                    if len(few) < len(size):
                        many = np.flatnonzero(own["many"])
                        n = size[many] - LENGTH + 1
                        to = np.cumsum(n)
                        step = np.arange(to[-1]) - np.repeat(to - n, n)
                        hashes = Rolling(BYTE_HASH[data]).spans(np.repeat(begin[many], n) + step, np.repeat(begin[many], n) + step + LENGTH)
                        found = {"h": hashes, "row": np.repeat(own["row"][many], n), "start": np.repeat(own["start"][many].astype(np.int64), n) + step}
                        order, same = later([found["h"]], found)
                        spans, first = as_spans(taken(found, order[same]), LENGTH), taken(found, order[~same])
                        yield from blocks("windows", first, first["h"], buckets)
                        yield from blocks("spans", spans, spans["row"], buckets)

        yield from batches_of(rows())

    return dealt.mapInArrow(run, SCHEMA)


def indexed(blocks_by_minimizer: DataFrame, buckets: int, folder: str) -> DataFrame:
    """The removed spans that the suffix index and the windows' hashes find, by document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, more = gathered(batches)

        def rows() -> Iterator[tuple]:
            parts = [found["spans"]] if "spans" in found else []
            if "bytes" in found:
                parts.append(equal_windows(found["bytes"], np.frombuffer(b"".join(more), np.uint8), folder))
            if "windows" in found:
                order, same = later([found["windows"]["h"]], found["windows"])
                parts.append(as_spans(taken(found["windows"], order[same]), LENGTH))
            for spans in parts:
                yield from blocks("spans", spans, spans["row"], buckets)

        yield from batches_of(rows())

    return blocks_by_minimizer.repartition(int(blocks_by_minimizer.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket").mapInArrow(run, SCHEMA)


def cleaned(dealt: DataFrame, with_text: bool) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, and the kept text if asked for."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = ByRow("spans")
        for batch in batches:
            for part, column in slices(marks.add(batch)):
                data, offsets = flat(column)
                spans, low, high = marks.of(part.column(0).to_numpy(zero_copy_only=False))
                out = []
                for doc, a, b, i, j in zip(part.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), low.tolist(), high.tolist(), strict=True):
                    own = as_spans({k: spans[k][i:j] for k in ("row", "start")}, (spans["end"][i:j].astype(np.int64) - spans["start"][i:j])) if j > i else None
                    text, removed, n = data[a:b], 0, 0
                    if own:
                        gone = np.zeros(b - a + 1, np.int8)
                        gone[own["start"]] += 1
                        gone[own["end"]] -= 1
                        text, n = text[np.cumsum(gone[:-1], dtype=np.int8) == 0], len(own["start"])
                        removed = b - a - len(text)
                    kept = text.tobytes()
                    out.append((doc, b - a, removed, n, hashlib.sha256(kept).hexdigest(), *[kept.decode(errors="ignore")] * with_text))
                types = [pa.int64()] * 4 + [pa.string()] * (1 + with_text)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"][: 5 + with_text])

    return dealt.mapInArrow(run, schema)


def remove_repeats(documents: DataFrame, with_text: bool = False, most: int | None = None) -> DataFrame:
    """What is left of every document without strings that start earlier; `text` drops what is left of a cut character."""
    rows = numbered(documents)
    buckets = 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_folder(documents.sparkSession, "index")
    first = keep(meet(fragment_blocks(rows, buckets), buckets, MOST if most is None else most), "fragments")
    second = keep(indexed(fetched(with_texts(rows, first.where("kind = 'wanted'"), buckets), buckets), buckets, folder), "spans")
    spans = first.where("kind = 'spans'").unionAll(second)
    return cleaned(with_texts(rows, spans, buckets), with_text)
