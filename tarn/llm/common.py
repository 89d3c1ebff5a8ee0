"""Helpers of the corpus operators: shared folders, Arrow batches as flat byte arrays, word hashes.

Texts are handled as UTF-8 bytes. A slice of a batch holds whole texts of about SLICE_BYTES, SLICE_ROWS at most, so that the numpy arrays
made from it stay small whatever the size of an Arrow batch is.
"""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES, SLICE_ROWS = 1 << 20, 4096
#: Spark's switch for removing an execution's shuffle files at its end; else they lie until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
U64 = np.uint64
#: Odd multipliers of the rolling hashes and of the mixer.
BASE, MIX_A, MIX_B = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
#: ASCII white space \x20 and \x09-\x0D parts words; every other byte belongs to one.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master gets a temporary
    folder; a cluster, whose machines would not see it, gets an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tarn-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)  # a path without a scheme is the default file system's
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's URI below the shared root. Writers create it."""
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files; the session's own setting holds again afterwards."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def keep(frame: DataFrame, kind: str) -> DataFrame:
    """The frame written to the shared folder and read again: lineage is cut and survives lost executors. Its shuffles go."""
    path = shared_folder(frame.sparkSession, kind)
    with shuffles_removed(frame.sparkSession):
        frame.write.parquet(path)
    kept = frame.sparkSession.read.schema(frame.schema).parquet(path)
    kept._kept_at = path
    return kept


def discard(*frames: DataFrame) -> None:
    """Deletes what keep() wrote, when nothing is to read it any more. Frames that keep() did not return are left alone."""
    for frame in frames:
        if at := vars(frame).pop("_kept_at", None):
            path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(columns: Iterable[str], wanted: str) -> str:
    """A column name that no column has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI; a plain path is local."""
    from pyarrow import fs

    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, payload: bytes) -> None:
    """The whole file appears at once: written under another name, then moved. A repeated task replaces it by the same bytes."""
    files, path = filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(payload)
    try:
        files.move(part, path)
    except OSError:  # a store that does not move onto a file: the other attempt's is whole and the same
        if files.get_file_info(path).type.name == "NotFound":
            raise
        files.delete_file(part)


def read_file(uri: str) -> memoryview:
    """The file's bytes: memory-mapped if it is local, read otherwise."""
    files, path = filesystem(uri)
    if urlsplit(uri).scheme in ("", "file"):
        return memoryview(pa.memory_map(path, "r").read_buffer())
    with files.open_input_file(path) as f:
        return memoryview(f.read_buffer())


def release() -> None:
    """Gives freed memory back to the system; a worker lives through many tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as strings; null is an empty text."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of the batch with whole texts of about `most` bytes in all, and their text column."""
    column = text_column(batch, name)
    if not len(column):
        return
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = sorted({0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), *range(0, len(column), SLICE_ROWS), len(column)})
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a), column.slice(a, b - a)
    release()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string column."""
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and their number at the end) of the words; none crosses a text's end."""
    mask = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(mask)
    before[:1] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    after = np.empty_like(mask)
    after[-1:] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = IS_WORD) -> tuple[np.ndarray, pa.Array]:
    """Each word's number in the list of distinct words, and that list."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    where = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=where[1:])
    packed = data[table[data]]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(packed)]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = IS_WORD) -> np.ndarray:
    """A 64-bit hash of each word."""
    ids, distinct = word_ids(data, starts, ends, table)
    return np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()], U64)[ids] if len(ids) else np.zeros(0, U64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatters the bits of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


class Rolling:
    """Hashes of all windows of any length over a sequence of 64-bit numbers, from one prefix sum."""

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        self.back = np.full(n + 1, BASE_INVERSE, U64)
        power = np.full(n + 1, BASE, U64)
        self.back[0] = power[0] = 1
        np.cumprod(self.back, out=self.back)
        np.cumprod(power, out=power)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(numbers * power[:-1], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        """The hash of numbers[i:i+length] for every i at which it fits."""
        if len(self.sums) <= length:
            return np.zeros(0, U64)
        return mixed((self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length] + U64(length))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of numbers[start:end] for every pair."""
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(U64))


def owners(first: np.ndarray) -> np.ndarray:
    """The text's number for each element, given the first element of each text and their number at the end."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ranked = np.sort(keys)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys
