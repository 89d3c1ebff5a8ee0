"""Token ids of whole texts, and their binary output with Elias-Fano document boundaries (operator 10).

`encode` splits texts before single spaces, around single line feeds and between an ASCII letter and punctuation, where
no token of the public vocabularies reaches across, gives each distinct piece to the tokenizer once, and concatenates the
ids; a text with runs of blanks or what may be a special token's
string goes to the tokenizer whole. Pieces are remembered up to CACHE_PIECES, then forgotten.

File format of one shard, little-endian: the magic, then eight int64 (documents, null ids, smallest doc_id, bytes per id,
two Elias-Fano byte lengths, ids, reserved), the Elias-Fano code of the ascending doc_ids less the smallest, the
Elias-Fano code of the document ends, and all ids in one array. Offsets come from `EliasFano.select`, which samples the
high bits' ones; no table of 64-bit offsets is stored or made.

Documents are dealt to shards by ranges of doc_id, so shard order is corpus order; each task writes its shard whole under
a name fixed by its number, and a repeated task replaces it. Null ids come first, rows of one id are ordered by a hash of
their text, and may lie in several shards. A task holds its shard's ids, so shards are as large as partitions are. Null or
empty texts hold the end id alone; a text of any length is encoded whole; repeated rows are written each. Empty tables
give no shards and no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import flat, read_file, shared_folder, slices, write_file

CACHE_PIECES = 1_000_000
#: Texts are encoded so many bytes at a time: a larger slice repeats more of its pieces.
ENCODE_BYTES = 4 << 20
MAGIC = b"TARNIDS1"
#: Every how many ones the place of a one is sampled.
SAMPLE = 256
#: Two blanks side by side, one a space or line feed; the class covers more than any regular expression's \\s.
BLANKS = r"[ \n][\s\x0b\x1c-\x1f\x{85}\pZ]|[\s\x0b\x1c-\x1f\x{85}\pZ][ \n]"
#: Kinds of bytes: 1 space, 2 line feed, 3 ASCII punctuation, 4 ASCII letter, 0 any other.
KINDS = np.zeros(256, np.uint8)
for _byte in range(33, 127):
    KINDS[_byte] = 4 if chr(_byte).isalpha() else 0 if chr(_byte).isdigit() else 3
KINDS[0x20], KINDS[0x0A] = 1, 2


class Encoder:
    """A tokenizer file with a memory of pieces: the piece's bytes to its place in one pool of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.pool, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.number) > CACHE_PIECES:
            self.forget()
        if new := [p for p in pieces if p not in self.number]:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            found = self._ids([p.decode() for p in new])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(found), np.uint32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in found])])
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids before each text and their number at the end) of a large_string column without nulls."""
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        odd = pc.or_(pc.match_substring_regex(column, BLANKS), pc.match_substring(column, "<|")).to_numpy(zero_copy_only=False)
        data, offsets = flat(pc.if_else(pa.array(odd), "", column))
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets[:-1]] = True
        if len(data):
            kind = np.frombuffer(data.tobytes().translate(KINDS.tobytes()), np.uint8)
            cut[:-1] |= (kind == 1) | (kind == 2)
            cut[1:-1] |= kind[:-1] == 2
            cut[1:-1] |= (kind[1:] == 3) & (kind[:-1] == 4)
        starts = np.flatnonzero(cut[:-1])
        where = np.append(starts, len(data))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(data)]).dictionary_encode()
        place = self._places(coded.dictionary.to_pylist())
        begin, sizes = self.ends[place], self.ends[place + 1] - self.ends[place]
        at = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        ids = self.pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin[at] - ends + lengths, lengths)]
        before = np.r_[0, ends][np.searchsorted(starts, offsets)]
        if odd.any():
            rows = np.flatnonzero(odd)
            whole = dict(zip(rows.tolist(), self._ids(column.take(pa.array(rows)).to_pylist()), strict=True))
            parts = [np.array(whole[i], np.uint32) if i in whole else ids[before[i] : before[i + 1]] for i in range(len(column))]
            before = np.r_[0, np.cumsum([len(p) for p in parts])]
            ids = np.concatenate(parts)
        return ids, before.astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class EliasFano:
    """A non-decreasing sequence of non-negative integers: low bits packed, high bits in unary."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray):
        self.n, self.low, self.lows, self.highs = n, low, lows, highs
        #: the place of every SAMPLE-th one among the high bits, from the ones in the bytes before it
        before = np.cumsum(np.bitwise_count(highs), dtype=np.uint32)
        wanted = np.arange(0, n, SAMPLE, dtype=np.uint32)
        byte = np.searchsorted(before, wanted, side="right")
        bits = np.cumsum(np.unpackbits(highs[byte, None], axis=1, bitorder="little"), axis=1)
        left = wanted - (before[byte] - np.bitwise_count(highs[byte]))
        self.samples = (byte * 8 + (bits <= left[:, None]).sum(axis=1)).astype(np.uint32)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        highs = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(highs[-1]) + 1 if n else 0, np.uint8)
        unary[highs] = 1
        return cls(n, low, np.packbits(bits.ravel(), bitorder="little"), np.packbits(unary, bitorder="little"))

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.low, len(self.lows), len(self.highs)], "<i8").tobytes() + self.lows.tobytes() + self.highs.tobytes()

    @classmethod
    def read(cls, raw: memoryview) -> EliasFano:
        n, low, a, b = np.frombuffer(raw[:32], "<i8").tolist()
        return cls(n, low, np.frombuffer(raw[32 : 32 + a], np.uint8), np.frombuffer(raw[32 + a : 32 + a + b], np.uint8))

    def _values(self, i: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for b in range(self.low):
            at = i * self.low + b
            out |= ((self.lows[at >> 3] >> (at & 7)) & 1).astype(np.int64) << b
        return (places - i << self.low) | out

    def select(self, i: int) -> int:
        """The i-th number: from the nearest sampled one, over as many high bits as hold the ones between."""
        start, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = start >> 3
        while True:
            bits = np.unpackbits(self.highs[byte : byte + SAMPLE], bitorder="little")
            ones = np.flatnonzero(bits[max(0, start - byte * 8) :]) + max(start, byte * 8)
            if left < len(ones):
                return int(self._values(np.array([i]), ones[left : left + 1])[0])
            left -= len(ones)
            byte += SAMPLE

    def run(self, k: int) -> np.ndarray:
        """The numbers from the k-th sampled one to the next: a select for all of them, over the high bits between the two."""
        start = int(self.samples[k])
        stop = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.highs)
        ones = np.flatnonzero(np.unpackbits(self.highs[start >> 3 : (stop + 7) >> 3], bitorder="little")) + (start >> 3) * 8
        ones = ones[(ones >= start) & (ones < stop)]
        return self._values(k * SAMPLE + np.arange(len(ones)), ones)

    def numbers(self) -> Iterator[int]:
        """Every number in turn; SAMPLE of them are held at a time."""
        for k in range(len(self.samples)):
            yield from self.run(k).tolist()


class Shard:
    """A shard's file: documents in order, each with its id, its place and its token ids."""

    HEAD = 64

    def __init__(self, raw: memoryview):
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a token shard")
        self.n, self.nulls, self.least, width, a, b, self.total = np.frombuffer(raw[8 : self.HEAD], "<i8").tolist()
        self.keys = EliasFano.read(raw[self.HEAD : self.HEAD + a])
        self.ends = EliasFano.read(raw[self.HEAD + a : self.HEAD + a + b])
        self.ids = np.frombuffer(raw[self.HEAD + a + b :], f"<u{width}")

    @staticmethod
    def to_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
        known = np.array([x for x in doc_ids if x is not None], np.int64)
        least = int(known[0]) if len(known) else 0
        width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
        keys, ends = EliasFano.of((known - least).astype(np.uint64)).to_bytes(), EliasFano.of(np.cumsum(lengths)).to_bytes()
        head = np.array([len(doc_ids), len(doc_ids) - len(known), least, width, len(keys), len(ends), len(ids)], "<i8")
        return MAGIC + head.tobytes() + keys + ends + ids.astype(f"<u{width}").tobytes()

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.keys.select(i - self.nulls)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the shard, ids) of every document, by selects along the high bits."""
        keys, start = self.keys.numbers(), 0
        for i, end in enumerate(self.ends.numbers()):
            yield None if i < self.nulls else self.least + next(keys), start, self.ids[start:end]
            start = end


def write_tokens(documents: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Writes the shards; returns shard, file, n_docs and n_ids of each, in a table of one row a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, number = encoder(tokenizer), TaskContext.get().partitionId()
        names, lengths, parts = [], [], []
        for batch in batches:
            for part, column in slices(batch, most=ENCODE_BYTES):
                ids, starts = code.encode(column)
                names += part.column(0).to_pylist()
                lengths.append(np.diff(starts) + 1)
                parts.append(np.insert(ids, starts[1:], end_id).astype(np.uint16 if end_id < 1 << 16 and (not len(ids) or int(ids.max()) < 1 << 16) else np.uint32))
        if names:
            ids = np.concatenate(parts)
            write_file(file := f"{folder}/shard-{number:08d}.tok", Shard.to_bytes(names, np.concatenate(lengths), ids))
            yield pa.RecordBatch.from_pydict({"shard": [number], "file": [file], "n_docs": [len(names)], "n_ids": [len(ids)]})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows of one id are parted by a hash of the text, and equal rows by their place in the input
    rows = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("place")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(run, "shard long, file string, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")
    return documents.sparkSession.read.parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the shards' files.

    The shards' totals are summed on the driver: one row a shard, so as few as the write had tasks."""
    shards, before = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r.shard):
        shards.append((row.file, before))
        before += row.n_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(d, base + s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, s, x in Shard(read_file(file)).documents()]
                for at in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[at : at + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType())])
    listed = spark.createDataFrame(shards, schema).repartition(max(1, len(shards)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(documents: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes every document's ids and reads the files back."""
    return read_tokens(write_tokens(documents, tokenizer, end_id, shared_folder(documents.sparkSession, "tokens")))
