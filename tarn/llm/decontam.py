"""Benchmark decontamination by greedy string tiling (operator 6).

Words are runs of letters, digits and bytes above ASCII, with A-Z lower-cased. Every text's k-word windows, hashed by a
rolling (Karp-Rabin) hash, are joined with those of the benchmark items; a run of hits on one diagonal is a maximal common
match. Tiling takes the longest match, marks its words in item and text, cuts what overlaps out of the others, and goes on
while a match of k words is left, so passages that come back reordered are covered piece by piece. An item's coverage is
the share of its words that are marked; a text is contaminated if an item's coverage reaches `threshold`.

Hits are equal hashes; a tile counts once its words are compared.

Documents are never shuffled. The items are held by every task as a sorted seed table; they are dealt to as many blocks as
keep a block within BLOCK_CHARS, and the documents pass each block in turn. Beyond one block, what a pass found is stored
before the next block is broadcast, so a larger benchmark costs more passes and not more memory.

Defined results: null or empty texts and items match nothing; an item shorter than k words, down to one, is matched as a
whole wherever its words stand in a row; of equally long matches the one that comes first in item and text is taken; texts
of any length are tiled whole; a null item id is reported as "null" and counts as an id; repeated items count once each;
rows of one doc_id, null included, are reported together; an empty table on either side contaminates nothing; other
columns, of any name, pass through untouched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import U64, Rolling, flat, keep, owners, slices, word_hashes, words

SEED_WORDS, THRESHOLD = 5, 0.5
BLOCK_CHARS = 8 << 20
#: Bytes of words, and what A-Z become.
IS_WORD = np.zeros(256, bool)
IS_WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
for _byte in range(128):
    IS_WORD[_byte] = chr(_byte).isalnum()
    LOWER[_byte] = ord(chr(_byte).lower())
FILTER_BITS = 20


def tiles(pairs: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """(item start, text start, words) of the tiles, from the pairs of places at which k words agree."""
    matches = []
    pairs = sorted((j - i, i) for i, j in pairs)
    for n, (diagonal, i) in enumerate(pairs):
        if n and pairs[n - 1] == (diagonal, i - 1):
            matches[-1][1] += 1
        else:
            matches.append([i, k, diagonal])
    heap = [(-length, i, i + diagonal) for i, length, diagonal in matches]
    heapify(heap)
    in_item: set[int] = set()
    in_text: set[int] = set()
    found = []
    while heap:
        length, i, j = heappop(heap)
        length = -length
        free = [i + x not in in_item and j + x not in in_text for x in range(length)]
        if all(free):
            found.append((i, j, length))
            in_item.update(range(i, i + length))
            in_text.update(range(j, j + length))
            continue
        start = None
        for x, ok in enumerate([*free, False]):
            if ok and start is None:
                start = x
            elif not ok and start is not None:
                if x - start >= k:
                    heappush(heap, (-(x - start), i + start, j + start))
                start = None
    return found


class Seeds:
    """The windows of a block of items, by hash."""

    def __init__(self, items: list[tuple[int | None, str | None]], k: int):
        self.ids, self.words, found = [], [], defaultdict(list)
        for item, text in items:
            data, offsets = flat(pa.array([text or ""], pa.large_string()))
            data = LOWER[data]
            starts, ends, _ = words(data, offsets, IS_WORD)
            if not len(starts):
                continue
            n = min(k, len(starts))
            hashes = word_hashes(data, starts, ends, IS_WORD)
            for place, key in enumerate(Rolling(hashes).windows(n).tolist()):
                found[n, key].append((len(self.ids), place))
            self.ids.append(item)
            self.words.append([data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        self.by_length = {}
        for n in {n for n, _ in found}:
            keys = np.array(sorted(key for m, key in found if m == n), U64)
            sieve = np.zeros(1 << FILTER_BITS, bool)
            sieve[keys & U64(len(sieve) - 1)] = True
            self.by_length[n] = keys, sieve, [found[n, key] for key in keys.tolist()]

    def coverage(self, column: pa.Array) -> list[dict[int, float]]:
        """For each text, the coverage of the items (by number) that share a seed with it."""
        data, offsets = flat(column)
        data = LOWER[data]
        starts, ends, first = words(data, offsets, IS_WORD)
        owner, rolling = owners(first), Rolling(word_hashes(data, starts, ends, IS_WORD))
        pairs: dict[tuple[int, int, int], list] = defaultdict(list)
        for n, (keys, sieve, places) in self.by_length.items():
            hashes = rolling.windows(n)
            at = np.flatnonzero(sieve[hashes & U64(len(sieve) - 1)])
            at = at[owner[at] == owner[at + n - 1]]
            spot = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
            hit = keys[spot] == hashes[at]
            for j, s in zip(at[hit].tolist(), spot[hit].tolist(), strict=True):
                text = int(owner[j])
                for item, i in places[s]:
                    pairs[text, item, n].append((i, j - int(first[text])))
        out: list[dict[int, float]] = [{} for _ in range(len(column))]
        for (text, item, n), own in pairs.items():
            held, begin = self.words[item], int(first[text])
            same = lambda i, j: held[i] == data[starts[begin + j] : ends[begin + j]].tobytes()  # noqa: E731, B023
            out[text][item] = sum(length for i, j, length in tiles(own, n) if all(same(i + x, j + x) for x in range(length))) / len(held)
        return out


def item_blocks(benchmark: DataFrame, k: int) -> Iterator[tuple[Seeds, bool]]:
    """The items in blocks of bounded size, each collected in turn, and whether it is the only one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = -(-total // BLOCK_CHARS)
    for b in range(blocks):
        yield Seeds([tuple(r) for r in items.where(F.expr(f"pmod(xxhash64(item_id, text), {blocks}) = {b}")).collect()], k), blocks == 1


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, k: int = SEED_WORDS) -> DataFrame:
    """One row for each contaminated doc_id: its items, the greatest coverage, and contaminated (true)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = []
    for seeds, alone in item_blocks(benchmark, k):
        held = rows.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, column in slices(batch):
                    ids = part.column(0).to_pylist()
                    out = [(d, held.value.ids[i], c) for d, found in zip(ids, held.value.coverage(column), strict=True) for i, c in found.items() if c >= threshold]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "coverage"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, coverage double")
        if not alone:
            part = keep(part, "contaminated")
            held.unpersist()
        parts.append(part)
    if not parts:
        parts = [rows.sparkSession.createDataFrame([], "doc_id long, item_id long, coverage double")]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    items = F.array_sort(F.collect_set(F.struct("item_id")))
    listed = F.array_join(F.transform(items, lambda x: F.coalesce(x["item_id"].cast("string"), F.lit("null"))), ",")
    return found.groupBy("doc_id").agg(listed.alias("item_ids"), F.size(items).cast("long").alias("n_items"), F.max("coverage").alias("coverage")).withColumn("contaminated", F.lit(True))


def decontaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, k: int = SEED_WORDS) -> DataFrame:
    """The documents, with all their columns, that are not contaminated."""
    schema = documents.schema
    for seeds, alone in item_blocks(benchmark, k):
        held = documents.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, column in slices(batch):
                    yield part.filter(pa.array([max(found.values(), default=0.0) < threshold for found in held.value.coverage(column)]))

        documents = documents.mapInArrow(run, schema)
        if not alone:
            documents = keep(documents, "decontaminated")
            held.unpersist()
    return documents
