"""Packing token ids into fixed windows by Karmarkar-Karp multiway differencing (operator 3).

A document's ids and its closing id fill whole windows of `window` ids first; what is left is cut into pieces of at most
`piece` ids. Pieces are gathered in blocks of `block` and each block is partitioned into k windows by the largest
differencing method: every piece starts as a partial partition of k sums, the two partial partitions with the largest
spread are merged, the fullest sum of one with the emptiest of the other, until one is left. k starts at the least
number that can hold the block and rises whenever a window exceeds the capacity.

Blocks are made within a task, so nothing is shuffled and a task's memory is bounded by one slice of texts and one block;
sequence ids are the task's number and a count within it. The last block of a task is smaller; its padding is below one
window in addition. A repeated task packs the same rows alike if its input comes in the same order, as files do.

Defined results: a null or empty text is the closing id alone; a text of any length is cut into whole windows and pieces; of
pieces of one size the earlier is merged first; repeated rows are packed each; an empty table gives no
rows; null doc_ids stay null; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import slices
from tarn.llm.tokens import ENCODE_BYTES, encoder

WINDOW, PIECE, BLOCK, END_ID = 1024, 256, 3000, 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The bin of every size in a k-way partition with near-equal sums.

    A partial partition holds its sums above the least one and, for each, a tree of members; its other sums, up to k, are
    empty. Merging two that fit beside each other in k sums only lists them together; else both are sorted, and the
    largest sums of one meet the smallest of the other."""
    if k == 1:
        return np.zeros(len(sizes), np.int64)
    partial = [([x], [i]) for i, x in enumerate(sizes.tolist())]
    heap = [(-x[0], i) for i, (x, _) in enumerate(partial)]
    heapify(heap)
    while len(heap) > 1:
        top, a = heappop(heap)
        _, b = heappop(heap)
        (x, mx), (y, my) = partial[a], partial[b]
        partial[b] = None
        if len(x) + len(y) < k:  # the least sum stays an empty one, so the spread stays the largest sum
            if len(x) < len(y):
                x, y, mx, my = y, x, my, mx
            x += y
            mx += my
            partial[a] = x, mx
            heappush(heap, (top, a))
            continue
        order, against = sorted(range(len(x)), key=x.__getitem__), sorted(range(len(y)), key=y.__getitem__, reverse=True)
        total, tree = np.zeros(k, np.int64), [None] * k
        total[k - len(x) :] = [x[j] for j in order]
        tree[k - len(x) :] = [mx[j] for j in order]
        total[: len(y)] += np.array([y[j] for j in against])
        for j, other in enumerate(against):
            tree[j] = my[other] if tree[j] is None else (tree[j], my[other])
        total -= total.min()
        partial[a] = total.tolist(), tree
        heappush(heap, (-int(total.max()), a))
    out = np.zeros(len(sizes), np.int64)
    for number, tree in enumerate(partial[heap[0][1]][1]):
        stack = [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            elif node is not None:
                out[node] = number
    return out


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of every size: as few as differencing can fill within the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differencing(sizes, k)
        if int(np.bincount(found, weights=sizes).max()) <= capacity:
            return found
        k += max(1, k // 400)


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, piece: int = PIECE, block: int = BLOCK, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: its document and place there, its ids' checksum, its window and place in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, base, made, waiting = encoder(tokenizer), TaskContext.get().partitionId() << 32, 0, []

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=NAMES)

        def packed(pieces: list[tuple]) -> pa.RecordBatch:
            nonlocal made
            at = windows(np.array([p[2] for p in pieces]), window)
            used: dict[int, int] = {}
            out = []
            for p, w in zip(pieces, at.tolist(), strict=True):
                out.append((*p, base + made + w, used.get(w, 0)))
                used[w] = used.get(w, 0) + p[2]
            made += int(at.max()) + 1
            return rows(out)

        for batch in batches:
            for part, column in slices(batch, most=ENCODE_BYTES):
                ids, starts = code.encode(column)
                whole = []
                for doc, a, b in zip(part.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], end_id).astype("<u4").tobytes()
                    n = b - a + 1
                    full = n // window * window
                    for start in range(0, full, window):
                        whole.append((doc, start, window, zlib.crc32(own[4 * start : 4 * (start + window)]), n, base + made, 0))
                        made += 1
                    for start in range(full, n, piece):
                        end = min(n, start + piece)
                        waiting.append((doc, start, end - start, zlib.crc32(own[4 * start : 4 * end]), n))
                if whole:
                    yield rows(whole)
                while len(waiting) >= block:
                    yield packed(waiting[:block])
                    del waiting[:block]
        if waiting:
            yield packed(waiting)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
