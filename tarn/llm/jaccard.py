"""N-gram Jaccard join: all documents whose shingle sets reach a similarity, as components (operator 4).

Jaccard distance is a metric, but unrelated texts all lie at a distance of nearly one from any pivot, where no triangle
bound parts them. So sets without a partner leave first, and pivots work on those that are left:

1. Equal sets count once, by a 64-bit key of the set; sets that share a key by chance differ in a second one, which is
   looked for, and are named by both. A set with more shingles of its own, that no other set has, than a partner may lack
   has no partner and is put aside: first by a count over a share of all shingles, which is a lower bound, then among the
   sets that are left.
2. Pivots: each set's minimum under MINIMA hashes of its shingles deals it to as many buckets, and the set with the fewest
   shingles of its own is its bucket's pivot. A set's distances to its pivots, MINIMA at most, are computed; a pivot within the radius links. What is
   linked is contracted to one label before anything else is compared.
3. What may link over labels: two sets with similarity s differ in at most (1-s)/(1+s) of their joint size. Shingles are
   dealt by hash to so many segments, for a class of set sizes, that a pair must agree in several whole segments
   (pigeonhole). Each set emits a signature of its segments, without the smallest as long as a pair is bound to agree in
   another one. Signatures travel with the label, every label's once a task, so that copies do not gather; labels that share
   one are joined to the least of them, and the components of that graph are the regions.
4. Regions are joined recursively by pivots chosen farthest first: every set goes to its nearest pivot's Voronoi cell and,
   by the triangle inequality, also to every cell whose pivot is at most twice the radius farther. Sets within the radius
   of a pivot are linked at once, pivots leave, and sets of one label are not compared again. Where cells do not part, the
   sets are compared under the windows that all pivots' distances leave.

A region larger than MAX_SETS or MAX_ELEMENTS is cut across tasks first, by the same steps as DataFrames: own shingles are
counted by a shuffle, pivots split what is left into cells that are joined as regions of their own. Cells that would
hold most sets several times are not made; these sets, and a cell that does not shrink, are cut into blocks: those of its most frequent label meet the others' blocks but not each other.

Signatures and shingles travel as binary blocks by hash buckets; a shingle goes there twice a block at most. Texts are read
again for the members of regions only; nothing of all documents reaches the driver. Intermediate tables are deleted when those
made from them are stored, and a step's shuffle files when it ends, so that steps do not add up on disk. Exact: similarity is
tested on whole numbers, on 51-bit shingle hashes.

Defined results: null, empty and blank texts have an empty set and link with nothing; a text with fewer words than a
shingle is one shingle; texts of any length are taken whole, in slices of whole texts; equal rows link with each other,
and what has several pivots or cells at the same distance goes to the first; null doc_ids take part and are never the
smallest id; an empty table gives an empty result; other columns, of any name, are ignored, or kept by distinct_documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import U64, Rolling, discard, flat, free_name, keep, mixed, owners, repeated, slices, word_hashes, words
from tarn.llm.components import components, hub_join

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SHINGLE_BITS = 51
#: Ratio of set sizes in a class; spare segments by required ones; the largest segment that may be left out.
CLASS_RATIO, SPARE, LARGEST_WEAK = 1.4, 0.5, 4
FLUSH, SEEN = 1 << 20, 1 << 20
#: The share of all shingles in which own ones are counted first, and how often the rest is counted anew.
SHARE, ROUNDS = 0.375, 3
MAX_SETS, MAX_ELEMENTS, PIVOTS = 20_000, 4_000_000, 16
#: Cells that hold so many times a large region's sets do not part it.
MOST_COPIES = 1.5
#: Buckets, and so pivots, of a set; the sets that meet one copy of a pivot.
MINIMA, SALTED = 4, 1000
#: Fewer only in a test of equal keys.
KEY_BITS = 64
#: So many member ids are broadcast at most (16 MB); beyond that the members are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of each text in ascending order, first of each text and their number at the end)."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    owner, rolling = owners(first), Rolling(word_hashes(data, starts, ends))
    hashes = rolling.windows(n)
    inside = np.flatnonzero(owner[: len(hashes)] == owner[n - 1 :][: len(hashes)]) if len(hashes) else np.zeros(0, np.int64)
    sizes = np.diff(first)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    keys = np.concatenate([hashes[inside], rolling.spans(first[short], first[short + 1])])
    text = np.concatenate([owner[inside], short]).astype(U64)
    joint = np.sort((text << U64(SHINGLE_BITS)) | (keys >> U64(64 - SHINGLE_BITS)))
    joint = joint[np.r_[True, joint[1:] != joint[:-1]]] if len(joint) else joint
    where = np.searchsorted(joint, np.arange(len(column) + 1, dtype=U64) << U64(SHINGLE_BITS))
    return (joint & U64((1 << SHINGLE_BITS) - 1)).astype(np.int64), where


def per_set(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The wrapping sum of the 64-bit values of each set."""
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=sums[1:])
    return sums[where[1:]] - sums[where[:-1]]


def two_keys(shingles: np.ndarray, where: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set; the first has fewer bits in tests."""
    sizes, spread = mixed(np.diff(where).astype(U64)), mixed(shingles.astype(U64) + U64(0x51ED))
    return mixed(per_set(spread, where) + sizes) >> U64(64 - bits), mixed(per_set(mixed(spread ^ U64(0x7A7A)), where) ^ sizes)


class Keys:
    """The keys of sets, given the first keys that different sets share."""

    def __init__(self, shared: Iterable[int] = ()):
        self.shared, self.bits = np.array(sorted(shared), np.int64).view(U64), KEY_BITS

    def __call__(self, shingles: np.ndarray, where: np.ndarray) -> np.ndarray:
        one, two = two_keys(shingles, where, self.bits)
        return np.where(np.isin(one, self.shared), one ^ two, one) if len(self.shared) else one


@lru_cache
def classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least size, differing shingles at most, segments) of the size classes."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(max(least[-1] + 1, int(least[-1] * CLASS_RATIO)))
    least = np.array(least)
    differ = 2 * (least[1:] - 1) * (100 - percent) // (100 + percent)
    return least[:-1], differ, differ + 1 + np.ceil(SPARE * differ).astype(np.int64)


def signatures(shingles: np.ndarray, where: np.ndarray, labels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, label) of every segment that the sets emit."""
    least, differ, segments = classes(percent)
    sizes = np.diff(where)
    own = np.searchsorted(least, sizes, side="right") - 1
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for up in count():  # the own class, and larger ones as long as a set of them can match
        number = np.minimum(own + up, len(differ) - 1)
        takes = (sizes > 0) & (differ[number] > 0)
        if up:
            takes &= 100 * sizes >= percent * least[number]
            if not (100 * sizes >= percent * least[number]).any():
                break
        sets = np.flatnonzero(takes)
        if not len(sets):
            continue
        lengths = sizes[sets]
        ends = np.cumsum(lengths)
        elements = shingles[np.arange(ends[-1]) + np.repeat(where[sets] - ends + lengths, lengths)].astype(U64)
        parts = segments[number[sets]]
        begin = np.cumsum(parts) - parts
        spread = mixed(elements ^ U64(0xA5A5))
        cell = (spread % np.repeat(parts, lengths).astype(U64)).astype(np.int64) + np.repeat(begin, lengths)
        total = int(parts.sum())
        high, low = mixed(spread) >> U64(38), spread >> U64(38)
        sums = [np.bincount(cell, weights=x.astype(np.float64), minlength=total).astype(U64) for x in (high, low)]
        filled = np.bincount(cell, minlength=total)
        of = np.repeat(np.arange(len(sets)), parts)
        # the largest weak size of each set that leaves fewer weak segments than a pair must share
        spare, weak = parts - differ[number[sets]], np.full(len(sets), -1)
        for size in range(LARGEST_WEAK + 1):
            fewer = np.bincount(of, weights=filled <= size, minlength=len(sets)) < spare
            weak[fewer & (weak == size - 1)] = size
        told = filled > weak[of]
        place = mixed((np.arange(total) - np.repeat(begin, parts)).astype(U64) * U64(1 << 20) + number[sets][of].astype(U64))
        out.append((mixed(sums[0] ^ mixed(sums[1] ^ place) + filled.astype(U64))[told], labels[sets][of][told]))
    if not out:
        return np.zeros(0, U64), np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def similar(shared: np.ndarray, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


class Region:
    """Sets of a region, joined by pivots."""

    def __init__(self, keys: np.ndarray, sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None):
        self.keys, self.percent, self.radius = keys, percent, 1 - percent / 100
        # sets of one label are linked: to the first of them
        self.parent = np.arange(len(keys)) if labels is None else np.unique(labels, return_index=True, return_inverse=True)[1:]
        if labels is not None:
            self.parent = self.parent[0][self.parent[1]]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        distinct, code = np.unique(np.concatenate(sets), return_inverse=True)
        self.codes = np.split(code.astype(np.int32), np.cumsum(self.sizes)[:-1])
        self.flag = np.zeros(len(distinct), np.uint8)
        self.vocabulary = len(distinct)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return int(i)

    def unite(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def alone(self) -> np.ndarray:
        """The sets that are left when those with too many shingles of their own are put aside, again and again."""
        left = np.arange(len(self.keys))
        while len(left):
            code = np.concatenate([self.codes[i] for i in left])
            own = (np.bincount(code, minlength=self.vocabulary) == 1)[code]
            lacking = np.add.reduceat(own, np.cumsum(self.sizes[left]) - self.sizes[left], dtype=np.int64)
            stay = 100 * (self.sizes[left] - lacking) >= self.percent * self.sizes[left]
            if stay.all():
                break
            left = left[stay]
        return left

    def shared(self, pivot: int, code: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The number of shingles that the pivot shares with each set, their codes being concatenated."""
        self.flag[self.codes[pivot]] = 1
        out = np.add.reduceat(self.flag[code], begin, dtype=np.int64)
        self.flag[self.codes[pivot]] = 0
        return out

    def gathered(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([self.codes[i] for i in left]), np.cumsum(self.sizes[left]) - self.sizes[left]

    def compare(self, i: int, others: np.ndarray) -> None:
        """Links a set with those of the others that it matches."""
        for j in others[similar(self.shared(i, *self.gathered(others)), self.sizes[i], self.sizes[others], self.percent)].tolist():
            self.unite(i, j)

    def join(self) -> np.ndarray:
        """The least set, by number, of each set's component."""
        work = [self.alone()]
        while work:
            left = work.pop()
            roots = np.array([self.root(i) for i in left.tolist()])
            if len(left) < 2 or (roots == roots[0]).all():
                continue
            code, begin = self.gathered(left)
            sizes, distance, chosen = self.sizes[left], [], [0]
            while True:
                p = int(left[chosen[-1]])
                both = self.shared(p, code, begin)
                for j in left[similar(both, self.sizes[p], sizes, self.percent)].tolist():
                    self.unite(p, j)
                distance.append(1 - both / (sizes + self.sizes[p] - both))
                nearest = np.min(distance, axis=0)
                if len(chosen) >= min(PIVOTS, len(left) // 4) or nearest.max() <= self.radius:
                    break
                chosen.append(int(nearest.argmax()))
            table = np.array(distance)
            home = table.argmin(axis=0)
            rest = np.ones(len(left), bool)
            rest[chosen] = False  # a pivot has met every set
            cells = [np.flatnonzero((table[j] <= nearest + 2 * self.radius + 1e-9) & rest) for j in range(len(chosen)) if (home[rest] == j).any()]
            if sum(map(len, cells)) <= 1.5 * len(left):
                work += [left[c] for c in cells]
            else:
                self.windows(left[rest], table[:, rest])
        return np.array([self.root(i) for i in range(len(self.keys))])

    def windows(self, left: np.ndarray, table: np.ndarray) -> None:
        """Compares every set with the later ones that no pivot's distance rules out and that are not linked yet."""
        order = np.argsort(table[0], kind="stable")
        left, table = left[order], table[:, order]
        for n, i in enumerate(left[:-1].tolist()):
            end = int(np.searchsorted(table[0], table[0, n] + self.radius + 1e-9, side="right"))
            near = np.flatnonzero((np.abs(table[:, n + 1 : end] - table[:, n : n + 1]) <= self.radius + 1e-9).all(axis=0)) + n + 1
            if len(near):
                own = self.root(i)
                near = near[np.array([self.root(j) != own for j in left[near].tolist()])]
            if len(near):
                self.compare(i, left[near])


# The distributed steps.
def described(documents: DataFrame, n: int) -> DataFrame:
    """doc_id, the set's size and its two keys, of every row."""
    bits = KEY_BITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in slices(batch):
                shingles, where = shingle_sets(column, n)
                one, two = two_keys(shingles, where, bits)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(where), pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["doc_id", "n", "key", "other"])

    return documents.mapInArrow(run, "doc_id long, n long, key long, other long")


def sets_of(batch: pa.RecordBatch, n: int, keys: Keys) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shingles, where, keys) of a batch's texts, or of its sets where it has them already."""
    if "shingles" in batch.schema.names:
        yield *stored(batch), batch.column(batch.schema.get_field_index("key")).to_numpy().view(U64)
        return
    for _, column in slices(batch):
        shingles, where = shingle_sets(column, n)
        yield shingles, where, keys(shingles, where)


def stored(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, where) of a batch of sets."""
    column = batch.column(batch.schema.get_field_index("shingles"))
    where = column.offsets.to_numpy()
    return column.values.to_numpy()[where[0] : where[-1]], where - where[0]


def only(shingles: np.ndarray, where: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of some sets."""
    sizes = np.diff(where)[sets]
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(where[sets] - ends + sizes, sizes)
    return shingles[at], np.r_[0, ends]


def parts_of(batches: Iterable[pa.RecordBatch], n: int, named: Keys) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sets of a task, equal ones once."""
    seen: set[int] = set()
    for batch in batches:
        for shingles, where, keys in sets_of(batch, n, named):
            fresh = []
            for i, k in enumerate(keys.tolist()):
                if k not in seen:
                    seen.add(k)
                    fresh.append(i)
            if fresh:
                yield *only(shingles, where, np.array(fresh)), keys[fresh]
            if len(seen) > SEEN:
                seen.clear()


def partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def own_shingles(frame: DataFrame, n: int, share: float, named: Keys) -> DataFrame:
    """key and own: how many of a set's shingles no other set has, among the given share of all shingles (by hash).

    Shingles travel as 32 bits within a bucket; two that coincide there count as shared, which only keeps sets in."""
    buckets = partitions(frame)
    schema = "bucket long, keys binary, counts binary, shingles binary"
    names = ["bucket", "keys", "counts", "shingles"]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)], names=names)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            keys, spread, of, base = [], [], [], 0
            for k, s, o in held:
                keys.append(k)
                spread.append(s)
                of.append(o + base)
                base += len(k)
            held.clear()
            keys, spread, of = np.concatenate(keys), np.concatenate(spread), np.concatenate(of)
            bucket = (spread % U64(buckets)).astype(np.int32)
            # two sets tell that a shingle is shared; of those it has beyond that none needs to travel
            order = np.argsort(spread, kind="stable")
            third = np.r_[False, False, spread[order][2:] == spread[order][:-2]][: len(order)]
            order = np.sort(order[~third])
            order = order[np.argsort(bucket[order], kind="stable")]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[b] : cuts[b + 1]]
                start = np.flatnonzero(np.r_[True, np.diff(of[at]) != 0])
                counts = np.diff(np.r_[start, len(at)])
                rows.append((b, keys[of[at[start]]].tobytes(), counts.astype("<u4").tobytes(), (spread[at] >> U64(32)).astype("<u4").tobytes()))
            return as_batch(rows)

        size = 0
        for shingles, where, keys in parts_of(batches, n, named):
            spread = mixed(shingles.astype(U64) ^ U64(0x3C3C))
            take = (mixed(spread) >> U64(48)).astype(np.int64) < int(share * (1 << 16))
            held.append((keys, spread[take], owners(where)[take]))
            size += len(held[-1][1])
            if size > FLUSH:
                yield flush()
                size = 0
        if size:
            yield flush()

    def alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, marks = [], [], []
        for batch in batches:
            for into, column, kind in zip((keys, counts, marks), batch.columns[1:], (U64, "<u4", "<u4"), strict=True):
                into += [np.frombuffer(x, kind) for x in column.to_pylist()]
        if not keys:
            return
        keys, counts, marks = np.concatenate(keys), np.concatenate(counts).astype(np.int64), np.concatenate(marks).astype(U64)
        begin = np.cumsum(counts) - counts
        own = ~repeated(marks)
        # a shingle that comes again only with copies of its set from other tasks is still the set's own: it counts once
        again = np.flatnonzero(~own)
        key_of = np.repeat(np.arange(len(keys)), counts)[again]
        order = np.lexsort((keys[key_of], marks[again]))
        mark, key = marks[again][order], keys[key_of][order]
        first = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]]) if len(mark) else np.zeros(0, np.int64)
        if len(first):
            same = np.minimum.reduceat(key, first) == np.maximum.reduceat(key, first)
            own[again[order[first[same]]]] = True
        sums = np.add.reduceat(own, begin, dtype=np.int64)
        some = np.flatnonzero(sums)
        keys, sums = keys[some], sums[some]
        home = (mixed(keys) % U64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(buckets + 1))
        rows = [(b, keys[order[cuts[b] : cuts[b + 1]]].tobytes(), sums[order[cuts[b] : cuts[b + 1]]].astype("<u4").tobytes(), b"") for b in np.flatnonzero(np.diff(cuts)).tolist()]
        if rows:
            yield as_batch(rows)

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = [], []
        for batch in batches:
            keys += [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            sums += [np.frombuffer(x, "<u4") for x in batch.column(2).to_pylist()]
        if keys:
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(np.bincount(at, weights=np.concatenate(sums)).astype(np.int64))], names=["key", "own"])

    blocks = frame.mapInArrow(emit, schema).repartition(buckets, "bucket").mapInArrow(alone, schema)
    return blocks.repartition(buckets, "bucket").mapInArrow(total, "key long, own long")


def may_match(sizes: DataFrame, own: DataFrame, size: Column, percent: int) -> DataFrame:
    """Of the sets, those that have few enough shingles of their own for a partner, and how many: own."""
    own = own.groupBy("key").agg(F.sum("own").alias("own"))
    return sizes.drop("own").join(own, "key", "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long"))).where(100 * (size - F.col("own")) >= percent * size)


def pivot_links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets and those of their pivots that lie within the radius.

    A set has a bucket by each of MINIMA minima of its hashed shingles. A bucket's pivot is the set with the fewest shingles of its
    own, as it lies in the middle, then the least key. So a group of G near copies has MINIMA * G distances at most. A pivot of
    many sets is copied for every SALTED of them."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles, where = stored(batch)
            for j in range(MINIMA if len(where) > 1 else 0):
                least = np.minimum.reduceat(mixed(shingles.astype(U64) ^ mixed(np.array([j + 1], U64))), where[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), pa.array(mixed(least + U64(j)).view(np.int64))], names=["key", "bucket"]).append_column("own", batch.column(batch.schema.get_field_index("own")))

    dealt = keep(sets.mapInArrow(deal, "key long, bucket long, own long"), "buckets")
    least = dealt.groupBy("bucket").agg(F.min(F.struct("own", "key")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "n", F.col("least.key").alias("pivot"))
    least = least.withColumn("followers", F.col("n"))
    pairs = hub_join(dealt, least, "bucket", dealt.count()).where("key <> pivot").groupBy("key", "pivot").agg(F.ceil(F.max("followers") / SALTED).alias("copies"))
    pairs = keep(pairs, "pairs")
    pivots = pairs.groupBy("pivot").agg(F.max("copies").alias("copies")).join(sets.select(F.col("key").alias("pivot"), F.col("shingles").alias("to")), "pivot")
    pivots = pivots.select("pivot", "to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"))
    follows = sets.join(pairs, "key").select("key", "shingles", "pivot", F.pmod(F.xxhash64("key"), F.col("copies")).alias("salt"))
    met = follows.join(pivots, ["pivot", "salt"]).withColumn("shared", F.size(F.array_intersect("shingles", "to")))
    links = met.where(100 * F.col("shared") >= percent * (F.size("shingles") + F.size("to") - F.col("shared"))).select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    links = keep(links, "links")
    discard(dealt, pairs)
    return links


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges (node, least node of its component) of the graph of the edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]
        apart = up[a] != up[b]
        a, b = a[apart], b[apart]
    moved = np.flatnonzero(up != np.arange(len(nodes)))
    return np.column_stack([nodes[moved], nodes[up[moved]]])


def signature_edges(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): labels of sets that share a signature, joined as far as a task knows them. A label's signature leaves a task once."""
    buckets = 4 * partitions(sets)

    def unique(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        sign, label = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((label, sign))
        sign, label = sign[order], label[order]
        new = np.r_[True, (sign[1:] != sign[:-1]) | (label[1:] != label[:-1])]
        return sign[new], label[new]

    def blocks(sign: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
        bucket = (sign % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(b, sign[o].tobytes(), label[o].tobytes()) for b in range(buckets) if len(o := order[cuts[b] : cuts[b + 1]])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "sign", "label"])

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            sign, label = signatures(*stored(batch), batch.column(batch.schema.get_field_index("label")).to_numpy().view(U64), percent)
            if len(sign):
                held.append((sign, label))
            if sum(len(s) for s, _ in held) > FLUSH:
                held = [unique(held)]
                if len(held[0][0]) > FLUSH // 2:
                    yield blocks(*held.pop())
        if held:
            yield blocks(*unique(held))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, labels = [], []
        for batch in batches:
            signs += [np.frombuffer(x, U64) for x in batch.column(1).to_pylist()]
            labels += [np.frombuffer(x, U64) for x in batch.column(2).to_pylist()]
        if not signs:
            return
        sign, label = np.concatenate(signs), np.concatenate(labels).view(np.int64)
        order = np.argsort(sign, kind="stable")
        sign, label = sign[order], label[order]
        start = np.r_[True, sign[1:] != sign[:-1]]
        least = np.minimum.reduceat(label, np.flatnonzero(start))[np.cumsum(start) - 1]
        apart = label != least
        pairs = forest(label[apart], least[apart])
        for at in range(0, len(pairs), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + 50_000, 0]), pa.array(pairs[at : at + 50_000, 1])], names=["a", "b"])

    told = sets.mapInArrow(emit, "bucket long, sign binary, label binary")
    return told.repartition(buckets // 4, "bucket").mapInArrow(meet, "a long, b long")


def member_sets(documents: DataFrame, members: DataFrame, n: int, named: Keys) -> DataFrame:
    """key and shingles of every member (doc_id, key), from the texts of the rows with its id: a repeated id's rows are read once each."""
    ids, keys = members.select(F.col("doc_id").alias("d")).distinct(), members.select("key")
    if members.count() <= BROADCAST_ROWS:
        ids, keys = F.broadcast(ids), F.broadcast(keys)
    chosen = documents.join(ids, documents.doc_id.eqNullSafe(ids.d), "left_semi").select("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingles, where, keys in parts_of(batches, n, named):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(shingles))], names=["key", "shingles"])

    return chosen.mapInArrow(run, "key long, shingles array<long>").join(keys, "key", "left_semi").dropDuplicates(["key"])


def joined_regions(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): every label that is linked with others inside a region, and the least of those labels."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, held = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                keys = np.array(sorted(held))
                labels = np.array([held[k][0] for k in keys.tolist()])
                roots = Region(keys, [held[k][1] for k in keys.tolist()], percent, labels).join()
                pairs = forest(labels, labels[roots])
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            shingles = batch.column(3)
            for i, (r, k, label) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:3]], strict=True)):
                if r != region:
                    yield from done()
                    region, held = r, {}
                held[k] = (label, shingles[i].values.to_numpy())
        yield from done()

    return sets.select("region", "key", "label", "shingles").repartition("region").sortWithinPartitions("region").mapInArrow(run, "a long, b long")


def peeled(sets: DataFrame, percent: int) -> DataFrame:
    """The sets that have few enough shingles of their own in their region: one round, counted by a shuffle."""
    single = sets.select("region", "key", F.explode("shingles").alias("s")).groupBy("region", "s").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).where("n = 1")
    own = single.groupBy("region", "key").agg(F.count(F.lit(1)).alias("own"))
    size = F.size("shingles")
    return sets.join(own, ["region", "key"], "left").where(100 * (size - F.coalesce("own", F.lit(0))) >= percent * size).drop("own")


def split(sets: DataFrame, percent: int, most: float) -> tuple[DataFrame | None, DataFrame]:
    """(sets in Voronoi cells as new regions, links (a, b) of labels with pivots' ones) of regions too large for a task, both kept.
    None for the cells if they would hold more than `most` sets: far from its pivots a set goes to every cell, and nothing is parted.

    Such regions are few, so their sizes are broadcast; a region's pivots are copied for every SALTED of its sets."""
    radius = 1 - percent / 100
    counts = F.broadcast(sets.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / SALTED).alias("copies")))
    ranked = sets.select("region", F.struct(F.xxhash64("key").alias("h"), "key", "label", "shingles").alias("s"))
    # the least hashes are a random choice; a minimum at a time keeps the state small
    pivots = ranked.groupBy("region", F.pmod(F.col("s.h"), F.lit(PIVOTS)).alias("j")).agg(F.min("s").alias("s")).groupBy("region").agg(F.collect_list("s").alias("pivots"))
    pivots = pivots.join(counts, "region").select("region", "pivots", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"))
    salted = sets.join(counts, "region").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("copies"))).drop("copies")
    both = salted.join(pivots, ["region", "salt"]).select("region", "key", "label", "shingles", F.col("pivots.key").alias("pivot"), F.col("pivots.label").alias("pivot_label"), F.col("pivots.shingles").alias("pivot_sets"))
    with_distance = both.withColumn("shared", F.transform("pivot_sets", lambda p: F.size(F.array_intersect("shingles", p))))
    union = lambda p, s: F.size("shingles") + F.size(p) - s
    with_distance = with_distance.withColumn("distance", F.zip_with("pivot_sets", "shared", lambda p, s: 1 - s / union(p, s)))
    with_distance = with_distance.withColumn("linked", F.zip_with("pivot_sets", "shared", lambda p, s: 100 * s >= percent * union(p, s)))
    held = keep(with_distance.select("region", "key", "label", "shingles", "pivot", "pivot_label", "distance", "linked"), "cells")
    links = held.select("label", F.explode(F.arrays_zip("pivot_label", "linked")).alias("x")).where("x.linked and x.pivot_label <> label").select(F.col("label").alias("a"), F.col("x.pivot_label").alias("b")).distinct()
    rest = held.where(~F.array_contains("pivot", F.col("key")))
    near = F.size(F.filter("distance", lambda d: d <= F.array_min("distance") + 2 * radius + 1e-9))
    if (rest.agg(F.sum(near)).first()[0] or 0) > most:
        links = keep(links, "links")
        discard(held)
        return None, links
    cells = rest.select("region", "key", "label", "shingles", F.explode(F.arrays_zip("pivot", "distance")).alias("x"), F.array_min("distance").alias("nearest"))
    cells = cells.where(F.col("x.distance") <= F.col("nearest") + 2 * radius + 1e-9)
    cells = cells.select(F.xxhash64("region", "x.pivot").alias("region"), "key", "label", "shingles").dropDuplicates(["region", "key"])
    cells, links = keep(cells, "cells"), keep(links, "links")
    discard(held)
    return cells, links


def tiled(sets: DataFrame, most: int) -> DataFrame:
    """The regions cut into blocks, a new region for each pair of blocks that may link labels: exact, whatever the distances are.

    The sets of a region's most frequent label are linked, so their blocks meet those of the other labels only."""
    by_label = sets.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n"))
    ours = F.broadcast(by_label.groupBy("region").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.ceil(2 * F.max("n") / most).alias("tops"), F.ceil(2 * (F.sum("n") - F.max("n")) / most).alias("others")))
    dealt = sets.join(ours, "region").withColumn("is_top", F.col("label") == F.col("top"))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("key"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("others"))))
    columns = ["region", "key", "label", "shingles", "is_top", "i"]
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("j")
    with_others = dealt.where("others > 0").select(*columns, to("others"))
    with_top = dealt.where("not is_top").select(*columns, to("tops"))
    first = with_others.select(F.xxhash64("region", F.when(F.col("is_top"), F.struct(F.lit(True).alias("t"), F.col("i").alias("i"), F.col("j").alias("j"))).otherwise(F.struct(F.lit(False).alias("t"), F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")))).alias("region"), "key", "label", "shingles")
    return first.unionAll(with_top.select(F.xxhash64("region", F.struct(F.lit(True).alias("t"), F.col("j").alias("i"), F.col("i").alias("j"))).alias("region"), "key", "label", "shingles"))


def oversize(sets: DataFrame) -> DataFrame:
    return sets.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles")).alias("elements")).where(f"n > {MAX_SETS} or elements > {MAX_ELEMENTS}")


def large_regions(sets: DataFrame, large: DataFrame, percent: int) -> list[DataFrame]:
    """Links of labels in regions of which some are too large for a task, all kept."""
    links = []
    names = keep(large.select("region"), "large")
    used = [names]
    done = [sets.join(F.broadcast(names), "region", "left_anti")]
    part = keep(peeled(sets.join(F.broadcast(names), "region", "left_semi"), percent), "peeled")
    size = part.count()
    for _ in range(ROUNDS):  # what only the sets put aside shared is now a set's own
        last, before, part = part, size, keep(peeled(part, percent), "peeled")
        discard(last)
        size = part.count()
        if size > 0.9 * before:
            break
    for _ in range(3):
        cells, found = split(part, percent, MOST_COPIES * part.count())
        links.append(found)
        if cells is None:  # the blocks below are cut from the sets themselves, not from a copy for each cell
            break
        names, before = keep(oversize(cells).select("region"), "large"), part
        done.append(cells.join(F.broadcast(names), "region", "left_anti"))
        part = keep(cells.join(F.broadcast(names), "region", "left_semi"), "cells")
        used += [cells, names]
        over = part.isEmpty() or part.count() > 0.7 * before.count()
        discard(before)
        if over:
            break
    done.append(tiled(part, MAX_SETS))
    links += [keep(joined_regions(x, percent), "links") for x in done]
    discard(part, *used)
    return links


def linked(documents: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, Keys]:
    """(doc_id, n, key of every row; key, least doc_id and number of rows n of every set; key and label of sets that may have
    links; the naming of sets). The tables are kept, with a few more columns.

    Linked sets have one label, the least key of their component."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    meta = keep(described(rows, n), "sets")
    by_key = lambda f: f.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("size"), F.count(F.lit(1)).alias("n"), (F.min("other") != F.max("other")).alias("several"))
    sizes = keep(by_key(meta), "sets")
    # among 10^10 sets about three pairs share a first key by chance
    shared = [r.key for r in sizes.where("several").select("key").collect()]
    named = Keys(shared)
    if shared:
        first = meta, sizes
        meta = keep(meta.withColumn("key", F.when(F.col("key").isin(shared), F.col("key").bitwiseXOR(F.col("other"))).otherwise(F.col("key"))), "sets")
        sizes = keep(by_key(meta), "sets")
        discard(*first)
    members = keep(may_match(sizes, own_shingles(rows, n, SHARE, named), F.col("size"), percent).select("doc_id", "key"), "members")
    sets = keep(member_sets(rows, members, n, named), "members")
    discard(members)
    left = sets.count()
    for _ in range(ROUNDS):  # what only the sets put aside shared is now a set's own
        last, sets = sets, keep(may_match(sets, own_shingles(sets, n, 1.0, named), F.size("shingles"), percent), "members")
        discard(last)
        before, left = left, sets.count()
        if left > 0.9 * before:
            break
    near = pivot_links(sets, percent)
    labels = components(near).withColumnRenamed("node", "key")
    last, sets = sets, keep(sets.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")), "members")
    discard(near, last)
    counts = keep(sets.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "labels")
    regions = components(signature_edges(sets, percent)).toDF("label", "region")
    regions = keep(counts.join(regions, "label"), "regions")
    inside = keep(hub_join(sets, regions, "label", left).select("region", "key", "label", "shingles"), "regions")
    large = oversize(inside)
    links = [joined_regions(inside, percent)] if large.isEmpty() else large_regions(inside, large, percent)
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionAll(more)
    joined = components(edges).toDF("label", "to")
    discard(inside, regions, *links)
    ends = keep(counts.join(joined, "label", "left").withColumn("to", F.coalesce("to", "label")), "labels")
    found = keep(hub_join(sets.select("key", "label"), ends, "label", left).select("key", F.col("to").alias("label")), "labels")
    discard(sets, counts, ends)
    return meta, sizes, found, named


def near_duplicates(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest doc_id reachable by links of similarity percent/100."""
    meta, sizes, labels, _ = linked(documents, n, percent)
    known = keep(sizes.join(labels, "key").select("key", "label", "doc_id"), "known")
    least = known.groupBy("label").agg(F.min("doc_id").alias("component"), F.count(F.lit(1)).alias("n"))
    known = hub_join(known, least, "label", known.count()).select("key", "component", F.lit(True).alias("linked"))
    hubs = sizes.join(known, "key", "left").select("key", "n", F.when(F.col("linked"), F.col("component")).otherwise(F.col("doc_id")).alias("component"))
    rows = meta.where("n > 0").withColumnRenamed("n", "n_shingles")
    found = hub_join(rows, keep(hubs, "known"), "key", rows.count()).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return found.unionAll(meta.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keyed(documents: DataFrame, n: int, name: str, named: Keys) -> DataFrame:
    """The documents with the key of their shingle set in a column of that name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in slices(batch):
                keys = pa.array(named(*shingle_sets(column, n)).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, keys], names=[*part.schema.names, name])

    return documents.mapInArrow(run, T.StructType([*documents.schema, T.StructField(name, T.LongType())]))


def distinct_documents(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns, without those that link, directly or not, with one of a smaller doc_id.

    Null ids count as the largest; of rows with one id the one with the least key of its set stays, and of rows that are
    equal in both, one. Texts without shingles stay. What goes is named by (doc_id, key) and is broadcast only up to
    BROADCAST_ROWS. Columns may have any name."""
    meta, sizes, labels, named = linked(documents, n, percent)
    hubs = keep(sizes.join(labels, "key", "left").select("key", "n", F.coalesce("label", "key").alias("label")), "known")
    sets = keep(hub_join(meta.where("n > 0").select("doc_id", "key"), hubs, "key", meta.count()).groupBy("doc_id", "key", "label").agg(F.count(F.lit(1)).alias("n")), "known")
    ranked = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    stays = sets.groupBy("label").agg(F.min(ranked).alias("s")).select(F.col("s.doc_id").alias("sd"), F.col("s.key").alias("sk"))
    goes = keep(sets.join(stays, sets.doc_id.eqNullSafe(stays.sd) & (sets.key == stays.sk), "left_anti").select("doc_id", "key"), "goes")
    again = keep(sets.where("n > 1").select("doc_id", "key"), "again")
    discard(meta, sizes, labels, hubs, sets)
    name, match_id, match_key = (free_name(documents.columns, x) for x in ("set_key", "match_id", "match_key"))
    marked = keyed(documents, n, name, named)

    def matched(names: DataFrame, how: str, frame: DataFrame) -> DataFrame:
        names = names.toDF(match_id, match_key)
        names = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
        return frame.join(names, frame.doc_id.cast("long").eqNullSafe(F.col(match_id)) & (frame[name] == F.col(match_key)), how)

    out = matched(goes, "left_anti", marked)
    if not again.isEmpty():
        out = matched(again, "left_anti", out).unionAll(matched(again, "left_semi", out).dropDuplicates(["doc_id", name]))
    return out.drop(name)
