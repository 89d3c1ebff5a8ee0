import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tarn.llm import decontam
from tarn.llm.decontam import SEED_WORDS, contaminated, decontaminated, tiles


def brute_tiles(a, b, k):
    """Greedy string tiling by its definition: all longest unmarked matches, again and again; the marked words of a."""
    in_a, in_b, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in in_a and j + n not in in_b:
                    n += 1
                if n > best[0] or n == best[0] and (-i, -j) > (-best[1], -best[2]):
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return total
        in_a.update(range(i, i + n))
        in_b.update(range(j, j + n))
        total += n


@pytest.mark.parametrize("seed", range(40))
def test_tiles_against_the_definition(seed):
    draw = random.Random(seed)
    a = [draw.choice("abc") for _ in range(draw.randrange(1, 25))]
    b = a[12:] + a[:12] + [draw.choice("abc") for _ in range(draw.randrange(20))]
    k = draw.choice([2, 3])
    pairs = [(i, j) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i : i + k] == b[j : j + k]]
    assert sum(n for *_, n in tiles(pairs, k)) == brute_tiles(a, b, k)


def item(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + str(draw.randrange(50)) for _ in range(n))


@pytest.fixture()
def tables(spark):
    items = [(i, item(i, 30)) for i in range(12)] + [(20, None), (21, ""), (22, "only three words"), (23, "Four Plain WORDS here"), (24, "\u65e5\u672c\u8a9e\u306e\u6587"), (5, item(5, 30)), (None, item(99, 20))]
    w = item(1, 30).split()
    docs = [
        (0, "pad " * 40 + item(0, 30) + " tail"),
        (1, " ".join(w[20:] + ["x"] + w[:10] + ["y"] + w[10:20])),  # reordered
        (2, " ".join(item(2, 30).upper().split()) + "."),
        (3, " ".join(item(3, 30).split()[:14])),  # under half
        (4, None), (5, ""), (6, "four, plain words; here"), (7, item(500, 400)), (8, "\n".join([item(4, 30)] * 3 + [item(6, 30)])),
        (11, "has only three words, in a row"), (12, "\u65e5\u672c\u8a9e\u306e\u6587"), (13, "words three only"),
        (None, item(99, 20)), (9, item(7, 30)), (9, item(8, 30)), (10, "z " * 30_000 + item(9, 30)),
    ]
    return spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")


WANT = {(0, "0"), (1, "1"), (2, "2"), (6, "23"), (8, "4,6"), (None, "null"), (9, "7,8"), (10, "9"), (11, "22"), (12, "24")}


def by_definition(docs, items, k=SEED_WORDS, threshold=0.5):
    """Plain words, tiles by their definition, coverage: the items of each contaminated id."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010FFFF]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for d, text in docs:
        for i, item in items:
            a, b = words(item), words(text)
            if a and brute_tiles(a, b, min(k, len(a))) / len(a) >= threshold:
                out.setdefault(d, set()).add(i)
    return {(d, ",".join("null" if i is None else str(i) for i in sorted(s, key=lambda i: (i is not None, i or 0)))) for d, s in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_end_to_end_against_the_definition(spark, seed):
    """Small vocabularies, so that seeds, shared and repeated passages are many."""
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choice(["ab", "Cd", "é", "12", "x-y", "日本"]) for _ in range(n))
    items = [(None if i == 3 else i % 9, text(draw.randrange(1, 14))) for i in range(12)] + [(50, ""), (51, None)]
    docs = [(i, text(draw.randrange(0, 25))) for i in range(25)] + [(100 + n, f"{text(4)} {t or ''}, {text(3)}") for n, (_, t) in enumerate(items)] + [(None, items[4][1]), (7, None)]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_ids) for r in got.collect()} == by_definition(docs, items)


def test_equal_hashes_of_other_words_do_not_count(spark, monkeypatch):
    monkeypatch.setattr(decontam, "word_hashes", lambda data, starts, ends, table: np.zeros(len(starts), np.uint64))
    seeds = decontam.Seeds([(1, "one two three four five six")], 5)
    assert [max(x.values(), default=0) for x in seeds.coverage(pa.array(["six five four three two one", "a one two three four five six"], pa.large_string()))] == [0, 0]


def test_contaminated(tables):
    docs, bench = tables
    rows = contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_ids) for r in rows} == WANT and len(rows) == len(WANT)
    assert all(0.5 <= r.coverage <= 1 and r.contaminated for r in rows) and SEED_WORDS == 5
    assert contaminated(docs.limit(0), bench).collect() == [] == contaminated(docs, bench.limit(0)).collect()


def test_documents_pass_with_all_columns(tables):
    docs, bench = tables
    kept = decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7, 13]
    assert decontaminated(docs, bench.limit(0)).count() == docs.count()


def test_more_blocks_give_the_same(tables, monkeypatch):
    docs, bench = tables
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 700)
    assert {(r.doc_id, r.item_ids) for r in contaminated(docs, bench).collect()} == WANT
    assert sorted(r.doc_id for r in decontaminated(docs, bench).collect()) == [3, 4, 5, 7, 13]
