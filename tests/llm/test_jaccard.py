import random
import re
import time
from collections import Counter
from pathlib import Path
from urllib.parse import urlsplit

import numpy as np
import pytest

from pyspark.sql import functions as F

from tarn.llm import components as components_module
from tarn.llm import jaccard as J
from tarn.llm.common import CLEANUP, discard, keep, shared_root
from tarn.llm.components import components


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    return sorted(str((d, len(s), min((x for x in ids[root(i)] if x is not None), default=None))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def copies(seed, stars=60):
    """Unrelated texts, chains and stars of near copies from light to heavy, small texts, equal rows, odd rows."""
    draw = random.Random(seed)
    word = lambda: draw.choice(["the", "of", "and", "to", "in"]) if draw.random() < 0.4 else f"w{draw.randrange(3000)}"
    text = lambda n: [word() for _ in range(n)]
    out = [text(draw.randrange(1, 300)) for _ in range(60)]
    for _ in range(12):
        chain = text(draw.randrange(8, 400))
        for _ in range(6):
            out.append(list(chain))
            for _ in range(max(1, len(chain) // 90)):
                chain[draw.randrange(len(chain))] = word()
    star = text(150)
    for i in range(stars):
        out.append([word() if draw.random() < i / stars * 0.12 else w for w in star])
    for n in range(1, 14):
        out += [(t := text(n)), t[:-1] or t, t + ["x"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(out)]
    rows += [(5, rows[5][1]), (900, rows[3][1].upper()), (901, None), (902, ""), (903, " \n"), (None, rows[7][1]), (None, "only here"), (904, " ".join(text(20_000)))]
    rows += [(905, rows[-1][1] + " more"), (3, rows[9][1])]
    draw.shuffle(rows)
    return rows


def found(spark, rows, n, percent):
    docs = spark.createDataFrame([(i, t, "x", -1) for i, t in rows], "doc_id long, text string, key string, n long").repartition(5)
    return sorted(str(tuple(r)) for r in J.near_duplicates(docs, n, percent).collect())


@pytest.mark.parametrize("n, percent, seed", [(3, 90, 1), (5, 80, 2), (1, 45, 7)])
def test_against_brute_force(spark, n, percent, seed):
    rows = copies(seed)
    assert found(spark, rows, n, percent) == brute(rows, n, percent)


def test_large_regions_give_the_same(spark, monkeypatch):
    rows = copies(4, stars=150)
    monkeypatch.setattr(J, "MAX_SETS", 20)
    monkeypatch.setattr(J, "BROADCAST_ROWS", 10)
    assert found(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_blocks_of_one_label_and_of_others(spark, monkeypatch):
    """Regions that no pivot parts: cells are as large as their region, so blocks meet in pairs."""
    rows = copies(4, stars=150)
    monkeypatch.setattr(J, "MAX_SETS", 8)
    monkeypatch.setattr(J, "PIVOTS", 1)
    monkeypatch.setattr(J, "MINIMA", 0)
    assert found(spark, rows, 2, 60) == brute(rows, 2, 60)


def test_without_pivots_of_buckets_the_rest_is_exact(spark, monkeypatch):
    rows = copies(8)
    monkeypatch.setattr(J, "MINIMA", 0)
    assert found(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_hot_pivots_and_hubs(spark, monkeypatch):
    """One group holds most rows: its hubs are broadcast and its pivots copied."""
    rows = copies(9, stars=200)
    rows += [(2000 + i, rows[3][1]) for i in range(300)]
    monkeypatch.setattr(J, "SALTED", 7)
    monkeypatch.setattr(components_module, "HOT", 5)
    assert found(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_different_sets_with_one_first_key(spark, monkeypatch):
    rows = copies(10)
    monkeypatch.setattr(J, "KEY_BITS", 6)
    assert found(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in copies(11)], "doc_id long, text string, Match_ID int, match_key int, SET_KEY int").repartition(3)
    got = J.distinct_documents(docs)
    assert got.columns == docs.columns and 0 < got.count() < docs.count()


def test_edges_grow_with_a_group_not_with_its_square(spark):
    """Near copies of one text: at most as many edges as labels in each task, and pivots contract the group first."""
    draw = random.Random(12)
    base = [f"w{draw.randrange(3000)}" for _ in range(200)]
    rows = []
    for i in range(400):
        text = list(base)
        for _ in range(1 + i % 3):
            text[draw.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = J.member_sets(docs, J.described(docs, 5).select("doc_id", "key"), 5, J.Keys())
    sets = J.keep(J.may_match(sets, J.own_shingles(sets, 5, 1.0, J.Keys()), F.size("shingles"), 80), "test")
    links = J.keep(J.pivot_links(sets, 80), "test")
    assert 390 < links.count() <= J.MINIMA * 400
    labels = components(links).withColumnRenamed("node", "key")
    marked = sets.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    assert marked.select("label").distinct().count() < 10
    assert J.signature_edges(marked, 80).count() < 10 * J.partitions(docs)


def test_forest():
    a, b = np.array([5, 9, 9, 7, 3]), np.array([3, 5, 3, 8, 3])
    assert J.forest(a, b).tolist() == [[5, 3], [8, 7], [9, 3]]
    assert len(J.forest(a[:0], b[:0])) == 0


def test_nothing(spark, nothing):
    assert J.near_duplicates(nothing, 3, 90).collect() == []


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_a_region_alone_against_all_pairs(percent):
    draw = np.random.default_rng(percent)
    base = [np.sort(draw.choice(5000, 120, replace=False)) for _ in range(6)]
    sets = []
    for i in range(400):
        own = base[i % 6].copy()
        swap = draw.random(len(own)) < draw.random() * 0.25
        own[swap] = draw.integers(5000, 9000, swap.sum())
        sets.append(np.unique(own))
    region = J.Region(np.arange(400), sets, percent)
    got = region.join()
    check = J.Region(np.arange(400), sets, percent)
    as_sets = [set(s.tolist()) for s in sets]
    for i in range(400):
        for j in range(i):
            both = len(as_sets[i] & as_sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                check.unite(i, j)
    assert got.tolist() == [check.root(i) for i in range(400)] and 6 <= len(set(got.tolist())) < 400


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 2000 + i) for i in range(300)] + [(9, 9)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_intermediate_tables_go(spark, monkeypatch):
    """Of a join's tables only the names of what goes and comes again are left, and edges."""
    monkeypatch.setattr(J, "ROUNDS", 1)
    root = Path(urlsplit(shared_root(spark)).path)
    tables = set(root.iterdir())
    docs = spark.createDataFrame(copies(3), "doc_id long, text string").repartition(3)
    out = J.distinct_documents(docs)
    kinds = Counter(x.name.split("-")[0] for x in set(root.iterdir()) - tables)
    assert set(kinds) == {"goes", "again", "edges"} and kinds["edges"] <= 3
    assert 0 < out.count() < docs.count()


def test_kept_tables_leave_no_shuffle_files(spark):
    """Whatever the garbage collector does; the session's own setting stays."""
    setting, before = spark.conf.get(CLEANUP), shuffle_files(spark)
    kept = [keep(spark.range(1000).repartition(2, "id").groupBy(F.col("id") % 7).count(), "test") for _ in range(3)]
    until = time.monotonic() + 10
    while (left := shuffle_files(spark) - before) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP) == setting
    discard(*kept)


def test_discard_leaves_other_frames_alone(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "own"))
    own, kept = spark.read.parquet(str(tmp_path / "own")), keep(spark.range(7), "test")
    at = Path(urlsplit(kept._kept_at).path)
    assert kept.count() == 7 and at.exists()
    discard(own, kept, kept)
    assert own.count() == 5 and not at.exists()


def test_cells_that_do_not_part_are_not_made(spark, monkeypatch):
    """Sets far from all pivots are not copied to every cell, and all links are found."""
    monkeypatch.setattr(J, "MAX_SETS", 40)
    draw, data = random.Random(8), []
    for i in range(60):  # pairs that share 9 of 10 words and, with the others, few
        own = draw.sample(range(400), 30)
        data += [(1, 2 * i, 2 * i, sorted(own)), (1, 2 * i + 1, 2 * i + 1, sorted(own[:-1]))]
    sets = spark.createDataFrame(data, "region long, key long, label long, shingles array<long>")
    cut, tiled = [], J.tiled
    monkeypatch.setattr(J, "tiled", lambda part, most: cut.append(part.count()) or tiled(part, most))
    links = J.large_regions(sets, J.oversize(sets), 80)
    got = {(max(r), min(r)) for x in links for r in x.where("a <> b").collect()}
    assert got == {(2 * i + 1, 2 * i) for i in range(60)} and cut[0] <= len(data)
