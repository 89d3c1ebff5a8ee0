import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tarn.llm import pii
from tarn.llm.jaccard import distinct_documents
from tarn.llm.queries import tokenizer_path
from tests.llm.test_jaccard import copies, shingles
from tests.llm.test_quality import brute as judged


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(4000)}" for _ in range(n))


def without_copies(rows):
    """Rows that stay: of each group the smallest id, null last."""
    sets = [shingles(r["text"], 5) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        rank = (r["doc_id"] is None, r["doc_id"] or 0, i)
        if sets[i] and rank < best.get(root(i), ((True, 1 << 62, 1 << 62), -1))[0]:
            best[root(i)] = (rank, i)
    stay = {i for _, i in best.values()} | {i for i, s in enumerate(sets) if not s}
    return [r for i, r in enumerate(rows) if i in stay]


@pytest.fixture()
def folder(spark, tmp_path):
    bench = [(i, prose(9000 + i, 20)) for i in range(5)]
    base = [prose(i, 120) for i in range(30)]
    near = base[0].split()
    near[60] = "changed"
    dirty = [prose(50, 60) + " " + bench[1][1], " ".join(bench[2][1].split()[10:] + ["and"] + bench[2][1].split()[:10]) + " " + prose(51, 60)]
    private = [prose(60, 70) + " mail a.b@c.example.org or +1 (743) 555-3824 now", prose(61, 60) + " 4111 1111 1111 1111 and 10.1.2.3."]
    junk = ["spam eggs ham " * 60, "\n".join([prose(70, 9)] * 30), prose(71, 20), "", None]
    texts = base + [" ".join(near), base[3]] + dirty + private + junk + [prose(80, 3000)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(None, base[5], "en", "s", 1), (6, base[6], "en", "s", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), [dict(zip(("doc_id", "text"), r[:2], strict=True)) for r in rows], bench


def test_against_brute_force(spark, folder):
    path, rows, bench = folder
    kept = without_copies([r for r in rows if judged(r["text"])[-1]])
    held = [r for r in kept if not any(set(shingles(b, 5)) and len(set(shingles(b, 5)) & set(shingles(r["text"], 5))) >= 8 for _, b in bench)]
    assert len(held) == 33 and {r["doc_id"] for r in kept} - {r["doc_id"] for r in held} == {32, 33}
    encode = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode
    marks = {34: ["<EMAIL>", "<PHONE>"], 35: ["<CARD>", "<IP>"]}
    want = {}
    for r in held:
        text = r["text"]
        for span, mark in (("a.b@c.example.org", "<EMAIL>"), ("+1 (743) 555-3824", "<PHONE>"), ("4111 1111 1111 1111", "<CARD>"), ("10.1.2.3", "<IP>")):
            text = text.replace(span, mark)
        assert all(m in text for m in marks.get(r["doc_id"], []))
        want[r["doc_id"]] = [*encode(text, add_special_tokens=False).ids, 0]
    out = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in out} == set(want)
    for r in out:
        assert r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in out) == sum(map(len, want.values()))


def test_all_but_the_last_stage_keep_the_columns(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), path).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [{"doc_id": i, "text": t} for i, t in copies(6)]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], 1) for r in rows], "doc_id long, text string, set_key_0 int").repartition(3)
    got = distinct_documents(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r["doc_id"]) for r in without_copies(rows))
    assert pii.KINDS
