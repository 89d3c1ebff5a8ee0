import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tarn.llm.packing import pack, windows
from tarn.llm.queries import tokenizer_path
from tarn.llm.common import shared_folder
from tarn.llm.tokens import EliasFano, Shard, encoder, read_tokens, token_output, write_tokens


def ids_of(name, text):
    return Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_tokenizers_ids(name, texts):
    column = pa.array([t or "" for _, t in texts], pa.large_string())
    ids, starts = encoder(tokenizer_path(name)).encode(column)
    whole = Tokenizer.from_file(tokenizer_path(name))
    for i, (_, text) in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 4000])
@pytest.mark.parametrize("most", [1, 9, 5000, 10**13])
def test_elias_fano_round_trip(n, most):
    values = np.sort(np.random.default_rng(n).integers(0, most, n))
    code = EliasFano.read(memoryview(EliasFano.of(values).to_bytes()))
    assert list(code.numbers()) == values.tolist()
    assert all(code.select(i) == values[i] for i in range(n))


def test_elias_fano_is_near_minimal():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 3000, 10_000))
    assert len(EliasFano.of(ends).to_bytes()) * 8 < 10_000 * (np.log2(ends[-1] / 10_000) + 3)


def test_shard_round_trip():
    lengths, ids = np.array([2, 1, 3]), np.array([5, 6, 7, 70_000, 9, 1])
    shard = Shard(memoryview(Shard.to_bytes([None, -4, 9], lengths, ids)))
    assert [(d, s, x.tolist()) for d, s, x in shard.documents()] == [(None, 0, [5, 6]), (-4, 2, [7]), (9, 3, [70_000, 9, 1])]
    assert [shard.doc_id(i) for i in range(3)] == [None, -4, 9] and shard.document(2).tolist() == [70_000, 9, 1]


def test_token_output_against_the_tokenizer(documents, texts):
    name = "word_bpe_49k.json"
    want = {}
    for doc, text in texts:
        ids = [*ids_of(name, text), 1]
        want.setdefault(doc, []).append((len(ids), crc(ids)))
    got = sorted((tuple(r) for r in token_output(documents, tokenizer_path(name)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d for d, _ in texts), key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got]).tolist()[:-1]]
    for doc, own in want.items():
        assert sorted(own) == sorted((n, c) for d, _, n, c in got if d == doc)


def test_one_id_for_most_rows_is_written_by_many_tasks(spark):
    docs = spark.createDataFrame([(None if i % 3 else 5, f"text {i % 40}") for i in range(600)], "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = write_tokens(docs, tokenizer_path("word_bpe_49k.json"), 1, shared_folder(spark, "test"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1 and max(r.n_docs for r in manifest.collect()) < 400
    assert read_tokens(manifest).groupBy("doc_id").count().where("doc_id = 5").first()["count"] == 200


def test_token_output_of_nothing(nothing):
    assert token_output(nothing, tokenizer_path("word_bpe_49k.json")).collect() == []


def test_packing_covers_every_id_once(documents, texts):
    name = "byte_bpe_50k.json"
    rows = pack(documents, tokenizer_path(name)).collect()
    want = sorted(((d is not None, d or 0), crc([*ids_of(name, t), 0])) for d, t in texts)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for doc in {d for d, _ in texts}:
        copies = [t for d, t in texts if d == doc]
        ids = [*ids_of(name, copies[0]), 0]
        own = sorted(pieces[doc], key=lambda r: r.start)[:: len(copies)]
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own]).tolist()[:-1]]
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(crc(ids[r.start : r.start + r.length]) == r.ids_crc32 for r in own)
    assert len(want) == len(texts)
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for spans in filled.values():
        spans.sort()
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans]).tolist()[:-1]] and sum(n for _, n in spans) <= 1024


def test_packing_of_nothing(nothing):
    assert pack(nothing, tokenizer_path("byte_bpe_50k.json")).collect() == []


def test_windows_are_near_equal_and_few():
    sizes = np.random.default_rng(3).integers(1, 257, 3000)
    at = windows(sizes, 1024)
    full = np.bincount(at, weights=sizes)
    assert full.max() <= 1024 and full.max() - full.min() <= 24
    assert 1 - sizes.sum() / (1024 * len(full)) < 0.01
    assert windows(np.array([1024, 1024, 1]), 1024).tolist() in ([0, 1, 2], [2, 1, 0], [1, 2, 0], [2, 0, 1], [0, 2, 1], [1, 0, 2])
