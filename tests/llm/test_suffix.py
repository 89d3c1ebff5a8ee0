import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tarn.llm import suffix as S


def brute(rows):
    """By the definition, over rows in the order of documents."""
    seen, out = set(), []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - S.LENGTH + 1):
            window = raw[i : i + S.LENGTH]
            if window in seen:
                gone[i : i + S.LENGTH] = 1
            seen.add(window)
        runs = int(((gone[:-1] == 1) & (np.r_[0, gone[:-2]] == 0)).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append(str((doc, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def collection(seed):
    draw = random.Random(seed)
    word = lambda: draw.choice(["the", "of", "thion", "été", "ß", "ein", "x" * draw.randrange(1, 9)]) + str(draw.randrange(40)) * draw.randrange(2)
    text = lambda n: " ".join(word() for _ in range(n))
    out = [text(draw.randrange(1, 250)) for _ in range(40)]
    passage = text(40)
    for i in range(40):
        at = draw.randrange(len(passage) - 30)
        out.append(text(draw.randrange(40)) + passage[at : at + draw.randrange(20, 260)] + text(draw.randrange(40)))
    for i in range(15):
        t = draw.choice(out)
        at = draw.randrange(len(t) + 1)
        out.append(t[:at] + draw.choice(["", "!", "zz"]) + t[at:])
    out += ["a" * 99, "a" * 100, "a" * 350, "ab" * 120, "abc" * 60 + text(3), "", out[3], out[3], passage, passage * 3, "é" * 130, "\x00" * 150, "a" * 100]
    out.append("\n".join([text(12)] * 9))
    return list(enumerate(out))


def got(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in random.Random(1).sample(rows, len(rows))], "doc_id long, text string, n_bytes int, row string").repartition(4)
    return sorted(str(tuple(r)) for r in S.remove_repeats(docs, **more).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = collection(seed)
    assert got(spark, rows) == brute(rows)


def test_many_fragments_of_a_minimizer_and_small_batches(spark, monkeypatch):
    rows = collection(3)
    monkeypatch.setattr(S, "BATCH", 5)
    assert got(spark, rows, most=3) == brute(rows)


def test_repeated_and_null_ids(spark):
    rows = [(None, "b" * 120), (None, None), (1, "q" * 130), (1, "r" * 130), (1, "r" * 130), (2, "q" * 101 + "r" * 101), (3, "b" * 140)]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert got(spark, rows) == brute(ordered)


def test_long_texts_in_pieces(spark, monkeypatch):
    draw = random.Random(7)
    part = "".join(draw.choice("abcdefgh ") for _ in range(900))
    rows = [(0, part + "x" * 300 + part), (1, "y" + part[100:700] * 4), (2, part[::-1])]
    monkeypatch.setattr(S, "PIECE", 256)
    assert got(spark, rows) == brute(rows)


def test_kept_text_and_nothing(spark, nothing):
    docs = spark.createDataFrame([(0, "k" * 20 + "m" * 105), (1, "m" * 105 + "end")], "doc_id long, text string")
    # the second 100 bytes of m's start later in the first document
    assert {r.doc_id: r.text for r in S.remove_repeats(docs, with_text=True).collect()} == {0: "k" * 20 + "m", 1: "end"}
    assert S.remove_repeats(nothing).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_collection_against_sorted_suffixes(tmp_path, seed):
    draw = random.Random(seed)
    strings = ["".join(draw.choice("ab" if seed % 2 else "abcdé") for _ in range(draw.randrange(1, 30))).encode() for _ in range(draw.randrange(1, 25))]
    index = S.Collection(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), f"file://{tmp_path}")
    suffixes = sorted((s[i:], j, i) for j, s in enumerate(strings) for i in range(len(s) + 1))
    alphabet = sorted(set(b"".join(strings)))
    want = [strings[j][i - 1] if i else None for _, j, i in suffixes]
    assert [alphabet[c - 1] if c else None for c in index.symbols.tolist()] == want
    common = [0] + [next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for (a, *_), (b, *_) in zip(suffixes, suffixes[1:], strict=False)]
    assert index.common.tolist() == common
    group, string, place = index.windows(4)
    found = {}
    for g, j, p in zip(group.tolist(), string.tolist(), place.tolist(), strict=True):
        found.setdefault(g, set()).add((j, p))
    truth = {}
    for j, s in enumerate(strings):
        for p in range(len(s) - 3):
            truth.setdefault(s[p : p + 4], set()).add((j, p))
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in truth.values() if len(v) > 1)
    assert not list(tmp_path.iterdir())


def test_a_long_text_after_a_short_one(spark):
    draw = random.Random(11)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(400))
    filler = np.random.default_rng(3).integers(97, 123, (1 << 24) + 5000, np.uint8).tobytes().decode()
    long = filler[:1000] + passage + "|" + filler[1000:] + "|" + passage
    column = pa.array(["short", long, "", "end"], pa.large_string())
    parts = list(S.pieces(column))
    assert max(len(data) for _, _, data, _ in parts) < 1 << 24
    assert {(text, place) for text, place, *_ in parts} >= {(0, 0), (1, 0), (1, S.PIECE), (2, 0)}
    docs = spark.createDataFrame([(0, "short"), (1, long), (2, "end")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.n_removed for r in S.remove_repeats(docs).collect()} == {0: 0, 1: 400, 2: 0}
