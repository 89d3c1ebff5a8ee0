import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tarn.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    None, "", "plain", "a@b.com.x@y.z", "a@b.c+d@e.f g@h", "é😀 x.y+z@mail.example.com, 1.2.3.4.5 256.1.1.1 0001.002.03.4", "+1 (743) 555-3824 and +49-30-12-", "4111 1111 1111 1111 x 4111-1111-1111-1112",
    "4465758382889437 4465758382889437", "+" * 50 + "1+1+1 ((((", "1.2.3", "9" * 60, "mail me: joe (at) site (dot) com now", "call (743) 555-3824 please", "it was seen at noon. then dot", "order 2024-05-06 and 12.50",
    "x" * 60_000 + "@" + "a." * 20_000 + "b", "1 2-3 " * 20_000, "a@b.co 1.2.3.4 4111111111111111 +12345678901\n" * 300, "@@..@a.b a@-.-", "٣@٤.٥",
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, "x", -1) for i, t in enumerate([*TEXTS, TEXTS[3]])] + [(None, TEXTS[6], "y", 2)], "doc_id long, text string, spans string, n_email int").repartition(3)


def test_base_against_plain_patterns(rows):
    for r in pii.personal_data(rows).collect():
        text = TEXTS[6] if r.doc_id is None else [*TEXTS, TEXTS[3]][r.doc_id]
        want = base(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in pii.KINDS], text and text[:60]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        got = r.spans.split(",") if r.spans else []
        assert set(want) <= set(got) and len(set(got)) == len(got)
        key = lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1]))
        assert [key(s) for s in got] == sorted(map(key, got))


def test_the_method_adds_spans_and_leaves_other_numbers(rows):
    got = {r.doc_id: r.spans for r in pii.personal_data(rows).collect()}
    assert got[8] == "card:0:16,card:17:33" and got[12] == "email:9:32" and got[13] == "phone:5:19"
    assert got[14] == got[15] == got[2] == ""


def test_redaction(rows):
    out = pii.redacted(rows)
    assert out.columns == rows.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] is None and got[1] == "" and got[2] == "plain" and got[8] == "<CARD> <CARD>" and got[4] == "<EMAIL><EMAIL> g@h"
    assert got[18] == "<EMAIL> <IP> <CARD> <PHONE>\n" * 300


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.co", "mine", "own", 5)], "doc_id long, text string, __SPANS string, __base_email string, n_chars int")
    assert [tuple(r) for r in pii.redacted(docs).collect()] == [(1, "<EMAIL>", "mine", "own", 7)]


def test_held_out_recall_and_no_rows(spark, rows):
    for kind in pii.KINDS:
        assert pii.fit(spark, kind)[2] >= 0.9
    assert pii.personal_data(rows.limit(0)).collect() == []


def test_the_plan_has_no_python(rows):
    plan = pii.personal_data(rows)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange(?!.*REPARTITION)", plan.replace("RoundRobinPartitioning", "REPARTITION"))


def test_blocks_and_pieces_change_nothing(rows, monkeypatch):
    small = rows.where("length(text) < 20000 or text is null")
    run = lambda: [sorted(map(str, f(small).collect())) for f in (pii.personal_data, pii.redacted)]
    want = run()
    monkeypatch.setattr(pii, "BLOCK", 7)
    monkeypatch.setattr(pii, "PIECE", 11)
    assert run() == want
