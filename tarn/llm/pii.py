"""Personal data: base patterns and a boosted-tree choice among candidate spans (operator 2).

Everything on the rows is a Spark SQL expression in one pass without a shuffle. Offsets come from splitting a text at a
pattern: the gaps and the matches alternate, and their lengths add up. Base spans are the leftmost matches of four
patterns that hold further checks. High-recall generators add candidates that may overlap them and each other; each is
described by format and context, scored by gradient-boosted trees written as CASE expressions, and chosen where its score
reaches the threshold of its kind. The trees are grown on the driver from LABELLED texts made by rule (so many rows a
kind), half of them held out to set the threshold at PRECISION.

Patterns are written so that they match what the plain ones match without backtracking: a repeated part that nothing can
shorten is possessive, and a run is tried from its first character or the end of the match before it.

Defined results: a null or empty text has no spans, and a null text stays null when redacted; a text of any length is
searched whole; a span found twice is reported once, spans that start alike are ordered by their end, and where they overlap
the first one's kind stands for all when redacted; repeated rows give repeated results; an empty table gives no rows; null
ids stay null; other columns, of any name, pass through untouched.
"""

from __future__ import annotations

import random
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, and what a text must hold for the pattern to be tried.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDED = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){12}", "phone": r"\+[0-9]"}
#: The generators of candidates.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{2,}+)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}+|[0-9]{4}[\x20.-][0-9]{6}[\x20.-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,5}+(?![0-9])",
}
WIDE_NEEDED = {"email": r"(?i)@|[\[(\x20]at[\])\x20]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9]{4}(?:[\x20.-]?+[0-9]){8}", "phone": r"[0-9]\)?[\x20./-]{1,2}\(?[0-9]{2}"}
FOR = {
    "email": r"(?i)mail|contact|write|reach|address|e-post|correo|courriel",
    "ip": r"(?i)\bip\b|host|server|address|login|client|node|from",
    "card": r"(?i)card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta",
    "phone": r"(?i)tel|phone|call|mobile|cell|fax|contact|ring|whatsapp|sms",
}
AGAINST = r"(?i)order|invoice|isbn|issn|version|release|serial|sku|part no|id[:#]|ref|build|section|chapter|page|score|date|price|population"
#: Values that are put in a row at once, and code points of a text's piece.
BLOCK, PIECE = 512, 4096
LABELLED, ROUNDS, RATE, PRECISION, SEED = 500, 25, 0.3, 0.98, 11
FEATURES = ("digits", "length", "plus", "bracket", "marks", "luhn", "for", "against", "glued_left", "glued_right", "date", "octets", "groups")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = digits.substr(n - i + 1, F.lit(1)).cast("int")
        twice = 2 * d
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i))
    return (n > 0) & (total % 10 == 0)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def octets(text: Column) -> Column:
    """Whether every dotted part is at most 255."""

    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(text, r"\."), small)


def valid(kind: str, span: Column) -> Column:
    """The check that a base match must pass."""
    match = span["match"]
    digits = digits_of(match)
    if kind == "ip":
        return octets(match)
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def let(value: Column, use) -> Column:
    """What `use` makes of a value that is worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join) -> Column:
    """What the associative `join` makes of 0, each value and all values before it. Appending copies an array, so blocks of
    BLOCK values are done by themselves and put together."""

    def sweep(part: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<int>"), lambda acc, x: F.array_append(acc, join(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)), x)))

    def behind(acc: Column, part: Column) -> Column:
        moved = F.transform(part, lambda x: join(acc["at"], x))
        return F.struct(join(acc["at"], F.element_at(part, -1)).alias("at"), F.array_append(acc["parts"], moved).alias("parts"))

    def whole(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(v), F.lit(BLOCK)), lambda i: sweep(F.slice(v, i, BLOCK)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("parts"))
        return F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(F.aggregate(parts, zero, behind, lambda acc: F.flatten(acc["parts"])))

    return let(values, whole)


def cut(text: Column) -> Column:
    """The text in pieces of PIECE code points, so that a place far behind is reached without walking there."""
    return F.when(F.length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0)))


def part(pieces: Column, start: Column, n: Column) -> Column:
    """The n code points from a start on of a text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    held = F.slice(pieces, first + 1, F.floor((start - first * PIECE + n) / PIECE).cast("int") + 1)
    return F.array_join(held, "").substr(start - first * PIECE + 1, n)


def matches(text: Column, pattern: str, needed: str) -> Column:
    """(start, end, match) of every leftmost non-overlapping match, in code points."""
    spans = "array<struct<start:int,end:int,match:string>>"
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("match"), (F.length(g) + F.coalesce(F.length(m), F.lit(0))).alias("n")))

    def placed(s: Column) -> Column:
        ends = running(F.transform(s, lambda x: x["n"]), lambda a, b: a + b)
        out = F.zip_with(s, ends, lambda x, end: F.struct((end - F.length(x["match"])).alias("start"), end.alias("end"), x["match"].alias("match")))
        return F.filter(out, lambda x: x["match"].isNotNull())  # the last gap has no match behind it

    return F.when(text.rlike(needed), let(steps, placed)).otherwise(F.array().cast(spans))


def base_spans(text: Column) -> list[Column]:
    """The base spans of each kind."""
    return [F.filter(matches(text, BASE[k], NEEDED[k]), partial(valid, k)) for k in KINDS]


def in_context(pieces: Column, span: Column) -> Column:
    """A span with the text to its left and right."""
    n = F.least(F.lit(24), span["start"])
    return F.struct(*[span[f].alias(f) for f in ("start", "end", "match")], part(pieces, span["start"] - n, n).alias("left"), part(pieces, span["end"], F.lit(4)).alias("right"))


def described(kind: str, span: Column) -> list[Column]:
    """The features of a candidate in its context."""
    match, digits, left, right = span["match"], digits_of(span["match"]), span["left"], span["right"]
    flags = [
        match.startswith("+"), match.contains("("), luhn(digits), left.rlike(FOR[kind]), left.rlike(AGAINST), left.rlike(r"[\p{L}0-9#$€.,:/=_-]$"),
        right.rlike(r"^(?:[\p{L}0-9%€$_/-]|[.,][0-9])"), match.rlike(r"^(?:(?:19|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9]|[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)?[0-9]{2})$"), octets(match),
    ]
    plus, bracket, checked, pro, contra, glued_left, glued_right, date, small = [F.coalesce(f, F.lit(False)).cast("int") for f in flags]
    marks, groups = F.length(F.regexp_replace(match, r"[^\x20./-]", "")), F.size(F.split(match, r"[\x20()./-]+"))
    return [F.length(digits), F.length(match), plus, bracket, marks, checked, pro, contra, glued_left, glued_right, date, small, groups]


# The labelled texts.
def labelled_texts(kind: str, n: int) -> list[tuple[str, int]]:
    """n texts with one candidate of the kind each, and whether it is personal data."""
    draw = random.Random(f"{SEED}{kind}")
    digit = lambda k: "".join(str(draw.randrange(10)) for _ in range(k))
    word = lambda: "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(2, 9)))

    def card() -> str:
        body = draw.choice("3456") + digit(draw.choice([12, 14, 14, 14, 15]))
        total = sum(int(d) if i % 2 else (int(d) * 2 - 9 * (int(d) > 4)) for i, d in enumerate(reversed(body)))
        return body + str(-total % 10)

    def grouped(x: str) -> str:
        mark = draw.choice(["", " ", "-"])
        return mark.join(x[i : i + 4] for i in range(0, len(x), 4)) if len(x) == 16 else x

    def wrong(x: str) -> str:
        return x[:-1] + str((int(x[-1]) + draw.randrange(1, 10)) % 10)

    octet = lambda: str(draw.randrange(256))
    good = {
        "email": lambda: draw.choice([f"{word()}@{word()}.com", f"{word()}.{word()}@{word()}.org", f"{word()} (at) {word()} (dot) com", f"{word()}[at]{word()}[dot]net", f"{word()}(at){word()}.de", f"{word()} @ {word()}.com"]),
        "ip": lambda: draw.choice([".".join(octet() for _ in range(4)), ":".join(f"{draw.randrange(4096, 65536):x}" for _ in range(8))]),
        "card": lambda: grouped(card()),
        "phone": lambda: draw.choice([f"+{draw.randrange(1, 99)} {digit(3)} {digit(3)} {digit(4)}", f"({digit(3)}) {digit(3)}-{digit(4)}", f"+1 ({digit(3)}) {digit(3)}-{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"00{draw.randrange(30, 50)} {digit(3)} {digit(7)[:5]}"]),
    }[kind]
    bad = {
        "email": lambda: draw.choice([f"{word()} at {word()} dot {word()}", f"{word()} at {word()}. {word()}", f"{word()} at {word()} . {word()}", f"{word()} @ {word()} . {word()}"]),
        "ip": lambda: draw.choice([".".join(str(draw.randrange(256, 1000)) for _ in range(4)), f"{draw.randrange(10)}.{draw.randrange(10)}.{draw.randrange(400, 999)}.{draw.randrange(10)}"]),
        "card": lambda: grouped(wrong(card())) if draw.random() < 0.7 else digit(13),
        "phone": lambda: draw.choice([f"{draw.randrange(1900, 2030)}-{draw.randrange(1, 13):02d}-{draw.randrange(1, 29):02d}", f"{digit(2)}.{digit(2)}", f"{digit(3)} {digit(3)}", f"{digit(1)}-{digit(2)}", f"{digit(4)} {digit(4)} {digit(4)} {digit(4)}", f"{digit(2)}/{digit(2)}/{digit(4)}", f"{digit(1)} {digit(3)} {digit(3)}", ".".join(octet() for _ in range(4)), f"{octet()}.{octet()}.{octet()}"]),
    }[kind]
    pro = {"email": ["mail me:", "contact", "write to"], "ip": ["from host", "server", "login from"], "card": ["card", "pay with", "Visa:"], "phone": ["call", "tel.", "phone:", "fax"]}[kind]
    contra = ["order", "invoice", "version", "serial", "ref", "section", "page"]
    out = []
    for i in range(n):
        yes = i % 2
        lead = draw.choice(pro) if draw.random() < (0.4 if yes else 0.1) else draw.choice(contra) if draw.random() < (0.02 if yes else 0.5) else word()
        out.append((f"{word()} {word()} {lead} {good() if yes else bad()}{draw.choice(['', '.', ',', ' ' + word(), '$$$' if yes else '%'])}", yes))
    return out


def grow(rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int):
    """A regression tree for one boosting round: nested (feature, cut, low, high) or a leaf's value."""
    value = RATE * float(gradient.sum() / (weight.sum() + 1.0))
    best = None
    if depth and len(rows) > 8:
        for f in range(rows.shape[1]):
            for cut in (values := np.unique(rows[:, f]))[:-1]:
                low = rows[:, f] <= cut
                gain = sum(gradient[s].sum() ** 2 / (weight[s].sum() + 1.0) for s in (low, ~low))
                if best is None or gain > best[0] + 1e-9:
                    best = gain, f, float(cut + values[np.searchsorted(values, cut) + 1]) / 2, low
    if best is None:
        return value
    _, f, cut, low = best
    return f, cut, grow(rows[low], gradient[low], weight[low], depth - 1), grow(rows[~low], gradient[~low], weight[~low], depth - 1)


def scored(tree, rows: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(rows), tree)
    f, cut, low, high = tree
    return np.where(rows[:, f] <= cut, scored(low, rows), scored(high, rows))


def boosted(rows: np.ndarray, labels: np.ndarray) -> list:
    """Trees of depth two under the logistic loss."""
    margin, trees = np.zeros(len(rows)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        trees.append(grow(rows, labels - p, p * (1 - p), 2))
        margin += scored(trees[-1], rows)
    return trees


def threshold(margins: np.ndarray, labels: np.ndarray) -> float:
    """The least margin, even odds or better, from which on the held-out rows reach PRECISION."""
    order = np.argsort(-margins, kind="stable")
    right = np.cumsum(labels[order]) / np.arange(1, len(order) + 1)
    last = np.r_[np.diff(margins[order]) != 0, True]
    good = np.flatnonzero((right >= PRECISION) & last & (margins[order] >= 0))
    return float(margins[order][good[-1]]) if len(good) else float("inf")


def fit(spark: SparkSession, kind: str) -> tuple[list, float, float]:
    """(trees, threshold, held-out recall) of a kind, from LABELLED texts described by the same expressions as any text."""
    texts = spark.createDataFrame(labelled_texts(kind, LABELLED), "text string, label int")
    spans = texts.select("text", "label", F.explode(matches(F.col("text"), WIDE[kind], WIDE_NEEDED[kind])).alias("s"))
    spans = spans.select(in_context(cut(F.col("text")), F.col("s")).alias("s"), "label")
    table = np.array([[float(v) for v in r] for r in spans.select(*described(kind, F.col("s")), "label").collect()])
    rows, labels = table[:, :-1], table[:, -1]
    held = np.arange(len(rows)) % 4 >= 2
    trees = boosted(rows[~held], labels[~held])
    margins = sum(scored(t, rows[held]) for t in trees)
    least = threshold(margins, labels[held])
    return trees, least, float((margins[labels[held] == 1] >= least).mean())


def as_column(tree, features: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, cut, low, high = tree
    return F.when(features[f] <= cut, as_column(low, features)).otherwise(as_column(high, features))


def picked(trees: list, least: float, span: Column) -> Column:
    """Whether the trees choose a described candidate."""
    features = [span["f"][i] for i in range(len(FEATURES))]
    return reduce(lambda a, b: a + b, [as_column(t, features) for t in trees]) >= least


def with_features(kind: str, span: Column) -> Column:
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.array(*described(kind, span)).alias("f"))


def chosen_spans(text: Column, pieces: Column, models: dict[str, tuple[list, float, float]]) -> list[Column]:
    """The candidates of each kind that its trees choose, of a text that is also there in pieces."""
    out = []
    for kind in KINDS:
        spans = F.transform(matches(text, WIDE[kind], WIDE_NEEDED[kind]), partial(in_context, pieces))
        out.append(F.filter(F.transform(spans, partial(with_features, kind)), partial(picked, *models[kind][:2])))
    return out


def as_span(kind: int, span: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"))


def labelled(spans: Column, kind: int) -> Column:
    return F.transform(spans, partial(as_span, kind))


def is_kind(kind: int, span: Column) -> Column:
    return span["kind"] == kind


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def once(spans: Column) -> Column:
    """Sorted spans, each once."""
    return let(F.sort_array(spans), lambda held: F.filter(held, lambda s, i: (i == 0) | (s != F.get(held, i - 1))))


def detect(documents: DataFrame) -> tuple[DataFrame, str, str, str]:
    """The documents with their base spans and all spans (arrays of kind, start, end in that order), each sorted, and their texts
    in pieces; and the names of those three columns, which no other column has in any case of letters."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in documents.columns):
        mark += "_"
    models = {k: fit(documents.sparkSession, k) for k in KINDS}
    text, pieces = F.coalesce(F.col("text").cast("string"), F.lit("")), f"{mark}pieces"
    held = documents.withColumn(pieces, cut(text))
    held = held.withColumns({f"{mark}base_{k}": s for k, s in zip(KINDS, base_spans(text), strict=True)} | {f"{mark}more_{k}": s for k, s in zip(KINDS, chosen_spans(text, F.col(pieces), models), strict=True)})
    base = F.flatten(F.array(*[labelled(F.col(f"{mark}base_{k}"), i) for i, k in enumerate(KINDS)]))
    more = F.flatten(F.array(*[labelled(F.col(f"{mark}more_{k}"), i) for i, k in enumerate(KINDS)]))
    held = held.withColumns({f"{mark}base": base, f"{mark}spans": once(F.concat(base, more))}).drop(*[f"{mark}{w}_{k}" for w in ("base", "more") for k in KINDS])
    return held, f"{mark}base", f"{mark}spans", pieces


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, their digest, and all spans."""
    found, base, spans, _ = detect(documents.select("doc_id", "text"))
    counts = [F.size(F.filter(base, partial(is_kind, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col(base)), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))


def redacted(documents: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans become one. n_chars follows."""
    text, names = F.col("text"), F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    found, _, spans, pieces = detect(documents)
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def rebuilt(held: Column, reach: Column) -> Column:
        def before(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(reach, i - 1), F.lit(0))
            return F.when(s["start"] >= at, F.concat(part(F.col(pieces), at, s["start"] - at), F.get(names, s["kind"])))

        return F.concat(F.array_join(F.transform(held, before), ""), part(F.col(pieces), F.element_at(reach, -1), F.length(text)))

    def reached(held: Column) -> Column:
        return let(running(F.transform(held, lambda s: s["end"]), F.greatest), partial(rebuilt, held))

    changed = found.withColumn("text", F.when(F.size(spans) > 0, let(by_start, reached)).otherwise(text))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return changed.select(*documents.columns)
