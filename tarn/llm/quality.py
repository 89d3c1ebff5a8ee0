"""Quality rules from repetition coverage (operator 9).

Rolling hashes over each text's words give, for several n-gram lengths, the words that lie inside an n-gram found twice or
more in the same text; their characters, and those of repeated lines, are measured against all word characters. It is one
pass without a shuffle: a text's figures depend on that text alone.

Defined results: a null or empty text has no words, zero in all counts, and fails; a one-line text of any length is
judged whole; repeated rows give repeated results; an empty table gives no rows; a null id stays null; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm.common import IS_WORD, MIX_A, U64, Rolling, flat, mixed, owners, repeated, slices, word_hashes, words

#: Largest share of word characters inside repeated n-grams, by n, that a kept text may have.
MOST_REPEATED = {3: 0.50, 5: 0.40, 7: 0.35, 10: 0.30}
#: Largest share of characters in repeated lines, and of symbols among word characters.
MOST_LINES, MOST_SYMBOLS = 0.30, 0.20
MIN_WORDS, BASE_PERCENT, BASE_N = 50, 50, 3
SYMBOLS = b"#*$%&|<>"
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, dup_ngram_share double"


def coverage(rolling: Rolling, first: np.ndarray, n: int) -> np.ndarray:
    """Which words lie inside an n-gram that its text holds twice or more."""
    total = int(first[-1])
    covered = np.zeros(total + 1, np.int64)
    keys = rolling.windows(n)
    if len(keys):
        owner = owners(first)
        inside = owner[: len(keys)] == owner[n - 1 :]
        at = np.flatnonzero(inside)
        at = at[repeated(keys[at] ^ mixed((owner[at] + 1).astype(U64) * MIX_A))]
        np.add.at(covered, at, 1)
        np.subtract.at(covered, at + n, 1)
    return np.cumsum(covered[:total]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of the values of each text."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def repeated_lines(text: bytes) -> tuple[int, int]:
    """(number, characters) of the lines with a word that equal an earlier line."""
    seen, count, chars = set(), 0, 0
    for line in text.split(b"\n"):
        if line in seen:
            if bare := line.strip():
                count += 1
                chars += sum(len(w.decode()) for w in bare.split())
        else:
            seen.add(line)
    return count, chars


def measured(column: pa.Array) -> dict[str, np.ndarray]:
    """The figures of each text of the column."""
    data, offsets = flat(column)
    starts, ends, first = words(data, offsets)
    codes = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=codes[1:])
    chars = codes[ends] - codes[starts]
    rolling = Rolling(word_hashes(data, starts, ends))
    out = {"n_words": np.diff(first), "word_chars": per_text(chars, first)}
    out["n_symbols"] = per_text(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), offsets)
    raw = data.tobytes()
    lines = np.array([repeated_lines(raw[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)], np.int64).reshape(-1, 2)
    out["n_dup_lines"] = lines[:, 0]
    whole = np.maximum(out["word_chars"], 1)
    worst, fine = np.zeros(len(column)), np.ones(len(column), bool)
    for n, most in MOST_REPEATED.items():
        covered = coverage(rolling, first, n)
        if n == BASE_N:
            out["n_repeat_words"] = per_text(covered, first)
        share = per_text(chars * covered, first) / whole
        worst, fine = np.maximum(worst, share), fine & (share <= most)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * out["n_words"])
    out["dup_line_share"], out["dup_ngram_share"] = lines[:, 1] / whole, worst
    out["kept"] = ~out["base_failed"] & fine & (out["dup_line_share"] <= MOST_LINES) & (out["n_symbols"] <= MOST_SYMBOLS * whole)
    return out


def quality(documents: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The figures and the verdict of every text, beside the columns named in `carry`."""
    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in carry), COLUMNS])
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in slices(batch):
                found = measured(column)
                kept = [part.column(part.schema.get_field_index(c)) for c in carry]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(found[n]) for n in names)], names=[*carry, *names])

    return documents.select(*dict.fromkeys((*carry, "text"))).mapInArrow(run, schema)


def kept_documents(documents: DataFrame) -> DataFrame:
    """The documents, with all their columns, that the rules keep."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in slices(batch):
                yield part.filter(pa.array(measured(column)["kept"]))

    return documents.mapInArrow(run, documents.schema)
