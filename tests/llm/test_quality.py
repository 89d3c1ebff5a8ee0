import re
from collections import Counter

from tarn.llm.quality import MOST_LINES, MOST_REPEATED, MOST_SYMBOLS, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)

    def covered(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        often = Counter(grams)
        return {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(n)}

    chars = sum(map(len, words))
    lines, seen, dup, dup_chars = text.split("\n"), set(), 0, 0
    for line in lines:
        if line in seen and WORD.search(line):
            dup += 1
            dup_chars += sum(map(len, WORD.findall(line)))
        seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    repeat = len(covered(3))
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    fine = all(sum(len(words[i]) for i in covered(n)) <= most * max(chars, 1) for n, most in MOST_REPEATED.items())
    fine = fine and dup_chars <= MOST_LINES * max(chars, 1) and symbols <= MOST_SYMBOLS * max(chars, 1)
    return len(words), chars, symbols, dup, repeat, failed, not failed and fine


def test_against_brute_force(documents, texts):
    got = sorted(str(tuple(r)[:8]) for r in quality(documents).collect())
    assert got == sorted(str((d, *brute(t))) for d, t in texts)


def test_nothing(nothing):
    assert quality(nothing).collect() == []
