"""The driver's contract: names, and the parts that must not need the corpus operators."""

import ast
import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_names_and_callables():
    import __spark_entry__ as entry

    found = entry.queries()
    assert all(callable(f) for f in found.values()) and set(entry.oracle_sql()) <= set(found)
    numbered = [n for n in found if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in numbered) in (list(range(1, 11)), [])


def test_nothing_else_imports_the_corpus_operators():
    for path in [*ROOT.glob("tarn/**/*.py"), ROOT / "bench.py"]:
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("tarn.llm") for n in names), path


def test_no_local_checkpoints():
    for path in ROOT.glob("tarn/**/*.py"):
        assert "localCheckpoint" not in path.read_text(), path
