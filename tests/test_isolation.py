"""Nothing outside the subpackage for training data imports it."""

from __future__ import annotations

import ast
from pathlib import Path

import rillmark

HOME = Path(rillmark.__file__).resolve().parent


def imported(path: Path) -> set[str]:
    names = set()
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            names |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            names |= {f"{node.module or ''}.{a.name}" for a in node.names} | {node.module or ""}
    return names


def test_engine_does_not_import_llm():
    for path in [p for p in HOME.rglob("*.py") if "llm" not in p.relative_to(HOME).parts]:
        assert not [n for n in imported(path) if "llm" in n.split(".")], path


def test_tests_of_the_engine_do_not_import_llm():
    for path in Path(__file__).parent.glob("*.py"):
        assert not [n for n in imported(path) if "llm" in n.split(".") or n == "corpus_pipeline"], path
