"""The library stands without the training-data operators."""

import ast
from pathlib import Path

import lexmill

ROOT = Path(lexmill.__file__).parent


def test_nothing_else_imports_the_llm_subpackage():
    for path in ROOT.rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
