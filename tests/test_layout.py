import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1] / "baglight"


def test_nothing_else_imports_the_training_data_operators():
    for p in ROOT.rglob("*.py"):
        if p.relative_to(ROOT).parts[0] != "llm":
            for n in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
                assert not any("baglight.llm" in x for x in names), p
