import ast
import pathlib

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40


def test_core_does_not_import_the_subpackage():
    for path in (ROOT / "copperleaf").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(".llm" in n for n in names), path


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
