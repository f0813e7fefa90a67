"""The core stands without the training-data package, which nothing else imports."""

import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_llm():
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("tidemark.llm") for n in names), p


def test_entry_without_llm(tmp_path):
    import shutil

    for name in ("tidemark", "__spark_entry__.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and not any(n[0] == 'p' and n[1].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": "/root"}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_scratch_is_cleared(spark, tmp_path):
    from tidemark import runtime

    path = Path(runtime.local_path(runtime.scratch(spark, "some")))
    df = runtime.cut(spark.range(3), "kept")
    assert df.count() == 3 and path.parent.is_dir()
    runtime.clear_scratch(spark)
    assert not path.parent.exists()
    runtime.clear_scratch(spark)  # nothing left is no error
