"""The contract with the driver, with and without the text operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "answer", "n_docs", "avg_score"] and df.count() > 0


def test_every_query_of_the_engine_is_there():
    from corvid import queries

    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


def test_entry_imports_without_the_text_operators(tmp_path):
    own = tmp_path / "repo"
    shutil.copytree(ROOT, own, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'topk_exact' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=own, env={"PYTHONPATH": str(own), "PATH": "/usr/bin:/bin"}, check=True)


def test_nothing_else_imports_the_text_operators():
    for p in (ROOT / "corvid").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text().replace("mock_llm", ""), p
