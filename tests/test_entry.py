"""The driver contract, and that the rest stands without the corpus operators."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).parent.parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["l_returnflag", "n", "q", "m", "lo", "hi"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_corpus_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", ".git", "granary"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "granary").mkdir()
    for p in (ROOT / "granary").iterdir():
        if p.name != "llm":
            (tmp_path / "granary" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1') or k == 'pipeline' for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "granary").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
