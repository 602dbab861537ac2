"""The driver's entry works, also without the optional subpackage."""

from __future__ import annotations

import importlib.util
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_the_optional_parts(tmp_path, pipeline):
    """With the pipeline file left where it is, or deleted as well."""
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        if (ROOT / name).exists():
            (tmp_path / name).symlink_to(ROOT / name)
    package = tmp_path / "tidegauge"
    package.mkdir()
    for p in (ROOT / "tidegauge").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'decisions' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_the_optional_subpackage():
    for p in (ROOT / "tidegauge").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "tidegauge.llm" not in p.read_text()
    assert importlib.util.find_spec("tidegauge.plans.registry")
