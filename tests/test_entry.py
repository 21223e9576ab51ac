"""The entry points load without the optional subpackage."""

import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_entry_loads_without_the_subpackage(tmp_path, pipeline_too):
    gone = ["llm", ".git", "__pycache__", ".pytest_cache"] + ["corpus_pipeline.py"] * pipeline_too
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(*gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q01_interval_coverage' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, timeout=120)
