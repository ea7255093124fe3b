"""Smoke: the driver contract at sf0.001; queries without SQL run here, the others in test_oracle."""

import os

import pytest

from conftest import ROOT, SF001

import __spark_entry__ as E


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["query_id", "rank", "id", "distance"]


def test_imports_without_a_session_and_without_the_optional_folder(tmp_path):
    """The entry module imports with and without the training-data subpackage."""
    import shutil
    import subprocess
    import sys
    for keep in (True, False):
        copy = tmp_path / str(keep)
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "tests", "*.md", "__pycache__"))
        if not keep:
            shutil.rmtree(copy / "kestrel" / "llm", ignore_errors=True)
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; print(any(k.startswith('op') for k in e.queries()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0, out.stderr
        assert out.stdout.strip() == str(keep and os.path.isdir(os.path.join(ROOT, "kestrel", "llm")))


def test_oracle_keys_are_registered():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_query_runs(spark, name):
    df = E.queries()[name](spark, SF001)
    assert df.count() >= 0
