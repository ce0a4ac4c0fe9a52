"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from packetloom.plans import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.COMPARISON_SQL)
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_text_operators(tmp_path):
    """The library and the registry import with both text folders deleted, and nothing of them is registered."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.join(os.path.dirname(__file__), "..")
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries()))"], cwd=tmp_path / "copy", capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")})
    assert run.returncode == 0, run.stderr
    names = run.stdout.split()
    assert set(names) == set(registry.QUERIES) and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
