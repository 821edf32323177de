"""Every registered query of the base library against its SQL."""

from __future__ import annotations

import pytest

from helpers import ROOT, same
from kvloom import queries as q


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_sql(name, spark, small):
    same(q.QUERIES[name], q.SQL[name], spark, small)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(q.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_llm_is_optional(tmp_path):
    """Without the llm folders and the pipeline the entry point imports and keeps the other queries."""
    import shutil
    import subprocess
    import sys

    shutil.copytree(f"{ROOT}/kvloom", tmp_path / "kvloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'key_slot' in n and not any(x.startswith('op') for x in n); assert 'key_slot' in e.oracle_sql()"
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
