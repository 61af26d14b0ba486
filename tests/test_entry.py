"""Every curation query against its SQL; the entry works without the training operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from docloom import queries


def test_flagship(spark):
    assert contract.entry(spark).columns == ["doc_id", "pos", "question"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_sql(name, spark, sf_dir, duck):
    want = duck.sql(contract.oracle_sql()[name])
    found = contract.queries()[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(want.columns)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    got, sql = sorted(map(tuple, found.select(*want.columns).collect()), key=key), sorted(want.fetchall(), key=key)
    assert len(got) == len(sql)
    for a, b in zip(got, sql):
        assert a == pytest.approx(b, abs=2e-6) if any(isinstance(x, float) for x in a) else a == b


def test_entry_with_both_folders_deleted(tmp_path):
    """In a copy without the training operators the rest imports and its queries are there."""
    root = Path(contract.__file__).parent
    for name in ("docloom", "tests"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cascade_final' in q and set(q) == set(e.oracle_sql()); import docloom.cli, docloom.streaming.filters"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_entry_reports_other_missing_modules():
    code = "import sys; sys.modules['xxhash'] = None\ntry:\n    import __spark_entry__\nexcept ImportError as e:\n    assert e.name == 'xxhash'\nelse:\n    raise AssertionError"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(contract.__file__).parent)


def test_entry_without_training_operators(tmp_path):
    code = "import sys; sys.modules['docloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=contract.__file__.rpartition("/")[0])
