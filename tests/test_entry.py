"""The registered queries against their SQL, and the package without its optional part."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from rowforge.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "convert_matrix"])
def test_query(spark, sf, db, name):
    got = QUERIES[name](spark, sf)
    if name not in ORACLES:
        assert got.count() > 0
        return
    want = db.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(tuple(str(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(str(v) for v in r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert a == b


def test_import_without_the_training_data_part(tmp_path):
    import shutil

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "rowforge", tmp_path / "rowforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'where_in' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=100)
