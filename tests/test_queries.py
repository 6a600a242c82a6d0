"""Every registered query beside its SQL, on the smallest tables."""

import importlib.util
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parent.parent
spec = importlib.util.spec_from_file_location("check", ROOT / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="the driver's tables are not here")
PLANS, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    held = duckdb.connect()
    held.execute("SET TimeZone = 'UTC'")
    for path in pathlib.Path(FOLDER).glob("*.parquet"):
        held.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return held


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, db, name):
    frame = PLANS[name](spark, FOLDER)
    got = check.rows_of(frame.columns, frame.collect())
    if name not in SQL:
        assert got
        return
    asked = db.execute(SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == sorted(frame.columns)
    assert got == check.rows_of(names, asked.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
