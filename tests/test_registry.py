import importlib.util
from pathlib import Path

import duckdb
import pytest

from quern.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    assert rows
    if name in registry.ORACLES:
        got = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(tuple(str(r[names.index(c)]) for c in df.columns) for r in got.fetchall())
        assert sorted(tuple(map(str, r)) for r in rows) == want


def test_entry_lists_all():
    spec = importlib.util.spec_from_file_location("entry", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
