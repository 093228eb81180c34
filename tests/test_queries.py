"""Every graph query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from veilgraph.plans import catalogue
from veilgraph.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    return round(float(value), 5) + 0.0 if isinstance(value, int | float) and not isinstance(value, bool) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, db, name):
    got = catalogue.Q[name](spark, SF)
    found = db.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert table(got.columns, got.collect()) == table(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.Q) - set(ORACLES) - {"q_run_table"}))
def test_runs(spark, name):
    rows = catalogue.Q[name](spark, SF).collect()
    assert rows
    if rows[0].__fields__ == ["src", "dst"]:
        assert len(set(rows)) == len(rows) and all(r.src < r.dst for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
