"""Every registered query of the rule engine runs on the smallest tables and equals its SQL."""

import os

import duckdb
import pytest

from rulewright.plans import catalog, evidence, inspections, labels

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order] for r in rows)


QUERIES, SQL = catalog.queries() | evidence.queries() | inspections.queries() | labels.queries(), catalog.oracle_sql() | evidence.oracle_sql() | inspections.oracle_sql() | labels.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    got = QUERIES[name](spark, FOLDER)
    want = db.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
