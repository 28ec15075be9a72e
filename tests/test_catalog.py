"""Every query of the catalogue against its SQL twin."""

import math
import os

import duckdb
import pytest

from graniteflow import catalog
from graniteflow.session import TABLES

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sql, name):
    found = catalog.QUERIES[name](spark, SF)
    want = sql.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, found.collect()) == rows_of(columns, want.fetchall())


def test_no_cartesian_product(spark):
    for name, query in catalog.QUERIES.items():
        plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner\n" not in plan and "Join Cross" not in plan, name
