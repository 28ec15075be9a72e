"""The operators' queries against their SQL on whole tables."""

import duckdb
import pytest

from graniteflow.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(catalog.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    rows = [dict(zip([d[0] for d in want.description], r, strict=True)) for r in want.fetchall()]
    found = catalog.QUERIES[name](spark, SF)
    assert sorted(found.columns) == columns
    plain = lambda r: tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns)
    assert sorted(map(plain, (r.asDict() for r in found.collect())), key=repr) == sorted(map(plain, rows), key=repr)
