"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from ionweave.plans import catalogue_files as catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    cur = db.execute(catalogue.ORACLE_SQL[name])
    columns = sorted(c[0] for c in cur.description)
    at = {c[0]: i for i, c in enumerate(cur.description)}
    value = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted(repr([value(r[at[c]]) for c in columns]) for r in cur.fetchall())
    assert want, "a query without rows shows nothing"
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(repr([value(r[c]) for c in columns]) for r in df.collect()) == want
