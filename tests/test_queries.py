"""Every core query against its SQL, run by DuckDB on the same tables."""

import duckdb
import pytest

from tarn.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    rel = db.execute(ORACLE[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    assert got == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in rel.fetchall())
