"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from strandloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    if name in registry.ORACLE_SQL:
        cur = duck.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    else:
        assert rows
