import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ENGINE = list(entry.engine.ORACLE)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def same(df, sql, con):
    cols = sorted(df.columns)
    own = sorted(tuple(map(repr, r)) for r in df.select(*cols).collect())
    names = ", ".join(f'"{c}"' for c in cols)
    want = sorted(tuple(map(repr, r)) for r in con.sql(f"SELECT {names} FROM ({sql})").fetchall())
    assert own == want


@pytest.mark.parametrize("name", ENGINE)
def test_query_equals_its_sql(spark, sf, con, name):
    same(entry.queries()[name](spark, sf), entry.oracle_sql()[name], con)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
