"""Every registered query against its SQL oracle."""

import duckdb
import pytest

import __spark_entry__ as entry
from veiltext.plans import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="session")
def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_oracle(spark, duck, folder, name):
    df = entry.queries()[name](spark, folder)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == canonical(cursor.fetchall(), names)
    assert got


def test_entry_runs(spark):
    assert entry.entry(spark).limit(3).count() == 3
