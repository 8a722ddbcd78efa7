"""Every registered reference query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from cohortspark.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def as_rows(table, columns):
    plain = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    return sorted(repr(tuple(plain(v) for v in row)) for row in zip(*(table.column(c).to_pylist() for c in columns), strict=True))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toArrow()
    if name not in registry.ORACLE_SQL:
        assert got.num_rows > 0
        return
    expected = duck.sql(registry.ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(expected.column_names)
    assert as_rows(got, columns) == as_rows(expected, columns)


def test_stems_of_all_tokens(spark):
    rows = registry.QUERIES["t7_tokenise_stem_all"](spark, DATA).collect()
    assert max(r.n_tokens for r in rows) > 8
    assert all(len(r.stems.split(" ")) == r.n_tokens for r in rows if r.n_tokens)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
