"""Every registered query that has SQL gives the rows that SQL gives."""

import math

import duckdb
import pytest

from vigil.plans import assembly, behaviour, catalogue, declared, review, submissions  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{round(float(v), 5):.5f}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


#: Queries that may be empty on the smallest tables: there an entity has too few cases for two strong effects and fewer than
#: eight peers; and a whole ledger has no breaks.
MAY_BE_EMPTY = {"corroboration", "counterfactual", "ledger_breaks"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got or name in MAY_BE_EMPTY
    if name in catalogue.ORACLE_SQL:
        cursor = duck.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
