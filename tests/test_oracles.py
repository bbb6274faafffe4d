"""Every query of the library against its SQL on the smallest tables."""

import datetime

import duckdb
import pytest

from medgraph.plans import graph_queries, text_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = text_queries.QUERIES | graph_queries.QUERIES
ORACLES = text_queries.ORACLES | graph_queries.ORACLES


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _rows(rows):
    return sorted(str([_plain(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, db, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    found = db.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    assert _rows(got.select(*[f"`{c}`" for c in columns]).collect()) == _rows(db.sql(f"SELECT {names} FROM ({ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
