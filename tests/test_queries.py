"""Every registered query of the library against its SQL, over whole tables."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb
import pytest

from attestor.plans import QUERIES, SQL


def plain(value):
    if isinstance(value, float | Decimal):
        return None if math.isnan(value) else round(float(value), 9)
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows(table):
    columns = sorted(table.column_names)
    return columns, sorted(repr(tuple(map(plain, r))) for r in zip(*[table.column(c).to_pylist() for c in columns], strict=True))


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, sf_dir, db, name):
    assert rows(QUERIES[name](spark, sf_dir).toArrow()) == rows(db.sql(SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs_and_repeats(spark, sf_dir, name):
    first, again = (rows(QUERIES[name](spark, sf_dir).toArrow()) for _ in range(2))
    assert first == again and first[1]


def test_the_entry_query(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert entry.oracle_sql().keys() <= entry.queries().keys()
