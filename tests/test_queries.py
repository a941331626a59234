"""Every registered query against its SQL on the smallest given tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from cohortia.plans import catalog, oracles

TABLES = ["nation", "customer", "part", "orders", "lineitem"]
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        return None if value is None or (isinstance(value, float) and math.isnan(value)) else value

    found = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(found, key=lambda row: tuple((value is None, str(value)) for value in row))


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_matches_sql(spark, folder, name):
    frame = catalog.run(name, spark, folder)
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    answer = connection.execute(oracles.SQL[name])
    columns = [column[0] for column in answer.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, answer.fetchall())
    types = {row[0]: str(row[1]) for row in connection.execute("DESCRIBE " + oracles.SQL[name]).fetchall()}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in frame.schema.fields} == types


def test_every_sql_has_a_query():
    assert set(oracles.SQL) <= set(catalog.REGISTRY)
    assert set(catalog.REGISTRY) <= set(entry_module.queries())


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(catalog.REGISTRY) - set(oracles.SQL)))
def test_query_without_sql_runs(spark, folder, name):
    found = catalog.run(name, spark, folder).toPandas()
    assert len(found) > 0
    if name == "boost_predict":
        assert found["p"].between(0, 1).all()
    if name == "table_one_p_values":
        assert found["p_value"].dropna().between(0, 1).all()
    assert isinstance(found, pd.DataFrame)
