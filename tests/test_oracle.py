"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as registered
from matchbook.plans import oracle, registry

TABLES = "region nation customer supplier part orders lineitem".split()
SPARK_TYPE = {
    "INTEGER": "int",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "DATE": "date",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
    "TIMESTAMP_NS": "timestamp_ntz",
}
QUERIES = registry.all_queries()
SQL = oracle.all_sql()


@pytest.fixture(scope="module")
def database():
    with duckdb.connect() as connection:
        for name in TABLES:
            connection.execute(f"create view {name} as from '{SMALL}/{name}.parquet'")
        yield connection


def normal(columns, records):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def cell(value):
        if isinstance(value, float):
            return None if math.isnan(value) else round(value, 5) + 0.0
        return value

    return sorted(([cell(r[i]) for i in order] for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, database, name):
    df = QUERIES[name](spark, SMALL)
    expected = database.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    types = {c[0]: SPARK_TYPE[str(c[1])] for c in expected.description}
    assert types == dict(df.dtypes)
    wanted = normal(columns, expected.fetchall())
    found = normal(df.columns, [tuple(row) for row in df.collect()])
    assert found == wanted


def test_only_fitted_pipelines_lack_sql():
    forests = {"rf_predict", "feature_importance", "cv_metrics", "forest_metrics", "forest_errors"}
    assert set(QUERIES) - set(SQL) == forests | {"linear_pipeline_metrics"}


def test_queries_and_sql_are_registered():
    assert set(QUERIES) <= set(registered.queries()) and set(SQL) <= set(registered.oracle_sql())


def test_entry(spark):
    df = registered.entry(spark)
    assert df.columns == ["id", "name", "points"]
    assert df.count() > 0
