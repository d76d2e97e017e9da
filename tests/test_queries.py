"""Every registered query with SQL against DuckDB, at the smallest size."""

from __future__ import annotations

import math

import duckdb
import pytest

from lumora.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "part", "events")
SQL = registry.oracle_sql()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def test_all_have_sql():
    assert registry.queries().keys() == SQL.keys()


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def data(spark):
    return registry._data(spark, SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, data, name):
    df = registry._OF_DATA[name](data) if name in registry._OF_DATA else registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=repr)
    relation = tables.sql(SQL[name])
    names = list(relation.columns)
    assert sorted(names) == columns
    want = sorted((tuple(normal(r[names.index(c)]) for c in columns) for r in relation.fetchall()), key=repr)
    assert got == want


def test_dense_fusion_rows(spark, data):
    """A row for each evaluation row and candidate, the target among them, whether the retriever scores it or not."""
    pool = {r.vertical: r["count"] for r in data.candidates.groupBy("vertical").count().collect()}
    want = sum(pool[r.vertical] for r in data.eval_rows().select("vertical").collect())
    features = registry.queries()["fusion_features_full"](spark, SF).collect()
    assert len(features) == want > registry._OF_DATA["fusion_features"](data).count()
    assert sum(r.item_id == r.target for r in features) == data.eval_rows().count() and any(r.knn_score == 0 for r in features)
