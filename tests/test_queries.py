"""Every registered query runs; those with SQL equal DuckDB's result."""

import math

import duckdb
import pytest

from rankloom.plans import composition, evaluation, models, registry  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    clean = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>") else x
    return sorted(([clean(x) for x in r] for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    a, b = rows(got), rows(want)
    assert [[float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r] for r in a] == [[float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r] for r in b]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).limit(5).count() > 0


@pytest.mark.parametrize("name", ["join_static", "avg_rank"])
def test_queries_of_pairs_and_groups_ask_for_all_users(spark, sf_dir, name):
    column = "qid" if name == "avg_rank" else "user_id"
    users = {r[0] for r in registry.log(spark, sf_dir).select("user_id").distinct().collect()}
    asked = {r[0] for r in registry.QUERIES[name](spark, sf_dir).select(column).distinct().collect()}
    assert asked == users


@pytest.mark.parametrize("name", ["ease_weights", "slim_weights"])
def test_dense_models_cover_the_whole_catalogue(spark, sf_dir, name):
    items = {r[0] for r in registry.log(spark, sf_dir).select("item_id").distinct().collect()}
    assert {r[0] for r in registry.QUERIES[name](spark, sf_dir).select("j").distinct().collect()} == items


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())
