from importlib import import_module

import duckdb
import pytest

import __spark_entry__ as registered
from check import TABLES, normalise

SF = "/root/testdata/sf0.001"
CHECKED = (
    "document_signals", "reuse_overlap", "ledger_integrity", "evidence_quality", "review_actions", "changed_hunks",
    "path_owners", "innermost_symbols", "changed_symbols", "reverse_reach", "ranking_metrics", "fixture_catalog",
)


def test_every_oracle_has_a_query():
    queries, oracles = registered.queries(), registered.oracle_sql()
    assert set(oracles) <= set(queries)
    own = {name for module in registered._MODULES for name in import_module(f"bindings.{module}").QUERIES}
    assert own <= set(queries) and own - set(oracles) == {"model_estimates", "out_of_fold_metrics"}


def test_entry(spark):
    assert registered.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    ours = normalise(registered.queries()[name](spark, SF).toPandas())
    theirs = normalise(connection.execute(registered.oracle_sql()[name]).fetchdf())
    assert ours.equals(theirs)
