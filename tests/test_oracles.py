"""Registered queries against their SQL twins. A cross-section by default; TALLYLINE_ALL=1 runs all."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIRECTORY = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = """totals_range groups_models filter_sessions_by_alias series_new_york_days heatmap_levels priced_events pricing_by_session
hybrid_totals_filtered hybrid_series valuation_reuse coverage_of_range issues_newest quota_book redacted_events log_observations
accounting_hinted_streams copies_canonical_plan forks_inherited answer_header answer_sessions_page""".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIRECTORY}/{table}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("TALLYLINE_ALL") else SAMPLE)
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, DIRECTORY)
    columns = sorted(found.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    order = lambda row: tuple((v is None, str(v)) for v in row)
    mine = sorted((tuple(tidy(r[c]) for c in columns) for r in found.collect()), key=order)
    theirs = sorted((tuple(tidy(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=order)
    assert mine == theirs
