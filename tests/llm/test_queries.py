from __future__ import annotations

import pytest
from brute import SMALL
from oracle_compare import compare, duckdb_connection

import __spark_entry__ as entry
from campaign_analytics.llm import queries

CHECKED = SMALL.replace("0.001", "0.01")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf_dir", [SMALL, CHECKED])
def test_query_matches_its_sql(spark, name, sf_dir):
    ok, message = compare(spark, duckdb_connection(sf_dir), name, sf_dir)
    assert ok, message


def test_all_are_registered():
    names = entry.queries()
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(f"op{i}" for i in range(1, 14))
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
