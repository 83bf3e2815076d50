"""Queries against their SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from hubbub.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert registry.ORACLE_SQL.keys() <= registry.QUERIES.keys()
    assert registry.QUERIES.keys() - registry.ORACLE_SQL.keys() == {"debrief_markdown"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", ["canonical", "board", "rail", "check_card", "score_cases", "words_to_segments", "arm_embeddings"])
def test_query_equals_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    answer = tables.execute(registry.ORACLE_SQL[name])
    places = [[d[0] for d in answer.description].index(c) for c in columns]
    assert len(answer.description) == len(columns)
    assert got == Counter(tuple(_plain(r[p]) for p in places) for r in answer.fetchall()) and got
