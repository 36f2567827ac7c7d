"""The driver contract: names, and equality with SQL on the smallest tables for a few queries."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values):
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_rows(spark):
    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["positional_entropy", "npmi_trigram", "boundary_features", "segmented_lines", "segment_inventory", "segment_features", "seed_precision", "overall_similarity", "parse_sequences", "length_bucket_join"])
def test_equals_sql(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    wanted = duck.sql(entry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in columns]
    assert rows(found.select(columns).collect()) == rows([r[i] for i in at] for r in wanted.fetchall())
