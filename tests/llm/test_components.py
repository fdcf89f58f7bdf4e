"""The grid contracts in few rounds whatever the shape and the ids of the graph."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from kinelake.llm import queries
from kinelake.llm.components import connected_components, contract, group_tracklets
from kinelake.sources.tables import table

DATA = "/root/testdata/sf0.001"


def test_ascending_chain_takes_logarithmic_rounds(spark):
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert 3 <= len(contract(edges, edges_per_block=5000)) <= 20


def test_ascending_chain_is_one_group(spark):
    edges = spark.range(3000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = connected_components(edges, edges_per_block=500)
    assert got.count() == 3001 and got.select("root").distinct().collect() == [(0,)]


def test_hub_and_star_of_stars(spark):
    hub = spark.range(1, 30_000).select(F.lit(10**6).cast("bigint").alias("u"), F.col("id").alias("v"))
    twigs = spark.range(1, 30_000).select(F.col("id").alias("u"), (F.col("id") + 10**7).alias("v"))
    edges = hub.unionByName(twigs)
    assert len(contract(edges, edges_per_block=5000)) <= 10
    got = connected_components(edges, edges_per_block=5000)
    assert got.count() == 59_999 and got.select("root").distinct().collect() == [(1,)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
def test_small_blocks_give_the_same_groups(spark):
    parts = [table(spark, DATA, n) for n in ("tracklets", "link_edges", "connect_labels")]
    one, many = (sorted(map(tuple, group_tracklets(*parts, edges_per_block=b).collect())) for b in (10**6, 8))
    assert one == many and any(n > 1 for *_, n in one)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))
