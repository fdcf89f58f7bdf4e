"""The merge of sketches has a bounded fan-in and keeps its bound; results lie where DuckDB says."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.llm import queries
from kinelake.llm.quantiles import merge_sketches, percentiles, sketch_columns

DATA = "/root/testdata/sf0.001"


def test_hot_group_is_merged_as_a_tree(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("g"), (F.col("id") * 7919 % 60_013).cast("double").alias("v"))
    parts = sketch_columns(df.repartition(24), ["g"], ["v"], 32, 4)
    merged = merge_sketches(parts, ["g"], 32, 4, fan_in=16)
    assert merged.groupBy("g").count().agg(F.max("count")).first()[0] <= 16
    got = {r.g: r for r in percentiles(merged, ["g"], [0.5], 32, 4).collect()}
    hot = np.sort(df.where("g = 'hot'").toPandas()["v"].to_numpy())
    assert got["hot"].n == len(hot) and abs(np.searchsorted(hot, got["hot"].value) - 0.5 * len(hot)) <= got["hot"].max_rank_error < 0.2 * len(hot)
    assert len(got) == 51


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
def test_percentiles_lie_within_their_bound(spark):
    con = duckdb.connect()
    rows = con.sql(f"SELECT camera_id, zone, zone_code, box_h, conf FROM '{DATA}/tracks.parquet'").df()
    for r in queries.p2_percentiles(spark, DATA).collect():
        same = rows[(rows.camera_id.isna() if r.camera_id is None else rows.camera_id == r.camera_id) & (rows.zone == r.zone) & (rows.zone_code == r.zone_code)]
        v = np.sort(same[r.metric].dropna().to_numpy(float))
        rank = max(1, int(np.ceil(r.q * len(v) - 1e-9)))
        lo, hi = np.searchsorted(v, r.value, "left") + 1, np.searchsorted(v, r.value, "right")
        assert r.n == len(v) and lo - r.max_rank_error <= rank <= hi + r.max_rank_error
