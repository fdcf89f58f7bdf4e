import numpy as np
from pyspark.sql import functions as F

from kinelake.functions.ranks import exact_percentiles


def test_percentiles_are_those_of_the_whole_group(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}", float(v), None if i % 5 == 0 else float(v) * -3) for i, v in enumerate(rng.normal(0, 20, 900))]
    rows += [("ties", 4.0, None)] * 9 + [("one", -2.5, 0.0), ("none", None, float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    want = {"a": ("x", 0.005), "m": ("x", 0.5), "z": ("y", 0.995)}
    got = {r.g: r for r in exact_percentiles(df, ["g"], want).collect()}
    for g in {r[0] for r in rows} - {"none"}:
        for k, (c, q) in want.items():
            v = np.array([r[1 if c == "x" else 2] for r in rows if r[0] == g and r[1 if c == "x" else 2] is not None], float)
            assert (got[g][k] is None) if not len(v) else abs(got[g][k] - np.quantile(v, q)) < 1e-9
    assert "none" not in got
    whole = exact_percentiles(df, [], {"m": ("x", 0.5)}).first().m
    assert abs(whole - df.where("x is not null").select(F.percentile("x", F.lit(0.5))).first()[0]) < 1e-9
    assert exact_percentiles(df.limit(0), ["g"], want).count() == 0
