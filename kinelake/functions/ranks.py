"""Exact percentiles per group without gathering a group in one task.

``percentile`` keeps a group's distinct values in one task's memory, which a
group with a third of all rows doesn't allow.  Here a first pass counts values
in logarithmic bins with a map-side combine; only the bins that hold a wanted
rank are looked at again, and only their rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bins per doubling of a value, and the smallest value told from zero by a bin.
PER_OCTAVE = 64
FINEST = 1e-3


def exact_percentiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """by, and one column per entry of ``wanted`` (name: column, share).

    Interpolated between the two values beside the rank, as ``percentile``
    does.  Null and NaN values are left out; a group without values has no
    row, one with values of some columns only has nulls for the others.
    """
    columns = sorted({c for c, _ in wanted.values()})
    cells = F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*by, F.explode(cells).alias("e")).select(*by, "e.m", "e.v").where("v is not null and not isnan(v)")
    long = long.withColumn("b", (F.signum("v") * F.floor(PER_OCTAVE * F.log2(1 + F.abs("v") / FINEST))).cast("long"))
    group = Window.partitionBy(*by, "m")
    cum = long.groupBy(*by, "m", "b").agg(F.count(F.lit(1)).alias("n")).withColumns({"upto": F.sum("n").over(group.orderBy("b")), "total": F.sum("n").over(group)})
    at = lambda q: F.lit(q) * (F.col("total") - 1)
    ranks = F.array(*[F.when(F.col("m") == c, F.struct(F.lit(k).alias("k"), F.floor(at(q)).alias("lo"), F.ceil(at(q)).alias("hi"), at(q).alias("at"))) for k, (c, q) in wanted.items()])
    need = cum.select(*by, "m", "b", (F.col("upto") - F.col("n")).alias("below"), "upto", F.explode(F.filter(ranks, lambda x: x.isNotNull())).alias("w"))
    within = lambda c: (F.col(c) >= F.col("below")) & (F.col(c) < F.col("upto"))
    need = need.where(within("w.lo") | within("w.hi"))
    rank = F.col("below") + F.row_number().over(Window.partitionBy(*by, "m", "b", "w.k").orderBy("v")) - 1
    found = long.join(need, [*by, "m", "b"]).withColumn("rank", rank).where("rank = w.lo or rank = w.hi")
    ends = found.groupBy(*by, F.col("w.k").alias("k"), F.col("w.at").alias("at")).agg(F.max(F.when(F.col("rank") == F.col("w.lo"), F.col("v"))).alias("a"), F.max(F.when(F.col("rank") == F.col("w.hi"), F.col("v"))).alias("z"))
    value = F.when(F.col("a") == F.col("z"), F.col("a")).otherwise(F.col("a") + (F.col("z") - F.col("a")) * (F.col("at") - F.floor("at")))
    return ends.groupBy(*by).agg(*[F.max(F.when(F.col("k") == k, value)).alias(k) for k in wanted])
