"""Queries of the general training-data problems: periods, spikes, regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.operators.intervals import presence
from kinelake.operators.regular_grid import regular_grid
from kinelake.operators.spikes import flag_implausible
from kinelake.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return presence(table(spark, d, "player_tracklets"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return flag_implausible(table(spark, d, "tracks")).select("tid", "frame")


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    return flag_implausible(table(spark, d, "tracks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "tracks")).where("status in ('filled', 'unsupported')").select("tid", F.col("slot").cast("int").alias("slot"))


def p7_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "tracks"))


QUERIES = {"p4_found": p4_found, "p5_found": p5_found, "p5_flags": p5_flags, "p7_found": p7_found, "p7_grid": p7_grid}

SQL = {
    "p4_found": """
        WITH s AS (
            SELECT player_id, coalesce(list_transform(frames, lambda v: CAST(v AS BIGINT)), list_transform(t, lambda v: CAST(round(v * fps) AS BIGINT))) AS f
            FROM player_tracklets WHERE player_id >= 0),
        i AS (SELECT player_id, list_min(f) AS lo, list_max(f) AS hi FROM s WHERE len(f) > 0),
        a AS (SELECT *, max(hi) OVER (PARTITION BY player_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
        b AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY player_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM a),
        c AS (SELECT player_id, min(lo) AS lo, max(hi) AS hi FROM b GROUP BY player_id, g),
        d AS (SELECT player_id, lag(hi) OVER (PARTITION BY player_id ORDER BY lo) + 1 AS lo, lo - 1 AS hi FROM c)
        SELECT player_id, 'period' AS kind, CAST(lo AS INTEGER) AS start_frame, CAST(hi AS INTEGER) AS end_frame FROM c
        UNION ALL SELECT player_id, 'gap', CAST(lo AS INTEGER), CAST(hi AS INTEGER) FROM d WHERE lo IS NOT NULL""",
    "p7_found": """
        WITH r AS (
            SELECT tid, CAST(floor(2 * CASE WHEN t_sec IS NULL OR abs(CAST(t_sec AS DOUBLE) - frame / fps) > 2 THEN frame / fps ELSE CAST(t_sec AS DOUBLE) END) AS BIGINT) AS slot
            FROM tracks WHERE tid IS NOT NULL),
        s AS (SELECT tid, min(slot) AS lo, max(slot) AS hi FROM r WHERE slot IS NOT NULL GROUP BY tid),
        g AS (SELECT tid, unnest(generate_series(lo, hi)) AS slot FROM s)
        SELECT tid, CAST(slot AS INTEGER) AS slot FROM (SELECT tid, slot FROM g EXCEPT SELECT tid, slot FROM r)""",
}
