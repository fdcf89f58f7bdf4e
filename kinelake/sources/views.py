"""Canonical views over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.sources.tables import camera_of, observation_time


def clean_tracks(tracks: DataFrame) -> DataFrame:
    """Canonical track view: one row per (tid, frame), NaN as null, doubles,
    the believed clock ``t``, ``x`` and ``y`` on the pitch.

    Rows without tid or frame are left out; of repeated rows the earliest
    ingested stays.  The rows are partitioned by tid, which windows and
    aggregations per track then reuse.
    """
    num = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    w = Window.partitionBy("tid", "frame").orderBy("ingested_at")
    rows = tracks.where("tid is not null and frame is not null").repartition("tid").withColumn("k", F.row_number().over(w)).where("k = 1")
    return rows.select(
        "tid",
        "frame",
        F.col("source_clip").alias("clip"),
        camera_of().alias("cam"),
        F.col("fps").cast("double").alias("fps"),
        observation_time().alias("t"),
        num("foot_x").alias("fx"),
        num("foot_y").alias("fy"),
        num("box_h").alias("box_h"),
        num("box_w").alias("box_w"),
        num("conf").alias("conf"),
        F.coalesce("bottom_cropped", F.lit(False)).alias("cropped"),
        num("pitch_x").alias("x"),
        num("pitch_y").alias("y"),
        F.coalesce(F.col("in_pitch"), num("pitch_x").isNotNull() & num("pitch_y").isNotNull()).alias("in_pitch"),
        "zone",
        F.col("zone_code").cast("int").alias("zone_code"),
    )


#: The same view for the SQL counterparts, as a common table expression ``t``.
BASE_SQL = """t AS (
    SELECT tid, frame, source_clip AS clip, coalesce(camera_id, regexp_replace(source_clip, '_clip[0-9]+$', ''), '') AS cam, fps,
        CASE WHEN t_sec IS NULL OR isnan(t_sec) OR abs(CAST(t_sec AS DOUBLE) - frame / fps) > 2 THEN CASE WHEN fps > 0 THEN frame / fps END ELSE CAST(t_sec AS DOUBLE) END AS t,
        CAST(foot_x AS DOUBLE) AS fx, CAST(foot_y AS DOUBLE) AS fy,
        CASE WHEN NOT isnan(box_h) THEN CAST(box_h AS DOUBLE) END AS box_h, CASE WHEN NOT isnan(box_w) THEN CAST(box_w AS DOUBLE) END AS box_w,
        CASE WHEN NOT isnan(conf) THEN CAST(conf AS DOUBLE) END AS conf, coalesce(bottom_cropped, FALSE) AS cropped,
        CASE WHEN NOT isnan(pitch_x) THEN CAST(pitch_x AS DOUBLE) END AS x, CASE WHEN NOT isnan(pitch_y) THEN CAST(pitch_y AS DOUBLE) END AS y,
        coalesce(in_pitch, pitch_x IS NOT NULL AND pitch_y IS NOT NULL) AS in_pitch, zone, CAST(zone_code AS INTEGER) AS zone_code
    FROM (SELECT *, row_number() OVER (PARTITION BY tid, frame ORDER BY ingested_at) AS k FROM tracks WHERE tid IS NOT NULL AND frame IS NOT NULL)
    WHERE k = 1)"""
