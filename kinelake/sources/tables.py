"""Scans of the stored tables and the derived columns every operator shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest difference in seconds between t_sec and frame / fps for which t_sec is believed.
CLOCK_TOLERANCE_S = 2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observation_time(t_sec: str = "t_sec", frame: str = "frame", fps: str = "fps") -> Column:
    """Seconds on the clip's clock: ``t_sec``, but ``frame / fps`` where it is
    null, NaN or further than ``CLOCK_TOLERANCE_S`` from it.  Null if neither
    is known."""
    t = F.nanvl(F.col(t_sec).cast("double"), F.lit(None).cast("double"))
    by_frame = F.when(F.col(fps) > 0, F.col(frame) / F.col(fps))
    return F.when(t.isNull() | (F.abs(t - by_frame) > CLOCK_TOLERANCE_S), by_frame).otherwise(t)


def camera_of(camera_id: str = "camera_id", source_clip: str = "source_clip") -> Column:
    """The camera of a row; a missing id is recovered from the clip name."""
    return F.coalesce(F.col(camera_id), F.regexp_replace(F.col(source_clip), r"_clip\d+$", ""), F.lit(""))
