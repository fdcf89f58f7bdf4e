"""Readers and writers of the formats tracks and catalogs come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = ("tid", "frame", "t_sec", "foot_x", "foot_y")
#: Optional track columns with their type and default.
OPTIONAL = {"box_h": ("float", None), "box_w": ("float", None), "conf": ("float", None), "bottom_cropped": ("boolean", False), "pitch_x": ("float", None), "pitch_y": ("float", None), "zone": ("string", None), "metric_lowconf": ("boolean", False), "static_susp": ("boolean", False)}
#: Other names under which a catalog field may come.
ALIASES = {"venue": ("venue", "place_name", "place"), "views": ("views", "watch_count"), "first_url": ("first_url", "url"), "id": ("id", "match_id"), "n_cams": ("n_cams", "cams"), "date": ("date",), "title": ("title", "name")}


def with_track_defaults(df: DataFrame) -> DataFrame:
    """Check the required columns (ValueError) and add defaults for the optional ones; other columns stay."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"tracks lack the columns {missing}")
    for c, (kind, default) in OPTIONAL.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(default).cast(kind))
    if "in_pitch" not in df.columns:
        df = df.withColumn("in_pitch", F.col("pitch_x").isNotNull() & F.col("pitch_y").isNotNull())
    return df


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks from Parquet, or from CSV with a header where the path ends in .csv."""
    if path.rstrip("/").endswith(".csv"):
        return with_track_defaults(spark.read.csv(path, header=True, inferSchema=True))
    return with_track_defaults(spark.read.parquet(path))


def coerce_bool(c: str):
    """1, true, yes, y, t (any case) are true; blank is null; all else false."""
    s = F.lower(F.trim(F.col(c).cast("string")))
    return F.when(s == "", None).otherwise(s.isin("1", "true", "yes", "y", "t"))


def coerce_int(c: str):
    return F.expr(f"try_cast(try_cast({c} as double) as int)")


def _canonical(df: DataFrame) -> DataFrame:
    out = []
    for name, others in ALIASES.items():
        have = [F.col(o) for o in others if o in df.columns and not isinstance(df.schema[o].dataType, T.StructType)]
        have += [F.col(f"{o}.name") for o in others if o in df.columns and isinstance(df.schema[o].dataType, T.StructType) and "name" in df.schema[o].dataType.names]
        out.append((F.coalesce(*[h.cast("string") for h in have]) if have else F.lit(None).cast("string")).alias(name))
    df = df.select(*out)
    return df.withColumns({c: coerce_int(c) for c in ("id", "n_cams", "views")})


def read_catalog_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Match catalog from a tab-separated file with a header, under canonical names."""
    return _canonical(spark.read.csv(path, sep="\t", header=True))


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """Match catalog from JSON: a list of rows, or an object holding it as rows, data or matches."""
    df = spark.read.json(path, multiLine=True)
    for key in ("rows", "data", "matches"):
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType):
            df = df.select(F.explode(key).alias("r")).select("r.*")
            break
    return _canonical(df)


def write_tracks(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def append_ledger(df: DataFrame, path: str) -> None:
    """Append decision rows as JSON lines; the state is the latest row by cycle."""
    df.write.mode("append").json(path)


def ledger_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).json(path)
    return rows.groupBy("key").agg(F.max_by("value", "cycle").alias("value"), F.max("cycle").alias("cycle"))


def yolo_lines(t: DataFrame, width: float = 1280.0, height: float = 720.0) -> DataFrame:
    """One text line per box (class, centre, size, relative to the frame) with its clip and frame, from the canonical view."""
    b = t.where("box_h > 0 and box_w > 0 and fx is not null and fy is not null")
    part = lambda c: F.format_number(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 6)
    return b.select("clip", "frame", F.concat_ws(" ", F.lit("0"), part(F.col("fx") / width), part((F.col("fy") - F.col("box_h") / 2) / height), part(F.col("box_w") / width), part(F.col("box_h") / height)).alias("line"))
