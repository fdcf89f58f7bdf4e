"""Motion along tracks: distances, speeds, episodes, gap filling.

All operators take the canonical track view; rows without a place or a time
take no part.  Interpolated rows never enter distance or speed.  Windows are
per track by frame.  Speed caps are medians joined back as one-row or
one-row-per-track aggregates, never a window without partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.functions.ranks import exact_percentiles
from kinelake.operators.tracks import by_frame, placed, r, step, window_median


def _moving(t: DataFrame) -> DataFrame:
    s = step(placed(t).where("t is not null"))
    return s.withColumn("v", F.when(F.col("dt") > 0, F.col("seg") / F.col("dt")))


def kinematics_global(t: DataFrame, factor: float = 6.0, max_dt: float = 1.0) -> DataFrame:
    """Distance per track; steps above ``factor`` times the global median speed are bad."""
    s = _moving(t)
    cap = exact_percentiles(s.where(f"v is not null and dt <= {max_dt}").select("v"), [], {"m": ("v", 0.5)}).select((factor * F.col("m")).alias("cap"))
    j = s.crossJoin(F.broadcast(cap))  # one row
    bad = F.col("seg").isNotNull() & ((F.coalesce("dt", F.lit(0.0)) <= 0) | (F.col("dt") > max_dt) | (F.col("v") > F.col("cap")))
    good = F.col("seg").isNotNull() & ~bad
    return j.groupBy("tid").agg(F.count("seg").alias("segments"), F.sum(bad.cast("int")).alias("bad"), r(F.sum(F.when(good, F.col("seg")).otherwise(0.0)), 4).alias("dist_raw"), r(F.sum(F.when(good, F.col("seg") * F.least(F.coalesce("conf", F.lit(0.0)) / 0.7, F.lit(1.0))).otherwise(0.0)), 4).alias("dist_weighted"))


def kinematics_track(t: DataFrame, factor: float = 6.0) -> DataFrame:
    """Per-track engine: in-pitch rows only, the cap is the track's own median."""
    s = _moving(t.where("in_pitch"))
    cap = s.groupBy("tid").agg((factor * F.median("v")).alias("cap"))
    j = s.join(cap, "tid").where("seg is not null")
    bad = (F.coalesce("dt", F.lit(0.0)) <= 0) | (F.col("v") > F.col("cap"))
    return j.groupBy("tid").agg(r(F.sum(F.when(bad, 0.0).otherwise(F.col("seg"))), 4).alias("distance"), r(F.avg(bad.cast("double"))).alias("clipped_frac"))


def player_report(t: DataFrame, moving: float = 0.5) -> DataFrame:
    """Per track: rows, duration, distance, mean moving speed, p50, p90, p99 of speed."""
    s = _moving(t)
    q = lambda a: r(F.percentile("v", F.lit(a)), 4)
    return s.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), r(F.max("t") - F.min("t"), 4).alias("duration_s"), r(F.sum("seg"), 4).alias("path"), r(F.avg(F.when(F.col("v") > moving, F.col("v"))), 4).alias("mean_moving"), q(0.5).alias("v50"), q(0.9).alias("v90"), q(0.99).alias("v99"))


def arc_length(t: DataFrame) -> DataFrame:
    return step(placed(t)).groupBy("tid").agg(r(F.sum("seg"), 4).alias("arc_length"))


def rolling_median(t: DataFrame, half: int = 3) -> DataFrame:
    """Centred rolling median of place over seven rows, fewer at the ends."""
    w = by_frame().rowsBetween(-half, half)
    return placed(t).select("tid", "frame", r(window_median("x", w)).alias("mx"), r(window_median("y", w)).alias("my"))


def speed_bfill(t: DataFrame) -> DataFrame:
    """Instantaneous speed; the first row takes the next known speed, else 0."""
    after = by_frame().rowsBetween(0, Window.unboundedFollowing)
    s = _moving(t).withColumn("filled", F.coalesce("v", F.first("v", ignorenulls=True).over(after), F.lit(0.0)))
    return s.select("tid", "frame", r("filled", 4).alias("speed"))


def backward_velocity(t: DataFrame, max_step: int = 5) -> DataFrame:
    """Velocity from the previous frame, the first row forward; null across holes."""
    w = by_frame()
    s = step(placed(t)).withColumns({"nf": F.lead("frame").over(w), "nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    back, ahead = F.col("frame") - F.col("pf"), F.col("nf") - F.col("frame")
    vel = lambda a, b, c: F.when(F.col("pf").isNull(), F.when(ahead <= max_step, (F.col(c) - F.col(a)) / ahead)).when(back <= max_step, (F.col(a) - F.col(b)) / back)
    return s.select("tid", "frame", r(vel("x", "px", "nx")).alias("vx"), r(vel("y", "py", "ny")).alias("vy"))


def sprint_episodes(t: DataFrame, fast: float = 5.0, least_s: float = 0.2) -> DataFrame:
    """Runs of fast rows: from the row before to the row after, counted if long enough."""
    w = by_frame()
    s = _moving(t).withColumns({"fast": F.coalesce(F.col("v") >= fast, F.lit(False)), "i": F.row_number().over(w), "next_t": F.coalesce(F.lead("t").over(w), F.col("t"))})
    f = s.where("fast and i > 1").withColumn("run", F.col("i") - F.row_number().over(w))
    e = f.groupBy("tid", "run").agg(F.min("pt").alias("a"), F.max("next_t").alias("b"), F.max("v").alias("top"))
    e = e.withColumn("dur", F.round(F.col("b") - F.col("a"), 6)).where(F.col("dur") >= least_s)
    return e.groupBy("tid").agg(F.count(F.lit(1)).alias("n_sprints"), r(F.sum("dur"), 4).alias("total_s"), r(F.max("top"), 4).alias("top_speed"))


def swap_candidates(t: DataFrame, jump: float = 3.0, within: int = 5, near: float = 1.5, bucket: int = 5) -> DataFrame:
    """Teleports within a few frames, flagged as crossing where another track was near."""
    s = step(placed(t)).withColumn("df", F.col("frame") - F.col("pf")).where((F.col("df") <= within) & (F.col("seg") > jump))
    jumps = s.select("tid", "clip", "frame", "x", "y", "seg")
    other = placed(t).select("clip", F.col("tid").alias("o"), F.col("frame").alias("of"), F.col("x").alias("ox"), F.col("y").alias("oy")).withColumn("b", F.explode(F.array(*[F.floor(F.col("of") / bucket) + k for k in (-1, 0, 1)])))
    hit = jumps.withColumn("b", F.floor(F.col("frame") / bucket)).join(other, ["clip", "b"]).where((F.col("o") != F.col("tid")) & (F.abs(F.col("of") - F.col("frame")) <= 2) & ((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")) < near * near))
    marked = hit.select("tid", "frame").distinct().withColumn("crossing", F.lit(True))
    return jumps.join(marked, ["tid", "frame"], "left").select("tid", "frame", r("seg", 4).alias("jump"), F.coalesce("crossing", F.lit(False)).alias("crossing"))


def segment_split(t: DataFrame, max_gap_s: float = 2.0, vmax: float = 12.0) -> DataFrame:
    """Segments between long gaps or impossible speeds."""
    s = _moving(t).withColumn("cut", ((F.col("dt") > max_gap_s) | (F.col("v") > vmax)).cast("int"))
    n = s.withColumn("seg_no", F.sum(F.coalesce("cut", F.lit(0))).over(by_frame().rowsBetween(Window.unboundedPreceding, 0)))
    return n.groupBy("tid", "seg_no").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("f0"), F.max("frame").alias("f1"))


def session_tracks(t: DataFrame, gap: int = 50) -> DataFrame:
    """Sessions of a track: a hole of more than ``gap`` frames opens a new one (extends the reference)."""
    s = t.withColumn("new", (F.col("frame") - F.lag("frame").over(by_frame()) > gap).cast("int"))
    n = s.withColumn("session", F.sum(F.coalesce("new", F.lit(0))).over(by_frame().rowsBetween(Window.unboundedPreceding, 0)))
    return n.groupBy("tid", "session").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("f0"), F.max("frame").alias("f1"))


def _bracketed(t: DataFrame, max_gap: int) -> DataFrame:
    """Holes of at most ``max_gap`` frames exploded to their missing frames, with both ends."""
    w = by_frame()
    n = placed(t).withColumns({"nf": F.lead("frame").over(w), "nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    h = n.where((F.col("nf") - F.col("frame") > 1) & (F.col("nf") - F.col("frame") <= max_gap))
    e = h.select("tid", F.col("frame").alias("f0"), "nf", "x", "y", "nx", "ny", F.explode(F.sequence(F.col("frame") + 1, F.col("nf") - 1)).alias("frame"))
    return e.withColumn("a", (F.col("frame") - F.col("f0")) / (F.col("nf") - F.col("f0")))


def bridge_gaps(t: DataFrame, max_gap: int = 25) -> DataFrame:
    """Linear rows in short holes, marked as interpolated; their confidence is null."""
    b = _bracketed(t, max_gap)
    lerp = lambda c, n: r(F.col(c) + F.col("a") * (F.col(n) - F.col(c)))
    return b.select("tid", "frame", lerp("x", "nx").alias("x"), lerp("y", "ny").alias("y"), F.lit(None).cast("double").alias("conf"), F.lit(True).alias("interpolated"))


def bridge_short_gaps(t: DataFrame, max_s: float = 0.5) -> DataFrame:
    """Holes of at most half a second filled on the image and projected again (here: counted per clip)."""
    w = by_frame()
    n = t.where("fx is not null and fy is not null and t is not null").withColumns({"nf": F.lead("frame").over(w), "nt": F.lead("t").over(w)})
    h = n.where((F.col("nf") - F.col("frame") > 1) & (F.round(F.col("nt") - F.col("t"), 6) <= max_s))
    return h.groupBy("clip").agg(F.count(F.lit(1)).alias("n_holes"), F.sum(F.col("nf") - F.col("frame") - 1).alias("n_filled"))


def mine_false_negatives(t: DataFrame, max_gap: int = 10) -> DataFrame:
    """Frames where a track was probably missed."""
    b = _bracketed(t, max_gap + 1)
    lerp = lambda c, n: r(F.col(c) + F.col("a") * (F.col(n) - F.col(c)))
    return b.select("tid", "frame", lerp("x", "nx").alias("x"), lerp("y", "ny").alias("y"))


def mine_orphans(t: DataFrame, least: int = 20) -> DataFrame:
    return t.groupBy("tid").agg(F.countDistinct("frame").alias("n_frames")).where(F.col("n_frames") < least)


def continuous_state(t: DataFrame, max_gap: int = 50, fps: float = 25.0) -> DataFrame:
    """Observed rows and cubic Hermite rows between them, with decaying confidence."""
    w = by_frame()
    p = placed(t).withColumns({"pf": F.lag("frame").over(w), "px": F.lag("x").over(w), "py": F.lag("y").over(w), "nf": F.lead("frame").over(w), "nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    back, ahead = F.col("frame") - F.col("pf"), F.col("nf") - F.col("frame")
    use_back = F.col("pf").isNotNull() & (F.col("nf").isNull() | (back <= ahead))
    near = F.when(use_back, back).otherwise(ahead)
    vel = lambda c, a, b: F.when(near <= 8, F.when(use_back, (F.col(c) - F.col(a)) / back).otherwise((F.col(b) - F.col(c)) / ahead)).otherwise(F.lit(0.0))
    p = p.withColumns({"vx": vel("x", "px", "nx"), "vy": vel("y", "py", "ny")})
    p = p.withColumns({"nvx": F.lead("vx").over(w), "nvy": F.lead("vy").over(w)})
    h = p.where((ahead > 1) & (ahead <= max_gap)).withColumn("span", F.col("nf") - F.col("frame"))
    e = h.select("tid", F.col("frame").alias("f0"), "span", "x", "y", "nx", "ny", "vx", "vy", "nvx", "nvy", F.explode(F.sequence(F.col("frame") + 1, F.col("nf") - 1)).alias("frame")).withColumn("s", (F.col("frame") - F.col("f0")) / F.col("span"))
    s = F.col("s")
    herm = lambda a, b, va, vb: (2 * s * s * s - 3 * s * s + 1) * F.col(a) + (s * s * s - 2 * s * s + s) * F.col("span") * F.col(va) + (3 * s * s - 2 * s * s * s) * F.col(b) + (s * s * s - s * s) * F.col("span") * F.col(vb)
    filled = e.select("tid", "frame", r(herm("x", "nx", "vx", "nvx"), 4).alias("x"), r(herm("y", "ny", "vy", "nvy"), 4).alias("y"), F.lit("interp").alias("status"), r(F.exp(-F.col("span") / (2 * fps))).alias("conf"))
    seen = placed(t).select("tid", "frame", r("x", 4).alias("x"), r("y", 4).alias("y"), F.lit("obs").alias("status"), F.lit(1.0).alias("conf"))
    return seen.unionByName(filled)


def coverage_summary(t: DataFrame) -> DataFrame:
    """Share of observed frames in the life of each track, averaged per clip."""
    g = t.groupBy("clip", "tid").agg((F.count(F.lit(1)) / (F.max("frame") - F.min("frame") + 1)).alias("cov"))
    return g.groupBy("clip").agg(F.count(F.lit(1)).alias("n_tracks"), r(F.avg("cov")).alias("mean_cov"), r(F.min("cov")).alias("min_cov"))


def track_features(t: DataFrame, length: float = 50.0, depth: float = 7.0) -> DataFrame:
    """Residence at both ends, median speed over short steps, far share, spread."""
    s = _moving(t)
    return s.groupBy("tid").agg(
        r(F.avg((F.col("x") < depth).cast("double"))).alias("res_left"),
        r(F.avg((F.col("x") > length - depth).cast("double"))).alias("res_right"),
        r(F.median(F.when(F.col("dt") < 0.3, F.col("v"))), 4).alias("median_speed"),
        r(F.avg((F.col("zone") == "far").cast("double"))).alias("far_frac"),
        r(F.stddev_pop("x"), 4).alias("sd_x"),
        r(F.stddev_pop("y"), 4).alias("sd_y"),
    )


def return_events(t: DataFrame, deep: float = 10.0, out: float = 15.0) -> DataFrame:
    """Advance-and-return events: armed beyond ``out``, counted when back inside ``deep``."""
    k = placed(t).where((F.col("x") < deep) | (F.col("x") > out)).withColumn("far_out", F.col("x") > out)
    c = k.withColumn("was", F.lag("far_out").over(by_frame()))
    return c.groupBy("tid").agg(F.sum((F.col("was") & ~F.col("far_out")).cast("int")).alias("returns")).where("returns > 0")


def window_residence(t: DataFrame, window: int = 200, depth: float = 7.0, length: float = 50.0) -> DataFrame:
    """Share of a track's rows in the trailing window that lie at each end of the pitch."""
    w = by_frame().rangeBetween(-window, 0)
    p = placed(t)
    return p.select("tid", "frame", r(F.avg((F.col("x") < depth).cast("double")).over(w)).alias("left"), r(F.avg((F.col("x") > length - depth).cast("double")).over(w)).alias("right"))


def interp_grid(t: DataFrame, every: int = 10, reach: int = 50) -> DataFrame:
    """Place on a common frame grid, linear between the rows around, null too far from them."""
    span = placed(t).groupBy("tid").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    grid = span.where(F.ceil(F.col("a") / every) <= F.floor(F.col("b") / every)).select("tid", F.explode(F.sequence((F.ceil(F.col("a") / every) * every).cast("int"), (F.floor(F.col("b") / every) * every).cast("int"), F.lit(every))).alias("frame"))
    u = placed(t).select("tid", "frame", F.struct("frame", "x", "y").alias("o"), F.lit(0).alias("k")).unionByName(grid.select("tid", "frame", F.lit(None).cast("struct<frame:int,x:double,y:double>").alias("o"), F.lit(1).alias("k")))
    w = Window.partitionBy("tid").orderBy("frame", "k")
    e = u.withColumns({"p": F.last("o", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.first("o", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where("k = 1")
    a = F.when(F.col("p.frame") == F.col("frame"), 0.0).otherwise((F.col("frame") - F.col("p.frame")) / (F.col("n.frame") - F.col("p.frame")))
    near = (F.col("p.frame") == F.col("frame")) | (F.col("n.frame") - F.col("p.frame") <= reach)
    at = lambda c: r(F.when(near, F.col(f"p.{c}") + F.when(F.col("p.frame") == F.col("frame"), 0.0).otherwise(a * (F.col(f"n.{c}") - F.col(f"p.{c}")))), 4)
    return e.select("tid", "frame", at("x").alias("x"), at("y").alias("y"))


def asof_sample(t: DataFrame, every_s: float = 5.0) -> DataFrame:
    """Frame of a track nearest to each multiple of ``every_s`` within its life (ties: the earlier)."""
    p = t.where("t is not null").withColumn("t", F.round("t", 4))
    # a row can only be nearest to the multiples around it and its neighbours
    n = p.withColumns({"pt": F.lag("t").over(by_frame()), "nt": F.lead("t").over(by_frame())})
    lo, hi = F.ceil(F.coalesce("pt", F.col("t")) / every_s), F.floor(F.coalesce("nt", F.col("t")) / every_s)
    c = n.where(lo <= hi).select("tid", "frame", "t", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("i"))
    d = c.withColumn("d", F.round(F.abs(F.col("t") - F.col("i") * every_s), 4))
    return d.groupBy("tid", "i").agg(F.min(F.struct("d", "frame")).alias("b")).select("tid", "i", F.col("b.frame").alias("frame"), F.col("b.d").alias("d"))
