"""Per-frame game state: focus, kickoff readiness, walls, roles and fusion of views.

Works on all placed rows of every frame; the two teams are those of the tracklets
where these are given, else the parities of tid.  Frames with fewer than two moving players have no
focus.  All closed forms stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.operators.pairs import _d2, _players, _teams, frame_pairs, framed, inframe_dedup
from kinelake.operators.tracks import placed, r


def velocities(t: DataFrame, hole: int = 10) -> DataFrame:
    """Placed rows with the velocity in metres a second from the track's previous row (null across holes of more frames)."""
    w = Window.partitionBy("tid").orderBy("g")
    c = framed(t).withColumns({"dg": F.col("g") - F.lag("g").over(w), "ux": F.col("x") - F.lag("x").over(w), "uy": F.col("y") - F.lag("y").over(w)})
    v = lambda u: F.when(F.col("dg") <= hole, F.col(u) * 25 / F.col("dg"))
    return c.withColumns({"vx": v("ux"), "vy": v("uy")}).withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))).drop("ux", "uy", "dg")


def convergence_point(t: DataFrame, least_speed: float = 0.25) -> DataFrame:
    """Least-squares intersection of the movement rays; the centroid where they are nearly parallel."""
    m = velocities(t).where(f"speed >= {least_speed}").withColumns({"dx": F.col("vx") / F.col("speed"), "dy": F.col("vy") / F.col("speed")})
    s = lambda e: F.sum(F.expr(e))
    g = m.groupBy("clip", "g").agg(F.count(F.lit(1)).alias("k"), s("1 - dx*dx").alias("a"), s("-dx*dy").alias("b"), s("1 - dy*dy").alias("c"), s("(1 - dx*dx)*x - dx*dy*y").alias("u"), s("(1 - dy*dy)*y - dx*dy*x").alias("v"), F.avg("x").alias("mx"), F.avg("y").alias("my")).where("k >= 2")
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    flat = det <= 1e-2 * (F.col("a") + F.col("c")) * (F.col("a") + F.col("c"))
    px = F.when(flat, F.col("mx")).otherwise((F.col("c") * F.col("u") - F.col("b") * F.col("v")) / det)
    py = F.when(flat, F.col("my")).otherwise((F.col("a") * F.col("v") - F.col("b") * F.col("u")) / det)
    return g.select("clip", "g", "k", r(px, 3).alias("px"), r(py, 3).alias("py"), flat.alias("degenerate"))


def focus_track(t: DataFrame, margin: float = 3.0) -> DataFrame:
    """The convergence point kept within the players' box and a margin."""
    box = framed(t).groupBy("clip", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    j = convergence_point(t).join(box, ["clip", "g"])
    within = lambda c, a, b: r(F.least(F.greatest(F.col(c), F.col(a) - margin), F.col(b) + margin), 3)
    return j.select("clip", "g", within("px", "x0", "x1").alias("fx"), within("py", "y0", "y1").alias("fy"))


def kickoff_readiness(t: DataFrame, tracklets: DataFrame | None = None) -> DataFrame:
    """Readiness 0 to 1 of a frame: teams split, centred, still; and the side of the centroid.

    With ``tracklets`` the teams are theirs, and tracks of unknown team belong to neither."""
    v = velocities(t)
    mid = v.groupBy("clip").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    left = (F.col("x") < F.col("cx")).cast("double")
    if tracklets is None:
        v = v.withColumn("team", F.pmod("tid", F.lit(2)))
    else:
        v = v.join(_teams(tracklets), "tid", "left")
    g = v.join(mid, "clip").groupBy("clip", "g").agg(F.avg(F.when(F.col("team") == 0, left)).alias("a"), F.avg(F.when(F.col("team") == 1, left)).alias("b"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg(F.coalesce("speed", F.lit(0.0))).alias("sp"), F.first("cx").alias("cx"), F.first("cy").alias("cy"))
    split = F.greatest(F.col("a") * (1 - F.col("b")), (1 - F.col("a")) * F.col("b"))
    d = F.sqrt((F.col("mx") - F.col("cx")) * (F.col("mx") - F.col("cx")) + (F.col("my") - F.col("cy")) * (F.col("my") - F.col("cy")))
    return g.where("a is not null and b is not null").select("clip", "g", r(split * F.exp(-d / 10) * F.exp(-F.col("sp") / 5), 5).alias("ready"), r(F.col("mx") - F.col("cx"), 4).alias("side"))


def wall_pairs(t: DataFrame, reach: float = 14.0) -> DataFrame:
    """Best two-player wall of a frame: spacing near one metre and square to the length of the pitch."""
    p = frame_pairs(framed(t)).withColumn("d", F.sqrt(_d2())).where((F.col("d") <= reach) & (F.col("d") > 0))
    s = F.round(F.sqrt(F.exp(-F.abs(F.col("d") - 1)) * F.abs(F.col("a.y") - F.col("b.y")) / F.col("d")), 6)
    b = p.groupBy("clip", "g").agg(F.max(F.struct(s.alias("s"), (-F.col("a.tid")).alias("na"), (-F.col("b.tid")).alias("nb"))).alias("w")).where("w.s > 0")
    return b.select("clip", "g", (-F.col("w.na")).alias("tid_a"), (-F.col("w.nb")).alias("tid_b"), F.col("w.s").alias("score"))


def circular_std(t: DataFrame) -> DataFrame:
    """Circular standard deviation of the heading of a track."""
    v = velocities(t).where("speed > 0")
    g = v.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("vx") / F.col("speed")).alias("c"), F.avg(F.col("vy") / F.col("speed")).alias("s")).where("n >= 3")
    return g.select("tid", "n", r(F.sqrt(-2 * F.log(F.greatest(F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")), F.lit(1e-6)))), 4).alias("circ_std"))


def spurious_rules(t: DataFrame) -> DataFrame:
    """First of five rules a track breaks, tried in the order doubled, still off the pitch, brief, still, off the field."""
    dup = inframe_dedup(t, clock=framed).groupBy("tid").agg(F.count(F.lit(1)).alias("dups"))
    n_c = framed(t).groupBy("tid").agg(F.count(F.lit(1)).alias("cells"))
    g = t.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("span"), F.stddev_pop("fx").alias("su"), F.stddev_pop("fy").alias("sv"), F.stddev_pop("x").alias("sx"), F.avg((~F.col("in_pitch")).cast("double")).alias("off"))
    j = g.join(n_c, "tid", "left").join(dup, "tid", "left").withColumn("share", F.coalesce(F.col("dups") / F.col("cells"), F.lit(0.0)))
    rule = F.when(F.col("share") > 0.5, "double_detection").when((F.col("off") > 0.5) & (F.col("sx") < 1), "off_pitch_stationary").when(F.col("n") < 12, "orphan_blip").when((F.col("span") >= 4) & (F.col("su") < 5) & (F.col("sv") < 5), "static_foreign").when(F.col("off") > 0.8, "off_field_persistent")
    return j.select("tid", "n", rule.alias("spurious_reason"))


def gk_candidates(t: DataFrame, residence: float = 0.45, keep: int = 3) -> DataFrame:
    """Candidates for the goalkeeper of each end of a clip's pitch: resident, then slow (a top-k report)."""
    v = velocities(t)
    ext = v.groupBy("clip").agg(F.percentile("x", F.lit(0.05)).alias("lo"), F.percentile("x", F.lit(0.95)).alias("hi"))
    band = 0.15 * (F.col("hi") - F.col("lo"))
    g = v.join(ext, "clip").groupBy("clip", "tid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("x") < F.col("lo") + band).cast("double")), 6).alias("left"), F.round(F.avg((F.col("x") > F.col("hi") - band).cast("double")), 6).alias("right"), F.round(F.median("speed"), 6).alias("speed"))
    e = g.select("clip", "tid", "n", "speed", F.explode(F.array(F.struct(F.lit("left").alias("end"), F.col("left").alias("res")), F.struct(F.lit("right").alias("end"), F.col("right").alias("res")))).alias("e")).select("clip", "tid", "n", "speed", "e.end", "e.res").where(f"res >= {residence}")
    k = F.row_number().over(Window.partitionBy("clip", "end").orderBy(F.desc("res"), F.asc_nulls_last("speed"), "tid"))
    return e.withColumn("rank", k).where(f"rank <= {keep}").select("clip", "end", "tid", "res", "rank")


def vest_rules(t: DataFrame, least: int = 12) -> DataFrame:
    """Rule fusion over per-track features with an abstention; no balance of the classes is forced."""
    g = t.where("conf is not null and box_h > 0 and box_w is not null").groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("a"), F.avg(F.col("box_w") / F.col("box_h")).alias("b"))
    lab = F.when(F.col("n") < least, "abstain").when(F.round("a", 6) >= 0.65, "vest").when(F.round("a", 6) <= 0.45, "no_vest").when(F.round("b", 6) > 0.55, "gk").otherwise("abstain")
    return g.select("tid", "n", lab.alias("vest_label"))


def coverage_mask(t: DataFrame, nx: int = 12, ny: int = 8, h_inv: tuple = (22.0, -0.5, 90.0, -0.3, 12.0, 130.0, 0.0001, 0.004, 1.0)) -> DataFrame:
    """Cells of each camera's pitch whose centre lies inside the image when projected back; others are null."""
    p = placed(t).groupBy("cam").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    g = p.withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    g = g.withColumns({"cx": F.lit(50.0) * (F.col("ix") + 0.5) / nx, "cy": F.lit(30.0) * (F.col("iy") + 0.5) / ny})
    den = h_inv[6] * F.col("cx") + h_inv[7] * F.col("cy") + h_inv[8]
    u, v = (h_inv[0] * F.col("cx") + h_inv[1] * F.col("cy") + h_inv[2]) / den, (h_inv[3] * F.col("cx") + h_inv[4] * F.col("cy") + h_inv[5]) / den
    return g.select("cam", "ix", "iy", F.when((u >= 0) & (u <= 1280) & (v >= 0) & (v <= 720), F.lit(1)).alias("visible"))


def fusion_tracklets(t: DataFrame, length: float = 50.0, width: float = 30.0, offset_s: float = 0.5, margin: float = 3.0) -> DataFrame:
    """Two views (parity of tid) in one frame: the second turned and shifted in time, cropped to the pitch, short ones dropped."""
    p = placed(t).where("t is not null")
    second = F.col("tid") % 2 == 1
    q = p.select("clip", "tid", F.when(second, F.col("t") + offset_s).otherwise(F.col("t")).alias("t"), F.when(second, length - F.col("x")).otherwise(F.col("x")).alias("X"), F.when(second, width - F.col("y")).otherwise(F.col("y")).alias("Y"))
    q = q.where(F.col("X").between(-margin, length + margin) & F.col("Y").between(-margin, width + margin))
    return q.groupBy("clip", "tid").agg(F.count(F.lit(1)).alias("n"), r(F.min("t"), 4).alias("t0"), r(F.max("t"), 4).alias("t1"), r(F.avg("X"), 4).alias("mx"), r(F.avg("Y"), 4).alias("my")).where("n >= 2")


def coregister(t: DataFrame, limit: float = 10.0) -> DataFrame:
    """Per clip the median translation between mutually nearest rows of the two views, and the closed-form rotation."""
    from kinelake.operators.pairs import coreg_pairs

    c = framed(t).select("clip", "g", "tid", "x", "y")
    m = coreg_pairs(t, limit).join(c.select("clip", "g", F.col("tid").alias("tid_a"), F.col("x").alias("ax"), F.col("y").alias("ay")), ["clip", "g", "tid_a"]).join(c.select("clip", "g", F.col("tid").alias("tid_b"), F.col("x").alias("bx"), F.col("y").alias("by")), ["clip", "g", "tid_b"])
    w = m.groupBy("clip").agg(F.avg("ax").alias("ma"), F.avg("ay").alias("na"), F.avg("bx").alias("mb"), F.avg("by").alias("nb"))
    j = m.join(w, "clip").withColumns({"p": F.col("ax") - F.col("ma"), "q": F.col("ay") - F.col("na"), "u": F.col("bx") - F.col("mb"), "v": F.col("by") - F.col("nb")})
    g = j.groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.median(F.col("bx") - F.col("ax")).alias("dx"), F.median(F.col("by") - F.col("ay")).alias("dy"), F.sum(F.expr("p*v - q*u")).alias("s"), F.sum(F.expr("p*u + q*v")).alias("c")).where("n >= 5")
    return g.select("clip", "n", r("dx", 4).alias("dx"), r("dy", 4).alias("dy"), r(F.atan2("s", "c"), 4).alias("angle"))


def fused_tracks(t: DataFrame, labels: DataFrame, vmax: float = 8.0) -> DataFrame:
    """Per player and clip the confidence-weighted track frame by frame and its length over plausible steps."""
    c = framed(t).join(_players(labels), "tid")
    f = c.groupBy("clip", "player_id", "g").agg(F.sum("conf").alias("w"), F.sum(F.col("conf") * F.col("x")).alias("sx"), F.sum(F.col("conf") * F.col("y")).alias("sy"), F.countDistinct("tid").alias("k")).where("w > 0")
    f = f.select("clip", "player_id", "g", "k", (F.col("sx") / F.col("w")).alias("x"), (F.col("sy") / F.col("w")).alias("y"))
    w = Window.partitionBy("clip", "player_id").orderBy("g")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    s = f.withColumn("d", F.sqrt(dx * dx + dy * dy)).withColumn("dt", (F.col("g") - F.lag("g").over(w)) / 25.0)
    return s.groupBy("clip", "player_id").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("max_tracks"), r(F.sum(F.when(F.col("d") <= vmax * F.col("dt"), F.col("d")).otherwise(0.0)), 3).alias("dist"))
