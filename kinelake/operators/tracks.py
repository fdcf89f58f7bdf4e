"""Relational operators on the canonical track view (columns of ``clean_tracks``).

Every operator takes the view and returns a DataFrame.  Null coordinates are
absent observations: rows without both x and y take no part in geometry, rows
without ``t`` none in time.  Repeated rows are gone in the view; empty input
gives an empty result.  Thresholds are parameters, their defaults those of
25 fps football tracks in metres.  All windows are per track and share the
view's partitioning by tid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from kinelake.functions.ranks import exact_percentiles

ROUND = 6


def by_frame() -> WindowSpec:
    """The window all per-track operators share."""
    return Window.partitionBy("tid").orderBy("frame")


def r(c: Column | str, digits: int = ROUND) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def window_median(c: str, w: WindowSpec) -> Column:
    """Exact median over a short row frame (Spark has no framed median)."""
    a = F.array_sort(F.collect_list(c).over(w))
    n = F.size(a)
    return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2.0)


def placed(t: DataFrame) -> DataFrame:
    return t.where("x is not null and y is not null")


def step(t: DataFrame) -> DataFrame:
    """Adds the previous row's frame, time and place, dt, seg (step length)."""
    w = by_frame()
    s = t.withColumns({"pf": F.lag("frame").over(w), "pt": F.lag("t").over(w), "px": F.lag("x").over(w), "py": F.lag("y").over(w)})
    return s.withColumns({"dt": F.col("t") - F.col("pt"), "seg": F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))})


# --- scans and row-wise geometry


def infer_fps(t: DataFrame) -> DataFrame:
    s = t.where("t is not null").withColumns({"dt": F.col("t") - F.lag("t").over(by_frame()), "df": F.col("frame") - F.lag("frame").over(by_frame())})
    return s.where("df > 0 and dt > 0").groupBy("clip").agg(r(1 / F.median(F.col("dt") / F.col("df")), 4).alias("fps"))


def detections_to_rows(t: DataFrame, least_ratio: float = 1.3, frame_bottom: float = 720.0) -> DataFrame:
    """Boxes to foot points: too flat boxes dropped, cut-off feet flagged."""
    box = t.where("box_h > 0 and box_w > 0").where(F.try_divide("box_h", "box_w") >= least_ratio)
    zone = F.when(F.col("fy") < 360, "far").when(F.col("fy") < 560, "mid").otherwise("near")
    return box.select("tid", "frame", r("fx").alias("foot_x"), r("fy").alias("foot_y"), (F.col("fy") >= frame_bottom - 2).alias("bottom_cropped"), zone.alias("zone"))


def far_band(t: DataFrame) -> DataFrame:
    """Rows of the image holding far players: 1st to 40th percentile of foot_y, widened by 4 % of the span."""
    p = t.where("fy is not null").select("cam", "fy")
    s = exact_percentiles(p, ["cam"], {"a": ("fy", 0.01), "b": ("fy", 0.4)}).join(p.groupBy("cam").agg((F.max("fy") - F.min("fy")).alias("span")), "cam")
    return s.select("cam", F.floor(F.col("a") - 0.04 * F.col("span")).cast("int").alias("lo"), F.ceil(F.col("b") + 0.04 * F.col("span")).cast("int").alias("hi"))


def zone_fixed(t: DataFrame) -> DataFrame:
    z = F.when(F.col("fy") < 360, "far").when(F.col("fy") < 560, "mid").otherwise("near")
    return t.where("fy is not null").groupBy("cam", z.alias("zone_fixed")).agg(F.count(F.lit(1)).alias("n"))


def zone_tercile(t: DataFrame) -> DataFrame:
    """Terciles by quantile of pitch depth per camera, 0 near, 2 far."""
    p = placed(t)
    cut = exact_percentiles(p, ["cam"], {"a": ("y", 1 / 3), "b": ("y", 2 / 3)})
    z = F.when(F.col("y") < F.col("a"), 0).when(F.col("y") < F.col("b"), 1).otherwise(2)
    return p.join(cut, "cam").groupBy("cam", z.alias("zone_tercile")).agg(F.count(F.lit(1)).alias("n"))


def zone_range(t: DataFrame) -> DataFrame:
    """Thirds of the range of image height per camera, 0 far, 2 near."""
    p = t.where("fy is not null")
    cut = p.groupBy("cam").agg(F.min("fy").alias("a"), F.max("fy").alias("b"))
    z = F.least(F.lit(2), F.floor(3 * (F.col("fy") - F.col("a")) / F.greatest(F.col("b") - F.col("a"), F.lit(1e-9)))).cast("int")
    return p.join(cut, "cam").groupBy("cam", z.alias("zone_range")).agg(F.count(F.lit(1)).alias("n"))


def project_homography(t: DataFrame, h: tuple = (0.05, 0.002, -4.0, 0.001, 0.09, -12.0, 0.00001, 0.0004, 1.0)) -> DataFrame:
    """Foot points through a 3 x 3 homography given as data."""
    den = h[6] * F.col("fx") + h[7] * F.col("fy") + h[8]
    return t.where("fx is not null and fy is not null").select("tid", "frame", r((h[0] * F.col("fx") + h[1] * F.col("fy") + h[2]) / den).alias("px"), r((h[3] * F.col("fx") + h[4] * F.col("fy") + h[5]) / den).alias("py"))


def undistort_division(t: DataFrame, k1: float = -1e-7, k2: float = 1e-14, cx: float = 640.0, cy: float = 360.0) -> DataFrame:
    """Division-free radial model: r_u = r_d (1 + k1 r^2 + k2 r^4) around the image centre."""
    dx, dy = F.col("fx") - cx, F.col("fy") - cy
    r2 = dx * dx + dy * dy
    f = 1 + k1 * r2 + k2 * r2 * r2
    return t.where("fx is not null and fy is not null").select("tid", "frame", r(cx + dx * f).alias("ux"), r(cy + dy * f).alias("uy"))


def shared_frame(t: DataFrame, length: float = 50.0, width: float = 30.0, scale: float = 1.0) -> DataFrame:
    """The second camera's view turned by 180 degrees onto the first one's pitch."""
    return placed(t).select("tid", "frame", r(length - scale * F.col("x")).alias("sx"), r(width - scale * F.col("y")).alias("sy"))


def confidence_weight(t: DataFrame, sigma: float = 0.3) -> DataFrame:
    """Confidence weight of a row: 0 outside the frame or pitch."""
    clip = lambda c, a, b: F.least(F.greatest(c, F.lit(a)), F.lit(b))
    w = clip(F.col("conf") / 0.7, 0.0, 1.0) * clip(F.col("box_h") / 90, 0.2, 1.0) / (1 + (sigma / 0.5) ** 2)
    return t.where("conf is not null and box_h is not null").select("tid", "frame", r(F.when(F.col("cropped") | ~F.col("in_pitch"), F.lit(0.0)).otherwise(w)).alias("w_conf"))


def camera_reliability(t: DataFrame, cam_x: float = 25.0, cam_y: float = -5.0, half: float = 22.0) -> DataFrame:
    d2 = (F.col("x") - cam_x) * (F.col("x") - cam_x) + (F.col("y") - cam_y) * (F.col("y") - cam_y)
    return placed(t).select("tid", "frame", r(1 / (1 + d2 / (half * half))).alias("reliability"))


def reconstruct_bbox(t: DataFrame, width: float = 1280.0, height: float = 720.0) -> DataFrame:
    """Foot point and size back to a box inside the frame."""
    b = t.where("box_h is not null and box_w is not null and fx is not null and fy is not null")
    inside = lambda c, hi: F.least(F.greatest(c, F.lit(0.0)), F.lit(hi))
    return b.select("tid", "frame", r(inside(F.col("fx") - F.col("box_w") / 2, width)).alias("x1"), r(inside(F.col("fy") - F.col("box_h"), height)).alias("y1"), r(inside(F.col("fx") + F.col("box_w") / 2, width)).alias("x2"), r(inside(F.col("fy"), height)).alias("y2"))


def out_distance(t: DataFrame, length: float = 50.0, width: float = 30.0) -> DataFrame:
    """Distance outside the pitch rectangle, and whether inside a quadrilateral by half planes."""
    dx = F.greatest(-F.col("x"), F.col("x") - length, F.lit(0.0))
    dy = F.greatest(-F.col("y"), F.col("y") - width, F.lit(0.0))
    quad = [(2.0, 1.0), (48.0, 2.0), (46.0, 28.0), (3.0, 27.0)]
    cross = [(bx - ax) * (F.col("y") - ay) - (by - ay) * (F.col("x") - ax) for (ax, ay), (bx, by) in zip(quad, quad[1:] + quad[:1])]
    inside = (cross[0] >= -1e-6) & (cross[1] >= -1e-6) & (cross[2] >= -1e-6) & (cross[3] >= -1e-6)
    return placed(t).select("tid", "frame", r(F.sqrt(dx * dx + dy * dy)).alias("out_dist"), inside.alias("inside_quad"))


def reflect(t: DataFrame, length: float = 50.0) -> DataFrame:
    return placed(t).select("tid", "frame", r(length - F.col("x")).alias("x"), r("y").alias("y"))


def local_jacobian(t: DataFrame, h: tuple = (0.05, 0.002, -4.0, 0.001, 0.09, -12.0, 0.00001, 0.0004, 1.0)) -> DataFrame:
    """Metres per pixel at the foot point, by one-pixel differences of the projection."""

    def project(u: Column, v: Column) -> tuple[Column, Column]:
        den = h[6] * u + h[7] * v + h[8]
        return (h[0] * u + h[1] * v + h[2]) / den, (h[3] * u + h[4] * v + h[5]) / den

    u, v = F.col("fx"), F.col("fy")
    (x0, y0), (x1, y1), (x2, y2) = project(u, v), project(u + 1, v), project(u, v + 1)
    a = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    b = F.sqrt((x2 - x0) * (x2 - x0) + (y2 - y0) * (y2 - y0))
    return t.where("fx is not null and fy is not null").select("tid", "frame", r(0.5 * (a + b)).alias("m_per_px"))


# --- filters and gates


def qc_columns(t: DataFrame) -> DataFrame:
    c = F.coalesce("conf", F.lit(0.0))
    low = (c < 0.3) | ((F.col("zone") == "far") & (c < 0.4)) | F.col("cropped")
    return t.groupBy("cam").agg(F.count(F.lit(1)).alias("n"), F.sum((c < 0.3).cast("int")).alias("recovered"), F.sum(F.coalesce(low, F.lit(False)).cast("int")).alias("low_conf"))


def static_tracks(t: DataFrame, span_s: float = 4.0, spread_px: float = 5.0) -> DataFrame:
    """Tracks locked to a pixel: long-lived and hardly spread."""
    g = t.where("fx is not null and fy is not null and t is not null").groupBy("tid").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("span"), F.stddev_pop("fx").alias("sx"), F.stddev_pop("fy").alias("sy"))
    return g.select("tid", "n", ((F.col("n") >= 2) & (F.col("span") >= span_s) & (F.col("sx") < spread_px) & (F.col("sy") < spread_px)).alias("static_susp"))


def clean_upright(t: DataFrame) -> DataFrame:
    ratio = F.try_divide("box_h", "box_w")
    return t.where((F.col("conf") > 0.6) & (F.col("box_h") > 50) & (ratio > 1.7) & (ratio < 5) & ~F.col("cropped")).groupBy("cam").agg(F.count(F.lit(1)).alias("n"), r(F.avg("box_h")).alias("mean_h"))


def tracklet_quality(t: DataFrame, least_s: float = 2.0, conf_share: float = 0.5, cv: float = 0.5, max_step: float = 3.0, off_share: float = 0.5) -> DataFrame:
    """Gate with reasons: too short, low confidence, unstable box, jumpy, off pitch."""
    s = step(t)
    g = s.groupBy("tid").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("t") - F.min("t")).alias("dur"),
        F.avg((F.coalesce("conf", F.lit(0.0)) >= 0.5).cast("double")).alias("sure"),
        F.try_divide(F.stddev_pop("box_h"), F.avg("box_h")).alias("cv"),
        F.median("seg").alias("med_step"),
        F.avg((~F.col("in_pitch")).cast("double")).alias("off"),
    )
    reason = lambda cond, name: F.when(cond, F.lit(name))
    why = F.concat_ws(
        ",",
        reason(F.coalesce("dur", F.lit(0.0)) < least_s, "short"),
        reason(F.col("sure") < conf_share, "low_conf"),
        reason(F.col("cv") > cv, "box_cv"),
        reason(F.col("med_step") > max_step, "jumpy"),
        reason(F.col("off") > off_share, "off_pitch"),
    )
    return g.select("tid", "n", why.alias("reasons"), (why == "").alias("accepted"))


def pseudo_labels(t: DataFrame, conf: float = 0.5) -> DataFrame:
    """Rows of accepted tracks that are good enough to serve as labels."""
    good = tracklet_quality(t).where("accepted").select("tid")
    return t.join(good, "tid", "left_semi").where((F.col("conf") >= conf) & F.col("in_pitch") & ~F.col("cropped")).groupBy("clip").agg(F.count(F.lit(1)).alias("n_labels"), F.countDistinct("tid").alias("n_tracks"))


def honesty_filter(t: DataFrame) -> DataFrame:
    """Rows that may enter metrics: observed, not interpolated (the confidence of an interpolated row is null)."""
    return t.where("conf is not null").groupBy("clip").agg(F.count(F.lit(1)).alias("n"))


# --- per-frame aggregates


def _frame_counts(t: DataFrame) -> DataFrame:
    return t.groupBy("clip", "frame").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tid").alias("k"), F.sum((F.col("zone") == "far").cast("int")).alias("far"))


def parity_qc(t: DataFrame, expected: int = 3) -> DataFrame:
    c = _frame_counts(t)
    return c.groupBy("clip").agg(F.count(F.lit(1)).alias("n_frames"), r(F.avg((F.col("n") == expected).cast("double"))).alias("frac_expected"), F.median("n").alias("median_n"), r(F.avg((F.col("n") % 2 == 1).cast("double"))).alias("odd_frac"))


def parity_flags(t: DataFrame, expected: int = 3) -> DataFrame:
    c = _frame_counts(t)
    return c.select("clip", "frame", F.col("n"), F.col("far").alias("far_count"), F.greatest(F.lit(0), expected - F.col("n")).alias("deficit"), (F.col("n") % 2 == 1).alias("odd"), (F.col("n") > expected).alias("overshoot"))


def concurrency_stats(t: DataFrame) -> DataFrame:
    """Maximum, p95, median and smallest mode of the number of tracks per frame."""
    c = _frame_counts(t)
    g = c.groupBy("clip").agg(F.max("k").alias("k_max"), r(F.percentile("k", F.lit(0.95))).alias("k_p95"), F.median("k").alias("k_median"))
    freq = c.groupBy("clip", "k").agg(F.count(F.lit(1)).alias("f"))
    mode = freq.groupBy("clip").agg(F.max(F.struct("f", (-F.col("k")).alias("neg"))).alias("m")).select("clip", (-F.col("m.neg")).alias("k_mode"))
    return g.join(mode, "clip")


def detection_floor(t: DataFrame) -> DataFrame:
    c = _frame_counts(t)
    return c.groupBy("clip").agg(F.max("k").alias("floor"), F.sum((F.col("n") != F.col("k")).cast("int")).alias("duplicate_frames"))


def sweep_concurrency(t: DataFrame) -> DataFrame:
    """Peak of overlapping life spans [f0, f1] per clip by a sweep over starts and ends."""
    span = t.groupBy("clip", "tid").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"))
    ev = span.select("clip", F.explode(F.array(F.struct(F.col("f0").alias("f"), F.lit(1).alias("d")), F.struct((F.col("f1") + 1).alias("f"), F.lit(-1).alias("d")))).alias("e")).select("clip", "e.f", "e.d")
    net = ev.groupBy("clip", "f").agg(F.sum("d").alias("d"))
    run = net.withColumn("live", F.sum("d").over(Window.partitionBy("clip").orderBy("f").rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("clip").agg(F.max("live").alias("peak"))


def roster_estimate(t: DataFrame) -> DataFrame:
    """Agreement of two estimates of the number of players: p95 of concurrency and peak of the life spans."""
    e = concurrency_stats(t).join(sweep_concurrency(t), "clip")
    return e.select("clip", F.round("k_p95").cast("int").alias("by_frames"), F.col("peak").cast("int").alias("by_spans"), (F.abs(F.round("k_p95") - F.col("peak")) <= 1).alias("agree"))


def deficit_gate(t: DataFrame, expected: int = 3, every: int = 6) -> DataFrame:
    """Frames where recovery should run: every sixth frame whose trailing median of 13 counts is too low."""
    c = _frame_counts(t)
    w = Window.partitionBy("clip").orderBy("frame").rowsBetween(-12, 0)
    return c.withColumn("med", window_median("n", w)).where((F.col("med") < expected) & (F.col("frame") % every == 0)).select("clip", "frame", "med")


# --- per-track aggregates


def presence_class(t: DataFrame, least: int = 60, span_share: float = 0.85, density: float = 0.5) -> DataFrame:
    clip = t.groupBy("clip").agg((F.max("frame") - F.min("frame") + 1).alias("len"), F.countDistinct("frame").alias("n_frames"))
    g = t.groupBy("clip", "tid").agg(F.count(F.lit(1)).alias("n"), (F.max("frame") - F.min("frame") + 1).alias("span"))
    j = g.join(clip, "clip")
    core = (F.col("n") >= least) & (F.col("span") / F.col("len") >= span_share) & (F.col("n") / F.col("span") >= density)
    return j.select("tid", "n", r(F.col("span") / F.col("len")).alias("span_frac"), F.when(core, "core").when(F.col("n") >= least, "partial").otherwise("brief").alias("presence"))


def tracklet_summary(t: DataFrame, k: int = 5) -> DataFrame:
    """n, first and last frame and time, median place of the first and last k rows, share of far rows."""
    p = t.withColumn("a", F.row_number().over(by_frame())).withColumn("b", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("frame"))))
    head, tail = F.col("a") <= k, F.col("b") <= k
    med = lambda cond, c: r(F.median(F.when(cond, F.col(c))))
    return p.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("f0"), F.max("frame").alias("f1"), r(F.min("t"), 4).alias("t0"), r(F.max("t"), 4).alias("t1"), med(head, "x").alias("hx"), med(head, "y").alias("hy"), med(tail, "x").alias("tx"), med(tail, "y").alias("ty"), r(F.avg((F.col("zone") == "far").cast("double"))).alias("far_frac"))


def intra_holes(t: DataFrame) -> DataFrame:
    h = t.withColumn("gap", F.lead("frame").over(by_frame()) - F.col("frame") - 1).where("gap > 0")
    return h.groupBy("tid").agg(F.count(F.lit(1)).alias("n_holes"), F.sum("gap").alias("missing"), F.median("gap").alias("median_gap"), r(F.percentile("gap", F.lit(0.95))).alias("p95_gap"), F.max("gap").alias("max_gap"))


def births_deaths(t: DataFrame, border: float = 2.0, length: float = 50.0) -> DataFrame:
    """First and last placed row of each track, whether near the border."""
    p = placed(t)
    g = p.groupBy("tid").agg(F.min_by(F.struct("x", "y"), "frame").alias("b"), F.max_by(F.struct("x", "y"), "frame").alias("d"))
    edge = lambda c: (F.col(f"{c}.x") < border) | (F.col(f"{c}.x") > length - border)
    return g.select("tid", r("b.x").alias("birth_x"), r("b.y").alias("birth_y"), r("d.x").alias("death_x"), r("d.y").alias("death_y"), edge("b").alias("born_at_border"), edge("d").alias("died_at_border"))


def far_quality(t: DataFrame) -> DataFrame:
    far = F.col("zone") == "far"
    return t.groupBy("tid").agg(r(F.avg(far.cast("double"))).alias("far_frac"), F.sum((far & ~F.col("in_pitch")).cast("int")).alias("dropped_far"), r(F.median("box_h")).alias("median_h"))


def median_mad(t: DataFrame, m_per_px: float = 0.02, least: int = 12) -> DataFrame:
    """Median height per track and its median absolute deviation."""
    h = t.where("box_h is not null").select("tid", (F.col("box_h") * m_per_px).alias("h"))
    med = h.groupBy("tid").agg(F.median("h").alias("med"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return h.join(med, "tid").groupBy("tid").agg(F.first("n").alias("n"), r(F.first("med")).alias("median_h"), r(F.median(F.abs(F.col("h") - F.col("med")))).alias("mad_h"))


def band_normalize(t: DataFrame, bands: int = 8) -> DataFrame:
    """Heights divided by the median of their quantile band of image height: spread and shape per camera."""
    p = t.where("box_h > 0 and fy is not null").select("cam", "fy", "box_h")
    cuts = exact_percentiles(p, ["cam"], {f"q{i}": ("fy", i / bands) for i in range(1, bands)})
    b = sum(((F.col("fy") >= F.col(f"q{i}")).cast("int") for i in range(1, bands)), F.lit(0))
    banded = p.join(cuts, "cam").select("cam", "box_h", b.alias("band"))
    med = exact_percentiles(banded, ["cam", "band"], {"m": ("box_h", 0.5)})
    return banded.join(med, ["cam", "band"]).select("cam", (F.col("box_h") / F.col("m")).alias("h")).groupBy("cam").agg(F.count(F.lit(1)).alias("n"), r(F.avg("h"), 4).alias("mean_h"), r(F.stddev_pop("h"), 4).alias("sd_h"))


def far_stats(t: DataFrame, frame_h: float = 720.0, small: float = 0.06) -> DataFrame:
    return t.where("box_h is not null").groupBy("cam").agg(F.count(F.lit(1)).alias("n"), r(F.avg((F.col("box_h") / frame_h < small).cast("double"))).alias("small_frac"))


def frame_uncertainty(t: DataFrame) -> DataFrame:
    """Per frame the mean of 1 - conf and of the binary entropy of conf."""
    c = F.least(F.greatest(F.col("conf"), F.lit(1e-9)), F.lit(1 - 1e-9))
    h = -(c * F.log2(c) + (1 - c) * F.log2(1 - c))
    return t.where("conf is not null").groupBy("clip", "frame").agg(r(F.avg(1 - F.col("conf"))).alias("least_conf"), r(F.avg(h)).alias("entropy"))


def label_queue(t: DataFrame, expected: int = 3, segment: int = 25, budget: int = 50) -> DataFrame:
    """Frames worth labelling: the best of each segment, the best segments per clip (top-k is the feature)."""
    c = t.groupBy("clip", "frame").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("zone") == "far").cast("int")).alias("far"), F.median("conf").alias("mc"))
    score = 2 * F.greatest(F.lit(0), expected - F.col("n")) + 0.5 * F.col("far") + (F.col("n") % 2) + 3 * (1 - F.coalesce("mc", F.lit(0.0)))
    s = c.withColumn("score", F.round(score, 6)).withColumn("seg", F.floor(F.col("frame") / segment))
    best = s.withColumn("k", F.row_number().over(Window.partitionBy("clip", "seg").orderBy(F.desc("score"), "frame"))).where("k = 1")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("clip").orderBy(F.desc("score"), "frame"))).where(F.col("rank") <= budget).select("clip", "frame", "score", "rank")


def weighted_median(t: DataFrame) -> DataFrame:
    """First height at which the confidence-weighted share reaches one half, per track."""
    p = t.where("box_h is not null and conf > 0")
    w = Window.partitionBy("tid").orderBy("box_h", "frame")
    c = p.withColumn("cw", F.sum(F.round(F.col("conf") * 1e6).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("tw", F.sum(F.round(F.col("conf") * 1e6).cast("long")).over(Window.partitionBy("tid")))
    return c.where("cw * 2 >= tw").groupBy("tid").agg(r(F.min("box_h")).alias("weighted_median"))


def weighted_occupancy(t: DataFrame, nx: int = 10, ny: int = 6) -> DataFrame:
    """Confidence-weighted presence per cell, divided by the clip's fullest cell."""
    g = _grid(placed(t).where("conf is not null"), nx, ny).groupBy("cam", "ix", "iy").agg(F.sum("conf").alias("w"))
    return g.select("cam", "ix", "iy", r(F.col("w") / F.max("w").over(Window.partitionBy("cam")), 5).alias("occupancy"))


#: Robust extent of a camera's pitch.
EXTENT = {"x0": ("x", 0.005), "x1": ("x", 0.995), "y0": ("y", 0.005), "y1": ("y", 0.995)}


def _extent(p: DataFrame) -> DataFrame:
    return exact_percentiles(p, ["cam"], EXTENT)


def _grid(p: DataFrame, nx: int, ny: int) -> DataFrame:
    """Cells of the camera's robust extent; the last bin is closed on the right."""
    e = p.join(_extent(p), "cam").where("x between x0 and x1 and y between y0 and y1 and x1 > x0 and y1 > y0")
    cell = lambda c, a, b, n: F.least(F.floor((F.col(c) - F.col(a)) / ((F.col(b) - F.col(a)) / n)), F.lit(n - 1)).cast("int")
    return e.withColumn("ix", cell("x", "x0", "x1", nx)).withColumn("iy", cell("y", "y0", "y1", ny))


def robust_extent(t: DataFrame) -> DataFrame:
    return _extent(placed(t)).select("cam", *[r(c).alias(c) for c in ("x0", "x1", "y0", "y1")])


def heatmap(t: DataFrame, nx: int = 10, ny: int = 6) -> DataFrame:
    return _grid(placed(t), nx, ny).groupBy("cam", "ix", "iy").agg(F.count(F.lit(1)).alias("n"))


def heatmap_exposure(t: DataFrame, nx: int = 6, ny: int = 4) -> DataFrame:
    """Presence seconds per cell over the dense grid; cells never covered are null, not zero."""
    p = placed(t).withColumn("fps", F.coalesce("fps", F.lit(25.0)))
    g = _grid(p, nx, ny).groupBy("cam", "ix", "iy").agg(F.sum(1 / F.col("fps")).alias("s"))
    dense = g.select("cam").distinct().withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    return dense.join(g, ["cam", "ix", "iy"], "left").select("cam", "ix", "iy", r("s", 4).alias("presence_s"))


def presence_grid(t: DataFrame, nx: int = 4, ny: int = 3) -> DataFrame:
    """Presence per track and cell relative to the track's fullest cell."""
    g = _grid(placed(t), nx, ny).groupBy("tid", "ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    return g.select("tid", "ix", "iy", r(F.col("n") / F.max("n").over(Window.partitionBy("tid"))).alias("share"))


def territory_thirds(t: DataFrame, least: int = 12) -> DataFrame:
    """Shares of the pitch thirds, per track and overall (grouping sets)."""
    e = placed(t).join(_extent(placed(t)).select("cam", "x0", "x1"), "cam").where("x1 > x0")
    third = F.floor(F.least(F.greatest((F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")), F.lit(0.0)), F.lit(0.999999)) * 3)
    z = e.withColumn("third", third)
    share = lambda k: r(F.avg((F.col("third") == k).cast("double"))).alias(f"third_{k}")
    g = z.rollup("cam", "tid").agg(F.count(F.lit(1)).alias("n"), *[share(k) for k in range(3)], F.grouping_id().alias("level"))
    return g.where(f"level <> 0 or n >= {least}")


def binned_median(t: DataFrame, width: float = 40.0, least: int = 20) -> DataFrame:
    b = t.where("box_h is not null and fy is not null").withColumn("bin", F.floor(F.col("fy") / width).cast("int"))
    return b.groupBy("cam", "bin").agg(F.count(F.lit(1)).alias("n"), r(F.median("box_h")).alias("median_h")).where(F.col("n") > least)


def resolve_domain(t: DataFrame) -> DataFrame:
    """Pitch domain if any pitch value exists, else pixels; extent from the data."""
    g = t.groupBy("clip").agg(F.count("x").alias("n_pitch"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), F.min("fx").alias("u_lo"), F.max("fx").alias("u_hi"))
    pitch = F.col("n_pitch") > 0
    return g.select("clip", F.when(pitch, "pitch").otherwise("pixel").alias("domain"), r(F.when(pitch, F.col("x_lo")).otherwise(F.col("u_lo"))).alias("lo"), r(F.when(pitch, F.col("x_hi")).otherwise(F.col("u_hi"))).alias("hi"))


def gk_heuristic(t: DataFrame, length: float = 50.0, depth: float = 5.0, spread: float = 6.5, least: int = 20) -> DataFrame:
    g = placed(t).groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.median("x").alias("mx"), F.stddev_pop("x").alias("sx"), F.avg(((F.col("x") < 5) | (F.col("x") > length - 5)).cast("double")).alias("share"))
    return g.where((F.col("n") >= least) & (F.col("sx") < spread) & ((F.col("mx") < depth) | (F.col("mx") > length - depth))).select("tid", "n", r("mx").alias("median_x"), r("share").alias("end_share"))


def top_tracks(t: DataFrame, n: int = 25, least: int = 12) -> DataFrame:
    """The longest tracks (a top-k report)."""
    return t.groupBy("tid").agg(F.count(F.lit(1)).alias("n_obs")).where(F.col("n_obs") >= least).orderBy(F.desc("n_obs"), "tid").limit(n)


def pick_frame(t: DataFrame) -> DataFrame:
    """Per clip the busiest and most spread frame."""
    f = placed(t).groupBy("clip", "frame").agg(F.count(F.lit(1)).alias("n"), F.stddev("x").alias("sx"), F.stddev("y").alias("sy"))
    s = f.withColumn("score", F.round(F.col("n") + (F.coalesce("sx", F.lit(0.0)) + F.coalesce("sy", F.lit(0.0))) / 10, 6))
    return s.groupBy("clip").agg(F.max(F.struct("score", (-F.col("frame")).alias("neg"))).alias("b")).select("clip", (-F.col("b.neg")).alias("frame"), F.col("b.score").alias("score"))


def stride_sample(t: DataFrame, k: int = 10) -> DataFrame:
    """Every k-th distinct frame of a clip, from the first."""
    f = t.select("clip", "frame").distinct()
    return f.withColumn("i", F.row_number().over(Window.partitionBy("clip").orderBy("frame")) - 1).where(F.col("i") % k == 0).select("clip", "frame")


def linspace_sample(t: DataFrame, n: int = 5) -> DataFrame:
    """n evenly spaced rows of each track, positions truncated towards zero."""
    p = t.withColumn("i", F.row_number().over(by_frame()) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("tid")))
    hit = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.floor(j * (F.col("m") - 1) / (n - 1)) == F.col("i"))
    return p.where(hit).select("tid", "frame")


def best_window(t: DataFrame, length: int = 300) -> DataFrame:
    """Start frame maximising the mean count of the frames within the next ``length`` frames."""
    c = _frame_counts(t)
    w = Window.partitionBy("clip").orderBy("frame").rangeBetween(0, length - 1)
    m = c.withColumn("m", F.round(F.avg("n").over(w), 6))
    return m.groupBy("clip").agg(F.max(F.struct("m", (-F.col("frame")).alias("neg"))).alias("b")).select("clip", (-F.col("b.neg")).alias("start_frame"), F.col("b.m").alias("mean_n"))


def quantile_window_pick(t: DataFrame, n: int = 5) -> DataFrame:
    """In each of n time quantiles of a track the tallest box within a tenth of its span."""
    p = t.where("box_h is not null and t is not null")
    g = p.groupBy("tid").agg(F.percentile("t", F.array(*[F.lit((i + 0.5) / n) for i in range(n)])).alias("q"), (F.max("t") - F.min("t")).alias("span"))
    centre = g.select("tid", "span", F.posexplode("q").alias("i", "c"))
    near = p.join(centre, "tid").where(F.abs(F.col("t") - F.col("c")) <= 0.1 * F.col("span") + 1e-9)
    pick = near.groupBy("tid", "i").agg(F.max(F.struct("box_h", (-F.col("frame")).alias("neg"))).alias("b"))
    return pick.select("tid", (-F.col("b.neg")).alias("frame")).distinct()


def active_probe(t: DataFrame, least: int = 2) -> DataFrame:
    """Median count of six evenly spaced frames of a clip."""
    c = _frame_counts(t).withColumn("i", F.row_number().over(Window.partitionBy("clip").orderBy("frame")) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("clip")))
    s = c.where(F.exists(F.sequence(F.lit(0), F.lit(5)), lambda j: F.floor(j * (F.col("m") - 1) / 5) == F.col("i")))
    return s.groupBy("clip").agg(F.median("n").alias("median_n")).withColumn("active", F.col("median_n") >= least)


def tracklet_arrays(t: DataFrame) -> DataFrame:
    """Tracklet objects: sorted arrays of frames and places per track (bounded per track by its frames), reported as a checksum."""
    g = placed(t).groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("frame", "x", "y"))).alias("obs"))
    return g.select("tid", F.size("obs").alias("n"), F.col("obs")[0]["frame"].alias("f0"), F.element_at("obs", -1)["frame"].alias("f1"), r(F.aggregate("obs", F.lit(0.0), lambda a, o: a + o["x"]), 3).alias("sum_x"))
