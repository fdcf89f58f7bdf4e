"""Evaluation, gates and control-loop operators.

Ground truth is ``gt_detections``; predictions are the rows of the canonical
track view.  An image is a clip and a half-second slot; a prediction is the
most confident row of a track in it.  Null boxes or clips take no part;
repeated detections count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.operators.tracks import EXTENT, _extent, r


def _slot(c: str = "t") -> Column:
    return F.floor(F.col(c) * 2).cast("int")


def predictions(t: DataFrame) -> DataFrame:
    """clip, slot, tid, conf and box of the most confident row per track and slot."""
    p = t.where("t is not null and conf is not null and box_h > 0 and box_w > 0 and fx is not null and fy is not null")
    best = p.groupBy("clip", "cam", _slot().alias("slot"), "tid").agg(F.max(F.struct("conf", (-F.col("frame")).alias("neg"), "fx", "fy", "box_w", "box_h", "zone")).alias("o"))
    o = lambda c: F.col(f"o.{c}")
    return best.select("clip", "cam", "slot", "tid", o("conf").alias("conf"), o("zone").alias("zone"), (o("fx") - o("box_w") / 2).alias("x0"), (o("fy") - o("box_h")).alias("y0"), (o("fx") + o("box_w") / 2).alias("x1"), o("fy").alias("y1"))


def truths(gt: DataFrame, tracklets: DataFrame) -> DataFrame:
    """det_id, clip, slot and box of each labelled detection whose tracklet is known."""
    clip = tracklets.where("tid is not null and source_clip is not null").groupBy(F.col("tid").alias("tracklet_id")).agg(F.min("source_clip").alias("clip"))
    g = gt.where("det_id is not null and t is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    g = g.groupBy("det_id").agg(F.min(F.struct("tracklet_id", "t", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])).alias("o")).select("det_id", "o.*")
    return g.join(clip, "tracklet_id").select("det_id", "clip", _slot().alias("slot"), *[F.col(c).alias(f"g{c}") for c in ("x0", "y0", "x1", "y1")])


def _matched(t: DataFrame, gt: DataFrame, tracklets: DataFrame, least: float) -> DataFrame:
    """Predictions with their best truth (highest IoU only, no second choice) and whether they are the first to claim it."""
    p, g = predictions(t), truths(gt, tracklets)
    j = p.join(g, ["clip", "slot"])
    w = F.greatest(F.lit(0.0), F.least("x1", "gx1") - F.greatest("x0", "gx0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "gy1") - F.greatest("y0", "gy0"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) + (F.col("gx1") - F.col("gx0")) * (F.col("gy1") - F.col("gy0"))
    j = j.withColumn("iou", F.round(F.try_divide(w * h, area - w * h), 6))
    best = j.groupBy("clip", "slot", "tid").agg(F.max(F.struct("iou", (-F.col("det_id")).alias("neg"))).alias("b")).select("clip", "slot", "tid", F.col("b.iou").alias("iou"), (-F.col("b.neg")).alias("det_id"))
    img = g.select("clip", "slot").distinct()
    m = p.join(img, ["clip", "slot"]).join(best, ["clip", "slot", "tid"], "left")
    first = F.row_number().over(Window.partitionBy("det_id").orderBy(F.desc("conf"), "tid", "slot"))
    hit = m.where(f"iou >= {least}").withColumn("k", first).where("k = 1").select("clip", "slot", "tid", F.lit(1).alias("tp"))
    return m.join(hit, ["clip", "slot", "tid"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))


def heldout_eval(t: DataFrame, gt: DataFrame, tracklets: DataFrame, least: float = 0.3) -> DataFrame:
    """Average precision, recall and precision, per camera and overall."""
    m = _matched(t, gt, tracklets, least)
    cams = t.groupBy("clip").agg(F.min("cam").alias("cam"))
    truth = truths(gt, tracklets).join(cams, "clip")
    levels = [(m.withColumn("grp", F.col("cam")), truth.withColumn("grp", F.col("cam"))), (m.withColumn("grp", F.lit("all")), truth.withColumn("grp", F.lit("all")))]
    out = None
    for p, g in levels:
        n = g.groupBy("grp").agg(F.count(F.lit(1)).alias("n_gt"))
        # ranks over score levels, pre-aggregated, so that no group is ranked row by row in one task
        s = p.groupBy("grp", F.round("conf", 3).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum("tp").alias("tp"))
        w = Window.partitionBy("grp").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        c = s.withColumns({"cn": F.sum("n").over(w), "ct": F.sum("tp").over(w)})
        ap = c.groupBy("grp").agg(F.sum(F.col("tp") * F.col("ct") / F.col("cn")).alias("a"), F.sum("tp").alias("tp"), F.sum("n").alias("n"))
        e = n.join(ap, "grp", "left").select("grp", "n_gt", F.coalesce("n", F.lit(0)).alias("n_pred"), r(F.coalesce("a", F.lit(0.0)) / F.col("n_gt"), 5).alias("ap"), r(F.coalesce("tp", F.lit(0)) / F.col("n_gt"), 5).alias("recall"))
        out = e if out is None else out.unionByName(e)
    return out


def average_precision(t: DataFrame, gt: DataFrame, tracklets: DataFrame) -> DataFrame:
    return heldout_eval(t, gt, tracklets).where("grp = 'all'").select("ap", "recall", "n_gt", "n_pred")


def _near(t: DataFrame, gt: DataFrame, tracklets: DataFrame, radius: float = 55.0) -> DataFrame:
    """det_id, conf: the best confidence of a prediction whose foot is near that of the truth in its slot."""
    p = predictions(t).select("clip", "slot", "conf", ((F.col("x0") + F.col("x1")) / 2).alias("px"), F.col("y1").alias("py"))
    dx, dy = (F.col("gx0") + F.col("gx1")) / 2 - F.col("px"), F.col("gy1") - F.col("py")
    j = truths(gt, tracklets).join(p, ["clip", "slot"]).where(dx * dx + dy * dy <= radius * radius)
    return j.groupBy("det_id").agg(F.max("conf").alias("conf"))


def recall_regions(t: DataFrame, gt: DataFrame, tracklets: DataFrame, radius: float = 55.0) -> DataFrame:
    """Recall per image region: truths with a prediction's foot near theirs in the slot."""
    g = truths(gt, tracklets).withColumn("region", F.when(F.col("gy1") < 360, "far").when(F.col("gy1") < 560, "mid").otherwise("near"))
    return g.join(_near(t, gt, tracklets, radius), "det_id", "left").groupBy("region").agg(F.count(F.lit(1)).alias("n_gt"), r(F.avg(F.col("conf").isNotNull().cast("double"))).alias("recall"))


def _recall_by_cam(t: DataFrame, gt: DataFrame, tracklets: DataFrame, confs: dict[str, float]) -> DataFrame:
    """det_id, cam and, per name, whether a prediction of at least that confidence is near."""
    cams = t.groupBy("clip").agg(F.min("cam").alias("cam"))
    j = truths(gt, tracklets).join(cams, "clip").join(_near(t, gt, tracklets), "det_id", "left")
    return j.select("det_id", "cam", *[F.coalesce((F.col("conf") >= c).cast("double"), F.lit(0.0)).alias(n) for n, c in confs.items()])


def regression_gate(t: DataFrame, gt: DataFrame, tracklets: DataFrame, drop: float = 0.05) -> DataFrame:
    """Compare a stricter with the base configuration per camera: keep or roll back."""
    g = _recall_by_cam(t, gt, tracklets, {"base": 0.3, "new": 0.6}).groupBy("cam").agg(F.avg("base").alias("base"), F.avg("new").alias("new"), F.count(F.lit(1)).alias("n"))
    d = F.col("new") - F.col("base")
    return g.select("cam", "n", r("base").alias("base_recall"), r("new").alias("new_recall"), F.when(F.col("n") < 2, "blocked").when(F.round(d, 6) < -drop, "rollback").otherwise("keep").alias("decision"))


def kfold_delta(t: DataFrame, gt: DataFrame, tracklets: DataFrame, folds: int = 5) -> DataFrame:
    """Recall with and without weak detections per deterministic fold (det_id modulo)."""
    j = _recall_by_cam(t, gt, tracklets, {"on": 0.0, "off": 0.5})
    return j.groupBy((F.col("det_id") % folds).alias("fold")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("on") - F.avg("off")).alias("delta"))


def config_search(t: DataFrame, gt: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Recall at each confidence threshold of a small grid, from one histogram of the confidences; no false positives, no ranking."""
    grid = t.sparkSession.range(1, 8).select((F.col("id") / 10).alias("threshold"))
    hits = truths(gt, tracklets).join(_near(t, gt, tracklets), "det_id", "left").groupBy(F.floor(F.coalesce("conf", F.lit(0.0)) * 1000).alias("b")).agg(F.count(F.lit(1)).alias("n"))  # at most 1001 rows
    s = hits.crossJoin(F.broadcast(grid)).groupBy("threshold").agg(F.sum("n").alias("n_gt"), F.sum(F.when(F.col("b") >= F.round(F.col("threshold") * 1000), F.col("n")).otherwise(0)).alias("hit"))
    return s.select("threshold", r(F.col("hit") / F.col("n_gt")).alias("recall"))


def reconcile_median(t: DataFrame) -> DataFrame:
    """Median and sorted list of three counters of players per slot (rows over three thresholds)."""
    n = lambda c: F.count(F.when(F.col("conf") >= c, 1))
    s = t.where("t is not null").groupBy("clip", _slot().alias("slot")).agg(n(0.2).alias("a"), n(0.4).alias("b"), n(0.6).alias("c"))
    a = F.sort_array(F.array("a", "b", "c"))
    return s.select("clip", "slot", a[1].alias("median_n"), F.array_join(a.cast("array<string>"), ",").alias("counts"))


def recall_band(t: DataFrame, gt: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Band of recall when ambiguous truths (small boxes) may be left out, capped at 100."""
    g = truths(gt, tracklets).withColumn("ambiguous", (F.col("gy1") - F.col("gy0") < 60).cast("int"))
    s = g.join(_near(t, gt, tracklets), "det_id", "left").groupBy("clip").agg(F.count(F.lit(1)).alias("h"), F.sum("ambiguous").alias("a"), F.count("conf").alias("c"))
    return s.select("clip", "h", r(F.col("c") * 100 / F.col("h"), 4).alias("lo"), r(F.when(F.col("h") > F.col("a"), F.least(F.lit(100.0), F.col("c") * 100 / (F.col("h") - F.col("a")))), 4).alias("hi"))


# --- identities


def contingency(embeddings: DataFrame) -> DataFrame:
    """True label against a predicted cluster (signs of the first three components)."""
    s = lambda i: (F.get("embedding", F.lit(i)) > 0).cast("int")
    return embeddings.where("label is not null and size(embedding) >= 3").groupBy(F.col("label").cast("int").alias("gt"), (s(0) * 4 + s(1) * 2 + s(2)).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def purity_frag(embeddings: DataFrame) -> DataFrame:
    """Mean and least purity, clusters of more than one identity with a strong minority, fragments per identity."""
    c = contingency(embeddings)
    p = c.groupBy("pred").agg(F.sum("n").alias("n"), F.max("n").alias("m"), F.count(F.lit(1)).alias("ids"))
    a = p.agg(r(F.avg(F.col("m") / F.col("n")), 5).alias("purity_mean"), r(F.min(F.col("m") / F.col("n")), 5).alias("purity_min"), F.sum(((F.col("ids") > 1) & (1 - F.col("m") / F.col("n") > 0.2)).cast("int")).alias("frankenstein"))
    f = c.groupBy("gt").agg(F.count(F.lit(1)).alias("k")).agg(r(F.avg("k"), 5).alias("fragments_per_id"))
    return a.crossJoin(f)  # one row each


def cluster_purity(embeddings: DataFrame) -> DataFrame:
    p = contingency(embeddings).groupBy("pred").agg(F.sum("n").alias("n"), F.max("n").alias("m"))
    return p.agg(F.sum("n").alias("n"), r(F.sum("m") / F.sum("n"), 5).alias("purity"))


def largest_gap(embeddings: DataFrame) -> DataFrame:
    """Per label the threshold in the middle of the largest gap of the first component."""
    e = embeddings.where("label is not null and size(embedding) >= 1").select("label", F.get("embedding", F.lit(0)).cast("double").alias("v"))
    n = e.withColumn("nv", F.lead("v").over(Window.partitionBy("label").orderBy("v"))).where("nv is not null")
    b = n.groupBy("label").agg(F.max(F.struct(F.round(F.col("nv") - F.col("v"), 9).alias("gap"), (-F.col("v")).alias("neg"), ((F.col("v") + F.col("nv")) / 2).alias("cut"))).alias("b"))
    return b.select("label", r("b.gap").alias("gap"), r("b.cut").alias("threshold"))


def selection_weights(t: DataFrame, floor: float = 0.05, gap_weight: float = 0.5) -> DataFrame:
    """Weights for choosing frames: uncertainty and time since the previous frame, scaled to [floor, 1] per clip."""
    f = t.where("conf is not null").groupBy("clip", "frame").agg(F.avg(1 - F.col("conf")).alias("u"))
    w = Window.partitionBy("clip")
    g = f.withColumn("gap", F.coalesce(F.col("frame") - F.lag("frame").over(w.orderBy("frame")), F.lit(0)))
    s = g.withColumn("s", F.col("u") + gap_weight * F.col("gap") / F.greatest(F.max("gap").over(w), F.lit(1)))
    s = s.withColumns({"lo": F.min("s").over(w), "hi": F.max("s").over(w)})
    return s.select("clip", "frame", r(F.when(F.col("hi") > F.col("lo"), floor + (1 - floor) * (F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(1.0)), 5).alias("weight"))


# --- symmetry and scorecard


def _halves(t: DataFrame, bins: int = 8) -> DataFrame:
    """Rows of both halves of each camera's pitch with the far half mirrored: half, bin of depth, bin of width."""
    p = t.where("x is not null and y is not null")
    e = _extent(p).select("cam", *[F.round(c, 6).alias(c) for c in EXTENT])
    j = p.join(e, "cam").where("x between x0 and x1 and y between y0 and y1 and x1 > x0 and y1 > y0")
    u = F.round((F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")), 9)
    side = F.when(u < 0.5, 0).otherwise(1)
    depth = F.when(u < 0.5, u).otherwise(1 - u) * 2
    return j.select("cam", "clip", "frame", "tid", side.alias("half"), F.least(F.floor(depth * bins), F.lit(bins - 1)).cast("int").alias("b"))


def symmetry_jsd(t: DataFrame, bins: int = 8) -> DataFrame:
    """Jensen-Shannon divergence in bits between the mirrored halves."""
    h = _halves(t, bins)
    n = h.groupBy("cam", "b").agg(F.sum((F.col("half") == 0).cast("int")).alias("a"), F.sum((F.col("half") == 1).cast("int")).alias("c"))
    w = Window.partitionBy("cam")
    p = n.withColumns({"p": F.try_divide("a", F.sum("a").over(w)), "q": F.try_divide("c", F.sum("c").over(w))}).where("p is not null and q is not null")
    m = (F.col("p") + F.col("q")) / 2
    kl = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return p.groupBy("cam").agg(r(F.sum((kl("p") + kl("q")) / 2), 5).alias("jsd"))


def zone_deficit(t: DataFrame, bins: int = 4) -> DataFrame:
    """Relative deficit of the far half per depth band (far over near, minus one)."""
    n = _halves(t, bins).groupBy("cam", "b").agg(F.sum((F.col("half") == 0).cast("int")).alias("near_n"), F.sum((F.col("half") == 1).cast("int")).alias("far_n"))
    return n.select("cam", F.col("b").alias("band"), "near_n", "far_n", r(F.when(F.col("near_n") > 0, F.col("far_n") / F.col("near_n") - 1)).alias("deficit"))


def _emd(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Earth mover's distance of the two samples (half 0 and 1) of each group: area between their distribution functions."""
    v = samples.groupBy(by, F.col(value).alias("v")).agg(F.sum((F.col("half") == 0).cast("int")).alias("a"), F.sum((F.col("half") == 1).cast("int")).alias("c"))
    w = Window.partitionBy(by).orderBy("v")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(by)
    d = v.withColumns({"fa": F.try_divide(F.sum("a").over(run), F.sum("a").over(tot)), "fc": F.try_divide(F.sum("c").over(run), F.sum("c").over(tot)), "dv": F.lead("v").over(w) - F.col("v")})
    return d.groupBy(by).agg(r(F.sum(F.abs(F.col("fa") - F.col("fc")) * F.col("dv")), 5).alias("emd")).where("emd is not null")


def count_emd(t: DataFrame) -> DataFrame:
    """Distance of the distributions of players per frame between the halves."""
    c = _halves(t).groupBy("cam", "clip", "frame", "half").agg(F.count(F.lit(1)).alias("n"))
    return _emd(c, "cam", "n")


def speed_emd(t: DataFrame, vmax: float = 12.0) -> DataFrame:
    """Distance of the speed distributions (rounded to 0.01) between the halves."""
    w = Window.partitionBy("tid").orderBy("frame")
    p = t.where("x is not null and y is not null and t is not null")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    s = p.withColumn("dt", F.col("t") - F.lag("t").over(w)).withColumn("d", F.sqrt(dx * dx + dy * dy)).where("dt > 0").select("tid", "frame", F.round(F.col("d") / F.col("dt"), 2).alias("v")).where(F.col("v") <= vmax)
    return _emd(_halves(t).join(s, ["tid", "frame"]), "cam", "v")


def match_scorecard(t: DataFrame) -> DataFrame:
    """Four axes per clip scored 0 to 100, their mean, the limiting one, whether watchable.

    The share of big steps counts each track's first row in its denominator.
    """
    w = Window.partitionBy("tid").orderBy("frame")
    p = t.where("x is not null and y is not null")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    s = p.withColumn("big", (F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)) > 2).cast("double"))
    g = s.groupBy("clip").agg(F.avg("big").alias("jump"), F.avg(F.coalesce("conf", F.lit(0.0))).alias("conf"), F.avg(F.col("in_pitch").cast("double")).alias("inside"), (F.count(F.lit(1)) / F.countDistinct("tid")).alias("len"))
    lin = lambda c, bad, good: F.round(F.least(F.greatest((F.col(c) - bad) / (good - bad), F.lit(0.0)), F.lit(1.0)) * 100, 4)
    a = g.select("clip", lin("jump", 0.2, 0.0).alias("smooth"), lin("conf", 0.2, 0.8).alias("sure"), lin("inside", 0.5, 1.0).alias("inside"), lin("len", 10, 200).alias("length"))
    low = F.least("smooth", "sure", "inside", "length")
    name = F.when(F.col("smooth") == low, "smooth").when(F.col("sure") == low, "sure").when(F.col("inside") == low, "inside").otherwise("length")
    overall = F.round((F.col("smooth") + F.col("sure") + F.col("inside") + F.col("length")) / 4, 6)
    return a.select("*", overall.alias("overall"), name.alias("limiting"), (overall >= 50).alias("watchable"))


# --- heights and scale


def kde_mode(t: DataFrame, m_per_px: float = 0.02, width: float = 0.1) -> DataFrame:
    """Mode of the height density per camera on a fixed grid; heights are binned to a centimetre first."""
    h = t.where("box_h is not null").groupBy("cam", F.round(F.col("box_h") * m_per_px, 2).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    grid = h.withColumn("i", F.explode(F.sequence(F.lit(50), F.lit(300), F.lit(5))))  # 51 points per bin of height
    z = (F.col("i") / 100 - F.col("h")) / width
    d = grid.groupBy("cam", "i").agg(F.round(F.sum(F.col("n") * F.exp(-0.5 * z * z)), 4).alias("d"))
    return d.groupBy("cam").agg(F.max(F.struct("d", (-F.col("i")).alias("neg"))).alias("b")).select("cam", r(-F.col("b.neg") / 100, 4).alias("mode_h"))


def height_mode_scale(t: DataFrame, body: float = 1.75) -> DataFrame:
    """Scale from the mode of heights, with the mean beside it."""
    mean = t.where("box_h is not null").groupBy("cam").agg(F.avg(F.col("box_h") * 0.02).alias("mean_h"))
    return kde_mode(t).join(mean, "cam").select("cam", "mode_h", r("mean_h", 4).alias("mean_h"), r(body / F.col("mode_h"), 4).alias("scale"))


def player_height_scale(t: DataFrame, body: float = 1.75) -> DataFrame:
    """Median height, spread and scale per camera from clean upright boxes."""
    ratio = F.try_divide("box_h", "box_w")
    h = t.where((F.col("conf") > 0.6) & (F.col("box_h") > 50) & (ratio > 1.7) & (ratio < 5) & ~F.col("cropped")).select("cam", (F.col("box_h") * 0.02).alias("h"))
    med = h.groupBy("cam").agg(F.median("h").alias("m"))
    return h.join(med, "cam").groupBy("cam").agg(F.count(F.lit(1)).alias("n"), r(F.first("m"), 4).alias("median_h"), r(F.median(F.abs(F.col("h") - F.col("m"))), 4).alias("mad"), r(F.try_divide(F.stddev_pop("h"), F.avg("h")), 4).alias("cv"), r(body / F.first("m"), 4).alias("scale"))


# --- geometry fits


def tls_fit(t: DataFrame) -> DataFrame:
    """Total least squares line through each track: angle and root mean square residual, from the 2 x 2 covariance."""
    g = t.where("x is not null and y is not null").groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("a"), F.var_pop("y").alias("c"), F.covar_pop("x", "y").alias("b")).where("n >= 3")
    half = (F.col("a") - F.col("c")) / 2
    low = (F.col("a") + F.col("c")) / 2 - F.sqrt(half * half + F.col("b") * F.col("b"))
    return g.select("tid", "n", r(0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c")), 4).alias("angle"), r(F.sqrt(F.greatest(low, F.lit(0.0))), 4).alias("rms"))


def circle_fit(t: DataFrame, least: int = 10) -> DataFrame:
    """Least-squares circle through each track by its normal equations (centred sums)."""
    p = t.where("x is not null and y is not null")
    c = p.groupBy("tid").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    j = p.join(c, "tid").select("tid", "mx", "my", (F.col("x") - F.col("mx")).alias("u"), (F.col("y") - F.col("my")).alias("v"))
    s = lambda e: F.sum(F.expr(e))
    g = j.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), s("u*u").alias("uu"), s("v*v").alias("vv"), s("u*v").alias("uv"), s("u*u*u + u*v*v").alias("ru"), s("v*v*v + v*u*u").alias("rv")).where(F.col("n") >= least)
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    a = (F.col("ru") / 2 * F.col("vv") - F.col("rv") / 2 * F.col("uv")) / det
    b = (F.col("rv") / 2 * F.col("uu") - F.col("ru") / 2 * F.col("uv")) / det
    ok = det > 1e-3 * F.col("uu") * F.col("vv")
    return g.where(ok).select("tid", "n", r(F.col("mx") + a, 2).alias("cx"), r(F.col("my") + b, 2).alias("cy"), r(F.sqrt(a * a + b * b + (F.col("uu") + F.col("vv")) / F.col("n")), 2).alias("radius"))


def nearest_residual(gt: DataFrame, t: DataFrame) -> DataFrame:
    """Distance of each labelled place to the nearest row of its track within half a second."""
    g = gt.where("det_id is not null and px is not null and py is not null and t is not null").select("det_id", F.col("tracklet_id").alias("tid"), F.col("t").alias("gt_t"), "px", "py", F.explode(F.array(_slot() - 1, _slot(), _slot() + 1)).alias("slot")).distinct()
    p = t.where("x is not null and y is not null and t is not null").select("tid", "t", "x", "y", _slot().alias("slot"))
    j = g.join(p, ["tid", "slot"]).where(F.abs(F.col("t") - F.col("gt_t")) <= 0.5)
    d = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    return j.groupBy("det_id").agg(r(F.min(d), 4).alias("residual"))


def reproj_zones(gt: DataFrame, t: DataFrame) -> DataFrame:
    """Median residual per image zone of the labelled detections."""
    n = nearest_residual(gt, t)
    z = gt.where("det_id is not null and y1 is not null").groupBy("det_id").agg(F.min("y1").alias("y1"))
    zone = F.when(F.col("y1") < 360, "far").when(F.col("y1") < 560, "mid").otherwise("near")
    return n.join(z, "det_id").groupBy(zone.alias("zone")).agg(F.count(F.lit(1)).alias("n"), r(F.median("residual"), 4).alias("median_m"))
