"""Gates, projections with lens distortion, and small reports over catalog, labels and links.

Everything is a row expression, a map-side aggregation or an equi-join; tables
of cameras are dimension tables and joined as Spark measures them.  Null
measures never pass a gate; empty tables give empty results, single-row
reports a row of nulls or zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.operators.evaluation import _near, truths
from kinelake.operators.pairs import _teams
from kinelake.operators.tracks import placed, r

#: Focal length and centre of the image, distortion k1, k2, p1, p2, k3 used where a camera has no calibration of its own.
FOCAL, CENTRE_X, CENTRE_Y = 1100.0, 640.0, 360.0
BROWN = (-0.12, 0.03, 0.001, -0.0005, 0.0)
#: Pitch to image homography, row by row.
H_PITCH = (22.0, -0.5, 90.0, -0.3, 12.0, 130.0, 0.0001, 0.004, 1.0)


def size_filter(t: DataFrame, tall: float = 25.0, upright: float = 1.6) -> DataFrame:
    """Rows with boxes tall and upright enough for a person; ball-like ones fall."""
    return t.where((F.col("box_h") > tall) & (F.col("box_w") > 0) & (F.col("box_h") / F.col("box_w") >= upright)).select("tid", "frame")


def stitch_motion_gate(link_edges: DataFrame, vmax: float = 12.0) -> DataFrame:
    """Links with a positive gap and a speed a person can run; unknown measures fail."""
    ok = (F.col("gap_s") > 0) & (F.col("req_speed") <= vmax)
    return link_edges.where("a_tid is not null and b_tid is not null").groupBy("a_tid", "b_tid").agg(F.max(F.coalesce(ok, F.lit(False))).alias("passed"))


def cross_team_cost(link_edges: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Links between tracks of two known, different teams cost infinity, all others nothing."""
    team = _teams(tracklets)
    e = link_edges.where("a_tid is not null and b_tid is not null").select("a_tid", "b_tid").distinct()
    j = e.join(team.select(F.col("tid").alias("a_tid"), F.col("team").alias("ta")), "a_tid", "left").join(team.select(F.col("tid").alias("b_tid"), F.col("team").alias("tb")), "b_tid", "left")
    return j.select("a_tid", "b_tid", F.when(F.col("ta") != F.col("tb"), F.lit(float("inf"))).otherwise(0.0).alias("cost"))


def vibration_sentinel(cameras: DataFrame, limit: float = 4.0) -> DataFrame:
    """Per venue whether every known residual of its cameras is within the limit."""
    q = cameras.where("venue_id is not null and venue_id <> '' and calib_qa.p95_px is not null")
    return q.groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("calib_qa.p95_px") <= limit).alias("steady"))


def first_event_gate(tracklets: DataFrame, gt: DataFrame) -> DataFrame:
    """Per clip the time of its first labelled event; a split is refused where none is known."""
    clips = tracklets.where("tid is not null and source_clip is not null").groupBy("tid").agg(F.min("source_clip").alias("clip"))
    first = gt.where("t is not null and not isnan(t)").groupBy(F.col("tracklet_id").alias("tid")).agg(F.min("t").alias("t"))
    g = clips.join(first, "tid", "left").groupBy("clip").agg(F.min("t").alias("event_s"))
    return g.select("clip", r("event_s", 4).alias("event_s"), F.when(F.col("event_s").isNull(), "refused").otherwise("split").alias("decision"))


def in_pitch_margin(t: DataFrame, cameras: DataFrame, margin: float = 2.0) -> DataFrame:
    """Per camera with known dimensions: placed rows, and those inside its pitch and the margin."""
    dims = cameras.where("size(dims_m) >= 2").select(F.col("camera_id").alias("cam"), F.col("dims_m")[0].alias("length"), F.col("dims_m")[1].alias("width"))
    j = placed(t).join(dims, "cam")
    inside = F.col("x").between(-margin, F.col("length") + margin) & F.col("y").between(-margin, F.col("width") + margin)
    return j.groupBy("cam").agg(F.count(F.lit(1)).alias("n"), F.sum(inside.cast("long")).alias("n_in"))


def _distort(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Radial factor and the two tangential offsets of normalised image coordinates."""
    k1, k2, p1, p2, k3 = BROWN
    q = x * x + y * y
    return 1 + q * (k1 + q * (k2 + q * k3)), 2 * p1 * x * y + p2 * (q + 2 * x * x), p1 * (q + 2 * y * y) + 2 * p2 * x * y


def undistort_points(t: DataFrame, rounds: int = 5) -> DataFrame:
    """Feet in the undistorted image: fixed-point inverse of the radial and tangential lens model."""
    q = t.where("fx is not null and fy is not null").select("tid", "frame", ((F.col("fx") - CENTRE_X) / FOCAL).alias("dx"), ((F.col("fy") - CENTRE_Y) / FOCAL).alias("dy"))
    q = q.withColumns({"ux": F.col("dx"), "uy": F.col("dy")})
    for _ in range(rounds):
        k, tx, ty = _distort(F.col("ux"), F.col("uy"))
        q = q.select("tid", "frame", "dx", "dy", ((F.col("dx") - tx) / k).alias("ux"), ((F.col("dy") - ty) / k).alias("uy"))
    return q.select("tid", "frame", r(F.col("ux") * FOCAL + CENTRE_X, 3).alias("u"), r(F.col("uy") * FOCAL + CENTRE_Y, 3).alias("v"))


def pitch_to_pixel(t: DataFrame) -> DataFrame:
    """Places projected into the distorted image: homography, then the lens model."""
    h = H_PITCH
    den = h[6] * F.col("x") + h[7] * F.col("y") + h[8]
    q = placed(t).select("tid", "frame", (((h[0] * F.col("x") + h[1] * F.col("y") + h[2]) / den - CENTRE_X) / FOCAL).alias("ux"), (((h[3] * F.col("x") + h[4] * F.col("y") + h[5]) / den - CENTRE_Y) / FOCAL).alias("uy"))
    k, tx, ty = _distort(F.col("ux"), F.col("uy"))
    return q.select("tid", "frame", r((F.col("ux") * k + tx) * FOCAL + CENTRE_X, 3).alias("u"), r((F.col("uy") * k + ty) * FOCAL + CENTRE_Y, 3).alias("v"))


def order_labels_by_x(t: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Teams of a clip renamed so that the one with the smaller mean x is 0."""
    m = placed(t).join(_teams(tracklets).where("team is not null"), "tid").groupBy("clip", "team").agg(F.round(F.avg("x"), 6).alias("mx"))
    return m.select("clip", "team", (F.row_number().over(Window.partitionBy("clip").orderBy("mx", "team")) - 1).alias("ordered"))


def align_labels(t: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Per clip whether its teams agree better with the halves of its tracks as they are or flipped."""
    p = placed(t).groupBy("clip", "tid").agg(F.avg("x").alias("mx")).join(_teams(tracklets).where("team in (0, 1)"), "tid")
    mid = p.groupBy("clip").agg(F.avg("mx").alias("mid"))
    same = (F.col("team") == (F.round("mx", 6) >= F.round("mid", 6)).cast("int")).cast("long")
    g = p.join(mid, "clip").groupBy("clip").agg(F.sum(same).alias("as_is"), F.sum(1 - same).alias("flipped"))
    return g.select("clip", "as_is", "flipped", (F.col("flipped") > F.col("as_is")).alias("flip"))


def map_at_frame(t: DataFrame, frame: int = 100) -> DataFrame:
    """Places of all tracks in one frame."""
    return placed(t).where(F.col("frame") == frame).select("clip", "tid", r("x", 4).alias("x"), r("y", 4).alias("y"))


def recall_summary(t: DataFrame, gt: DataFrame, tracklets: DataFrame, base: float = 0.6, tile: float = 0.3) -> DataFrame:
    """One row: recall of the base detections, of base and weak ones together, and of the far labels; null without labels."""
    g = truths(gt, tracklets).join(_near(t, gt, tracklets), "det_id", "left")
    hit = lambda c: F.coalesce((F.col("conf") >= c).cast("double"), F.lit(0.0))
    return g.agg(F.count(F.lit(1)).alias("n_gt"), r(F.avg(hit(base))).alias("base"), r(F.avg(hit(tile))).alias("base_tile"), r(F.avg(F.when(F.col("gy1") < 360, hit(tile)))).alias("far"))


def split_frames(gt: DataFrame, n_dev: int = 5) -> DataFrame:
    """Per camera ``n_dev`` labelled detections for development, the rest for tests, in a hash order that does not depend on the engine."""
    d = gt.where("det_id is not null and camera_id is not null").select("camera_id", "det_id").distinct()
    k = F.row_number().over(Window.partitionBy("camera_id").orderBy(F.md5(F.col("det_id").cast("string")), "det_id"))
    return d.select("camera_id", "det_id", F.when(k <= n_dev, "dev").otherwise("test").alias("split"))


def corpus_freshness(tracks: DataFrame, gt: DataFrame) -> DataFrame:
    """Per track whether its labels are at least as new as its newest row."""
    new = tracks.where("tid is not null").groupBy("tid").agg(F.max("ingested_at").alias("i"))
    done = gt.where("tracklet_id is not null").groupBy(F.col("tracklet_id").alias("tid")).agg(F.max("labeled_at").alias("o"))
    return done.join(new, "tid").where("i is not null and o is not null").select("tid", (F.col("o") >= F.col("i")).alias("fresh"))


def discover_venues(matches: DataFrame, cameras: DataFrame) -> DataFrame:
    """First match of every venue, as typed, that the registry has no name for."""
    known = cameras.where("venue_name is not null").select(F.col("venue_name").alias("venue")).distinct()
    return matches.where("venue is not null and id is not null and trim(venue) <> ''").join(known, "venue", "left_anti").groupBy("venue").agg(F.min("id").alias("id"))


def ema_update(t: DataFrame, decay: float = 0.999, cut_frame: int = 200) -> DataFrame:
    """Per track the mean confidence of its early rows moved towards that of its later ones; a side that is missing leaves the other."""
    part = t.where("conf is not null").groupBy("tid").agg(F.avg(F.when(F.col("frame") < cut_frame, F.col("conf"))).alias("a"), F.avg(F.when(F.col("frame") >= cut_frame, F.col("conf"))).alias("b"))
    return part.select("tid", r(F.coalesce(decay * F.col("a") + (1 - decay) * F.col("b"), "a", "b")).alias("state"))


def calibration_audit(cameras: DataFrame, limit: float = 20.0) -> DataFrame:
    """Per environment: cameras, those with a fit, its median, and whether that regressed beyond the limit."""
    px = F.when(~F.isnan("calib_qa.median_px"), F.col("calib_qa.median_px"))
    g = cameras.groupBy("environment").agg(F.count(F.lit(1)).alias("n"), F.count(px).alias("solved"), F.percentile(px, F.lit(0.5)).alias("m"))
    return g.select("environment", "n", "solved", r("m", 4).alias("median_px"), F.coalesce(F.col("m") > limit, F.lit(True)).alias("regressed"))


def force_reproject(cameras: DataFrame) -> DataFrame:
    """Cameras whose scale is anchored: their stored places must not be used."""
    return cameras.where("camera_id is not null").select("camera_id", F.coalesce(F.col("scale_anchor.passed"), F.lit(False)).alias("force"))


def per_frame_coverage(t: DataFrame) -> DataFrame:
    """Reconciled counts per clip and half second as whole numbers: far rows and the rest."""
    s = t.where("t is not null").withColumn("slot", F.floor(F.col("t") * 2).cast("int"))
    return s.groupBy("clip", "slot").agg(F.countDistinct(F.when(F.col("zone") == "far", F.col("tid"))).cast("int").alias("n_far"), F.countDistinct(F.when(F.col("zone") != "far", F.col("tid"))).cast("int").alias("n_rest"))


def band_by_zone(t: DataFrame, zones: tuple[str, ...] = ("far", "mid", "near")) -> DataFrame:
    """Median detection doubt (1 - conf) per zone over counts of its thousandths; a zone without rows has null."""
    n = t.where("conf is not null").groupBy("zone", F.round((1 - F.col("conf")) * 1000).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("zone")
    cum = n.withColumns({"upto": F.sum("n").over(w.orderBy("b")), "total": F.sum("n").over(w)})  # at most 1001 counts per zone
    m = cum.where("2 * upto >= total").groupBy("zone").agg(F.min("b").alias("b"))
    every = t.sparkSession.createDataFrame([(z,) for z in zones], "zone string")
    return every.join(m, "zone", "left").select("zone", r(F.col("b") / 1000, 3).alias("median_doubt"))
