"""Joins between tracks: encounters, duplicates, links and affinities.

Pair joins never compare all with all: they are equi-joins on the clip and a
time bucket, with exact predicates after; buckets are as wide as the largest
gap asked for, and one side is given to the next bucket too.  Rows are compared
in their own frame (``framed``), all of them; only the sequential kernels that
need one step after the other use ``coarse``, one row per track and few
frames.  Rows without a place take no part.  Spans of time are in frames of a
clock of 25 a second.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.operators.tracks import by_frame, placed, r, tracklet_summary


def framed(t: DataFrame, width: int = 1) -> DataFrame:
    """Every placed row with its stretch ``g`` of ``width`` frames; a stretch of one is the frame itself."""
    fill = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("conf", "box_h", "box_w")]
    return placed(t).select("clip", "tid", F.floor(F.col("frame") / width).cast("int").alias("g"), "frame", "x", "y", "fx", "fy", *fill, "zone")


def coarse(t: DataFrame, width: int = 5) -> DataFrame:
    """One row per (tid, g): the first placed row of each stretch of ``width`` frames."""
    rows = framed(t, width)
    each = [c for c in rows.columns if c not in ("clip", "tid", "g")]
    return rows.groupBy("clip", "tid", "g").agg(F.min_by(F.struct(*each), "frame").alias("o")).select("clip", "tid", "g", "o.*")


def _d2(a: str = "a", b: str = "b") -> Column:
    dx, dy = F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y")
    return dx * dx + dy * dy


def frame_pairs(c: DataFrame) -> DataFrame:
    """Pairs a.tid < b.tid of rows in the same frame."""
    a, b = c.select("clip", "g", F.struct("tid", "x", "y", "conf", "box_h").alias("a")), c.select("clip", "g", F.struct("tid", "x", "y", "conf", "box_h").alias("b"))
    return a.join(b, ["clip", "g"]).where("a.tid < b.tid")


def encounter_pairs(t: DataFrame, radius: float = 1.5) -> DataFrame:
    p = frame_pairs(framed(t)).where(_d2() < radius * radius)
    return p.groupBy("clip", F.col("a.tid").alias("tid_a"), F.col("b.tid").alias("tid_b")).agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("g0"), F.max("g").alias("g1"))


def encounter_events(t: DataFrame, radius: float = 3.0, gap: int = 25, seam: int = 50) -> DataFrame:
    """Encounters merged over short gaps; a seam risk if a member ends near the last one."""
    c = framed(t)
    p = frame_pairs(c).where(_d2() < radius * radius).select("clip", F.col("a.tid").alias("tid_a"), F.col("b.tid").alias("tid_b"), "g")
    w = Window.partitionBy("clip", "tid_a", "tid_b").orderBy("g")
    n = p.withColumn("new", (F.coalesce(F.col("g") - F.lag("g").over(w), F.lit(10**6)) > gap).cast("int")).withColumn("event", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = n.groupBy("clip", "tid_a", "tid_b", "event").agg(F.min("g").alias("g0"), F.max("g").alias("g1"))
    last = c.groupBy("tid").agg(F.max("g").alias("last_g"))
    j = e.join(last.select(F.col("tid").alias("tid_a"), F.col("last_g").alias("la")), "tid_a").join(last.select(F.col("tid").alias("tid_b"), F.col("last_g").alias("lb")), "tid_b")
    final = F.col("g1") == F.max("g1").over(Window.partitionBy("clip", "tid_a", "tid_b"))
    return j.select("clip", "tid_a", "tid_b", "event", "g0", "g1", (final & (F.least("la", "lb") - F.col("g1") <= seam)).alias("seam_risk"))


def inframe_dedup(t: DataFrame, radius: float = 2.0, clock: Callable[[DataFrame], DataFrame] = coarse) -> DataFrame:
    """Single-hop rule: a row falls to a better one (conf * box_h, then smaller tid)
    within the radius in its step of the clock (``framed``: every row in its own frame)."""
    p = frame_pairs(clock(t)).where(_d2() < radius * radius)
    sa, sb = F.round(F.col("a.conf") * F.col("a.box_h"), 6), F.round(F.col("b.conf") * F.col("b.box_h"), 6)
    return p.select("clip", "g", F.when(sa >= sb, F.col("b.tid")).otherwise(F.col("a.tid")).alias("tid")).distinct()


def tile_antijoin(t: DataFrame, conf: float = 0.3, radius: float = 28.0) -> DataFrame:
    """Weak detections without a strong one near their foot in the same frame."""
    c = framed(t)
    weak, strong = c.where(F.col("conf") < conf).alias("w"), c.where(F.col("conf") >= conf).alias("s")
    near = (F.col("w.fx") - F.col("s.fx")) * (F.col("w.fx") - F.col("s.fx")) + (F.col("w.fy") - F.col("s.fy")) * (F.col("w.fy") - F.col("s.fy")) < radius * radius
    return weak.join(strong, (F.col("w.clip") == F.col("s.clip")) & (F.col("w.g") == F.col("s.g")) & near, "left_anti").select("clip", "g", "tid")


def _focus(c: DataFrame) -> DataFrame:
    return c.groupBy("clip", "g").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count(F.lit(1)).alias("k")).where("k >= 2")


def greedy_owner(t: DataFrame) -> DataFrame:
    """Nearest track to the focus of each frame (ties: smaller tid)."""
    c = framed(t)
    j = c.join(_focus(c), ["clip", "g"]).withColumn("d", F.round(F.sqrt((F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my"))), 6))
    return j.groupBy("clip", "g").agg(F.min(F.struct("d", "tid")).alias("b")).select("clip", "g", F.col("b.tid").alias("owner"), F.col("b.d").alias("d"))


def possession_share(t: DataFrame) -> DataFrame:
    o = greedy_owner(t)
    n = o.groupBy("clip", "owner").agg(F.count(F.lit(1)).alias("n"))
    return n.select("clip", "owner", "n", r(F.col("n") / F.sum("n").over(Window.partitionBy("clip"))).alias("share"))


def _handoffs(t: DataFrame, within: int) -> DataFrame:
    w = Window.partitionBy("clip").orderBy("g")
    return greedy_owner(t).withColumns({"was": F.lag("owner").over(w), "wg": F.lag("g").over(w)}).where(f"was <> owner and g - wg <= {within}")


def _teams(tracklets: DataFrame) -> DataFrame:
    return tracklets.where("tid is not null").groupBy("tid").agg(F.max("team").alias("team"))


def handoff_events(t: DataFrame, tracklets: DataFrame, within: int = 50) -> DataFrame:
    """Change of owner between frames: pass within a team of the tracklets, else turnover; unknown where a team is."""
    team = _teams(tracklets)
    o = _handoffs(t, within).join(team.select(F.col("tid").alias("was"), F.col("team").alias("a")), "was", "left").join(team.select(F.col("tid").alias("owner"), F.col("team").alias("b")), "owner", "left")
    kind = F.when(F.col("a").isNull() | F.col("b").isNull(), "unknown").when(F.col("a") == F.col("b"), "pass").otherwise("turnover")
    return o.select("clip", "g", F.col("was").alias("from_tid"), F.col("owner").alias("to_tid"), kind.alias("kind"))


def transition_matrix(t: DataFrame, within: int = 50) -> DataFrame:
    """Symmetric counts of handoffs between two tracks."""
    h = _handoffs(t, within)
    return h.groupBy("clip", F.least("was", "owner").alias("a"), F.greatest("was", "owner").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def overlap_distance(t: DataFrame, least: int = 5, limit: float = 1e9) -> DataFrame:
    """Median distance of two tracks over their common frames."""
    p = frame_pairs(framed(t)).groupBy("clip", F.col("a.tid").alias("tid_a"), F.col("b.tid").alias("tid_b")).agg(F.count(F.lit(1)).alias("n"), F.median(F.sqrt(_d2())).alias("d"))
    return p.where((F.col("n") >= least) & (F.col("d") <= limit)).select("clip", "tid_a", "tid_b", "n", r("d", 4).alias("median_d"))


def coreg_pairs(t: DataFrame, limit: float = 10.0) -> DataFrame:
    """Mutually nearest rows of two sources (parity of tid) in a frame."""
    c = framed(t)
    a, b = c.where("tid % 2 = 0").select("clip", "g", F.struct("tid", "x", "y").alias("a")), c.where("tid % 2 = 1").select("clip", "g", F.struct("tid", "x", "y").alias("b"))
    p = a.join(b, ["clip", "g"]).withColumn("d", F.round(F.sqrt(_d2()), 6))
    ra = F.row_number().over(Window.partitionBy("clip", "g", "a.tid").orderBy("d", "b.tid"))
    rb = F.row_number().over(Window.partitionBy("clip", "g", "b.tid").orderBy("d", "a.tid"))
    m = p.withColumns({"ra": ra, "rb": rb}).where(f"ra = 1 and rb = 1 and d <= {limit}")
    return m.select("clip", "g", F.col("a.tid").alias("tid_a"), F.col("b.tid").alias("tid_b"), "d")


def _spans(t: DataFrame) -> DataFrame:
    """Life span with first and last place and the end velocity over the last rows."""
    p = placed(t).where("t is not null")
    return p.groupBy("clip", "tid").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("t"), 4).alias("t0"), F.round(F.max("t"), 4).alias("t1"), F.min_by("x", "frame").alias("x0"), F.min_by("y", "frame").alias("y0"), F.max_by("x", "frame").alias("x1"), F.max_by("y", "frame").alias("y1"))


def _followers(s: DataFrame, gap: float) -> DataFrame:
    """Pairs where b begins 0 to ``gap`` seconds after a ends: equi-join on gap-wide buckets, b also in the bucket before."""
    cols = [c for c in s.columns if c != "clip"]
    a = s.select("clip", F.struct(*cols).alias("a"), F.floor(F.col("t1") / gap).cast("long").alias("bucket"))
    b = s.select("clip", F.struct(*cols).alias("b"), F.explode(F.array(F.floor(F.col("t0") / gap).cast("long"), F.floor(F.col("t0") / gap).cast("long") - 1)).alias("bucket"))
    j = a.join(b, ["clip", "bucket"]).where("a.tid <> b.tid").withColumn("gap", F.round(F.col("b.t0") - F.col("a.t1"), 4))
    dx, dy = F.col("b.x0") - F.col("a.x1"), F.col("b.y0") - F.col("a.y1")
    return j.where(f"gap >= 0 and gap <= {gap}").withColumn("dist", F.sqrt(dx * dx + dy * dy))


def link_candidates(t: DataFrame, gap: float = 8.0, vmax: float = 8.0) -> DataFrame:
    """Forward links: b starts after a ends, within the gap and reachable."""
    f = _followers(_spans(t), gap).where(F.col("gap") > 0).withColumn("req", F.round(F.col("dist") / F.col("gap"), 6)).where(F.col("req") <= vmax)
    return f.select("clip", F.col("a.tid").alias("tid_a"), F.col("b.tid").alias("tid_b"), "gap", r("dist", 4).alias("dist"), r("req", 4).alias("req_speed"))


def continuation_candidates(t: DataFrame, gap: float = 8.0, vmax: float = 8.0, limit: float = 10.0) -> DataFrame:
    """Links scored with the velocity of the whole first track: cost = predicted distance + 0.3 gap."""
    s = _spans(t).withColumns({"vx": F.when(F.col("t1") > F.col("t0"), (F.col("x1") - F.col("x0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0), "vy": F.when(F.col("t1") > F.col("t0"), (F.col("y1") - F.col("y0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0)})
    f = _followers(s, gap)
    ex, ey = F.col("b.x0") - F.col("a.x1") - F.col("a.vx") * F.col("gap"), F.col("b.y0") - F.col("a.y1") - F.col("a.vy") * F.col("gap")
    f = f.withColumn("pred", F.round(F.sqrt(ex * ex + ey * ey), 6)).where((F.col("dist") <= vmax * F.greatest("gap", F.lit(0.2))) & (F.col("pred") <= limit))
    return f.select("clip", F.col("a.tid").alias("tid_a"), F.col("b.tid").alias("tid_b"), "gap", r(F.col("pred") + 0.3 * F.col("gap"), 4).alias("cost"))


def gta_edges(t: DataFrame, tracklets: DataFrame, gap: float = 5.0, vmax: float = 7.0, fps: float = 25.0) -> DataFrame:
    """Links between compatible teams (unknown fits all), required speed over at least one frame."""
    team = tracklets.where("tid is not null").groupBy("tid").agg(F.max("team").alias("team"))
    s = _spans(t).join(team, "tid", "left")
    f = _followers(s, gap).withColumn("req", F.round(F.col("dist") / F.greatest("gap", F.lit(1 / fps)), 6))
    ok = F.col("a.team").isNull() | F.col("b.team").isNull() | (F.col("a.team") == F.col("b.team"))
    return f.where(ok & (F.col("req") <= vmax)).select("clip", F.col("a.tid").alias("tid_a"), F.col("b.tid").alias("tid_b"), "gap", r("req", 4).alias("req_speed"))


def knn_prune(t: DataFrame, by_speed: int = 4, by_gap: int = 2) -> DataFrame:
    """Links among the few best of either end, by required speed or by gap."""
    e = link_candidates(t)
    ends = e.select("*", F.explode(F.array("tid_a", "tid_b")).alias("end"))
    k = ends.withColumns({"ks": F.row_number().over(Window.partitionBy("end").orderBy("req_speed", "tid_a", "tid_b")), "kg": F.row_number().over(Window.partitionBy("end").orderBy("gap", "tid_a", "tid_b"))})
    return k.where(f"ks <= {by_speed} or kg <= {by_gap}").select("tid_a", "tid_b").distinct()


def audit_seams(t: DataFrame, margin: float = 0.2) -> DataFrame:
    """For each track's best successor whether the runner-up is too close."""
    e = continuation_candidates(t)
    w = Window.partitionBy("tid_a").orderBy("cost", "tid_b")
    k = e.withColumns({"k": F.row_number().over(w), "second": F.lead("cost").over(w)}).where("k = 1")
    m = F.round(F.col("second") - F.col("cost"), 4)
    return k.select("clip", "tid_a", "tid_b", "cost", m.alias("margin"), F.coalesce(m < margin, F.lit(False)).alias("suspect"))


def crossings(t: DataFrame, near: float = 2.0, apart: float = 3.0) -> DataFrame:
    """Pairs that come close and are apart before and after."""
    d = frame_pairs(framed(t)).select("clip", F.col("a.tid").alias("tid_a"), F.col("b.tid").alias("tid_b"), "g", F.round(F.sqrt(_d2()), 6).alias("d"))
    m = d.groupBy("clip", "tid_a", "tid_b").agg(F.min(F.struct("d", "g")).alias("m")).where(F.col("m.d") <= near)
    j = d.join(m, ["clip", "tid_a", "tid_b"])
    g = j.groupBy("clip", "tid_a", "tid_b").agg(F.first("m.g").alias("g"), F.first("m.d").alias("min_d"), F.max(F.when(F.col("g") < F.col("m.g"), F.col("d"))).alias("before"), F.max(F.when(F.col("g") > F.col("m.g"), F.col("d"))).alias("after"))
    return g.where((F.col("before") > apart) & (F.col("after") > apart)).select("clip", "tid_a", "tid_b", "g", "min_d")


def resolves(t: DataFrame, reach: int = 20, radius: float = 8.0) -> DataFrame:
    """How many other tracks are seen within the radius of each crossing, up to ``reach`` frames away."""
    c = framed(t).select("clip", "tid", "g", "x", "y")
    x = crossings(t).join(c.select("clip", F.col("tid").alias("tid_a"), "g", "x", "y"), ["clip", "tid_a", "g"])
    bucket = lambda g: F.floor(g / reach).cast("int")
    x = x.withColumn("bucket", F.explode(F.array(*[bucket(F.col("g")) + k for k in (-1, 0, 1)])))
    o = c.select("clip", bucket(F.col("g")).alias("bucket"), F.struct("tid", "g", "x", "y").alias("o"))
    near = (F.col("o.x") - F.col("x")) * (F.col("o.x") - F.col("x")) + (F.col("o.y") - F.col("y")) * (F.col("o.y") - F.col("y")) <= radius * radius
    j = x.join(o, ["clip", "bucket"]).where((F.col("o.tid") != F.col("tid_a")) & (F.col("o.tid") != F.col("tid_b")) & (F.abs(F.col("o.g") - F.col("g")) <= reach) & near)
    return j.groupBy("clip", "tid_a", "tid_b").agg(F.countDistinct("o.tid").alias("n_witnesses"))


def comotion_affinity(t: DataFrame, least: int = 5) -> DataFrame:
    """Mean cosine of velocities on common frames; negative affinities count as zero."""
    w = Window.partitionBy("tid").orderBy("g")
    c = framed(t).withColumns({"vx": F.col("x") - F.lag("x").over(w), "vy": F.col("y") - F.lag("y").over(w), "dg": F.col("g") - F.lag("g").over(w)}).where("dg <= 10")
    c = c.withColumn("vn", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))).where("vn > 0")
    a, b = (c.select("clip", "g", F.struct("tid", "vx", "vy", "vn").alias(n)) for n in "ab")
    cos = (F.col("a.vx") * F.col("b.vx") + F.col("a.vy") * F.col("b.vy")) / (F.col("a.vn") * F.col("b.vn"))
    p = a.join(b, ["clip", "g"]).where("a.tid < b.tid").groupBy("clip", F.col("a.tid").alias("tid_a"), F.col("b.tid").alias("tid_b")).agg(F.count(F.lit(1)).alias("n"), F.avg(cos).alias("c"))
    return p.where(F.col("n") >= least).select("clip", "tid_a", "tid_b", "n", r(F.greatest("c", F.lit(0.0)), 5).alias("affinity"))


# --- identities given as labels


def _players(labels: DataFrame) -> DataFrame:
    return labels.where("tid is not null and player_id >= 0").groupBy("tid").agg(F.min("player_id").alias("player_id"))


def label_join(tracklets: DataFrame, labels: DataFrame) -> DataFrame:
    """Player of each tracklet, -1 where unknown; no tracklet is lost."""
    known = tracklets.where("tid is not null").select("tid").distinct()
    return known.join(_players(labels), "tid", "left").select("tid", F.coalesce("player_id", F.lit(-1)).alias("player_id"))


def spurious_anti(t: DataFrame, least: int = 20) -> DataFrame:
    """Rows left after tracks of too few frames are removed."""
    few = t.groupBy("tid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)
    return t.join(few, "tid", "left_anti").groupBy("clip").agg(F.count(F.lit(1)).alias("n"))


def over_merge_check(t: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of one player's tracks that live at the same time in one clip (one row per pair)."""
    s = t.groupBy("clip", "tid").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1")).join(_players(labels), "tid")
    a, b = (s.select("clip", "player_id", F.struct("tid", "f0", "f1").alias(n)) for n in "ab")
    return a.join(b, ["clip", "player_id"]).where("a.tid < b.tid and a.f0 <= b.f1 and b.f0 <= a.f1").select("player_id", F.col("a.tid").alias("tid_a"), F.col("b.tid").alias("tid_b"))


def min_gap_speed(t: DataFrame, labels: DataFrame) -> DataFrame:
    """Between consecutive tracks of a player in a clip: gap and required speed over at least 0.2 s."""
    s = _spans(t).join(_players(labels), "tid")
    w = Window.partitionBy("clip", "player_id").orderBy("t0", "tid")
    n = s.withColumns({"nt": F.lead("tid").over(w), "nt0": F.lead("t0").over(w), "nx": F.lead("x0").over(w), "ny": F.lead("y0").over(w)}).where("nt is not null")
    gap = F.round(F.col("nt0") - F.col("t1"), 4)
    d = F.sqrt((F.col("nx") - F.col("x1")) * (F.col("nx") - F.col("x1")) + (F.col("ny") - F.col("y1")) * (F.col("ny") - F.col("y1")))
    return n.select("clip", "player_id", F.col("tid").alias("tid_a"), F.col("nt").alias("tid_b"), gap.alias("gap_s"), r(d / F.greatest(gap, F.lit(0.2)), 4).alias("speed"))


def player_gaps(t: DataFrame, labels: DataFrame, bridgeable: int = 25) -> DataFrame:
    """Frame gaps between a player's consecutive tracks in a clip, and how many can be bridged."""
    s = t.groupBy("clip", "tid").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1")).join(_players(labels), "tid")
    w = Window.partitionBy("clip", "player_id").orderBy("f0", "tid")
    g = s.withColumn("gap", F.lead("f0").over(w) - F.col("f1")).where("gap > 0")
    return g.groupBy("player_id").agg(F.count(F.lit(1)).alias("n_gaps"), F.sum("gap").alias("total"), F.sum((F.col("gap") <= bridgeable).cast("int")).alias("bridgeable"))


def trim_overlaps(t: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of a player's later tracks in frames an earlier one already has."""
    c = framed(t).join(_players(labels), "tid")
    first = F.min("g").over(Window.partitionBy("tid"))
    k = F.row_number().over(Window.partitionBy("clip", "player_id", "g").orderBy("first_g", "tid"))
    return c.withColumn("first_g", first).withColumn("k", k).where("k > 1").select("player_id", "tid", "g")


# --- embeddings


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_pairs(embeddings: DataFrame, gate: float = 0.65, block: int = 2000) -> DataFrame:
    """Pairs with 1 - cos at most ``gate``, exactly.

    No index prunes such wide gates without losing pairs, so the vectors are
    hashed to blocks of about ``block`` and every pair of blocks is one group
    of bounded size; the work is spread evenly over all of them.
    """
    e = embeddings.where("vec_id is not null and embedding is not null and size(embedding) > 0").select("vec_id", "embedding").withColumn("norm", F.sqrt(_dot("embedding", "embedding"))).where("norm > 0")
    side = max(1, -(-e.count() // block))
    h = F.pmod(F.xxhash64("vec_id"), F.lit(side)).cast("int")
    every = F.sequence(F.lit(0), F.lit(side - 1))
    a = e.select(F.struct("vec_id", "embedding", "norm").alias("a"), h.alias("i"), F.explode(every).alias("j"))
    b = e.select(F.struct("vec_id", "embedding", "norm").alias("b"), F.explode(every).alias("i"), h.alias("j"))
    cos = _dot("a.embedding", "b.embedding") / (F.col("a.norm") * F.col("b.norm"))
    j = a.join(b, ["i", "j"]).where("a.vec_id < b.vec_id").withColumn("d", 1 - cos).where(F.round("d", 9) <= gate)
    return j.select(F.col("a.vec_id").alias("id_a"), F.col("b.vec_id").alias("id_b"), r("d", 5).alias("distance"))


def medoid(embeddings: DataFrame) -> DataFrame:
    """Per label the vector with the largest dot product with the label's sum (so no pairs are formed)."""
    e = embeddings.where("embedding is not null and label is not null").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    s = e.groupBy("label", "i").agg(F.sum(F.col("v").cast("double")).alias("s"))
    d = e.join(s, ["label", "i"]).groupBy("label", "vec_id").agg(F.round(F.sum(F.col("v").cast("double") * F.col("s")), 6).alias("score"))
    return d.groupBy("label").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("neg"))).alias("b")).select("label", (-F.col("b.neg")).alias("vec_id"))


def team_shape(t: DataFrame) -> DataFrame:
    """Width, depth and mean nearest-neighbour distance of the tracks in a frame."""
    c = framed(t)
    p = frame_pairs(c).withColumn("d", F.sqrt(_d2()))
    each = p.select("clip", "g", F.explode(F.array("a.tid", "b.tid")).alias("tid"), "d").groupBy("clip", "g", "tid").agg(F.min("d").alias("nn"))
    nn = each.groupBy("clip", "g").agg(F.avg("nn").alias("nn"))
    g = c.groupBy("clip", "g").agg(F.count(F.lit(1)).alias("k"), (F.max("x") - F.min("x")).alias("depth"), (F.max("y") - F.min("y")).alias("width"))
    return g.where("k >= 2").join(nn, ["clip", "g"]).select("clip", "g", "k", r("depth", 4).alias("depth"), r("width", 4).alias("width"), r("nn", 4).alias("nn_spacing"))
