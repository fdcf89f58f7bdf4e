"""Catalog and registry operators: match records, cameras, gates, samples, exports.

Blank strings count as missing; unparsable numbers become null; rows without
their key are left out; of repeated keys the latest scan wins.  Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.operators.tracks import r


def blank_null(c: str) -> Column:
    return F.when(F.trim(F.col(c)) != "", F.col(c))


def latest_matches(m: DataFrame) -> DataFrame:
    """One row per match id: the latest scan, then the most views."""
    w = Window.partitionBy("id").orderBy(F.desc("scanned_at"), F.desc("views"), "venue")
    return m.where("id is not null").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def normalize_text(m: DataFrame) -> DataFrame:
    """Venue keys: trimmed lower case, single spaces, without trailing dots; and a slug of plain letters."""
    k = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.translate("venue", "İ", "i")), r"\s+", " ")), r"[.…]+$", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.translate("venue", "ıİşŞğĞüÜöÖçÇ", "iissgguuoocc")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return latest_matches(m).where("venue is not null").select("id", k.alias("venue_key"), slug.alias("slug"))


def url_parse(m: DataFrame) -> DataFrame:
    """Facility token, folder, start stamp, pitch code and camera number of a clip address."""
    rx = r"/([a-z]+\d+)s(\d+)/([a-z]+)/(\d{14})\.([A-Za-z]?\d+)-(\d+)\."
    g = lambda i: F.nullif(F.regexp_extract("first_url", rx, i), F.lit(""))
    return latest_matches(m).where("first_url is not null").select("id", g(1).alias("facility"), g(2).alias("server"), g(4).alias("stamp"), g(5).alias("pitch_code"), F.coalesce(g(6).cast("int"), F.lit(1)).alias("cam"))


def classify_rules(c: DataFrame) -> DataFrame:
    """Indoor or outdoor by the pitch code's letter, else by words of the venue name, else unknown; with source and confidence."""
    code, name = F.upper("saha_code"), F.lower("venue_name")
    indoor, outdoor = F.coalesce(code.startswith("K"), F.lit(False)), F.coalesce(code.startswith("A"), F.lit(False))
    word_in, word_out = F.coalesce(name.contains("kapalı"), F.lit(False)), F.coalesce(name.contains("açık"), F.lit(False))
    env = F.when(indoor, "indoor").when(outdoor, "outdoor").when(word_in, "indoor").when(word_out, "outdoor").otherwise("unknown")
    src = F.when(indoor | outdoor, "code").when(word_in | word_out, "name").otherwise("none")
    conf = F.when(indoor | outdoor, 0.9).when(word_in | word_out, 0.6).otherwise(0.0)
    return c.where("camera_id is not null").select("camera_id", env.alias("environment"), src.alias("source"), conf.alias("confidence"))


def parse_dates(m: DataFrame) -> DataFrame:
    """Mixed date forms to one: year-month-day or day.month.year."""
    iso = F.regexp_extract("date", r"^(\d{4})-(\d{2})-(\d{2})", 0)
    dmy = F.regexp_extract("date", r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$", 0)
    part = lambda i: F.lpad(F.regexp_extract("date", r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$", i), 2, "0")
    year = F.regexp_extract("date", r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$", 3)
    d = F.when(iso != "", iso).when(dmy != "", F.concat_ws("-", year, part(2), part(1)))
    return latest_matches(m).select("id", d.alias("day"))


def normalize_row(m: DataFrame) -> DataFrame:
    """Lenient catalog row: blanks to null, counts parsed through double, unknown venues to null."""
    venue = F.when(F.trim("venue").isin("-", "?", "bilinmiyor", "unknown", ""), None).otherwise(F.trim("venue"))
    return latest_matches(m).select("id", venue.alias("venue"), F.expr("try_cast(try_cast(n_cams as double) as int)").alias("n_cams"), F.coalesce("views", F.lit(0)).cast("bigint").alias("views"), blank_null("title").alias("title"))


def by_venue(m: DataFrame) -> DataFrame:
    """Matches, views and most cameras per normalised venue."""
    n = normalize_row(m).where("venue is not null").withColumn("venue_key", F.lower(F.translate(F.regexp_replace("venue", r"\s+", " "), "İ", "i")))
    return n.groupBy("venue_key").agg(F.count(F.lit(1)).alias("n"), F.sum("views").alias("views"), F.max("n_cams").alias("max_cams"))


def stratified_sample(m: DataFrame, venues: int = 20, per_venue: int = 3) -> DataFrame:
    """Round-robin over the largest venues, best matches first (a sampling operator)."""
    n = normalize_row(m).where("venue is not null").withColumn("venue_key", F.lower(F.translate(F.regexp_replace("venue", r"\s+", " "), "İ", "i")))
    top = n.groupBy("venue_key").agg(F.count(F.lit(1)).alias("c"), F.max("n_cams").alias("mc"), F.max("views").alias("mv")).orderBy(F.desc("c"), F.desc_nulls_last("mc"), F.desc("mv"), "venue_key").limit(venues)
    ranked = top.withColumn("venue_rank", F.row_number().over(Window.orderBy(F.desc("c"), F.desc_nulls_last("mc"), F.desc("mv"), "venue_key")))  # at most `venues` rows
    within = F.row_number().over(Window.partitionBy("venue_key").orderBy(F.desc_nulls_last("n_cams"), F.desc("views"), "id"))
    j = n.join(ranked.select("venue_key", "venue_rank"), "venue_key").withColumn("round", within).where(F.col("round") <= per_venue)
    return j.select("id", "venue_key", "round", "venue_rank")


def venue_split(m: DataFrame) -> DataFrame:
    """Whole venues to train or validation by a stable rule: the smallest yields validate until a fifth of the venues does."""
    v = by_venue(m).select("venue_key", "n")
    total = v.agg(F.count(F.lit(1)).alias("total"))
    small = v.withColumn("b", F.least("n", F.lit(1000)))
    # ranks by (n, key) over pre-aggregated size classes would do at scale; venues are a dimension
    k = small.withColumn("k", F.row_number().over(Window.orderBy("b", "venue_key"))).crossJoin(total)
    return k.select("venue_key", "n", F.when(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("total") / 5)), "val").otherwise("train").alias("split"))


def alias_lookup(m: DataFrame, c: DataFrame) -> DataFrame:
    """Camera venue whose name, else alias, equals the typed venue exactly; names go before aliases."""
    v = c.where("venue_id is not null and trim(venue_id) <> ''")
    names = v.select("venue_id", F.col("venue_name").alias("n"), F.lit(0).alias("prio")).unionByName(v.select("venue_id", F.explode("aliases").alias("n"), F.lit(1).alias("prio"))).where("n is not null")
    best = names.groupBy("n").agg(F.min(F.struct("prio", "venue_id")).alias("b"))
    return latest_matches(m).join(best, F.col("venue") == F.col("n")).select("id", F.col("b.venue_id").alias("venue_id"), F.when(F.col("b.prio") == 0, "name").otherwise("alias").alias("by"))


def calib_gate(c: DataFrame, worst: float = 20.0, least: int = 6) -> DataFrame:
    """Fail-closed gate on calibration quality, with all reasons."""
    q = F.col("calib_qa.median_px")
    bad = F.isnan(F.coalesce(q, F.lit(0.0)))
    reasons = F.concat_ws(",", F.when(F.col("calib_qa").isNull(), "missing_qa"), F.when(F.col("calib_qa").isNotNull() & (q.isNull() | bad), "no_median"), F.when(~bad & (q > worst), "median_px"), F.when(F.col("calib_qa.n_landmarks") < least, "landmarks"))
    return c.where("camera_id is not null").select("camera_id", reasons.alias("reasons"), (reasons == "").alias("accepted"))


def attach_calibration(c: DataFrame) -> DataFrame:
    """Stricter registry gate and status: linked, rejected or missing."""
    q = F.col("calib_qa.median_px")
    ok = F.col("calib_qa").isNotNull() & q.isNotNull() & ~F.isnan(F.coalesce(q, F.lit(0.0))) & (q <= 15) & (F.coalesce("calib_qa.n_landmarks", F.lit(0)) >= 6)
    return c.where("camera_id is not null").select("camera_id", F.when(F.col("calib_path").isNull() | (F.trim("calib_path") == ""), "missing").when(ok, "linked").otherwise("rejected").alias("status"))


def median_only_gate(c: DataFrame) -> DataFrame:
    """Third gate: only a median above 20 rejects; NaN and missing pass."""
    q = F.col("calib_qa.median_px")
    return c.where("camera_id is not null").select("camera_id", (~F.coalesce((q > 20) & ~F.isnan(q), F.lit(False))).alias("accepted"))


def scale_state(c: DataFrame) -> DataFrame:
    """Unit and quality of a camera's scale."""
    a = F.col("scale_anchor")
    return c.where("camera_id is not null").select("camera_id", F.when(a.isNull(), "relative").when(F.coalesce(a["passed"], F.lit(False)), "exact").otherwise("approx").alias("quality"), F.when(a.isNull(), "relative_m").when(F.coalesce(a["passed"], F.lit(False)), "m").otherwise("m (approx)").alias("unit"))


def dims_precedence(c: DataFrame) -> DataFrame:
    """Rank of the source of the pitch size and whether metric claims are allowed."""
    rank = F.when(F.col("dims_source") == "published", 4).when((F.col("dims_source") == "satellite_measured") & (F.col("covered") == "open"), 3).when(F.col("dims_source") == "physical_pacing", 2).when(F.size(F.coalesce("dims_m", F.array().cast("array<double>"))) == 2, 1).otherwise(0)
    claim = (F.coalesce("dims_confidence", F.lit(0.0)) >= 0.6) & F.coalesce(F.col("scale_anchor.passed"), F.lit(False))
    return c.where("camera_id is not null").select("camera_id", rank.alias("dims_rank"), claim.alias("claim_allowed"))


def field_format(c: DataFrame) -> DataFrame:
    """Nearest of three pitch formats by aspect, and the catalog size snapped to, smaller format on ties."""
    fmt = [("5v5", 40.0, 20.0), ("7v7", 55.0, 35.0), ("8v8", 68.0, 45.0)]
    a = F.try_divide(F.get("dims_m", F.lit(0)), F.get("dims_m", F.lit(1)))
    options = F.array(*[F.struct(F.round(F.abs(a - l / w), 9).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, l, w) in enumerate(fmt)])
    return c.where("camera_id is not null and size(dims_m) = 2 and dims_m[1] > 0").select("camera_id", r(a).alias("aspect"), F.array_min(options)["name"].alias("format"))


def impossible_catalog(c: DataFrame) -> DataFrame:
    """Pitch sizes that cannot be: ratio or bounds, with reasons."""
    l, w = F.get("dims_m", F.lit(0)), F.get("dims_m", F.lit(1))
    why = F.concat_ws(",", F.when(l < w, "turned"), F.when(F.try_divide(l, w) > 2.2, "too_long"), F.when((l < 20) | (l > 110), "length"), F.when((w < 12) | (w > 75), "width"))
    return c.where("camera_id is not null and size(dims_m) = 2 and dims_m[1] > 0").select("camera_id", why.alias("reasons"), (why != "").alias("impossible"))


def registry_rank(c: DataFrame, top: int = 50) -> DataFrame:
    """Cameras worth calibrating: weighted score of metric claims, coverage, views and quality (a top-k report)."""
    v = F.least(F.coalesce("views_total", F.lit(0)) / 5000, F.lit(1.0))
    cov = F.coalesce("frame_coverage.covered_fraction_est", F.lit(0.0))
    q = F.least(F.greatest((20 - F.coalesce("calib_qa.median_px", F.lit(20.0))) / 20, F.lit(0.0)), F.lit(1.0))
    s = F.when(F.coalesce("available", F.lit(False)), 0.35 * F.coalesce("metric_claim_allowed", F.lit(False)).cast("double") + 0.2 * cov + 0.2 * v + 0.15 * q).otherwise(0.0)
    return c.where("camera_id is not null").select("camera_id", r(s).alias("score")).orderBy(F.desc("score"), "camera_id").limit(top)


def registry_build(c: DataFrame) -> DataFrame:
    """Cameras, views and most cameras per facility and pitch code."""
    return c.where("facility_token is not null").groupBy("facility_token", "saha_code").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("views_total", F.lit(0))).alias("views"), F.max("n_cams").alias("max_cams"))


def registry_upsert(c: DataFrame, t: DataFrame) -> DataFrame:
    """Registry joined with the cameras seen in the tracks: known values are protected, new cameras added."""
    seen = t.groupBy(F.col("cam").alias("camera_id")).agg(F.count(F.lit(1)).alias("seen_rows"))
    old = c.where("camera_id is not null").select("camera_id", "calib_status", "sample_count")
    j = old.join(seen, "camera_id", "full_outer")
    return j.select("camera_id", F.coalesce("calib_status", F.lit("new")).alias("calib_status"), (F.coalesce("sample_count", F.lit(0)) + F.coalesce("seen_rows", F.lit(0))).alias("samples"))


def best_verdict(c: DataFrame) -> DataFrame:
    """Best of a venue's verdicts by rank GOOD, DECENT, ROUGH, BAD, UNSOLVABLE from the calibration's median."""
    q = F.col("calib_qa.median_px")
    v = F.when(q.isNull(), "UNSOLVABLE").when(q <= 6, "GOOD").when(q <= 10, "DECENT").when(q <= 15, "ROUGH").otherwise("BAD")
    rank = F.when(v == "GOOD", 0).when(v == "DECENT", 1).when(v == "ROUGH", 2).when(v == "BAD", 3).otherwise(4)
    g = c.where("venue_id is not null and trim(venue_id) <> ''").groupBy("venue_id").agg(F.min(F.struct(rank.alias("k"), v.alias("v"))).alias("b"), F.count(F.lit(1)).alias("n"))
    return g.select("venue_id", F.col("b.v").alias("verdict"), "n")


def resolve_candidate(c: DataFrame) -> DataFrame:
    """Per venue the first camera, in preference order, that covers at least 0.9 of the pitch; else the best one."""
    f = F.coalesce("frame_coverage.covered_fraction_est", F.lit(0.0))
    g = c.where("venue_id is not null and trim(venue_id) <> '' and camera_id is not null").select("venue_id", "camera_id", F.coalesce("cam_index", F.lit(999)).alias("i"), f.alias("f"))
    k = F.row_number().over(Window.partitionBy("venue_id").orderBy((F.col("f") < 0.9).cast("int"), F.when(F.col("f") >= 0.9, F.col("i")), F.desc("f"), "i", "camera_id"))
    return g.withColumn("k", k).where("k = 1").select("venue_id", "camera_id", (F.col("f") >= 0.9).alias("sufficient"))


def bit_distance(m: DataFrame) -> DataFrame:
    """Hamming distance of 64-bit hashes of consecutive matches of a venue, and whether they differ enough to keep (consecutive rule)."""
    h = latest_matches(m).where("venue is not null").select("venue", "id", (F.col("id").cast("bigint") * F.lit(2654435761) % F.lit(4294967296)).alias("h"))
    w = Window.partitionBy("venue").orderBy("id")
    d = h.withColumn("ph", F.lag("h").over(w)).where("ph is not null").withColumn("dist", F.bit_count(F.col("h").bitwiseXOR(F.col("ph"))))
    return d.select("id", "dist", (F.col("dist") > 10).alias("keep"))


def coco_export(t: DataFrame, every: int = 50) -> DataFrame:
    """Annotation rows with dense image ids for every 50th frame (a stride of the export format), boxes clamped to the frame."""
    b = t.where(f"frame % {every} = 0 and box_h > 0 and box_w > 0 and fx is not null and fy is not null")
    img = F.dense_rank().over(Window.partitionBy("clip").orderBy("frame"))
    inside = lambda c, hi: F.least(F.greatest(c, F.lit(0.0)), F.lit(hi))
    x1, y1 = inside(F.col("fx") - F.col("box_w") / 2, 1280.0), inside(F.col("fy") - F.col("box_h"), 720.0)
    x2, y2 = inside(F.col("fx") + F.col("box_w") / 2, 1280.0), inside(F.col("fy"), 720.0)
    return b.select("clip", img.alias("image_id"), "tid", r(x1, 3).alias("bbox_x"), r(y1, 3).alias("bbox_y"), r(x2 - x1, 3).alias("bbox_w"), r(y2 - y1, 3).alias("bbox_h"), r((x2 - x1) * (y2 - y1), 2).alias("area"))


def page_extract(d: DataFrame) -> DataFrame:
    """Clock stamps, headings and emphasised words counted in the markup of a text."""
    n = lambda rx: F.regexp_count("text", F.lit(rx))
    return d.where("text is not null and text <> ''").select("doc_id", n(r"\[[0-9]{2}:[0-9]{2}\]").alias("stamps"), n(r"## [0-9]").alias("headings"), n(r"<p>").alias("paragraphs"), F.nullif(F.regexp_extract("text", r"\[([0-9]{2}:[0-9]{2})\]", 1), F.lit("")).alias("first_stamp"))


def ledger_summary(e: DataFrame) -> DataFrame:
    """Append-only events as a ledger: counts per decision and the latest value."""
    dec = F.when(F.col("event_type") == "error", "rollback").when(F.col("event_type") == "purchase", "keep").otherwise("observe")
    return e.groupBy(dec.alias("decision")).agg(F.count(F.lit(1)).alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"), F.countDistinct("user_id").alias("users"))


def tumbling_parity(e: DataFrame) -> DataFrame:
    """Tumbling hourly counts and distinct users (batch form of the streaming query)."""
    return e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")).select(F.unix_seconds("w.start").alias("start_s"), "n", "users", (F.col("n") % 2 == 1).alias("odd"))


def sliding_median(e: DataFrame) -> DataFrame:
    """Sliding six-hour median value, hopping by two hours."""
    return e.groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), r(F.median("value")).alias("median_value")).select(F.unix_seconds("w.start").alias("start_s"), "n", "median_value")


def user_sessions(e: DataFrame) -> DataFrame:
    """Sessions of a user with holes of at most six hours."""
    return e.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")
