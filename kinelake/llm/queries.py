"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm.components import group_tracklets
from kinelake.llm.mixing import mix_sources
from kinelake.llm.names import link_venues
from kinelake.llm.nearest import detections_to_tracks
from kinelake.llm.quantiles import percentiles, sketch_columns
from kinelake.llm.subjects import document_subjects, fit_subjects
from kinelake.llm.tokenizer import encode_texts
from kinelake.sources.tables import table

QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    groups = group_tracklets(*(table(spark, d, n) for n in ("tracklets", "link_edges", "connect_labels")))
    return groups.where("n_tids > 1").select("tid", "group_tid")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return group_tracklets(*(table(spark, d, n) for n in ("tracklets", "link_edges", "connect_labels"))).select("tid", "group_tid", "n_tids")


def _daily_sketches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tracks").select("camera_id", "zone", "zone_code", F.to_date("ingested_at").alias("day"), "box_h", "conf")
    return sketch_columns(rows, ["camera_id", "zone", "zone_code", "day"], ["box_h", "conf"])


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per camera, zone and zone code over all days: the daily sketches combine."""
    return percentiles(_daily_sketches(spark, d), ["camera_id", "zone", "zone_code"], QUANTILES)


def p2_by_zone(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(_daily_sketches(spark, d), ["camera_id", "zone"], QUANTILES)


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows behind each estimate; the error bound stays under two percent of them."""
    p = percentiles(_daily_sketches(spark, d), ["camera_id", "zone", "zone_code"], [0.5])
    return p.select("camera_id", "zone", F.col("zone_code").cast("int").alias("zone_code"), "metric", "n", (F.col("max_rank_error") <= 0.02 * F.col("n")).alias("bounded"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return detections_to_tracks(table(spark, d, "gt_detections"), table(spark, d, "tracks")).select("det_id", "tid", "frame")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    links = link_venues(table(spark, d, "match_records"), table(spark, d, "camera_registry"))
    # cameras without a venue count even where their name is exact
    return links.where("kind = 'camera' or not exact").select("kind", "record_key", "venue_id").distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return document_subjects(documents, fit_subjects(table(spark, d, "subject_examples"), documents, table(spark, d, "subject_areas")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Make-up of the corpus: documents and summed shares per subject."""
    return _subjects(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("share").alias("share_sum"))


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_percentiles": p2_percentiles,
    "p2_by_zone": p2_by_zone,
    "p2_counts": p2_counts,
    "p3_found": p3_found,
    "p6_found": p6_found,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
}

_GROUPS = """
        WITH RECURSIVE e AS (
            SELECT CAST(a_tid AS BIGINT) AS u, CAST(b_tid AS BIGINT) AS v FROM link_edges WHERE a_tid IS NOT NULL AND b_tid IS NOT NULL
            UNION SELECT CAST(tid AS BIGINT), 1099511627776 + player_id FROM connect_labels WHERE player_id >= 0 AND tid IS NOT NULL),
        both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
        reach AS (
            SELECT u AS id, u AS at FROM both_ways
            UNION SELECT r.id, b.v FROM reach r JOIN both_ways b ON r.at = b.u),
        known AS (SELECT DISTINCT tid FROM tracklets WHERE tid IS NOT NULL),
        roots AS (SELECT k.tid, coalesce(min(r.at), k.tid) AS root FROM known k LEFT JOIN reach r ON r.id = k.tid GROUP BY k.tid),
        groups AS (SELECT tid, min(tid) OVER (PARTITION BY root) AS group_tid, count(*) OVER (PARTITION BY root) AS n_tids FROM roots)"""

SQL = {
    "p1_found": _GROUPS + " SELECT tid, group_tid FROM groups WHERE n_tids > 1",
    "p1_groups": _GROUPS + " SELECT tid, group_tid, n_tids FROM groups",
    "p2_counts": """
        SELECT camera_id, zone, CAST(zone_code AS INTEGER) AS zone_code, metric, count(*) AS n, TRUE AS bounded
        FROM (SELECT camera_id, zone, zone_code, 'box_h' AS metric, CAST(box_h AS DOUBLE) AS v FROM tracks
              UNION ALL SELECT camera_id, zone, zone_code, 'conf', CAST(conf AS DOUBLE) FROM tracks)
        WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL""",
    "p3_found": """
        WITH r AS (
            SELECT tid, camera_id, frame, CASE WHEN t_sec IS NULL OR abs(CAST(t_sec AS DOUBLE) - frame / fps) > 2 THEN frame / fps ELSE CAST(t_sec AS DOUBLE) END AS t FROM tracks),
        j AS (
            SELECT g.det_id, r.tid, r.frame, r.t, abs(r.t - g.t) AS d FROM gt_detections g JOIN r ON r.tid = g.tracklet_id AND r.camera_id = g.camera_id
            WHERE abs(r.t - g.t) <= 0.2::DOUBLE)
        SELECT det_id, tid, frame FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY d, tid, t, frame) AS k FROM j) WHERE k = 1""",
}
