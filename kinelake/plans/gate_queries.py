"""Queries on gates, projections and small reports."""

from __future__ import annotations

from kinelake.operators import gates as op
from kinelake.plans.evaluation_queries import _BASE, _NEAR, _TGT
from kinelake.plans.pair_queries import _TEAM
from kinelake.plans.registry import Registry

Q = Registry()

Q.on("size_filter", "t", op.size_filter, "SELECT tid, frame FROM t WHERE box_h > 25 AND box_w > 0 AND box_h / box_w >= CAST(1.6 AS DOUBLE)")
Q.on("stitch_motion_gate", "link_edges", op.stitch_motion_gate, """
    SELECT a_tid, b_tid, bool_or(coalesce(gap_s > 0 AND req_speed <= 12, FALSE)) AS passed FROM link_edges WHERE a_tid IS NOT NULL AND b_tid IS NOT NULL GROUP BY a_tid, b_tid""")
Q.on("cross_team_cost", ["link_edges", "tracklets"], op.cross_team_cost, f"""
    WITH {_TEAM} SELECT DISTINCT a_tid, b_tid, CASE WHEN a.team <> b.team THEN CAST('inf' AS DOUBLE) ELSE 0 END AS cost
    FROM link_edges LEFT JOIN team a ON a.tid = a_tid LEFT JOIN team b ON b.tid = b_tid WHERE a_tid IS NOT NULL AND b_tid IS NOT NULL""")
Q.on("vibration_sentinel", "camera_registry", op.vibration_sentinel, """
    SELECT venue_id, count(*) AS n, bool_and(calib_qa.p95_px <= 4) AS steady FROM camera_registry WHERE venue_id IS NOT NULL AND venue_id <> '' AND calib_qa.p95_px IS NOT NULL GROUP BY venue_id""")
Q.on("first_event_gate", ["tracklets", "gt_detections"], op.first_event_gate, """
    WITH c AS (SELECT tid, min(source_clip) AS clip FROM tracklets WHERE tid IS NOT NULL AND source_clip IS NOT NULL GROUP BY tid), f AS (SELECT tracklet_id AS tid, min(t) AS t FROM gt_detections WHERE t IS NOT NULL AND NOT isnan(t) GROUP BY 1)
    SELECT clip, round(min(t), 4) AS event_s, CASE WHEN min(t) IS NULL THEN 'refused' ELSE 'split' END AS decision FROM c LEFT JOIN f USING (tid) GROUP BY clip""")
Q.on("in_pitch_margin", ["t", "camera_registry"], op.in_pitch_margin, """
    SELECT cam, count(*) AS n, sum(CASE WHEN x BETWEEN -2 AND dims_m[1] + 2 AND y BETWEEN -2 AND dims_m[2] + 2 THEN 1 ELSE 0 END) AS n_in
    FROM t JOIN camera_registry ON camera_id = cam WHERE len(dims_m) >= 2 AND x IS NOT NULL AND y IS NOT NULL GROUP BY cam""")

_K1, _K2, _P1, _P2, _K3 = (f"CAST({v} AS DOUBLE)" for v in op.BROWN)
_RAD = f"(1 + q * ({_K1} + q * ({_K2} + q * {_K3})))"
_TX, _TY = f"(2 * {_P1} * ux * uy + {_P2} * (q + 2 * ux * ux))", f"({_P1} * (q + 2 * uy * uy) + 2 * {_P2} * ux * uy)"
_STEPS = "s0 AS (SELECT tid, frame, (fx - 640) / 1100 AS dx, (fy - 360) / 1100 AS dy, (fx - 640) / 1100 AS ux, (fy - 360) / 1100 AS uy FROM t WHERE fx IS NOT NULL AND fy IS NOT NULL)" + "".join(
    f", s{i + 1} AS (SELECT tid, frame, dx, dy, (dx - {_TX}) / {_RAD} AS ux, (dy - {_TY}) / {_RAD} AS uy FROM (SELECT *, ux * ux + uy * uy AS q FROM s{i}))" for i in range(5)
)
Q.on("undistort_points", "t", op.undistort_points, f"WITH {_STEPS} SELECT tid, frame, round(ux * 1100 + 640, 3) AS u, round(uy * 1100 + 360, 3) AS v FROM s5")
_DEN = "(CAST(0.0001 AS DOUBLE) * x + CAST(0.004 AS DOUBLE) * y + 1)"
Q.on("pitch_to_pixel", "t", op.pitch_to_pixel, f"""
    WITH p AS (SELECT tid, frame, ((22 * x - CAST(0.5 AS DOUBLE) * y + 90) / {_DEN} - 640) / 1100 AS ux, ((CAST(-0.3 AS DOUBLE) * x + 12 * y + 130) / {_DEN} - 360) / 1100 AS uy FROM t WHERE x IS NOT NULL AND y IS NOT NULL), s AS (SELECT *, ux * ux + uy * uy AS q FROM p)
    SELECT tid, frame, round((ux * {_RAD} + {_TX}) * 1100 + 640, 3) AS u, round((uy * {_RAD} + {_TY}) * 1100 + 360, 3) AS v FROM s""")
Q.on("order_labels_by_x", ["t", "tracklets"], op.order_labels_by_x, f"""
    WITH {_TEAM}, m AS (SELECT clip, team, round(avg(x), 6) AS mx FROM t JOIN team USING (tid) WHERE team IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL GROUP BY clip, team)
    SELECT clip, team, row_number() OVER (PARTITION BY clip ORDER BY mx, team) - 1 AS ordered FROM m""")
Q.on("align_labels", ["t", "tracklets"], op.align_labels, f"""
    WITH {_TEAM}, p AS (SELECT clip, tid, team, avg(x) AS mx FROM t JOIN team USING (tid) WHERE team IN (0, 1) AND x IS NOT NULL AND y IS NOT NULL GROUP BY clip, tid, team), m AS (SELECT clip, avg(mx) AS mid FROM p GROUP BY clip),
    s AS (SELECT clip, CASE WHEN team = CASE WHEN round(mx, 6) >= round(mid, 6) THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS same FROM p JOIN m USING (clip))
    SELECT clip, sum(same) AS as_is, sum(1 - same) AS flipped, sum(1 - same) > sum(same) AS flip FROM s GROUP BY clip""")
Q.on("map_at_frame", "t", op.map_at_frame, "SELECT clip, tid, round(x, 4) AS x, round(y, 4) AS y FROM t WHERE frame = 100 AND x IS NOT NULL AND y IS NOT NULL")
_HITS = "(SELECT max(conf) FROM pred p WHERE p.clip = truth.clip AND p.slot = truth.slot AND " + _NEAR + ")"
Q.on("recall_summary", _TGT, op.recall_summary, f"""
    WITH {_BASE}, j AS (SELECT det_id, gy1, {_HITS} AS conf FROM truth)
    SELECT count(*) AS n_gt, round(avg(CASE WHEN conf >= CAST(0.6 AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS base, round(avg(CASE WHEN conf >= CAST(0.3 AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS base_tile,
        round(avg(CASE WHEN conf >= CAST(0.3 AS DOUBLE) THEN 1.0 ELSE 0.0 END) FILTER (gy1 < 360), 6) AS far FROM j""")
Q.on("split_frames", "gt_detections", op.split_frames, """
    SELECT camera_id, det_id, CASE WHEN row_number() OVER (PARTITION BY camera_id ORDER BY md5(CAST(det_id AS VARCHAR)), det_id) <= 5 THEN 'dev' ELSE 'test' END AS split
    FROM (SELECT DISTINCT camera_id, det_id FROM gt_detections WHERE det_id IS NOT NULL AND camera_id IS NOT NULL)""")
Q.on("corpus_freshness", ["tracks", "gt_detections"], op.corpus_freshness, """
    WITH i AS (SELECT tid, max(ingested_at) AS i FROM tracks WHERE tid IS NOT NULL GROUP BY tid), o AS (SELECT tracklet_id AS tid, max(labeled_at) AS o FROM gt_detections WHERE tracklet_id IS NOT NULL GROUP BY 1)
    SELECT tid, o >= i AS fresh FROM o JOIN i USING (tid) WHERE i IS NOT NULL AND o IS NOT NULL""")
Q.on("discover_venues", ["match_records", "camera_registry"], op.discover_venues, """
    SELECT venue, min(id) AS id FROM match_records m WHERE venue IS NOT NULL AND id IS NOT NULL AND trim(venue) <> '' AND NOT EXISTS (SELECT 1 FROM camera_registry c WHERE c.venue_name = m.venue) GROUP BY venue""")
Q.on("ema_update", "t", op.ema_update, """
    WITH p AS (SELECT tid, avg(conf) FILTER (frame < 200) AS a, avg(conf) FILTER (frame >= 200) AS b FROM t WHERE conf IS NOT NULL GROUP BY tid)
    SELECT tid, round(coalesce(CAST(0.999 AS DOUBLE) * a + (1 - CAST(0.999 AS DOUBLE)) * b, a, b), 6) AS state FROM p""")
Q.on("calibration_audit", "camera_registry", op.calibration_audit, """
    WITH p AS (SELECT environment, CASE WHEN NOT isnan(calib_qa.median_px) THEN calib_qa.median_px END AS px FROM camera_registry)
    SELECT environment, count(*) AS n, count(px) AS solved, round(quantile_cont(px, 0.5), 4) AS median_px, coalesce(quantile_cont(px, 0.5) > 20, TRUE) AS regressed FROM p GROUP BY environment""")
Q.on("force_reproject", "camera_registry", op.force_reproject, "SELECT camera_id, coalesce(scale_anchor.passed, FALSE) AS force FROM camera_registry WHERE camera_id IS NOT NULL")
Q.on("per_frame_coverage", "t", op.per_frame_coverage, """
    SELECT clip, CAST(floor(t * 2) AS INTEGER) AS slot, CAST(count(DISTINCT CASE WHEN zone = 'far' THEN tid END) AS INTEGER) AS n_far, CAST(count(DISTINCT CASE WHEN zone <> 'far' THEN tid END) AS INTEGER) AS n_rest FROM t WHERE t IS NOT NULL GROUP BY 1, 2""")
Q.on("band_by_zone", "t", op.band_by_zone, """
    SELECT z.zone, (SELECT round(quantile_disc(CAST(round((1 - conf) * 1000) AS INTEGER), 0.5) / 1000, 3) FROM t WHERE t.zone = z.zone AND conf IS NOT NULL) AS median_doubt FROM (SELECT unnest(['far', 'mid', 'near']) AS zone) z""")

QUERIES, SQL = Q.queries, Q.sql
