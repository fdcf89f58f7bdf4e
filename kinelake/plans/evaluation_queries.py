"""Queries on evaluation, gates, symmetry, heights and fits."""

from __future__ import annotations

from kinelake.operators import evaluation as op
from kinelake.plans.registry import Registry

Q = Registry()
_TGT = ["t", "gt_detections", "tracklets"]

_PRED = """pred AS (SELECT clip, cam, slot, tid, conf, zone, fx - box_w / 2 AS x0, fy - box_h AS y0, fx + box_w / 2 AS x1, fy AS y1 FROM (
        SELECT *, CAST(floor(t * 2) AS INTEGER) AS slot, row_number() OVER (PARTITION BY clip, cam, floor(t * 2), tid ORDER BY conf DESC, frame) AS i FROM t
        WHERE t IS NOT NULL AND conf IS NOT NULL AND box_h > 0 AND box_w > 0 AND fx IS NOT NULL AND fy IS NOT NULL) WHERE i = 1)"""
_TRUE = """clips AS (SELECT tid AS tracklet_id, min(source_clip) AS clip FROM tracklets WHERE tid IS NOT NULL AND source_clip IS NOT NULL GROUP BY tid),
    truth AS (SELECT det_id, clip, CAST(floor(t * 2) AS INTEGER) AS slot, CAST(x0 AS DOUBLE) AS gx0, CAST(y0 AS DOUBLE) AS gy0, CAST(x1 AS DOUBLE) AS gx1, CAST(y1 AS DOUBLE) AS gy1 FROM (
        SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY tracklet_id NULLS FIRST, t, x0, y0, x1, y1) AS i FROM gt_detections
        WHERE det_id IS NOT NULL AND t IS NOT NULL AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL) JOIN clips USING (tracklet_id) WHERE i = 1)"""
_BASE = f"{_PRED}, {_TRUE}"
_AP = _BASE + """,
    j AS (SELECT p.clip, p.slot, p.tid, det_id, greatest(0, least(x1, gx1) - greatest(x0, gx0)) * greatest(0, least(y1, gy1) - greatest(y0, gy0)) AS inter, (x1 - x0) * (y1 - y0) + (gx1 - gx0) * (gy1 - gy0) AS area FROM pred p JOIN truth g ON p.clip = g.clip AND p.slot = g.slot),
    best AS (SELECT clip, slot, tid, det_id, iou FROM (SELECT *, row_number() OVER (PARTITION BY clip, slot, tid ORDER BY iou DESC, det_id) AS i FROM (SELECT *, round(inter / (area - inter), 6) AS iou FROM j)) WHERE i = 1),
    m AS (SELECT p.*, b.det_id, b.iou FROM pred p SEMI JOIN truth g ON p.clip = g.clip AND p.slot = g.slot LEFT JOIN best b ON b.clip = p.clip AND b.slot = p.slot AND b.tid = p.tid),
    hit AS (SELECT *, CASE WHEN iou >= CAST(0.3 AS DOUBLE) AND row_number() OVER (PARTITION BY det_id, iou >= CAST(0.3 AS DOUBLE) ORDER BY conf DESC, tid, slot) = 1 THEN 1 ELSE 0 END AS tp FROM m),
    cams AS (SELECT clip, min(cam) AS cam FROM t GROUP BY clip),
    pg AS (SELECT cam AS grp, conf, tp FROM hit UNION ALL SELECT 'all', conf, tp FROM hit),
    gg AS (SELECT cam AS grp FROM truth JOIN cams USING (clip) UNION ALL SELECT 'all' FROM truth JOIN cams USING (clip)),
    n AS (SELECT grp, count(*) AS n_gt FROM gg GROUP BY grp),
    s AS (SELECT grp, round(conf, 3) AS score, count(*) AS n, sum(tp) AS tp FROM pg GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ct FROM s WINDOW w AS (PARTITION BY grp ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    ap AS (SELECT grp, sum(tp * ct / cn) AS a, sum(tp) AS tp, sum(n) AS n FROM c GROUP BY grp),
    res AS (SELECT grp, n_gt, coalesce(n, 0) AS n_pred, round(coalesce(a, 0) / n_gt, 5) AS ap, round(coalesce(tp, 0) / n_gt, 5) AS recall FROM n LEFT JOIN ap USING (grp))"""
Q.on("heldout_eval", _TGT, op.heldout_eval, f"WITH {_AP} SELECT * FROM res")
Q.on("average_precision", _TGT, op.average_precision, f"WITH {_AP} SELECT ap, recall, n_gt, n_pred FROM res WHERE grp = 'all'")
Q.on("recall_regions", _TGT, op.recall_regions, f"""WITH {_BASE}, g AS (SELECT *, CASE WHEN gy1 < 360 THEN 'far' WHEN gy1 < 560 THEN 'mid' ELSE 'near' END AS region FROM truth)
    SELECT region, count(*) AS n_gt, round(avg(CASE WHEN EXISTS (SELECT 1 FROM pred p WHERE p.clip = g.clip AND p.slot = g.slot AND ((gx0 + gx1) / 2 - (x0 + x1) / 2) * ((gx0 + gx1) / 2 - (x0 + x1) / 2) + (gy1 - y1) * (gy1 - y1) <= 3025) THEN 1.0 ELSE 0.0 END), 6) AS recall FROM g GROUP BY region""")
_NEAR = "((gx0 + gx1) / 2 - (x0 + x1) / 2) * ((gx0 + gx1) / 2 - (x0 + x1) / 2) + (gy1 - y1) * (gy1 - y1) <= 3025"
_HIT = "(SELECT det_id, cam, CASE WHEN EXISTS (SELECT 1 FROM pred p WHERE p.clip = g.clip AND p.slot = g.slot AND p.conf >= CAST({c} AS DOUBLE) AND " + _NEAR + ") THEN 1.0 ELSE 0.0 END AS hit FROM truth g JOIN cams USING (clip))"
_CAMS = "cams AS (SELECT clip, min(cam) AS cam FROM t GROUP BY clip)"
Q.on("regression_gate", _TGT, op.regression_gate, f"""WITH {_BASE}, {_CAMS}, b AS (SELECT cam, avg(hit) AS base, count(*) AS n FROM {_HIT.format(c=0.3)} GROUP BY cam), w AS (SELECT cam, avg(hit) AS new FROM {_HIT.format(c=0.6)} GROUP BY cam)
    SELECT cam, n, round(base, 6) AS base_recall, round(new, 6) AS new_recall, CASE WHEN n < 2 THEN 'blocked' WHEN round(new - base, 6) < CAST(-0.05 AS DOUBLE) THEN 'rollback' ELSE 'keep' END AS decision FROM b JOIN w USING (cam)""")
Q.on("kfold_delta", _TGT, op.kfold_delta, f"""WITH {_BASE}, {_CAMS}, a AS (SELECT det_id, hit AS h1 FROM {_HIT.format(c=0.0)}), b AS (SELECT det_id, hit AS h0 FROM {_HIT.format(c=0.5)})
    SELECT det_id % 5 AS fold, count(*) AS n, round(avg(h1) - avg(h0), 6) AS delta FROM a JOIN b USING (det_id) GROUP BY 1""")
Q.on("config_search", _TGT, op.config_search, f"""WITH {_BASE}, top AS (SELECT det_id, max(conf) AS top FROM truth g JOIN pred p ON p.clip = g.clip AND p.slot = g.slot AND {_NEAR} GROUP BY det_id),
    h AS (SELECT floor(coalesce(top, 0) * 1000) AS b FROM truth LEFT JOIN top USING (det_id)), grid AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) / 10 AS threshold)
    SELECT threshold, round(avg(CASE WHEN b >= round(threshold * 1000) THEN 1.0 ELSE 0.0 END), 6) AS recall FROM h, grid GROUP BY threshold""")
Q.on("reconcile_median", "t", op.reconcile_median, """
    WITH s AS (SELECT clip, CAST(floor(t * 2) AS INTEGER) AS slot, count(*) FILTER (conf >= CAST(0.2 AS DOUBLE)) AS a, count(*) FILTER (conf >= CAST(0.4 AS DOUBLE)) AS b, count(*) FILTER (conf >= CAST(0.6 AS DOUBLE)) AS c FROM t WHERE t IS NOT NULL GROUP BY 1, 2)
    SELECT clip, slot, b AS median_n, c || ',' || b || ',' || a AS counts FROM s""")
Q.on("recall_band", _TGT, op.recall_band, f"""WITH {_BASE}, g AS (SELECT clip, CASE WHEN gy1 - gy0 < 60 THEN 1 ELSE 0 END AS amb, CASE WHEN EXISTS (SELECT 1 FROM pred p WHERE p.clip = truth.clip AND p.slot = truth.slot AND {_NEAR}) THEN 1 ELSE 0 END AS hit FROM truth),
    s AS (SELECT clip, count(*) AS h, sum(amb) AS a, sum(hit) AS c FROM g GROUP BY clip)
    SELECT clip, h, round(c * 100 / h, 4) AS lo, round(CASE WHEN h > a THEN least(100, c * 100 / (h - a)) END, 4) AS hi FROM s""")
_CT = "ct AS (SELECT CAST(label AS INTEGER) AS gt, CAST(embedding[1] > 0 AS INTEGER) * 4 + CAST(embedding[2] > 0 AS INTEGER) * 2 + CAST(embedding[3] > 0 AS INTEGER) AS pred, count(*) AS n FROM embeddings WHERE label IS NOT NULL AND len(embedding) >= 3 GROUP BY 1, 2)"
Q.on("contingency", "embeddings", op.contingency, f"WITH {_CT} SELECT * FROM ct")
Q.on("purity_frag", "embeddings", op.purity_frag, f"""WITH {_CT}, p AS (SELECT pred, sum(n) AS n, max(n) AS m, count(*) AS ids FROM ct GROUP BY pred)
    SELECT round(avg(m / n), 5) AS purity_mean, round(min(m / n), 5) AS purity_min, sum(CASE WHEN ids > 1 AND 1 - m / n > CAST(0.2 AS DOUBLE) THEN 1 ELSE 0 END) AS frankenstein,
        (SELECT round(avg(k), 5) FROM (SELECT count(*) AS k FROM ct GROUP BY gt)) AS fragments_per_id FROM p""")
Q.on("cluster_purity", "embeddings", op.cluster_purity, f"WITH {_CT}, p AS (SELECT pred, sum(n) AS n, max(n) AS m FROM ct GROUP BY pred) SELECT sum(n) AS n, round(sum(m) / sum(n), 5) AS purity FROM p")
Q.on("largest_gap", "embeddings", op.largest_gap, """
    WITH e AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) >= 1), n AS (SELECT *, lead(v) OVER (PARTITION BY label ORDER BY v) AS nv FROM e)
    SELECT label, round(nv - v, 6) AS gap, round((v + nv) / 2, 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(nv - v, 9) DESC, v) AS k FROM n WHERE nv IS NOT NULL) WHERE k = 1""")
Q.on("selection_weights", "t", op.selection_weights, """
    WITH f AS (SELECT clip, frame, avg(1 - conf) AS u FROM t WHERE conf IS NOT NULL GROUP BY clip, frame), g AS (SELECT *, coalesce(frame - lag(frame) OVER (PARTITION BY clip ORDER BY frame), 0) AS gap FROM f),
    s AS (SELECT *, u + 0.5 * gap / greatest(max(gap) OVER (PARTITION BY clip), 1) AS s FROM g), b AS (SELECT *, min(s) OVER (PARTITION BY clip) AS lo, max(s) OVER (PARTITION BY clip) AS hi FROM s)
    SELECT clip, frame, round(CASE WHEN hi > lo THEN CAST(0.05 AS DOUBLE) + CAST(0.95 AS DOUBLE) * (s - lo) / (hi - lo) ELSE 1 END, 5) AS weight FROM b""")
_HALF = """p AS (SELECT * FROM t WHERE x IS NOT NULL AND y IS NOT NULL),
    e AS (SELECT cam, round(quantile_cont(x, 0.005), 6) AS x0, round(quantile_cont(x, 0.995), 6) AS x1, round(quantile_cont(y, 0.005), 6) AS y0, round(quantile_cont(y, 0.995), 6) AS y1 FROM p GROUP BY cam),
    u AS (SELECT p.*, round((x - x0) / (x1 - x0), 9) AS u FROM p JOIN e USING (cam) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND x1 > x0 AND y1 > y0),
    h AS (SELECT cam, clip, frame, tid, CASE WHEN u < 0.5 THEN 0 ELSE 1 END AS half, CAST(least(floor(CASE WHEN u < 0.5 THEN u ELSE 1 - u END * 2 * {b}), {b} - 1) AS INTEGER) AS b FROM u)"""
_HB = "n AS (SELECT cam, b, sum(CASE WHEN half = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN half = 1 THEN 1 ELSE 0 END) AS c FROM h GROUP BY cam, b)"
Q.on("symmetry_jsd", "t", op.symmetry_jsd, f"""WITH {_HALF.format(b=8)}, {_HB}, q AS (SELECT *, a / nullif(sum(a) OVER (PARTITION BY cam), 0) AS pp, c / nullif(sum(c) OVER (PARTITION BY cam), 0) AS qq FROM n)
    SELECT cam, round(sum((CASE WHEN pp > 0 THEN pp * log2(pp / ((pp + qq) / 2)) ELSE 0 END + CASE WHEN qq > 0 THEN qq * log2(qq / ((pp + qq) / 2)) ELSE 0 END) / 2), 5) AS jsd FROM q WHERE pp IS NOT NULL AND qq IS NOT NULL GROUP BY cam""")
Q.on("zone_deficit", "t", op.zone_deficit, f"WITH {_HALF.format(b=4)}, {_HB} SELECT cam, b AS band, a AS near_n, c AS far_n, round(CASE WHEN a > 0 THEN c / a - 1 END, 6) AS deficit FROM n")
_EMD = """v AS (SELECT cam, v, sum(CASE WHEN half = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN half = 1 THEN 1 ELSE 0 END) AS c FROM samples GROUP BY cam, v),
    d AS (SELECT cam, sum(a) OVER w / nullif(sum(a) OVER (PARTITION BY cam), 0) AS fa, sum(c) OVER w / nullif(sum(c) OVER (PARTITION BY cam), 0) AS fc, lead(v) OVER (PARTITION BY cam ORDER BY v) - v AS dv FROM v WINDOW w AS (PARTITION BY cam ORDER BY v ROWS UNBOUNDED PRECEDING))
    SELECT cam, round(sum(abs(fa - fc) * dv), 5) AS emd FROM d GROUP BY cam HAVING sum(abs(fa - fc) * dv) IS NOT NULL"""
Q.on("count_emd", "t", op.count_emd, f"WITH {_HALF.format(b=8)}, samples AS (SELECT cam, half, count(*) AS v FROM h GROUP BY cam, clip, frame, half), {_EMD}")
Q.on("speed_emd", "t", op.speed_emd, f"""WITH {_HALF.format(b=8)}, s AS (SELECT tid, frame, t - lag(t) OVER w AS dt, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d FROM p WHERE t IS NOT NULL WINDOW w AS (PARTITION BY tid ORDER BY frame)),
    samples AS (SELECT cam, half, round(d / dt, 2) AS v FROM h JOIN s USING (tid, frame) WHERE dt > 0 AND round(d / dt, 2) <= 12), {_EMD}""")
_LIN = "round(least(greatest(({c} - {b}) / CAST({d} AS DOUBLE), 0), 1) * 100, 4)"
Q.on("match_scorecard", "t", op.match_scorecard, f"""
    WITH s AS (SELECT *, CASE WHEN coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) > 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS big FROM t WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY tid ORDER BY frame)),
    g AS (SELECT clip, avg(big) AS jump, avg(coalesce(conf, 0)) AS conf, avg(CASE WHEN in_pitch THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ins, count(*) / count(DISTINCT tid) AS len FROM s GROUP BY clip),
    a AS (SELECT clip, {_LIN.format(c='jump', b='CAST(0.2 AS DOUBLE)', d='-0.2')} AS smooth, round(least(greatest((conf - CAST(0.2 AS DOUBLE)) / (CAST(0.8 AS DOUBLE) - CAST(0.2 AS DOUBLE)), 0), 1) * 100, 4) AS sure, {_LIN.format(c='ins', b='0.5', d='0.5')} AS inside, {_LIN.format(c='len', b='10', d='190')} AS length FROM g)
    SELECT *, round((smooth + sure + inside + length) / 4, 6) AS overall, CASE least(smooth, sure, inside, length) WHEN smooth THEN 'smooth' WHEN sure THEN 'sure' WHEN inside THEN 'inside' ELSE 'length' END AS limiting,
        round((smooth + sure + inside + length) / 4, 6) >= 50 AS watchable FROM a""")
_KDE = """hb AS (SELECT cam, round(box_h * CAST(0.02 AS DOUBLE), 2) AS h, count(*) AS n FROM t WHERE box_h IS NOT NULL GROUP BY 1, 2), gi AS (SELECT unnest(generate_series(50, 300, 5)) AS i),
    kd AS (SELECT cam, i, round(sum(n * exp(-0.5 * ((i / 100 - h) / CAST(0.1 AS DOUBLE)) * ((i / 100 - h) / CAST(0.1 AS DOUBLE)))), 4) AS d FROM hb, gi GROUP BY cam, i),
    mode AS (SELECT cam, round(i / 100, 4) AS mode_h FROM (SELECT *, row_number() OVER (PARTITION BY cam ORDER BY d DESC, i) AS k FROM kd) WHERE k = 1)"""
Q.on("kde_mode", "t", op.kde_mode, f"WITH {_KDE} SELECT * FROM mode")
Q.on("height_mode_scale", "t", op.height_mode_scale, f"WITH {_KDE}, m AS (SELECT cam, avg(box_h * CAST(0.02 AS DOUBLE)) AS mean_h FROM t WHERE box_h IS NOT NULL GROUP BY cam) SELECT cam, mode_h, round(mean_h, 4) AS mean_h, round(CAST(1.75 AS DOUBLE) / mode_h, 4) AS scale FROM mode JOIN m USING (cam)")
Q.on("player_height_scale", "t", op.player_height_scale, """
    WITH h AS (SELECT cam, box_h * CAST(0.02 AS DOUBLE) AS h FROM t WHERE conf > CAST(0.6 AS DOUBLE) AND box_h > 50 AND box_h / box_w > CAST(1.7 AS DOUBLE) AND box_h / box_w < 5 AND NOT cropped), m AS (SELECT cam, quantile_cont(h, 0.5) AS m FROM h GROUP BY cam)
    SELECT cam, count(*) AS n, round(any_value(m), 4) AS median_h, round(quantile_cont(abs(h - m), 0.5), 4) AS mad, round(stddev_pop(h) / avg(h), 4) AS cv, round(CAST(1.75 AS DOUBLE) / any_value(m), 4) AS scale FROM h JOIN m USING (cam) GROUP BY cam""")
Q.on("tls_fit", "t", op.tls_fit, """
    WITH g AS (SELECT tid, count(*) AS n, var_pop(x) AS a, var_pop(y) AS c, covar_pop(x, y) AS b FROM t WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY tid HAVING count(*) >= 3)
    SELECT tid, n, round(0.5 * atan2(2 * b, a - c), 4) AS angle, round(sqrt(greatest((a + c) / 2 - sqrt((a - c) / 2 * (a - c) / 2 + b * b), 0)), 4) AS rms FROM g""")
Q.on("circle_fit", "t", op.circle_fit, """
    WITH p AS (SELECT tid, x, y, avg(x) OVER (PARTITION BY tid) AS mx, avg(y) OVER (PARTITION BY tid) AS my FROM t WHERE x IS NOT NULL AND y IS NOT NULL), j AS (SELECT tid, mx, my, x - mx AS u, y - my AS v FROM p),
    g AS (SELECT tid, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv, sum(u*u*u + u*v*v) AS ru, sum(v*v*v + v*u*u) AS rv FROM j GROUP BY tid HAVING count(*) >= 10),
    s AS (SELECT *, (ru / 2 * vv - rv / 2 * uv) / (uu * vv - uv * uv) AS a, (rv / 2 * uu - ru / 2 * uv) / (uu * vv - uv * uv) AS b FROM g WHERE uu * vv - uv * uv > 1e-3 * uu * vv)
    SELECT tid, n, round(mx + a, 2) AS cx, round(my + b, 2) AS cy, round(sqrt(a * a + b * b + (uu + vv) / n), 2) AS radius FROM s""")
_RES = """res AS (SELECT det_id, round(min(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 4) AS residual FROM (SELECT * FROM gt_detections WHERE det_id IS NOT NULL AND px IS NOT NULL AND py IS NOT NULL AND t IS NOT NULL) g
        JOIN t ON t.tid = g.tracklet_id AND t.x IS NOT NULL AND t.y IS NOT NULL AND abs(t.t - g.t) <= 0.5 GROUP BY det_id)"""
Q.on("nearest_residual", ["gt_detections", "t"], op.nearest_residual, f"WITH {_RES} SELECT * FROM res")
Q.on("reproj_zones", ["gt_detections", "t"], op.reproj_zones, f"""WITH {_RES}, z AS (SELECT det_id, min(y1) AS y1 FROM gt_detections WHERE det_id IS NOT NULL AND y1 IS NOT NULL GROUP BY det_id)
    SELECT CASE WHEN y1 < 360 THEN 'far' WHEN y1 < 560 THEN 'mid' ELSE 'near' END AS zone, count(*) AS n, round(quantile_cont(residual, 0.5), 4) AS median_m FROM res JOIN z USING (det_id) GROUP BY 1""")

QUERIES, SQL = Q.queries, Q.sql
