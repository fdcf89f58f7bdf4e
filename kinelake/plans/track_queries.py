"""Queries on the canonical track view: scans, geometry, gates, frame and track aggregates."""

from __future__ import annotations

from kinelake.operators import tracks as op
from kinelake.plans.registry import Registry

Q = Registry()

_H = "(1.0 + 0.00001 * fx + 0.0004 * fy)"
_X = "(0.05 * {u} + 0.002 * {v} - 4.0) / (0.00001 * {u} + 0.0004 * {v} + 1.0)"
_Y = "(0.001 * {u} + 0.09 * {v} - 12.0) / (0.00001 * {u} + 0.0004 * {v} + 1.0)"
_CLEAN_X = _X.format(u="fx", v="fy")
_CLEAN_Y = _Y.format(u="fx", v="fy")

Q.on("infer_fps", "t", op.infer_fps, """
    WITH s AS (SELECT clip, t - lag(t) OVER w AS dt, frame - lag(frame) OVER w AS df FROM t WHERE t IS NOT NULL WINDOW w AS (PARTITION BY tid ORDER BY frame))
    SELECT clip, round(1 / quantile_cont(dt / df, 0.5), 4) AS fps FROM s WHERE df > 0 AND dt > 0 GROUP BY clip""")
Q.on("detections_to_rows", "t", op.detections_to_rows, """
    SELECT tid, frame, round(fx, 6) AS foot_x, round(fy, 6) AS foot_y, fy >= 718 AS bottom_cropped,
        CASE WHEN fy < 360 THEN 'far' WHEN fy < 560 THEN 'mid' ELSE 'near' END AS zone
    FROM t WHERE box_h > 0 AND box_w > 0 AND box_h / box_w >= 1.3""")
Q.on("far_band", "t", op.far_band, """
    WITH s AS (SELECT cam, quantile_cont(fy, 0.01) AS a, quantile_cont(fy, 0.4) AS b, max(fy) - min(fy) AS span FROM t WHERE fy IS NOT NULL GROUP BY cam)
    SELECT cam, CAST(floor(a - CAST(0.04 AS DOUBLE) * span) AS INTEGER) AS lo, CAST(ceil(b + CAST(0.04 AS DOUBLE) * span) AS INTEGER) AS hi FROM s""")
Q.on("zone_fixed", "t", op.zone_fixed, """
    SELECT cam, CASE WHEN fy < 360 THEN 'far' WHEN fy < 560 THEN 'mid' ELSE 'near' END AS zone_fixed, count(*) AS n FROM t WHERE fy IS NOT NULL GROUP BY 1, 2""")
Q.on("zone_tercile", "t", op.zone_tercile, """
    WITH p AS (SELECT * FROM t WHERE x IS NOT NULL AND y IS NOT NULL),
    c AS (SELECT cam, quantile_cont(y, 1.0 / 3) AS a, quantile_cont(y, 2.0 / 3) AS b FROM p GROUP BY cam)
    SELECT cam, CASE WHEN y < a THEN 0 WHEN y < b THEN 1 ELSE 2 END AS zone_tercile, count(*) AS n FROM p JOIN c USING (cam) GROUP BY 1, 2""")
Q.on("zone_range", "t", op.zone_range, """
    WITH c AS (SELECT cam, min(fy) AS a, max(fy) AS b FROM t WHERE fy IS NOT NULL GROUP BY cam)
    SELECT cam, CAST(least(2, floor(3 * (fy - a) / greatest(b - a, 1e-9))) AS INTEGER) AS zone_range, count(*) AS n FROM t JOIN c USING (cam) WHERE fy IS NOT NULL GROUP BY 1, 2""")
Q.on("project_homography", "t", op.project_homography, f"""
    SELECT tid, frame, round({_CLEAN_X}, 6) AS px, round({_CLEAN_Y}, 6) AS py FROM t WHERE fx IS NOT NULL AND fy IS NOT NULL""")
Q.on("undistort_division", "t", op.undistort_division, """
    WITH d AS (SELECT tid, frame, fx - 640 AS dx, fy - 360 AS dy FROM t WHERE fx IS NOT NULL AND fy IS NOT NULL),
    f AS (SELECT *, 1 - 1e-7 * (dx * dx + dy * dy) + 1e-14 * (dx * dx + dy * dy) * (dx * dx + dy * dy) AS f FROM d)
    SELECT tid, frame, round(640 + dx * f, 6) AS ux, round(360 + dy * f, 6) AS uy FROM f""")
Q.on("shared_frame", "t", op.shared_frame, "SELECT tid, frame, round(50 - x, 6) AS sx, round(30 - y, 6) AS sy FROM t WHERE x IS NOT NULL AND y IS NOT NULL")
Q.on("confidence_weight", "t", op.confidence_weight, """
    SELECT tid, frame, round(CASE WHEN cropped OR NOT in_pitch THEN 0 ELSE
        least(greatest(conf / CAST(0.7 AS DOUBLE), 0), 1) * least(greatest(box_h / 90, CAST(0.2 AS DOUBLE)), 1) / (1 + CAST(0.36 AS DOUBLE)) END, 6) AS w_conf
    FROM t WHERE conf IS NOT NULL AND box_h IS NOT NULL""")
Q.on("camera_reliability", "t", op.camera_reliability, """
    SELECT tid, frame, round(1 / (1 + ((x - 25) * (x - 25) + (y + 5) * (y + 5)) / 484), 6) AS reliability FROM t WHERE x IS NOT NULL AND y IS NOT NULL""")
Q.on("reconstruct_bbox", "t", op.reconstruct_bbox, """
    SELECT tid, frame, round(least(greatest(fx - box_w / 2, 0), 1280), 6) AS x1, round(least(greatest(fy - box_h, 0), 720), 6) AS y1,
        round(least(greatest(fx + box_w / 2, 0), 1280), 6) AS x2, round(least(greatest(fy, 0), 720), 6) AS y2
    FROM t WHERE box_h IS NOT NULL AND box_w IS NOT NULL AND fx IS NOT NULL AND fy IS NOT NULL""")
Q.on("out_distance", "t", op.out_distance, """
    SELECT tid, frame, round(sqrt(greatest(-x, x - 50, 0) * greatest(-x, x - 50, 0) + greatest(-y, y - 30, 0) * greatest(-y, y - 30, 0)), 6) AS out_dist,
        46 * (y - 1) - 1 * (x - 2) >= -1e-6 AND -2 * (y - 2) - 26 * (x - 48) >= -1e-6 AND -43 * (y - 28) + 1 * (x - 46) >= -1e-6 AND -1 * (y - 27) + 26 * (x - 3) >= -1e-6 AS inside_quad
    FROM t WHERE x IS NOT NULL AND y IS NOT NULL""")
Q.on("reflect_tracks", "t", op.reflect, "SELECT tid, frame, round(50 - x, 6) AS x, round(y, 6) AS y FROM t WHERE x IS NOT NULL AND y IS NOT NULL")
Q.on("local_jacobian", "t", op.local_jacobian, f"""
    WITH p AS (SELECT tid, frame, {_CLEAN_X} AS x0, {_CLEAN_Y} AS y0, {_X.format(u='(fx + 1)', v='fy')} AS x1, {_Y.format(u='(fx + 1)', v='fy')} AS y1,
        {_X.format(u='fx', v='(fy + 1)')} AS x2, {_Y.format(u='fx', v='(fy + 1)')} AS y2 FROM t WHERE fx IS NOT NULL AND fy IS NOT NULL)
    SELECT tid, frame, round(0.5 * (sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) + sqrt((x2 - x0) * (x2 - x0) + (y2 - y0) * (y2 - y0))), 6) AS m_per_px FROM p""")
Q.on("qc_columns", "t", op.qc_columns, """
    SELECT cam, count(*) AS n, sum(CASE WHEN coalesce(conf, 0) < CAST(0.3 AS DOUBLE) THEN 1 ELSE 0 END) AS recovered,
        sum(CASE WHEN coalesce(conf, 0) < CAST(0.3 AS DOUBLE) OR (zone = 'far' AND coalesce(conf, 0) < CAST(0.4 AS DOUBLE)) OR cropped THEN 1 ELSE 0 END) AS low_conf
    FROM t GROUP BY cam""")
Q.on("static_tracks", "t", op.static_tracks, """
    SELECT tid, count(*) AS n, count(*) >= 2 AND max(t) - min(t) >= 4 AND stddev_pop(fx) < 5 AND stddev_pop(fy) < 5 AS static_susp
    FROM t WHERE fx IS NOT NULL AND fy IS NOT NULL AND t IS NOT NULL GROUP BY tid""")
Q.on("clean_upright", "t", op.clean_upright, """
    SELECT cam, count(*) AS n, round(avg(box_h), 6) AS mean_h FROM t
    WHERE conf > CAST(0.6 AS DOUBLE) AND box_h > 50 AND box_h / box_w > CAST(1.7 AS DOUBLE) AND box_h / box_w < 5 AND NOT cropped GROUP BY cam""")
_QUALITY = """
    s AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS seg FROM t WINDOW w AS (PARTITION BY tid ORDER BY frame)),
    g AS (SELECT tid, count(*) AS n, max(t) - min(t) AS dur, avg(CASE WHEN coalesce(conf, 0) >= 0.5 THEN 1.0 ELSE 0.0 END) AS sure, stddev_pop(box_h) / avg(box_h) AS cv,
        quantile_cont(seg, 0.5) AS med_step, avg(CASE WHEN in_pitch THEN 0.0 ELSE 1.0 END) AS off_share FROM s GROUP BY tid),
    q AS (SELECT tid, n, concat_ws(',', CASE WHEN coalesce(dur, 0) < 2 THEN 'short' END, CASE WHEN sure < 0.5 THEN 'low_conf' END, CASE WHEN cv > 0.5 THEN 'box_cv' END,
        CASE WHEN med_step > 3 THEN 'jumpy' END, CASE WHEN off_share > 0.5 THEN 'off_pitch' END) AS reasons FROM g)"""
Q.on("tracklet_quality", "t", op.tracklet_quality, f"WITH {_QUALITY} SELECT tid, n, reasons, reasons = '' AS accepted FROM q")
Q.on("pseudo_labels", "t", op.pseudo_labels, f"""WITH {_QUALITY}
    SELECT clip, count(*) AS n_labels, count(DISTINCT tid) AS n_tracks FROM t WHERE tid IN (SELECT tid FROM q WHERE reasons = '') AND conf >= 0.5 AND in_pitch AND NOT cropped GROUP BY clip""")
Q.on("honesty_filter", "t", op.honesty_filter, "SELECT clip, count(*) AS n FROM t WHERE conf IS NOT NULL GROUP BY clip")
_COUNTS = "c AS (SELECT clip, frame, count(*) AS n, count(DISTINCT tid) AS k, sum(CASE WHEN zone = 'far' THEN 1 ELSE 0 END) AS far FROM t GROUP BY clip, frame)"
Q.on("parity_qc", "t", op.parity_qc, f"""WITH {_COUNTS}
    SELECT clip, count(*) AS n_frames, round(avg(CASE WHEN n = 3 THEN 1.0 ELSE 0.0 END), 6) AS frac_expected, quantile_cont(n, 0.5) AS median_n, round(avg(CASE WHEN n % 2 = 1 THEN 1.0 ELSE 0.0 END), 6) AS odd_frac FROM c GROUP BY clip""")
Q.on("parity_flags", "t", op.parity_flags, f"WITH {_COUNTS} SELECT clip, frame, n, far AS far_count, greatest(0, 3 - n) AS deficit, n % 2 = 1 AS odd, n > 3 AS overshoot FROM c")
_CONC = f"""{_COUNTS},
    m AS (SELECT clip, k, row_number() OVER (PARTITION BY clip ORDER BY count(*) DESC, k) AS i FROM c GROUP BY clip, k),
    conc AS (SELECT clip, max(k) AS k_max, round(quantile_cont(k, 0.95), 6) AS k_p95, quantile_cont(k, 0.5) AS k_median FROM c GROUP BY clip)"""
_SWEEP = """span AS (SELECT clip, tid, min(frame) AS f0, max(frame) AS f1 FROM t GROUP BY clip, tid),
    ev AS (SELECT clip, f0 AS f, 1 AS d FROM span UNION ALL SELECT clip, f1 + 1, -1 FROM span),
    net AS (SELECT clip, f, sum(d) AS d FROM ev GROUP BY clip, f),
    live AS (SELECT clip, sum(d) OVER (PARTITION BY clip ORDER BY f ROWS UNBOUNDED PRECEDING) AS live FROM net),
    sweep AS (SELECT clip, max(live) AS peak FROM live GROUP BY clip)"""
Q.on("concurrency_stats", "t", op.concurrency_stats, f"WITH {_CONC} SELECT clip, k_max, k_p95, k_median, k AS k_mode FROM conc JOIN m USING (clip) WHERE i = 1")
Q.on("detection_floor", "t", op.detection_floor, f"WITH {_COUNTS} SELECT clip, max(k) AS floor, sum(CASE WHEN n <> k THEN 1 ELSE 0 END) AS duplicate_frames FROM c GROUP BY clip")
Q.on("sweep_concurrency", "t", op.sweep_concurrency, f"WITH {_SWEEP} SELECT clip, peak FROM sweep")
Q.on("roster_estimate", "t", op.roster_estimate, f"""WITH {_CONC}, {_SWEEP}
    SELECT clip, CAST(round(k_p95) AS INTEGER) AS by_frames, CAST(peak AS INTEGER) AS by_spans, abs(round(k_p95) - peak) <= 1 AS agree FROM conc JOIN sweep USING (clip)""")
Q.on("deficit_gate", "t", op.deficit_gate, f"""WITH {_COUNTS}, w AS (SELECT clip, frame, quantile_cont(n, 0.5) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS med FROM c)
    SELECT clip, frame, med FROM w WHERE med < 3 AND frame % 6 = 0""")
Q.on("presence_class", "t", op.presence_class, """
    WITH c AS (SELECT clip, max(frame) - min(frame) + 1 AS len FROM t GROUP BY clip),
    g AS (SELECT clip, tid, count(*) AS n, max(frame) - min(frame) + 1 AS span FROM t GROUP BY clip, tid)
    SELECT tid, n, round(span / len, 6) AS span_frac, CASE WHEN n >= 60 AND span / len >= 0.85 AND n / span >= 0.5 THEN 'core' WHEN n >= 60 THEN 'partial' ELSE 'brief' END AS presence FROM g JOIN c USING (clip)""")
Q.on("tracklet_summary", "t", op.tracklet_summary, """
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY frame) AS a, row_number() OVER (PARTITION BY tid ORDER BY frame DESC) AS b FROM t)
    SELECT tid, count(*) AS n, min(frame) AS f0, max(frame) AS f1, round(min(t), 4) AS t0, round(max(t), 4) AS t1,
        round(quantile_cont(x, 0.5) FILTER (a <= 5), 6) AS hx, round(quantile_cont(y, 0.5) FILTER (a <= 5), 6) AS hy,
        round(quantile_cont(x, 0.5) FILTER (b <= 5), 6) AS tx, round(quantile_cont(y, 0.5) FILTER (b <= 5), 6) AS ty,
        round(avg(CASE WHEN zone = 'far' THEN 1.0 ELSE 0.0 END), 6) AS far_frac FROM p GROUP BY tid""")
Q.on("intra_holes", "t", op.intra_holes, """
    WITH h AS (SELECT tid, lead(frame) OVER (PARTITION BY tid ORDER BY frame) - frame - 1 AS gap FROM t)
    SELECT tid, count(*) AS n_holes, sum(gap) AS missing, quantile_cont(gap, 0.5) AS median_gap, round(quantile_cont(gap, 0.95), 6) AS p95_gap, max(gap) AS max_gap FROM h WHERE gap > 0 GROUP BY tid""")
Q.on("births_deaths", "t", op.births_deaths, """
    WITH p AS (SELECT * FROM t WHERE x IS NOT NULL AND y IS NOT NULL),
    g AS (SELECT tid, arg_min(x, frame) AS bx, arg_min(y, frame) AS byy, arg_max(x, frame) AS dx, arg_max(y, frame) AS dy FROM p GROUP BY tid)
    SELECT tid, round(bx, 6) AS birth_x, round(byy, 6) AS birth_y, round(dx, 6) AS death_x, round(dy, 6) AS death_y, bx < 2 OR bx > 48 AS born_at_border, dx < 2 OR dx > 48 AS died_at_border FROM g""")
Q.on("far_quality", "t", op.far_quality, """
    SELECT tid, round(avg(CASE WHEN zone = 'far' THEN 1.0 ELSE 0.0 END), 6) AS far_frac, sum(CASE WHEN zone = 'far' AND NOT in_pitch THEN 1 ELSE 0 END) AS dropped_far, round(quantile_cont(box_h, 0.5), 6) AS median_h FROM t GROUP BY tid""")
Q.on("median_mad", "t", op.median_mad, """
    WITH h AS (SELECT tid, box_h * CAST(0.02 AS DOUBLE) AS h FROM t WHERE box_h IS NOT NULL), m AS (SELECT tid, quantile_cont(h, 0.5) AS med, count(*) AS n FROM h GROUP BY tid HAVING count(*) >= 12)
    SELECT tid, any_value(n) AS n, round(any_value(med), 6) AS median_h, round(quantile_cont(abs(h - med), 0.5), 6) AS mad_h FROM h JOIN m USING (tid) GROUP BY tid""")
_BANDS = ", ".join(f"quantile_cont(fy, {i / 8}) AS q{i}" for i in range(1, 8))
_BAND = " + ".join(f"CASE WHEN fy >= q{i} THEN 1 ELSE 0 END" for i in range(1, 8))
Q.on("band_normalize", "t", op.band_normalize, f"""
    WITH p AS (SELECT cam, fy, box_h FROM t WHERE box_h > 0 AND fy IS NOT NULL), c AS (SELECT cam, {_BANDS} FROM p GROUP BY cam),
    b AS (SELECT cam, box_h, {_BAND} AS band FROM p JOIN c USING (cam)), m AS (SELECT cam, band, quantile_cont(box_h, 0.5) AS m FROM b GROUP BY cam, band)
    SELECT cam, count(*) AS n, round(avg(box_h / m), 4) AS mean_h, round(stddev_pop(box_h / m), 4) AS sd_h FROM b JOIN m USING (cam, band) GROUP BY cam""")
Q.on("far_stats", "t", op.far_stats, "SELECT cam, count(*) AS n, round(avg(CASE WHEN box_h / 720 < CAST(0.06 AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS small_frac FROM t WHERE box_h IS NOT NULL GROUP BY cam")
Q.on("frame_uncertainty", "t", op.frame_uncertainty, """
    WITH c AS (SELECT clip, frame, conf, least(greatest(conf, 1e-9), 1 - 1e-9) AS c FROM t WHERE conf IS NOT NULL)
    SELECT clip, frame, round(avg(1 - conf), 6) AS least_conf, round(avg(-(c * log2(c) + (1 - c) * log2(1 - c))), 6) AS entropy FROM c GROUP BY clip, frame""")
Q.on("label_queue", "t", op.label_queue, """
    WITH c AS (SELECT clip, frame, count(*) AS n, sum(CASE WHEN zone = 'far' THEN 1 ELSE 0 END) AS far, quantile_cont(conf, 0.5) AS mc FROM t GROUP BY clip, frame),
    s AS (SELECT clip, frame, frame // 25 AS seg, round(2 * greatest(0, 3 - n) + CAST(0.5 AS DOUBLE) * far + n % 2 + 3 * (1 - coalesce(mc, 0)), 6) AS score FROM c),
    b AS (SELECT *, row_number() OVER (PARTITION BY clip, seg ORDER BY score DESC, frame) AS k FROM s),
    q AS (SELECT clip, frame, score, row_number() OVER (PARTITION BY clip ORDER BY score DESC, frame) AS rank FROM b WHERE k = 1)
    SELECT clip, frame, score, rank FROM q WHERE rank <= 50""")
Q.on("weighted_median", "t", op.weighted_median, """
    WITH p AS (SELECT tid, frame, box_h, CAST(round(conf * 1000000) AS BIGINT) AS w FROM t WHERE box_h IS NOT NULL AND conf > 0),
    c AS (SELECT *, sum(w) OVER (PARTITION BY tid ORDER BY box_h, frame ROWS UNBOUNDED PRECEDING) AS cw, sum(w) OVER (PARTITION BY tid) AS tw FROM p)
    SELECT tid, round(min(box_h), 6) AS weighted_median FROM c WHERE cw * 2 >= tw GROUP BY tid""")
_EXTENT = """p AS (SELECT * FROM t WHERE x IS NOT NULL AND y IS NOT NULL{more}),
    e AS (SELECT cam, quantile_cont(x, 0.005) AS x0, quantile_cont(x, 0.995) AS x1, quantile_cont(y, 0.005) AS y0, quantile_cont(y, 0.995) AS y1 FROM p GROUP BY cam)"""
_GRID = _EXTENT + """, g AS (SELECT *, CAST(least(floor((x - x0) / ((x1 - x0) / {nx})), {nx} - 1) AS INTEGER) AS ix, CAST(least(floor((y - y0) / ((y1 - y0) / {ny})), {ny} - 1) AS INTEGER) AS iy
    FROM p JOIN e USING (cam) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND x1 > x0 AND y1 > y0)"""
Q.on("robust_extent", "t", op.robust_extent, f"WITH {_EXTENT.format(more='')} SELECT cam, round(x0, 6) AS x0, round(x1, 6) AS x1, round(y0, 6) AS y0, round(y1, 6) AS y1 FROM e")
Q.on("heatmap", "t", op.heatmap, f"WITH {_GRID.format(more='', nx=10, ny=6)} SELECT cam, ix, iy, count(*) AS n FROM g GROUP BY 1, 2, 3")
Q.on("occupancy_weighted", "t", op.weighted_occupancy, f"""WITH {_GRID.format(more=' AND conf IS NOT NULL', nx=10, ny=6)}, w AS (SELECT cam, ix, iy, sum(conf) AS w FROM g GROUP BY 1, 2, 3)
    SELECT cam, ix, iy, round(w / max(w) OVER (PARTITION BY cam), 5) AS occupancy FROM w""")
Q.on("heatmap_exposure", "t", op.heatmap_exposure, f"""WITH {_GRID.format(more='', nx=6, ny=4)}, s AS (SELECT cam, ix, iy, sum(1 / coalesce(fps, 25)) AS s FROM g GROUP BY 1, 2, 3),
    d AS (SELECT * FROM (SELECT DISTINCT cam FROM s), (SELECT unnest(generate_series(0, 5)) AS ix), (SELECT unnest(generate_series(0, 3)) AS iy))
    SELECT d.cam, CAST(d.ix AS INTEGER) AS ix, CAST(d.iy AS INTEGER) AS iy, round(s, 4) AS presence_s FROM d LEFT JOIN s ON d.cam = s.cam AND d.ix = s.ix AND d.iy = s.iy""")
Q.on("presence_grid", "t", op.presence_grid, f"""WITH {_GRID.format(more='', nx=4, ny=3)}, n AS (SELECT tid, ix, iy, count(*) AS n FROM g GROUP BY 1, 2, 3)
    SELECT tid, ix, iy, round(n / max(n) OVER (PARTITION BY tid), 6) AS share FROM n""")
Q.on("territory_thirds", "t", op.territory_thirds, f"""WITH {_EXTENT.format(more='')},
    z AS (SELECT cam, tid, floor(least(greatest((x - x0) / (x1 - x0), 0), 0.999999) * 3) AS third FROM p JOIN e USING (cam) WHERE x1 > x0),
    g AS (SELECT cam, tid, count(*) AS n, round(avg(CASE WHEN third = 0 THEN 1.0 ELSE 0.0 END), 6) AS third_0, round(avg(CASE WHEN third = 1 THEN 1.0 ELSE 0.0 END), 6) AS third_1,
        round(avg(CASE WHEN third = 2 THEN 1.0 ELSE 0.0 END), 6) AS third_2, grouping(cam, tid) AS level FROM z GROUP BY ROLLUP (cam, tid))
    SELECT * FROM g WHERE level <> 0 OR n >= 12""")
Q.on("binned_median", "t", op.binned_median, """
    SELECT cam, CAST(floor(fy / 40) AS INTEGER) AS bin, count(*) AS n, round(quantile_cont(box_h, 0.5), 6) AS median_h FROM t WHERE box_h IS NOT NULL AND fy IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 20""")
Q.on("resolve_domain", "t", op.resolve_domain, """
    SELECT clip, CASE WHEN count(x) > 0 THEN 'pitch' ELSE 'pixel' END AS domain, round(CASE WHEN count(x) > 0 THEN min(x) ELSE min(fx) END, 6) AS lo, round(CASE WHEN count(x) > 0 THEN max(x) ELSE max(fx) END, 6) AS hi FROM t GROUP BY clip""")
Q.on("gk_heuristic", "t", op.gk_heuristic, """
    WITH g AS (SELECT tid, count(*) AS n, quantile_cont(x, 0.5) AS mx, stddev_pop(x) AS sx, avg(CASE WHEN x < 5 OR x > 45 THEN 1.0 ELSE 0.0 END) AS share FROM t WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY tid)
    SELECT tid, n, round(mx, 6) AS median_x, round(share, 6) AS end_share FROM g WHERE n >= 20 AND sx < 6.5 AND (mx < 5 OR mx > 45)""")
Q.on("top_tracks", "t", op.top_tracks, "SELECT tid, count(*) AS n_obs FROM t GROUP BY tid HAVING count(*) >= 12 ORDER BY n_obs DESC, tid LIMIT 25")
Q.on("pick_frame", "t", op.pick_frame, """
    WITH f AS (SELECT clip, frame, round(count(*) + (coalesce(stddev_samp(x), 0) + coalesce(stddev_samp(y), 0)) / 10, 6) AS score FROM t WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY clip, frame)
    SELECT clip, frame, score FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY score DESC, frame) AS k FROM f) WHERE k = 1""")
Q.on("stride_sample", "t", op.stride_sample, """
    SELECT clip, frame FROM (SELECT clip, frame, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS i FROM (SELECT DISTINCT clip, frame FROM t)) WHERE i % 10 = 0""")
Q.on("linspace_sample", "t", op.linspace_sample, """
    WITH p AS (SELECT tid, frame, row_number() OVER (PARTITION BY tid ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY tid) AS m FROM t)
    SELECT tid, frame FROM p WHERE i IN (0, (m - 1) // 4, 2 * (m - 1) // 4, 3 * (m - 1) // 4, m - 1)""")
Q.on("best_window", "t", op.best_window, f"""WITH {_COUNTS}, w AS (SELECT clip, frame, round(avg(n) OVER (PARTITION BY clip ORDER BY frame RANGE BETWEEN CURRENT ROW AND 299 FOLLOWING), 6) AS m FROM c)
    SELECT clip, frame AS start_frame, m AS mean_n FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY m DESC, frame) AS k FROM w) WHERE k = 1""")
Q.on("quantile_window_pick", "t", op.quantile_window_pick, """
    WITH p AS (SELECT * FROM t WHERE box_h IS NOT NULL AND t IS NOT NULL),
    g AS (SELECT tid, unnest([0, 1, 2, 3, 4]) AS i, unnest(quantile_cont(t, [0.1, 0.3, 0.5, 0.7, 0.9])) AS c, max(t) - min(t) AS span FROM p GROUP BY tid),
    b AS (SELECT p.tid, g.i, p.frame, row_number() OVER (PARTITION BY p.tid, g.i ORDER BY box_h DESC, frame) AS k FROM p JOIN g ON p.tid = g.tid AND abs(p.t - g.c) <= CAST(0.1 AS DOUBLE) * g.span + 1e-9)
    SELECT DISTINCT tid, frame FROM b WHERE k = 1""")
Q.on("active_probe", "t", op.active_probe, f"""WITH {_COUNTS}, p AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY clip) AS m FROM c),
    s AS (SELECT * FROM p WHERE i IN (0, (m - 1) // 5, 2 * (m - 1) // 5, 3 * (m - 1) // 5, 4 * (m - 1) // 5, m - 1))
    SELECT clip, quantile_cont(n, 0.5) AS median_n, quantile_cont(n, 0.5) >= 2 AS active FROM s GROUP BY clip""")
Q.on("tracklet_arrays", "t", op.tracklet_arrays, "SELECT tid, CAST(count(*) AS INTEGER) AS n, min(frame) AS f0, max(frame) AS f1, round(sum(x), 3) AS sum_x FROM t WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY tid")

QUERIES, SQL = Q.queries, Q.sql
