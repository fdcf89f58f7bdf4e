"""Queries on game state and the grouped kernels."""

from __future__ import annotations

from kinelake.operators import game as op
from kinelake.operators import sequence as seq
from kinelake.operators.pairs import framed
from kinelake.plans.pair_queries import _C, _INT, _P, _PL, _TEAM
from kinelake.plans.registry import Registry

Q = Registry()

_V = _C + """, vl AS (SELECT *, CASE WHEN g - lag(g) OVER w <= 10 THEN (x - lag(x) OVER w) * 25 / (g - lag(g) OVER w) END AS vx, CASE WHEN g - lag(g) OVER w <= 10 THEN (y - lag(y) OVER w) * 25 / (g - lag(g) OVER w) END AS vy FROM c WINDOW w AS (PARTITION BY tid ORDER BY g)),
    v AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM vl)"""
_CONV = _V + """, d AS (SELECT *, vx / speed AS dx, vy / speed AS dy FROM v WHERE speed >= CAST(0.25 AS DOUBLE)),
    s AS (SELECT clip, g, count(*) AS k, sum(1 - dx*dx) AS a, sum(-dx*dy) AS b, sum(1 - dy*dy) AS c, sum((1 - dx*dx)*x - dx*dy*y) AS u, sum((1 - dy*dy)*y - dx*dy*x) AS v, avg(x) AS mx, avg(y) AS my FROM d GROUP BY clip, g HAVING count(*) >= 2),
    f AS (SELECT *, a * c - b * b <= 1e-2 * (a + c) * (a + c) AS degenerate FROM s),
    cv AS (SELECT clip, g, k, round(CASE WHEN degenerate THEN mx ELSE (c * u - b * v) / (a * c - b * b) END, 3) AS px, round(CASE WHEN degenerate THEN my ELSE (a * v - b * u) / (a * c - b * b) END, 3) AS py, degenerate FROM f)"""
Q.on("convergence_point", "t", op.convergence_point, f"WITH {_CONV} SELECT clip, {_INT}, k, px, py, degenerate FROM cv")
Q.on("focus_track", "t", op.focus_track, f"""WITH {_CONV}, b AS (SELECT clip, g, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM c GROUP BY clip, g)
    SELECT clip, {_INT}, round(least(greatest(px, x0 - 3), x1 + 3), 3) AS fx, round(least(greatest(py, y0 - 3), y1 + 3), 3) AS fy FROM cv JOIN b USING (clip, g)""")
Q.on("kickoff_readiness", ["t", "tracklets"], op.kickoff_readiness, f"""WITH {_V}, {_TEAM}, m AS (SELECT clip, avg(x) AS cx, avg(y) AS cy FROM v GROUP BY clip),
    s AS (SELECT clip, g, avg(CASE WHEN team = 0 THEN CASE WHEN x < cx THEN 1.0::DOUBLE ELSE 0 END END) AS a, avg(CASE WHEN team = 1 THEN CASE WHEN x < cx THEN 1.0::DOUBLE ELSE 0 END END) AS b, avg(x) AS mx, avg(y) AS my, avg(coalesce(speed, 0)) AS sp, any_value(cx) AS cx, any_value(cy) AS cy FROM v JOIN m USING (clip) LEFT JOIN team USING (tid) GROUP BY clip, g)
    SELECT clip, {_INT}, round(greatest(a * (1 - b), (1 - a) * b) * exp(-sqrt((mx - cx) * (mx - cx) + (my - cy) * (my - cy)) / 10) * exp(-sp / 5), 5) AS ready, round(mx - cx, 4) AS side FROM s WHERE a IS NOT NULL AND b IS NOT NULL""")
Q.on("wall_pairs", "t", op.wall_pairs, f"""WITH {_C}, d AS (SELECT a.clip, a.g, a.tid AS tid_a, b.tid AS tid_b, a.y - b.y AS dy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM c a JOIN c b ON a.clip = b.clip AND a.g = b.g AND a.tid < b.tid),
    s AS (SELECT clip, g, tid_a, tid_b, round(sqrt(exp(-abs(d - 1)) * abs(dy) / d), 6) AS score FROM d WHERE d <= 14 AND d > 0)
    SELECT clip, {_INT}, tid_a, tid_b, score FROM (SELECT *, row_number() OVER (PARTITION BY clip, g ORDER BY score DESC, tid_a, tid_b) AS i FROM s) WHERE i = 1 AND score > 0""")
Q.on("circular_std", "t", op.circular_std, f"""WITH {_V}, s AS (SELECT tid, count(*) AS n, avg(vx / speed) AS c, avg(vy / speed) AS s FROM v WHERE speed > 0 GROUP BY tid HAVING count(*) >= 3)
    SELECT tid, n, round(sqrt(-2 * ln(greatest(sqrt(c * c + s * s), 1e-6))), 4) AS circ_std FROM s""")
Q.on("spurious_rules", "t", op.spurious_rules, f"""WITH {_P}, dd AS (SELECT tid, count(*) AS dups FROM (SELECT DISTINCT clip, g, CASE WHEN sa >= sb THEN tid_b ELSE tid_a END AS tid FROM p WHERE d2 < 4) GROUP BY tid), nc AS (SELECT tid, count(*) AS cells FROM c GROUP BY tid),
    s AS (SELECT tid, count(*) AS n, max(t) - min(t) AS span, stddev_pop(fx) AS su, stddev_pop(fy) AS sv, stddev_pop(x) AS sx, avg(CASE WHEN in_pitch THEN 0.0 ELSE 1.0 END) AS off_s FROM t GROUP BY tid)
    SELECT tid, n, CASE WHEN coalesce(dups / cells, 0) > 0.5 THEN 'double_detection' WHEN off_s > 0.5 AND sx < 1 THEN 'off_pitch_stationary' WHEN n < 12 THEN 'orphan_blip' WHEN span >= 4 AND su < 5 AND sv < 5 THEN 'static_foreign' WHEN off_s > 0.8 THEN 'off_field_persistent' END AS spurious_reason
    FROM s LEFT JOIN nc USING (tid) LEFT JOIN dd USING (tid)""")
Q.on("gk_candidates", "t", op.gk_candidates, f"""WITH {_V}, e AS (SELECT clip, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM v GROUP BY clip),
    s AS (SELECT clip, tid, round(avg(CASE WHEN x < lo + CAST(0.15 AS DOUBLE) * (hi - lo) THEN 1.0 ELSE 0.0 END), 6) AS l, round(avg(CASE WHEN x > hi - CAST(0.15 AS DOUBLE) * (hi - lo) THEN 1.0 ELSE 0.0 END), 6) AS r, round(quantile_cont(speed, 0.5), 6) AS speed FROM v JOIN e USING (clip) GROUP BY clip, tid),
    u AS (SELECT clip, tid, speed, 'left' AS "end", l AS res FROM s UNION ALL SELECT clip, tid, speed, 'right', r FROM s)
    SELECT clip, "end", tid, res, rank FROM (SELECT *, row_number() OVER (PARTITION BY clip, "end" ORDER BY res DESC, speed NULLS LAST, tid) AS rank FROM u WHERE res >= CAST(0.45 AS DOUBLE)) WHERE rank <= 3""")
Q.on("vest_rules", "t", op.vest_rules, """WITH s AS (SELECT tid, count(*) AS n, round(avg(conf), 6) AS a, round(avg(box_w / box_h), 6) AS b FROM t WHERE conf IS NOT NULL AND box_h > 0 AND box_w IS NOT NULL GROUP BY tid)
    SELECT tid, n, CASE WHEN n < 12 THEN 'abstain' WHEN a >= CAST(0.65 AS DOUBLE) THEN 'vest' WHEN a <= CAST(0.45 AS DOUBLE) THEN 'no_vest' WHEN b > CAST(0.55 AS DOUBLE) THEN 'gk' ELSE 'abstain' END AS vest_label FROM s""")
Q.on("coverage_mask", "t", op.coverage_mask, """WITH k AS (SELECT DISTINCT cam FROM t WHERE x IS NOT NULL AND y IS NOT NULL), c AS (SELECT cam, ix, iy, 50.0::DOUBLE * (ix + 0.5) / 12 AS cx, 30.0::DOUBLE * (iy + 0.5) / 8 AS cy FROM k, (SELECT unnest(generate_series(0, 11)) AS ix), (SELECT unnest(generate_series(0, 7)) AS iy)),
    p AS (SELECT *, (22 * cx - 0.5 * cy + 90) / (CAST(0.0001 AS DOUBLE) * cx + CAST(0.004 AS DOUBLE) * cy + 1) AS u, (CAST(-0.3 AS DOUBLE) * cx + 12 * cy + 130) / (CAST(0.0001 AS DOUBLE) * cx + CAST(0.004 AS DOUBLE) * cy + 1) AS v FROM c)
    SELECT cam, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, CASE WHEN u BETWEEN 0 AND 1280 AND v BETWEEN 0 AND 720 THEN 1 END AS visible FROM p""")
Q.on("fusion_tracklets", "t", op.fusion_tracklets, """WITH q AS (SELECT clip, tid, CASE WHEN tid % 2 = 1 THEN t + 0.5 ELSE t END AS t, CASE WHEN tid % 2 = 1 THEN 50 - x ELSE x END AS xx, CASE WHEN tid % 2 = 1 THEN 30 - y ELSE y END AS yy FROM t WHERE x IS NOT NULL AND y IS NOT NULL AND t IS NOT NULL)
    SELECT clip, tid, count(*) AS n, round(min(t), 4) AS t0, round(max(t), 4) AS t1, round(avg(xx), 4) AS mx, round(avg(yy), 4) AS my FROM q WHERE xx BETWEEN -3 AND 53 AND yy BETWEEN -3 AND 33 GROUP BY clip, tid HAVING count(*) >= 2""")
Q.on("coregister", "t", op.coregister, f"""WITH {_C}, q AS (SELECT a.clip, a.g, a.tid AS tid_a, b.tid AS tid_b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS byy, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS d FROM c a JOIN c b ON a.clip = b.clip AND a.g = b.g AND a.tid % 2 = 0 AND b.tid % 2 = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY clip, g, tid_a ORDER BY d, tid_b) AS ra, row_number() OVER (PARTITION BY clip, g, tid_b ORDER BY d, tid_a) AS rb FROM q),
    m AS (SELECT * FROM k WHERE ra = 1 AND rb = 1 AND d <= 10), w AS (SELECT clip, avg(ax) AS ma, avg(ay) AS na, avg(bx) AS mb, avg(byy) AS nb FROM m GROUP BY clip),
    s AS (SELECT clip, count(*) AS n, quantile_cont(bx - ax, 0.5) AS dx, quantile_cont(byy - ay, 0.5) AS dy, sum((ax - ma) * (byy - nb) - (ay - na) * (bx - mb)) AS s, sum((ax - ma) * (bx - mb) + (ay - na) * (byy - nb)) AS c FROM m JOIN w USING (clip) GROUP BY clip HAVING count(*) >= 5)
    SELECT clip, n, round(dx, 4) AS dx, round(dy, 4) AS dy, round(atan2(s, c), 4) AS angle FROM s""")
Q.on("fused_tracks", ["t", "connect_labels"], op.fused_tracks, f"""WITH {_PL}, {_C}, f AS (SELECT clip, player_id, g, sum(conf * x) / sum(conf) AS x, sum(conf * y) / sum(conf) AS y, count(DISTINCT tid) AS k FROM c JOIN pl USING (tid) GROUP BY clip, player_id, g HAVING sum(conf) > 0),
    s AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d, (g - lag(g) OVER w) / 25.0::DOUBLE AS dt FROM f WINDOW w AS (PARTITION BY clip, player_id ORDER BY g))
    SELECT clip, player_id, count(*) AS n, max(k) AS max_tracks, round(sum(CASE WHEN d <= 8 * dt THEN d ELSE 0 END), 3) AS dist FROM s GROUP BY clip, player_id""")

# grouped kernels: tested against brute force on small fixtures instead of SQL
for name in ("nms", "inframe_dedup_greedy"):  # every row in its own frame
    Q.on(name, "t", lambda t, f=getattr(seq, name): f(t, clock=framed))
for name in ("dedup_concurrency", "stitch", "consolidate", "cluster_merge", "gta_connect", "fuse", "gta_split", "presplit", "kinematics_smoothed", "savgol", "gsi_fill", "postprocess", "possession_viterbi", "role_timeline", "tracklet_builder", "static_fp", "kmeans2"):
    Q.on(name, "t", getattr(seq, name))
for name in ("greedy_match", "recall_by_zone"):
    Q.on(name, ["t", "gt_detections", "tracklets"], getattr(seq, name))
Q.on("kickoff_events", ["t", "tracklets"], seq.kickoff_events)
Q.on("idf1", ["t", "connect_labels"], seq.idf1)
Q.on("coreset_kcenter", "embeddings", seq.coreset_kcenter)
Q.on("global_stitch", "embeddings", seq.global_stitch)
Q.on("keep_if_changed", "match_records", seq.keep_if_changed)

QUERIES, SQL = Q.queries, Q.sql
