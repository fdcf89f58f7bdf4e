"""Queries on motion along tracks."""

from __future__ import annotations

from kinelake.operators import kinematics as op
from kinelake.plans.registry import Registry

Q = Registry()

_W = "WINDOW w AS (PARTITION BY tid ORDER BY frame)"


def _steps(where: str = "TRUE", timed: bool = True) -> str:
    return f"""p0 AS (SELECT * FROM t WHERE x IS NOT NULL AND y IS NOT NULL AND {where}{' AND t IS NOT NULL' if timed else ''}),
    p AS (SELECT *, t - lag(t) OVER w AS dt, frame - lag(frame) OVER w AS df, lag(t) OVER w AS pt, lag(frame) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(frame) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny,
        sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS seg FROM p0 {_W}),
    s AS (SELECT *, CASE WHEN dt > 0 THEN seg / dt END AS v FROM p)"""


Q.on("kinematics_global", "t", op.kinematics_global, f"""WITH {_steps()},
    cap AS (SELECT 6 * quantile_cont(v, 0.5) AS cap FROM s WHERE v IS NOT NULL AND dt <= 1),
    b AS (SELECT *, seg IS NOT NULL AND (coalesce(dt, 0) <= 0 OR dt > 1 OR coalesce(v > cap, FALSE)) AS bad FROM s, cap)
    SELECT tid, count(seg) AS segments, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS bad, round(sum(CASE WHEN seg IS NOT NULL AND NOT bad THEN seg ELSE 0 END), 4) AS dist_raw,
        round(sum(CASE WHEN seg IS NOT NULL AND NOT bad THEN seg * least(coalesce(conf, 0) / CAST(0.7 AS DOUBLE), 1) ELSE 0 END), 4) AS dist_weighted FROM b GROUP BY tid""")
Q.on("kinematics_track", "t", op.kinematics_track, f"""WITH {_steps('in_pitch')}, cap AS (SELECT tid, 6 * quantile_cont(v, 0.5) AS cap FROM s GROUP BY tid),
    b AS (SELECT tid, seg, coalesce(dt, 0) <= 0 OR coalesce(v > cap, FALSE) AS bad FROM s JOIN cap USING (tid) WHERE seg IS NOT NULL)
    SELECT tid, round(sum(CASE WHEN bad THEN 0 ELSE seg END), 4) AS distance, round(avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END), 6) AS clipped_frac FROM b GROUP BY tid""")
Q.on("player_report", "t", op.player_report, f"""WITH {_steps()}
    SELECT tid, count(*) AS n, round(max(t) - min(t), 4) AS duration_s, round(sum(seg), 4) AS path, round(avg(CASE WHEN v > 0.5 THEN v END), 4) AS mean_moving,
        round(quantile_cont(v, 0.5), 4) AS v50, round(quantile_cont(v, 0.9), 4) AS v90, round(quantile_cont(v, 0.99), 4) AS v99 FROM s GROUP BY tid""")
Q.on("arc_length", "t", op.arc_length, f"WITH {_steps(timed=False)} SELECT tid, round(sum(seg), 4) AS arc_length FROM s GROUP BY tid")
Q.on("rolling_median", "t", op.rolling_median, """
    SELECT tid, frame, round(quantile_cont(x, 0.5) OVER w, 6) AS mx, round(quantile_cont(y, 0.5) OVER w, 6) AS my FROM t WHERE x IS NOT NULL AND y IS NOT NULL
    WINDOW w AS (PARTITION BY tid ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
Q.on("speed_bfill", "t", op.speed_bfill, f"""WITH {_steps()}
    SELECT tid, frame, round(coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY tid ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 4) AS speed FROM s""")
Q.on("backward_velocity", "t", op.backward_velocity, f"""WITH {_steps(timed=False)}
    SELECT tid, frame, round(CASE WHEN pf IS NULL THEN CASE WHEN nf - frame <= 5 THEN (nx - x) / (nf - frame) END WHEN frame - pf <= 5 THEN (x - px) / (frame - pf) END, 6) AS vx,
        round(CASE WHEN pf IS NULL THEN CASE WHEN nf - frame <= 5 THEN (ny - y) / (nf - frame) END WHEN frame - pf <= 5 THEN (y - py) / (frame - pf) END, 6) AS vy FROM s""")
Q.on("sprint_episodes", "t", op.sprint_episodes, f"""WITH {_steps()},
    i AS (SELECT *, coalesce(v >= 5, FALSE) AS fast, row_number() OVER w AS i, coalesce(lead(t) OVER w, t) AS next_t FROM s {_W}),
    f AS (SELECT *, i - row_number() OVER (PARTITION BY tid ORDER BY frame) AS run FROM i WHERE fast AND i > 1),
    e AS (SELECT tid, run, round(max(next_t) - min(pt), 6) AS dur, max(v) AS top FROM f GROUP BY tid, run)
    SELECT tid, count(*) AS n_sprints, round(sum(dur), 4) AS total_s, round(max(top), 4) AS top_speed FROM e WHERE dur >= CAST(0.2 AS DOUBLE) GROUP BY tid""")
Q.on("swap_candidates", "t", op.swap_candidates, f"""WITH {_steps(timed=False)}, j AS (SELECT * FROM s WHERE df <= 5 AND seg > 3)
    SELECT tid, frame, round(seg, 4) AS jump, EXISTS (SELECT 1 FROM p0 o WHERE o.clip = j.clip AND o.tid <> j.tid AND abs(o.frame - j.frame) <= 2 AND (j.x - o.x) * (j.x - o.x) + (j.y - o.y) * (j.y - o.y) < 2.25) AS crossing FROM j""")
Q.on("segment_split", "t", op.segment_split, f"""WITH {_steps()}, c AS (SELECT tid, frame, sum(CASE WHEN dt > 2 OR v > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY frame ROWS UNBOUNDED PRECEDING) AS seg_no FROM s)
    SELECT tid, seg_no, count(*) AS n, min(frame) AS f0, max(frame) AS f1 FROM c GROUP BY tid, seg_no""")
Q.on("session_tracks", "t", op.session_tracks, """
    WITH s AS (SELECT tid, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY tid ORDER BY frame) > 50 THEN 1 ELSE 0 END AS new FROM t),
    n AS (SELECT tid, frame, sum(new) OVER (PARTITION BY tid ORDER BY frame ROWS UNBOUNDED PRECEDING) AS session FROM s)
    SELECT tid, session, count(*) AS n, min(frame) AS f0, max(frame) AS f1 FROM n GROUP BY tid, session""")
_HOLES = _steps(timed=False) + """, h AS (SELECT tid, frame AS f0, nf, x, y, nx, ny, unnest(generate_series(frame + 1, nf - 1)) AS frame FROM s WHERE nf - frame > 1 AND nf - frame <= {gap}),
    filled AS (SELECT tid, CAST(frame AS INTEGER) AS frame, round(x + (frame - f0) / (nf - f0) * (nx - x), 6) AS x, round(y + (frame - f0) / (nf - f0) * (ny - y), 6) AS y FROM h)"""
Q.on("bridge_gaps", "t", op.bridge_gaps, f"WITH {_HOLES.format(gap=25)} SELECT *, CAST(NULL AS DOUBLE) AS conf, TRUE AS interpolated FROM filled")
Q.on("bridge_short_gaps", "t", op.bridge_short_gaps, f"""
    WITH n AS (SELECT clip, frame, t, lead(frame) OVER w AS nf, lead(t) OVER w AS nt FROM t WHERE fx IS NOT NULL AND fy IS NOT NULL AND t IS NOT NULL {_W})
    SELECT clip, count(*) AS n_holes, sum(nf - frame - 1) AS n_filled FROM n WHERE nf - frame > 1 AND round(nt - t, 6) <= 0.5 GROUP BY clip""")
Q.on("mine_fn", "t", op.mine_false_negatives, f"WITH {_HOLES.format(gap=11)} SELECT * FROM filled")
Q.on("linear_fill", "t", lambda t: op.mine_false_negatives(t, 50), f"WITH {_HOLES.format(gap=51)} SELECT * FROM filled")
Q.on("mine_orphans", "t", op.mine_orphans, "SELECT tid, count(DISTINCT frame) AS n_frames FROM t GROUP BY tid HAVING count(DISTINCT frame) < 20")
_VEL = "CASE WHEN CASE WHEN ub THEN frame - pf ELSE nf - frame END <= 8 THEN CASE WHEN ub THEN ({c} - p{c}) / (frame - pf) ELSE (n{c} - {c}) / (nf - frame) END ELSE 0 END AS v{c}"
_HERM = "round((2 * s * s * s - 3 * s * s + 1) * {c} + (s * s * s - 2 * s * s + s) * span * v{c} + (3 * s * s - 2 * s * s * s) * n{c} + (s * s * s - s * s) * span * nv{c}, 4) AS {c}"
Q.on("continuous_state", "t", op.continuous_state, f"""WITH {_steps(timed=False)},
    u AS (SELECT *, pf IS NOT NULL AND (nf IS NULL OR frame - pf <= nf - frame) AS ub FROM s),
    v AS (SELECT *, {_VEL.format(c='x')}, {_VEL.format(c='y')} FROM u),
    n AS (SELECT *, lead(vx) OVER w AS nvx, lead(vy) OVER w AS nvy FROM v {_W}),
    h AS (SELECT tid, frame AS f0, nf - frame AS span, x, y, nx, ny, vx, vy, nvx, nvy, unnest(generate_series(frame + 1, nf - 1)) AS frame FROM n WHERE nf - frame > 1 AND nf - frame <= 50),
    e AS (SELECT *, (frame - f0) / span AS s FROM h)
    SELECT tid, CAST(frame AS INTEGER) AS frame, {_HERM.format(c='x')}, {_HERM.format(c='y')}, 'interp' AS status, round(exp(-span / 50), 6) AS conf FROM e
    UNION ALL SELECT tid, frame, round(x, 4), round(y, 4), 'obs', 1.0 FROM p0""")
Q.on("coverage_summary", "t", op.coverage_summary, """
    WITH g AS (SELECT clip, tid, count(*) / (max(frame) - min(frame) + 1) AS cov FROM t GROUP BY clip, tid)
    SELECT clip, count(*) AS n_tracks, round(avg(cov), 6) AS mean_cov, round(min(cov), 6) AS min_cov FROM g GROUP BY clip""")
Q.on("track_features", "t", op.track_features, f"""WITH {_steps()}
    SELECT tid, round(avg(CASE WHEN x < 7 THEN 1.0 ELSE 0.0 END), 6) AS res_left, round(avg(CASE WHEN x > 43 THEN 1.0 ELSE 0.0 END), 6) AS res_right,
        round(quantile_cont(CASE WHEN dt < CAST(0.3 AS DOUBLE) THEN v END, 0.5), 4) AS median_speed, round(avg(CASE WHEN zone = 'far' THEN 1.0 ELSE 0.0 END), 6) AS far_frac,
        round(stddev_pop(x), 4) AS sd_x, round(stddev_pop(y), 4) AS sd_y FROM s GROUP BY tid""")
Q.on("return_events", "t", op.return_events, """
    WITH k AS (SELECT tid, x > 15 AS far_out, lag(x > 15) OVER (PARTITION BY tid ORDER BY frame) AS was FROM t WHERE x IS NOT NULL AND y IS NOT NULL AND (x < 10 OR x > 15))
    SELECT tid, sum(CASE WHEN was AND NOT far_out THEN 1 ELSE 0 END) AS returns FROM k GROUP BY tid HAVING sum(CASE WHEN was AND NOT far_out THEN 1 ELSE 0 END) > 0""")
Q.on("window_residence", "t", op.window_residence, """
    SELECT tid, frame, round(avg(CASE WHEN x < 7 THEN 1.0 ELSE 0.0 END) OVER w, 6) AS "left", round(avg(CASE WHEN x > 43 THEN 1.0 ELSE 0.0 END) OVER w, 6) AS "right" FROM t WHERE x IS NOT NULL AND y IS NOT NULL
    WINDOW w AS (PARTITION BY tid ORDER BY frame RANGE BETWEEN 200 PRECEDING AND CURRENT ROW)""")
Q.on("interp_grid", "t", op.interp_grid, """
    WITH p AS (SELECT * FROM t WHERE x IS NOT NULL AND y IS NOT NULL), s AS (SELECT tid, min(frame) AS a, max(frame) AS b FROM p GROUP BY tid),
    g AS (SELECT tid, unnest(generate_series(CAST(ceil(a / 10) AS BIGINT) * 10, CAST(floor(b / 10) AS BIGINT) * 10, 10)) AS frame FROM s),
    j AS (SELECT g.tid, g.frame, p.frame AS pf, p.x AS px, p.y AS py FROM g ASOF JOIN p ON g.tid = p.tid AND g.frame >= p.frame),
    k AS (SELECT j.*, p.frame AS nf, p.x AS nx, p.y AS ny FROM j ASOF JOIN p ON j.tid = p.tid AND j.frame <= p.frame)
    SELECT tid, CAST(frame AS INTEGER) AS frame, CASE WHEN pf = frame THEN round(px, 4) WHEN nf - pf <= 50 THEN round(px + (frame - pf) / (nf - pf) * (nx - px), 4) END AS x,
        CASE WHEN pf = frame THEN round(py, 4) WHEN nf - pf <= 50 THEN round(py + (frame - pf) / (nf - pf) * (ny - py), 4) END AS y FROM k""")
Q.on("asof_sample", "t", op.asof_sample, """
    WITH p AS (SELECT tid, frame, round(t, 4) AS t FROM t WHERE t IS NOT NULL),
    g AS (SELECT tid, unnest(generate_series(CAST(ceil(min(t) / 5) AS BIGINT), CAST(floor(max(t) / 5) AS BIGINT))) AS i FROM p GROUP BY tid),
    j AS (SELECT g.tid, g.i, p.frame, round(abs(p.t - g.i * 5), 4) AS d FROM g JOIN p ON p.tid = g.tid)
    SELECT tid, CAST(i AS INTEGER) AS i, frame, d FROM (SELECT *, row_number() OVER (PARTITION BY tid, i ORDER BY d, frame) AS k FROM j) WHERE k = 1""")

QUERIES, SQL = Q.queries, Q.sql
