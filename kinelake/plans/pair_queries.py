"""Queries on pairs of tracks, identities and embeddings."""

from __future__ import annotations

from kinelake.operators import pairs as op
from kinelake.plans.registry import Registry

Q = Registry()

_C = "c AS (SELECT clip, tid, frame AS g, x, y, fx, fy, coalesce(conf, 0) AS conf, coalesce(box_h, 0) AS box_h FROM t WHERE x IS NOT NULL AND y IS NOT NULL)"
_TEAM = "team AS (SELECT tid, max(team) AS team FROM tracklets WHERE tid IS NOT NULL GROUP BY tid)"
_P = _C + """,
    p AS (SELECT a.clip, a.g, a.tid AS tid_a, b.tid AS tid_b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, round(a.conf * a.box_h, 6) AS sa, round(b.conf * b.box_h, 6) AS sb
        FROM c a JOIN c b ON a.clip = b.clip AND a.g = b.g AND a.tid < b.tid)"""
_INT = "CAST(g AS INTEGER) AS g"

Q.on("encounter_pairs", "t", op.encounter_pairs, f"WITH {_P} SELECT clip, tid_a, tid_b, count(*) AS n, CAST(min(g) AS INTEGER) AS g0, CAST(max(g) AS INTEGER) AS g1 FROM p WHERE d2 < 2.25 GROUP BY clip, tid_a, tid_b")
Q.on("encounter_events", "t", op.encounter_events, f"""WITH {_P}, n AS (SELECT *, CASE WHEN coalesce(g - lag(g) OVER w, 1000000) > 25 THEN 1 ELSE 0 END AS new FROM p WHERE d2 < 9 WINDOW w AS (PARTITION BY clip, tid_a, tid_b ORDER BY g)),
    v AS (SELECT *, sum(new) OVER (PARTITION BY clip, tid_a, tid_b ORDER BY g ROWS UNBOUNDED PRECEDING) AS event FROM n),
    e AS (SELECT clip, tid_a, tid_b, event, min(g) AS g0, max(g) AS g1 FROM v GROUP BY ALL), l AS (SELECT tid, max(g) AS last_g FROM c GROUP BY tid)
    SELECT clip, tid_a, tid_b, event, CAST(g0 AS INTEGER) AS g0, CAST(g1 AS INTEGER) AS g1,
        g1 = max(g1) OVER (PARTITION BY clip, tid_a, tid_b) AND least(la.last_g, lb.last_g) - g1 <= 50 AS seam_risk
    FROM e JOIN l la ON la.tid = tid_a JOIN l lb ON lb.tid = tid_b""")
Q.on("inframe_dedup", "t", lambda t: op.inframe_dedup(t, clock=op.framed), f"WITH {_P} SELECT DISTINCT clip, {_INT}, CASE WHEN sa >= sb THEN tid_b ELSE tid_a END AS tid FROM p WHERE d2 < 4")
Q.on("tile_antijoin", "t", op.tile_antijoin, f"""WITH {_C} SELECT clip, {_INT}, tid FROM c w WHERE conf < CAST(0.3 AS DOUBLE)
    AND NOT EXISTS (SELECT 1 FROM c s WHERE s.conf >= CAST(0.3 AS DOUBLE) AND s.clip = w.clip AND s.g = w.g AND (w.fx - s.fx) * (w.fx - s.fx) + (w.fy - s.fy) * (w.fy - s.fy) < 784)""")
_O = _C + """, f AS (SELECT clip, g, avg(x) AS mx, avg(y) AS my FROM c GROUP BY clip, g HAVING count(*) >= 2),
    k AS (SELECT c.clip, c.g, c.tid, round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 6) AS d FROM c JOIN f USING (clip, g)),
    o AS (SELECT clip, g, tid AS owner, d FROM (SELECT *, row_number() OVER (PARTITION BY clip, g ORDER BY d, tid) AS i FROM k) WHERE i = 1)"""
_HAND = _O + """, w AS (SELECT *, lag(owner) OVER v AS was, lag(g) OVER v AS wg FROM o WINDOW v AS (PARTITION BY clip ORDER BY g)), h AS (SELECT * FROM w WHERE was <> owner AND g - wg <= 50)"""
Q.on("greedy_owner", "t", op.greedy_owner, f"WITH {_O} SELECT clip, {_INT}, owner, d FROM o")
Q.on("possession_share", "t", op.possession_share, f"WITH {_O}, n AS (SELECT clip, owner, count(*) AS n FROM o GROUP BY clip, owner) SELECT clip, owner, n, round(n / sum(n) OVER (PARTITION BY clip), 6) AS share FROM n")
Q.on("handoff_events", ["t", "tracklets"], op.handoff_events, f"""WITH {_HAND}, {_TEAM} SELECT h.clip, {_INT}, was AS from_tid, owner AS to_tid, CASE WHEN a.team IS NULL OR b.team IS NULL THEN 'unknown' WHEN a.team = b.team THEN 'pass' ELSE 'turnover' END AS kind
    FROM h LEFT JOIN team a ON a.tid = was LEFT JOIN team b ON b.tid = owner""")
Q.on("transition_matrix", "t", op.transition_matrix, f"WITH {_HAND} SELECT clip, least(was, owner) AS a, greatest(was, owner) AS b, count(*) AS n FROM h GROUP BY 1, 2, 3")
_OVER = "SELECT clip, tid_a, tid_b, count(*) AS n, round(quantile_cont(sqrt(d2), 0.5), 4) AS median_d FROM p GROUP BY clip, tid_a, tid_b HAVING count(*) >= {n} AND quantile_cont(sqrt(d2), 0.5) <= {d}"
Q.on("overlap_distance", "t", op.overlap_distance, f"WITH {_P} {_OVER.format(n=5, d=1e9)}")
Q.on("co_distance", "t", lambda t: op.overlap_distance(t, 2, 20.0), f"WITH {_P} {_OVER.format(n=2, d=20)}")
Q.on("coreg_pairs", "t", op.coreg_pairs, f"""WITH {_C}, q AS (SELECT a.clip, a.g, a.tid AS tid_a, b.tid AS tid_b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS d
        FROM c a JOIN c b ON a.clip = b.clip AND a.g = b.g AND a.tid % 2 = 0 AND b.tid % 2 = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY clip, g, tid_a ORDER BY d, tid_b) AS ra, row_number() OVER (PARTITION BY clip, g, tid_b ORDER BY d, tid_a) AS rb FROM q)
    SELECT clip, {_INT}, tid_a, tid_b, d FROM k WHERE ra = 1 AND rb = 1 AND d <= 10""")
_S = """s AS (SELECT clip, tid, count(*) AS n, round(min(t), 4) AS t0, round(max(t), 4) AS t1, arg_min(x, frame) AS x0, arg_min(y, frame) AS y0, arg_max(x, frame) AS x1, arg_max(y, frame) AS y1
        FROM t WHERE x IS NOT NULL AND y IS NOT NULL AND t IS NOT NULL GROUP BY clip, tid)"""
_F = _S + """, f AS (SELECT a.clip, a.tid AS tid_a, b.tid AS tid_b, round(b.t0 - a.t1, 4) AS gap, sqrt((b.x0 - a.x1) * (b.x0 - a.x1) + (b.y0 - a.y1) * (b.y0 - a.y1)) AS dist, a AS a, b AS b
        FROM s a JOIN s b ON a.clip = b.clip AND a.tid <> b.tid AND round(b.t0 - a.t1, 4) BETWEEN 0 AND {gap})"""
_LINK = _F.format(gap=8) + ", e AS (SELECT clip, tid_a, tid_b, gap, round(dist, 4) AS dist, round(round(dist / gap, 6), 4) AS req_speed FROM f WHERE gap > 0 AND round(dist / gap, 6) <= 8)"
Q.on("link_candidates", "t", op.link_candidates, f"WITH {_LINK} SELECT * FROM e")
_V = "CASE WHEN a.t1 > a.t0 THEN (a.{c}1 - a.{c}0) / (a.t1 - a.t0) ELSE 0 END"
_CONT = _F.format(gap=8) + f""", u AS (SELECT *, b.x0 - a.x1 - {_V.format(c='x')} * gap AS ex, b.y0 - a.y1 - {_V.format(c='y')} * gap AS ey FROM f),
    e AS (SELECT clip, tid_a, tid_b, gap, round(round(sqrt(ex * ex + ey * ey), 6) + CAST(0.3 AS DOUBLE) * gap, 4) AS cost FROM u WHERE dist <= 8 * greatest(gap, CAST(0.2 AS DOUBLE)) AND round(sqrt(ex * ex + ey * ey), 6) <= 10)"""
Q.on("continuation_candidates", "t", op.continuation_candidates, f"WITH {_CONT} SELECT * FROM e")
Q.on("gta_edges", ["t", "tracklets"], op.gta_edges, f"""WITH {_F.format(gap=5)}, team AS (SELECT tid, max(team) AS team FROM tracklets WHERE tid IS NOT NULL GROUP BY tid)
    SELECT f.clip, tid_a, tid_b, gap, round(round(dist / greatest(gap, 1 / 25.0::DOUBLE), 6), 4) AS req_speed FROM f LEFT JOIN team ta ON ta.tid = tid_a LEFT JOIN team tb ON tb.tid = tid_b
    WHERE (ta.team IS NULL OR tb.team IS NULL OR ta.team = tb.team) AND round(dist / greatest(gap, 1 / 25.0::DOUBLE), 6) <= 7""")
Q.on("knn_prune", "t", op.knn_prune, f"""WITH {_LINK}, d AS (SELECT *, tid_a AS "end" FROM e UNION ALL SELECT *, tid_b FROM e),
    k AS (SELECT *, row_number() OVER (PARTITION BY "end" ORDER BY req_speed, tid_a, tid_b) AS ks, row_number() OVER (PARTITION BY "end" ORDER BY gap, tid_a, tid_b) AS kg FROM d)
    SELECT DISTINCT tid_a, tid_b FROM k WHERE ks <= 4 OR kg <= 2""")
Q.on("audit_seams", "t", op.audit_seams, f"""WITH {_CONT}, k AS (SELECT *, row_number() OVER w AS k, lead(cost) OVER w AS second FROM e WINDOW w AS (PARTITION BY tid_a ORDER BY cost, tid_b))
    SELECT clip, tid_a, tid_b, cost, round(second - cost, 4) AS margin, coalesce(round(second - cost, 4) < CAST(0.2 AS DOUBLE), FALSE) AS suspect FROM k WHERE k = 1""")
_X = _P + """, d AS (SELECT clip, tid_a, tid_b, g, round(sqrt(d2), 6) AS d FROM p),
    m AS (SELECT clip, tid_a, tid_b, d AS min_d, g AS mg FROM (SELECT *, row_number() OVER (PARTITION BY clip, tid_a, tid_b ORDER BY d, g) AS i FROM d) WHERE i = 1 AND d <= 2),
    x AS (SELECT clip, tid_a, tid_b, any_value(mg) AS g, any_value(min_d) AS min_d FROM d JOIN m USING (clip, tid_a, tid_b) GROUP BY clip, tid_a, tid_b
        HAVING max(CASE WHEN g < mg THEN d END) > 3 AND max(CASE WHEN g > mg THEN d END) > 3)"""
Q.on("crossings", "t", op.crossings, f"WITH {_X} SELECT clip, tid_a, tid_b, {_INT}, min_d FROM x")
Q.on("resolves", "t", op.resolves, f"""WITH {_X} SELECT x.clip, tid_a, tid_b, count(DISTINCT o.tid) AS n_witnesses FROM x JOIN c ON c.clip = x.clip AND c.tid = x.tid_a AND c.g = x.g JOIN c o ON o.clip = x.clip
    WHERE o.tid <> tid_a AND o.tid <> tid_b AND abs(o.g - x.g) <= 20 AND (o.x - c.x) * (o.x - c.x) + (o.y - c.y) * (o.y - c.y) <= 64 GROUP BY x.clip, tid_a, tid_b""")
Q.on("comotion_affinity", "t", op.comotion_affinity, f"""WITH {_C}, v AS (SELECT clip, tid, g, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy, g - lag(g) OVER w AS dg FROM c WINDOW w AS (PARTITION BY tid ORDER BY g)),
    n AS (SELECT *, sqrt(vx * vx + vy * vy) AS vn FROM v WHERE dg <= 10 AND vx * vx + vy * vy > 0)
    SELECT a.clip, a.tid AS tid_a, b.tid AS tid_b, count(*) AS n, round(greatest(avg((a.vx * b.vx + a.vy * b.vy) / (a.vn * b.vn)), 0), 5) AS affinity
    FROM n a JOIN n b ON a.clip = b.clip AND a.g = b.g AND a.tid < b.tid GROUP BY ALL HAVING count(*) >= 5""")
_PL = "pl AS (SELECT tid, min(player_id) AS player_id FROM connect_labels WHERE tid IS NOT NULL AND player_id >= 0 GROUP BY tid)"
Q.on("label_join", ["tracklets", "connect_labels"], op.label_join, f"WITH {_PL} SELECT k.tid, coalesce(player_id, -1) AS player_id FROM (SELECT DISTINCT tid FROM tracklets WHERE tid IS NOT NULL) k LEFT JOIN pl USING (tid)")
Q.on("spurious_anti", "t", op.spurious_anti, "SELECT clip, count(*) AS n FROM t WHERE tid NOT IN (SELECT tid FROM t GROUP BY tid HAVING count(*) < 20) GROUP BY clip")
_SP = "s AS (SELECT clip, tid, min(frame) AS f0, max(frame) AS f1, player_id FROM t JOIN pl USING (tid) GROUP BY clip, tid, player_id)"
Q.on("over_merge_check", ["t", "connect_labels"], op.over_merge_check, f"""WITH {_PL}, {_SP}
    SELECT a.player_id, a.tid AS tid_a, b.tid AS tid_b FROM s a JOIN s b ON a.clip = b.clip AND a.player_id = b.player_id AND a.tid < b.tid AND a.f0 <= b.f1 AND b.f0 <= a.f1""")
Q.on("min_gap_speed", ["t", "connect_labels"], op.min_gap_speed, f"""WITH {_PL}, {_S},
    n AS (SELECT s.*, player_id, lead(tid) OVER w AS nt, lead(t0) OVER w AS nt0, lead(x0) OVER w AS nx, lead(y0) OVER w AS ny FROM s JOIN pl USING (tid) WINDOW w AS (PARTITION BY clip, player_id ORDER BY t0, tid))
    SELECT clip, player_id, tid AS tid_a, nt AS tid_b, round(nt0 - t1, 4) AS gap_s, round(sqrt((nx - x1) * (nx - x1) + (ny - y1) * (ny - y1)) / greatest(round(nt0 - t1, 4), CAST(0.2 AS DOUBLE)), 4) AS speed FROM n WHERE nt IS NOT NULL""")
Q.on("player_gaps", ["t", "connect_labels"], op.player_gaps, f"""WITH {_PL}, {_SP}, g AS (SELECT player_id, lead(f0) OVER (PARTITION BY clip, player_id ORDER BY f0, tid) - f1 AS gap FROM s)
    SELECT player_id, count(*) AS n_gaps, sum(gap) AS total, sum(CASE WHEN gap <= 25 THEN 1 ELSE 0 END) AS bridgeable FROM g WHERE gap > 0 GROUP BY player_id""")
Q.on("trim_overlaps", ["t", "connect_labels"], op.trim_overlaps, f"""WITH {_PL}, {_C}, f AS (SELECT c.*, player_id, min(g) OVER (PARTITION BY c.tid) AS first_g FROM c JOIN pl ON pl.tid = c.tid)
    SELECT player_id, tid, {_INT} FROM (SELECT *, row_number() OVER (PARTITION BY clip, player_id, g ORDER BY first_g, tid) AS k FROM f) WHERE k > 1""")
Q.on("cosine_pairs", "embeddings", op.cosine_pairs, """
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) > 0)
    SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(1 - list_cosine_similarity(a.v, b.v), 5) AS distance FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE round(1 - list_cosine_similarity(a.v, b.v), 9) <= CAST(0.65 AS DOUBLE)""")
Q.on("medoid", "embeddings", op.medoid, """
    WITH e AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL),
    s AS (SELECT label, i, sum(v) AS s FROM e GROUP BY label, i), d AS (SELECT label, vec_id, round(sum(v * s), 6) AS score FROM e JOIN s USING (label, i) GROUP BY label, vec_id)
    SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM d) WHERE k = 1""")
Q.on("team_shape", "t", op.team_shape, f"""WITH {_P}, n AS (SELECT clip, g, tid_a AS tid, d2 FROM p UNION ALL SELECT clip, g, tid_b, d2 FROM p), nn AS (SELECT clip, g, tid, sqrt(min(d2)) AS nn FROM n GROUP BY clip, g, tid),
    m AS (SELECT clip, g, avg(nn) AS nn FROM nn GROUP BY clip, g), b AS (SELECT clip, g, count(*) AS k, max(x) - min(x) AS depth, max(y) - min(y) AS width FROM c GROUP BY clip, g HAVING count(*) >= 2)
    SELECT clip, {_INT}, k, round(depth, 4) AS depth, round(width, 4) AS width, round(nn, 4) AS nn_spacing FROM b JOIN m USING (clip, g)""")

QUERIES, SQL = Q.queries, Q.sql
