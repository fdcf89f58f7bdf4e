"""Queries on the catalog, the registry, exports and event windows."""

from __future__ import annotations

from kinelake.operators import catalog as op
from kinelake.plans.registry import Registry

Q = Registry()

_M = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scanned_at DESC NULLS LAST, views DESC NULLS LAST, venue NULLS FIRST) AS k FROM match_records WHERE id IS NOT NULL) WHERE k = 1)"
_N = _M + """, n AS (SELECT id, CASE WHEN trim(venue) IN ('-', '?', 'bilinmiyor', 'unknown', '') THEN NULL ELSE trim(venue) END AS venue, n_cams, coalesce(views, 0) AS views, CASE WHEN trim(title) <> '' THEN title END AS title FROM m),
    k AS (SELECT *, lower(replace(regexp_replace(venue, '\\s+', ' ', 'g'), 'İ', 'i')) AS venue_key FROM n WHERE venue IS NOT NULL)"""
_C = "c AS (SELECT * FROM camera_registry WHERE camera_id IS NOT NULL)"
_URL = r"/([a-z]+\d+)s(\d+)/([a-z]+)/(\d{14})\.([A-Za-z]?\d+)-(\d+)\."

Q.on("normalize_text", "match_records", op.normalize_text, f"""WITH {_M}
    SELECT id, regexp_replace(trim(regexp_replace(lower(replace(venue, 'İ', 'i')), '\\s+', ' ', 'g')), '[.…]+$', '') AS venue_key,
        regexp_replace(regexp_replace(lower(translate(venue, 'ıİşŞğĞüÜöÖçÇ', 'iissgguuoocc')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM m WHERE venue IS NOT NULL""")
Q.on("url_parse", "match_records", op.url_parse, f"""WITH {_M}, g AS (SELECT id, first_url AS u FROM m WHERE first_url IS NOT NULL)
    SELECT id, nullif(regexp_extract(u, '{_URL}', 1), '') AS facility, nullif(regexp_extract(u, '{_URL}', 2), '') AS server, nullif(regexp_extract(u, '{_URL}', 4), '') AS stamp,
        nullif(regexp_extract(u, '{_URL}', 5), '') AS pitch_code, coalesce(try_cast(nullif(regexp_extract(u, '{_URL}', 6), '') AS INTEGER), 1) AS cam FROM g""")
Q.on("classify_rules", "camera_registry", op.classify_rules, f"""WITH {_C}
    SELECT camera_id, CASE WHEN upper(saha_code) LIKE 'K%' THEN 'indoor' WHEN upper(saha_code) LIKE 'A%' THEN 'outdoor' WHEN lower(venue_name) LIKE '%kapalı%' THEN 'indoor' WHEN lower(venue_name) LIKE '%açık%' THEN 'outdoor' ELSE 'unknown' END AS environment,
        CASE WHEN upper(saha_code) LIKE 'K%' OR upper(saha_code) LIKE 'A%' THEN 'code' WHEN lower(venue_name) LIKE '%kapalı%' OR lower(venue_name) LIKE '%açık%' THEN 'name' ELSE 'none' END AS source,
        CASE WHEN upper(saha_code) LIKE 'K%' OR upper(saha_code) LIKE 'A%' THEN CAST(0.9 AS DOUBLE) WHEN lower(venue_name) LIKE '%kapalı%' OR lower(venue_name) LIKE '%açık%' THEN CAST(0.6 AS DOUBLE) ELSE 0 END AS confidence FROM c""")
Q.on("parse_dates", "match_records", op.parse_dates, f"""WITH {_M}
    SELECT id, CASE WHEN regexp_matches(date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN substr(date, 1, 10)
        WHEN regexp_matches(date, '^\\d{{1,2}}[./]\\d{{1,2}}[./]\\d{{4}}$') THEN concat_ws('-', regexp_extract(date, '(\\d{{4}})$', 1), lpad(regexp_extract(date, '^\\d{{1,2}}[./](\\d{{1,2}})', 1), 2, '0'), lpad(regexp_extract(date, '^(\\d{{1,2}})', 1), 2, '0')) END AS day FROM m""")
Q.on("normalize_row", "match_records", op.normalize_row, f"WITH {_N} SELECT * FROM n")
Q.on("by_venue", "match_records", op.by_venue, f"WITH {_N} SELECT venue_key, count(*) AS n, sum(views) AS views, max(n_cams) AS max_cams FROM k GROUP BY venue_key")
Q.on("stratified_sample", "match_records", op.stratified_sample, f"""WITH {_N},
    v AS (SELECT venue_key, row_number() OVER (ORDER BY count(*) DESC, max(n_cams) DESC NULLS LAST, max(views) DESC, venue_key) AS venue_rank FROM k GROUP BY venue_key),
    j AS (SELECT id, venue_key, row_number() OVER (PARTITION BY venue_key ORDER BY n_cams DESC NULLS LAST, views DESC, id) AS round, venue_rank FROM k JOIN v USING (venue_key) WHERE venue_rank <= 20)
    SELECT * FROM j WHERE round <= 3""")
Q.on("venue_split", "match_records", op.venue_split, f"""WITH {_N}, v AS (SELECT venue_key, count(*) AS n FROM k GROUP BY venue_key),
    r AS (SELECT *, row_number() OVER (ORDER BY least(n, 1000), venue_key) AS i, count(*) OVER () AS total FROM v)
    SELECT venue_key, n, CASE WHEN i <= greatest(1, total // 5) THEN 'val' ELSE 'train' END AS split FROM r""")
Q.on("alias_lookup", ["match_records", "camera_registry"], op.alias_lookup, f"""WITH {_M}, v AS (SELECT * FROM camera_registry WHERE trim(venue_id) <> ''),
    a AS (SELECT venue_id, venue_name AS n, 0 AS prio FROM v UNION ALL SELECT venue_id, unnest(aliases), 1 FROM v),
    b AS (SELECT n, venue_id, prio FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY prio, venue_id) AS i FROM a WHERE n IS NOT NULL) WHERE i = 1)
    SELECT id, venue_id, CASE prio WHEN 0 THEN 'name' ELSE 'alias' END AS "by" FROM m JOIN b ON venue = n""")
_MED = "calib_qa.median_px"
Q.on("calib_gate", "camera_registry", op.calib_gate, f"""WITH {_C}, g AS (SELECT camera_id, concat_ws(',', CASE WHEN calib_qa IS NULL THEN 'missing_qa' END, CASE WHEN calib_qa IS NOT NULL AND ({_MED} IS NULL OR isnan({_MED})) THEN 'no_median' END,
        CASE WHEN NOT isnan({_MED}) AND {_MED} > 20 THEN 'median_px' END, CASE WHEN calib_qa.n_landmarks < 6 THEN 'landmarks' END) AS reasons FROM c)
    SELECT camera_id, reasons, reasons = '' AS accepted FROM g""")
Q.on("attach_calibration", "camera_registry", op.attach_calibration, f"""WITH {_C}
    SELECT camera_id, CASE WHEN calib_path IS NULL OR trim(calib_path) = '' THEN 'missing' WHEN calib_qa IS NOT NULL AND {_MED} IS NOT NULL AND NOT isnan({_MED}) AND {_MED} <= 15 AND coalesce(calib_qa.n_landmarks, 0) >= 6 THEN 'linked' ELSE 'rejected' END AS status FROM c""")
Q.on("median_only_gate", "camera_registry", op.median_only_gate, f"WITH {_C} SELECT camera_id, NOT coalesce({_MED} > 20 AND NOT isnan({_MED}), FALSE) AS accepted FROM c")
Q.on("scale_state", "camera_registry", op.scale_state, f"""WITH {_C} SELECT camera_id, CASE WHEN scale_anchor IS NULL THEN 'relative' WHEN coalesce(scale_anchor.passed, FALSE) THEN 'exact' ELSE 'approx' END AS quality,
    CASE WHEN scale_anchor IS NULL THEN 'relative_m' WHEN coalesce(scale_anchor.passed, FALSE) THEN 'm' ELSE 'm (approx)' END AS unit FROM c""")
Q.on("dims_precedence", "camera_registry", op.dims_precedence, f"""WITH {_C} SELECT camera_id, CASE WHEN dims_source = 'published' THEN 4 WHEN dims_source = 'satellite_measured' AND covered = 'open' THEN 3 WHEN dims_source = 'physical_pacing' THEN 2 WHEN coalesce(len(dims_m), 0) = 2 THEN 1 ELSE 0 END AS dims_rank,
    coalesce(dims_confidence, 0) >= CAST(0.6 AS DOUBLE) AND coalesce(scale_anchor.passed, FALSE) AS claim_allowed FROM c""")
Q.on("field_format", "camera_registry", op.field_format, f"""WITH {_C}, a AS (SELECT camera_id, dims_m[1] / dims_m[2] AS a FROM c WHERE len(dims_m) = 2 AND dims_m[2] > 0),
    f AS (SELECT * FROM (VALUES (0, '5v5', 40 / 20), (1, '7v7', 55 / 35), (2, '8v8', 68 / 45)) v(i, format, ratio))
    SELECT camera_id, round(a, 6) AS aspect, format FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY round(abs(a - ratio), 9), i) AS k FROM a, f) WHERE k = 1""")
Q.on("impossible_catalog", "camera_registry", op.impossible_catalog, f"""WITH {_C}, d AS (SELECT camera_id, dims_m[1] AS l, dims_m[2] AS w FROM c WHERE len(dims_m) = 2 AND dims_m[2] > 0),
    g AS (SELECT camera_id, concat_ws(',', CASE WHEN l < w THEN 'turned' END, CASE WHEN l / w > CAST(2.2 AS DOUBLE) THEN 'too_long' END, CASE WHEN l < 20 OR l > 110 THEN 'length' END, CASE WHEN w < 12 OR w > 75 THEN 'width' END) AS reasons FROM d)
    SELECT camera_id, reasons, reasons <> '' AS impossible FROM g""")
Q.on("registry_rank", "camera_registry", op.registry_rank, f"""WITH {_C} SELECT camera_id, round(CASE WHEN coalesce(available, FALSE) THEN CAST(0.35 AS DOUBLE) * CASE WHEN coalesce(metric_claim_allowed, FALSE) THEN 1 ELSE 0 END + CAST(0.2 AS DOUBLE) * coalesce(frame_coverage.covered_fraction_est, 0)
        + CAST(0.2 AS DOUBLE) * least(coalesce(views_total, 0) / 5000, 1) + CAST(0.15 AS DOUBLE) * least(greatest((20 - coalesce({_MED}, 20)) / 20, 0), 1) ELSE 0 END, 6) AS score FROM c ORDER BY score DESC, camera_id LIMIT 50""")
Q.on("registry_build", "camera_registry", op.registry_build, "SELECT facility_token, saha_code, count(*) AS n, sum(coalesce(views_total, 0)) AS views, max(n_cams) AS max_cams FROM camera_registry WHERE facility_token IS NOT NULL GROUP BY 1, 2")
Q.on("registry_upsert", ["camera_registry", "t"], op.registry_upsert, f"""WITH {_C}, s AS (SELECT cam AS camera_id, count(*) AS seen FROM t GROUP BY cam)
    SELECT camera_id, coalesce(calib_status, 'new') AS calib_status, coalesce(sample_count, 0) + coalesce(seen, 0) AS samples FROM c FULL JOIN s USING (camera_id)""")
Q.on("best_verdict", "camera_registry", op.best_verdict, f"""WITH g AS (SELECT venue_id, CASE WHEN {_MED} IS NULL THEN 4 WHEN {_MED} <= 6 THEN 0 WHEN {_MED} <= 10 THEN 1 WHEN {_MED} <= 15 THEN 2 ELSE 3 END AS k FROM camera_registry WHERE trim(venue_id) <> '')
    SELECT venue_id, ['GOOD', 'DECENT', 'ROUGH', 'BAD', 'UNSOLVABLE'][min(k) + 1] AS verdict, count(*) AS n FROM g GROUP BY venue_id""")
Q.on("resolve_candidate", "camera_registry", op.resolve_candidate, """WITH g AS (SELECT venue_id, camera_id, coalesce(cam_index, 999) AS i, coalesce(frame_coverage.covered_fraction_est, 0) AS f FROM camera_registry WHERE trim(venue_id) <> '' AND camera_id IS NOT NULL)
    SELECT venue_id, camera_id, f >= CAST(0.9 AS DOUBLE) AS sufficient FROM (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY CASE WHEN f < CAST(0.9 AS DOUBLE) THEN 1 ELSE 0 END, CASE WHEN f >= CAST(0.9 AS DOUBLE) THEN i END NULLS FIRST, f DESC, i, camera_id) AS k FROM g) WHERE k = 1""")
Q.on("bit_distance", "match_records", op.bit_distance, f"""WITH {_M}, h AS (SELECT venue, id, CAST(id AS BIGINT) * 2654435761 % 4294967296 AS h FROM m WHERE venue IS NOT NULL), d AS (SELECT id, bit_count(xor(h, lag(h) OVER (PARTITION BY venue ORDER BY id))) AS dist FROM h)
    SELECT id, dist, dist > 10 AS keep FROM d WHERE dist IS NOT NULL""")
Q.on("coco_export", "t", op.coco_export, """WITH b AS (SELECT *, dense_rank() OVER (PARTITION BY clip ORDER BY frame) AS image_id, least(greatest(fx - box_w / 2, 0), 1280) AS x1, least(greatest(fy - box_h, 0), 720) AS y1, least(greatest(fx + box_w / 2, 0), 1280) AS x2, least(greatest(fy, 0), 720) AS y2
        FROM t WHERE frame % 50 = 0 AND box_h > 0 AND box_w > 0 AND fx IS NOT NULL AND fy IS NOT NULL)
    SELECT clip, image_id, tid, round(x1, 3) AS bbox_x, round(y1, 3) AS bbox_y, round(x2 - x1, 3) AS bbox_w, round(y2 - y1, 3) AS bbox_h, round((x2 - x1) * (y2 - y1), 2) AS area FROM b""")
Q.on("page_extract", "documents", op.page_extract, r"""
    SELECT doc_id, len(regexp_extract_all(text, '\[[0-9]{2}:[0-9]{2}\]')) AS stamps, len(regexp_extract_all(text, '## [0-9]')) AS headings, len(regexp_extract_all(text, '<p>')) AS paragraphs,
        nullif(regexp_extract(text, '\[([0-9]{2}:[0-9]{2})\]', 1), '') AS first_stamp FROM documents WHERE text IS NOT NULL AND text <> ''""")
Q.on("ledger_summary", "events", op.ledger_summary, """
    WITH e AS (SELECT *, CASE event_type WHEN 'error' THEN 'rollback' WHEN 'purchase' THEN 'keep' ELSE 'observe' END AS decision FROM events),
    l AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY ts DESC, event_id DESC) AS k FROM e)
    SELECT decision, count(*) AS n, max(CASE WHEN k = 1 THEN value END) AS latest, count(DISTINCT user_id) AS users FROM l GROUP BY decision""")
Q.on("tumbling_parity", "events", op.tumbling_parity, "SELECT epoch_us(ts) // 3600000000 * 3600 AS start_s, count(*) AS n, count(DISTINCT user_id) AS users, count(*) % 2 = 1 AS odd FROM events GROUP BY 1")
Q.on("sliding_median", "events", op.sliding_median, """
    WITH w AS (SELECT value, (epoch_us(ts) // 7200000000 - k) * 7200 AS start_s FROM events, (SELECT unnest([0, 1, 2]) AS k))
    SELECT start_s, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median_value FROM w GROUP BY start_s""")
Q.on("user_sessions", "events", op.user_sessions, """
    WITH s AS (SELECT user_id, epoch_us(ts) AS u, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY u ROWS UNBOUNDED PRECEDING) AS k FROM s)
    SELECT user_id, min(u) AS start_us, count(*) AS n FROM n GROUP BY user_id, k""")

QUERIES, SQL = Q.queries, Q.sql
