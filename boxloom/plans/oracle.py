"""SQL for DuckDB that gives the same rows as the queries beside it."""

from boxloom.functions.text import COLOURS, CONFIG_HEAD, CONFIG_MIDDLE, CONFIG_TAIL

_BOXES = """
b0 AS (SELECT l_orderkey // 8 AS sample_id, (l_orderkey % 2)::INT AS side, l_linenumber % 2 AS m, l_orderkey, l_linenumber, l_returnflag AS label,
  (l_partkey * 7 % 60)::DOUBLE AS x1, (l_suppkey * 13 % 60)::DOUBLE AS y1,
  (l_partkey * 7 % 60 + 10 + l_quantity::BIGINT % 20)::DOUBLE AS x2, (l_suppkey * 13 % 60 + 10 + l_linenumber % 7 * 3)::DOUBLE AS y2 FROM lineitem),
b AS (SELECT *, (row_number() OVER (PARTITION BY sample_id, side ORDER BY l_orderkey, l_linenumber, label, x1, y1, x2, y2) - 1)::INT AS idx FROM b0)"""


def _cands(models: bool = False, aware: bool = True) -> str:
    pre = _BOXES
    if models:
        pre += """,
bm0 AS (SELECT b.*, 'm' || m AS model FROM b WHERE side = 1 UNION ALL SELECT b.*, model FROM b, (VALUES ('m0'), ('m1')) t(model) WHERE side = 0),
bm AS (SELECT * FROM bm0)"""
    else:
        pre += ",\nbm AS (SELECT b.*, '' AS model FROM b)"
    return pre + f""",
i AS (SELECT g.model, g.sample_id, g.idx AS gi, p.idx AS pi,
  greatest(0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0, least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS inter,
  (g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) AS both_
  FROM bm g JOIN bm p ON g.model = p.model AND g.sample_id = p.sample_id {'AND g.label = p.label' if aware else ''} AND g.side = 0 AND p.side = 1),
c0 AS (SELECT model, sample_id, gi, pi, inter / (both_ - inter) AS iou FROM i),
c AS (SELECT *, row_number() OVER (PARTITION BY model, sample_id ORDER BY iou DESC, gi, pi) AS k FROM c0 WHERE iou >= 1e-9),
r AS (SELECT DISTINCT model, sample_id, 0::BIGINT AS k, []::INT[] AS ug, []::INT[] AS up, -1 AS gi, -1 AS pi, 0.0::DOUBLE AS iou, false AS ok FROM c
  UNION ALL
  SELECT r.model, r.sample_id, c.k, CASE WHEN f THEN list_append(ug, c.gi) ELSE ug END, CASE WHEN f THEN list_append(up, c.pi) ELSE up END, c.gi, c.pi, c.iou, f
  FROM r JOIN c ON c.model = r.model AND c.sample_id = r.sample_id AND c.k = r.k + 1,
  LATERAL (SELECT NOT list_contains(r.ug, c.gi) AND NOT list_contains(r.up, c.pi) AS f) l),
mt AS (SELECT model, sample_id, gi, pi, iou FROM r WHERE ok)"""


_METRICS = "WITH RECURSIVE" + _cands(True) + """,
th AS (SELECT * FROM (VALUES (0.1::DOUBLE, 0), (0.25, 1), (0.5, 2), (0.75, 3), (0.9, 4)) t(threshold, no)),
n AS (SELECT model, count(*) FILTER (WHERE side = 0) AS n_gt, count(*) FILTER (WHERE side = 1) AS n_pred FROM bm GROUP BY model),
s AS (SELECT n.model, threshold, no, n_gt, n_pred, count(iou) FILTER (WHERE iou >= threshold) AS tp, sum(iou) FILTER (WHERE iou >= threshold) AS si, sum(iou) AS st, count(iou) AS nt
  FROM n CROSS JOIN th LEFT JOIN mt ON mt.model = n.model GROUP BY ALL),
pr AS (SELECT *, n_pred - tp AS fp, n_gt - tp AS fn, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END AS precision, CASE WHEN n_gt > 0 THEN tp / n_gt ELSE 0 END AS recall FROM s),
me AS (SELECT model, threshold, no, tp, fp, fn, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
  CASE WHEN tp > 0 THEN si / tp ELSE 0 END AS mean_iou_tp, CASE WHEN n_gt > 0 THEN st / n_gt ELSE 0 END AS miou_gt_penalized, CASE WHEN nt > 0 THEN st / nt ELSE 0 END AS mean_iou_positive_matches FROM pr)
"""
_IMAGES = "im AS (SELECT o_orderkey AS image_id, (o_orderkey % 5 * 128 + 640)::INT AS width, (o_orderkey % 3 * 120 + 480)::INT AS height FROM orders)"
_RAW = _IMAGES + """,
rb AS (SELECT image_id, width, height, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, (l_suppkey % 30)::INT AS category_id, (l_partkey % width - 20)::DOUBLE AS x,
  (l_suppkey * 11 % height - 10)::DOUBLE AS y, l_quantity * 3.3::DOUBLE AS w, l_linenumber * 9.7::DOUBLE - 9.7::DOUBLE AS h FROM lineitem JOIN im ON l_orderkey = image_id),
bx AS (SELECT *, floor(greatest(0, least(width, x)))::BIGINT AS x1, floor(greatest(0, least(height, y)))::BIGINT AS y1,
  ceil(greatest(0, least(width, x + w)))::BIGINT AS x2, ceil(greatest(0, least(height, y + h)))::BIGINT AS y2 FROM rb),
nm AS (SELECT bx.*, n_name AS class FROM bx LEFT JOIN nation ON n_nationkey = category_id)"""
_ANS = _BOXES + """,
it AS (SELECT sample_id, string_agg('<' || label || ',' || round_even(x1 / 160 * 1000, 0)::BIGINT || ',' || round_even(y1 / 160 * 1000, 0)::BIGINT || ','
  || round_even(x2 / 160 * 1000, 0)::BIGINT || ',' || round_even(y2 / 160 * 1000, 0)::BIGINT || '>', ';' ORDER BY idx) AS t FROM b WHERE side = 1 GROUP BY sample_id),
cl AS (SELECT sample_id, CASE WHEN sample_id % 17 = 0 THEN 'no boxes in sight' WHEN sample_id % 13 = 0 THEN '<none>' ELSE t END AS cleaned FROM it)"""

ORACLE = {
    "metrics_by_threshold": _METRICS + "SELECT model, threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(mean_iou_tp, 6) AS mean_iou_tp, round(miou_gt_penalized, 6) AS miou_gt_penalized, round(mean_iou_positive_matches, 6) AS mean_iou_positive_matches FROM me",
    "summary_best_f1": _METRICS + "SELECT model, threshold AS best_threshold, round(f1, 6) AS best_f1, round(precision, 6) AS best_precision, round(recall, 6) AS best_recall, round(miou_gt_penalized, 6) AS miou_gt_penalized, round(mean_iou_positive_matches, 6) AS mean_iou_positive_matches FROM me QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold DESC, no) = 1",
    "csv_union_best": _METRICS + "SELECT model, threshold AS best_threshold, round(f1, 6) AS best_f1, round(precision, 6) AS best_precision, round(recall, 6) AS best_recall, round(miou_gt_penalized, 6) AS miou_gt_penalized, round(mean_iou_positive_matches, 6) AS mean_iou_positive_matches, CASE WHEN no >= 2 THEN round(mean_iou_tp, 6) END AS mean_iou_tp, tp, fp, fn FROM me QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold DESC, no) = 1",
    "iou_pairs": "WITH" + _cands().split(",\nc AS (")[0] + " SELECT sample_id, gi AS gt_idx, pi AS pred_idx, round(iou, 9) AS iou FROM c0 WHERE iou >= 0.5",
    "match_greedy": "WITH RECURSIVE" + _cands() + " SELECT sample_id, gi AS gt_idx, pi AS pred_idx, round(iou, 9) AS iou FROM mt",
    "match_class_agnostic": "WITH RECURSIVE" + _cands(aware=False) + " SELECT sample_id, gi AS gt_idx, pi AS pred_idx, round(iou, 9) AS iou FROM mt",
    "box_status": "WITH RECURSIVE" + _cands() + """, h AS (SELECT * FROM mt WHERE iou >= 0.5)
SELECT b.sample_id, CASE WHEN side = 0 THEN 'gt' ELSE 'pred' END AS side, idx, CASE WHEN iou IS NOT NULL THEN 'TP' WHEN side = 0 THEN 'FN' ELSE 'FP' END AS status,
  CASE WHEN iou IS NOT NULL AND side = 1 THEN 'TP ' || label || printf(' | IoU=%.2f', iou) WHEN iou IS NOT NULL THEN 'GT ' || label WHEN side = 0 THEN 'FN ' || label ELSE 'FP ' || label END AS text, x1, y2
FROM b LEFT JOIN h ON h.sample_id = b.sample_id AND CASE WHEN side = 0 THEN gi ELSE pi END = idx""",
    "outer_align": "WITH" + _BOXES + " SELECT sample_id, (count(*) FILTER (WHERE side = 0))::INT AS n_gt, (count(*) FILTER (WHERE side = 1))::INT AS n_pred FROM b GROUP BY sample_id",
    "xywh_clip": "WITH " + _RAW + " SELECT image_id, p, s, n, x1, y1, x2, y2, x1 < x2 AND y1 < y2 AS valid, round_even((x1 + x2) / 2, 0)::BIGINT AS cx, round_even((y1 + y2) / 2, 0)::BIGINT AS cy FROM bx",
    "yolo_to_xywh": "WITH " + _RAW + """, u AS (SELECT *, (p * 37 % 1000) / 1000 AS a, (s * 91 % 1000) / 1000 AS b, (p * 11 % 1000) / 1000 AS c, (n * 130 % 1000) / 1000 AS e FROM rb),
v AS (SELECT *, greatest(0, a * width - c * width / 2) AS xx, greatest(0, b * height - e * height / 2) AS yy FROM u)
SELECT image_id, p, s, n, round(xx, 6) AS x, round(yy, 6) AS y, round(greatest(0, least(c * width, width - xx)), 6) AS w, round(greatest(0, least(e * height, height - yy)), 6) AS h FROM v""",
    "normalize_text": "WITH" + _BOXES + " SELECT sample_id, side, idx, round_even(x1 / 160 * 1000, 0)::BIGINT || ',' || round_even(y1 / 160 * 1000, 0)::BIGINT || ',' || round_even(x2 / 160 * 1000, 0)::BIGINT || ',' || round_even(y2 / 160 * 1000, 0)::BIGINT AS txt FROM b",
    "denormalize_clip": "WITH " + _RAW + """, q AS (SELECT *, round_even((p * 7 % 1300 - 100) / 1000 * width, 0)::BIGINT AS xa, round_even((s * 13 % 1300 - 100) / 1000 * height, 0)::BIGINT AS ya,
  round_even((p * 3 % 1300 - 100) / 1000 * width, 0)::BIGINT AS xb, round_even((n * 170) / 1000 * height, 0)::BIGINT AS yb FROM rb)
SELECT image_id, p, s, n, greatest(0, least(width - 1, least(xa, xb))) AS x1, greatest(0, least(height - 1, least(ya, yb))) AS y1, greatest(1, least(width, greatest(xa, xb))) AS x2, greatest(1, least(height, greatest(ya, yb))) AS y2 FROM q""",
    "sanitize_labels": "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(trim(p_name || ' /' || p_type), '[^A-Za-z0-9_.:-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS label_name FROM part",
    "label_table": """WITH a AS (SELECT n_name AS label, 'nation ' || n_name AS description, 0 AS s, n_nationkey::BIGINT AS o FROM nation UNION ALL SELECT p_brand, NULL, 1, p_partkey FROM part),
c AS (SELECT regexp_replace(regexp_replace(regexp_replace(trim(label), '[^A-Za-z0-9_.:-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS label_name, description, s, o FROM a),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY label_name ORDER BY s, o) = 1)
SELECT (row_number() OVER (ORDER BY s, o, label_name))::INT AS label_id, label_name, description FROM f""",
    "label_collisions": "WITH r AS (SELECT DISTINCT unnest(list_slice([p_brand, replace(p_brand, '#', ' '), '_' || replace(p_brand, '#', '__')], 1, p_partkey % 3 + 1)) AS label FROM part) SELECT regexp_replace(regexp_replace(regexp_replace(trim(label), '[^A-Za-z0-9_.:-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS label_name, count(*) AS n FROM r GROUP BY 1 HAVING count(*) > 1",
    "invalid_counts": "WITH " + _RAW + """, v AS (SELECT image_id, class IS NOT NULL AND x1 < x2 AND y1 < y2 AS ok FROM nm),
g AS (SELECT im.image_id, count(ok) AS n, count(*) FILTER (WHERE ok) AS good FROM im LEFT JOIN v ON v.image_id = im.image_id GROUP BY im.image_id)
SELECT count(*) AS images, count(*) FILTER (WHERE good > 0) AS written, count(*) FILTER (WHERE n = 0) AS empty_seen, sum(good)::BIGINT AS instances, sum(n - good)::BIGINT AS invalid FROM g""",
    "category_filter": "WITH " + _RAW + " SELECT category_id, class, count(*) AS n FROM nm WHERE category_id IN (1, 3, 5, 7) GROUP BY ALL",
    "group_annotations": "WITH " + _RAW + " SELECT im.image_id, coalesce(string_agg(CASE WHEN nm.image_id IS NOT NULL THEN coalesce(class, '?') END, ',' ORDER BY p, s, n), '') AS classes FROM im LEFT JOIN nm ON nm.image_id = im.image_id GROUP BY im.image_id",
    "label_consistency": "WITH " + _RAW + " SELECT category_id, count(*) FILTER (WHERE class IS NULL) AS unknown, count(class) AS known FROM nm GROUP BY category_id",
    "clean_text": "WITH" + _ANS + " SELECT sample_id, cleaned FROM cl",
    "parse_tags": "WITH" + _ANS + """,
e AS (SELECT sample_id, cleaned, unnest(CASE WHEN cleaned = '<none>' THEN [] ELSE regexp_extract_all(cleaned, '<[^<>]*>') END) AS item FROM cl),
q AS (SELECT sample_id, list_transform(string_split(trim(item, '<>'), ',')[2:5], lambda t: round_even(t::DOUBLE / 1000 * 160, 0)::BIGINT) AS c FROM e),
z AS (SELECT sample_id, count(*) AS n, sum(least(159, c[1]) + least(159, c[2]) + greatest(1, least(160, c[3])) + greatest(1, least(160, c[4])))::BIGINT AS s FROM q GROUP BY sample_id)
SELECT cl.sample_id, cleaned <> 'no boxes in sight' AS valid, cleaned = '<none>' AS is_empty, coalesce(n, 0)::INT AS n_items, (cleaned = 'no boxes in sight')::INT AS n_errors, coalesce(s, 0) AS corner_sum FROM cl LEFT JOIN z ON z.sample_id = cl.sample_id""",
    "flatten_messages": "SELECT conv_id, string_agg(role || ':' || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS txt FROM conversations GROUP BY conv_id",
    "structure_counts": "SELECT conv_id, count(*)::INT AS n_messages, count(*)::INT AS n_text, sum(turn % 3)::INT AS n_image FROM conversations GROUP BY conv_id",
    "numeric_stats": """SELECT lang, count(n_chars) AS count, min(n_chars)::DOUBLE AS min, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, max(n_chars)::DOUBLE AS max,
round(quantile_cont(n_chars::DOUBLE, 0.5), 6) AS median, round(quantile_cont(n_chars::DOUBLE, 0.9), 6) AS p90, round(quantile_cont(n_chars::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(n_chars::DOUBLE, 0.99), 6) AS p99,
count(*) FILTER (WHERE n_chars > 2000) AS num_over_max_length, round(count(*) FILTER (WHERE n_chars > 2000) / count(n_chars), 6) AS ratio_over_max_length FROM documents GROUP BY lang""",
    # selection by stride, population deviation, percentiles between neighbours; a sample that cannot be measured still counts
    "dataset_statistics": """WITH m AS (SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE turn % 3 = 1) AS images, count(*) FILTER (WHERE turn > 0) AS targets,
  len(regexp_extract_all(string_agg(role || ':' || chr(10) || CASE WHEN turn % 3 = 1 THEN '<image>' || chr(10) ELSE '' END || coalesce(text, ''), chr(10) ORDER BY turn), '[^ \n\t]+')) AS words FROM conversations GROUP BY conv_id),
n AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS idx, count(*) OVER () AS total FROM m),
i AS (SELECT * FROM n WHERE total <= 40 OR idx IN (SELECT least(k * (SELECT count(*) FROM m) // 40, (SELECT count(*) FROM m) - 1) FROM range(40) t(k))),
v AS (SELECT 'raw_token_length' AS name, CASE WHEN words % 5 > 0 THEN words END::DOUBLE AS v FROM i UNION ALL SELECT 'collated_input_length', messages * 7 FROM i UNION ALL SELECT 'collated_label_length', NULL FROM i
  UNION ALL SELECT 'messages_per_sample', messages FROM i UNION ALL SELECT 'text_parts_per_sample', messages FROM i UNION ALL SELECT 'image_assets_per_sample', 0 FROM i
  UNION ALL SELECT 'message_image_parts_per_sample', images FROM i UNION ALL SELECT 'target_instances_per_sample', targets FROM i),
l AS (SELECT string_agg(role || '=' || n, ',' ORDER BY role) AS labels FROM (SELECT role, count(*) AS n FROM conversations JOIN i USING (conv_id) WHERE turn > 0 GROUP BY role)),
e AS (SELECT any_value(total) AS total, count(*) AS inspected, count(*) FILTER (WHERE words % 5 = 0) AS errors, min(idx) FILTER (WHERE words % 5 = 0) AS first_error FROM i)
SELECT total AS num_samples_total, inspected AS num_samples_inspected, errors AS num_errors, first_error, least(errors, 20)::INT AS told, labels, name, count(v) AS count, min(v) AS min, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
  round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, max(v) AS max,
  CASE WHEN name IN ('raw_token_length', 'collated_input_length', 'collated_label_length') AND count(v) > 0 THEN count(*) FILTER (WHERE v > 25) END AS over
FROM v, l, e GROUP BY total, inspected, errors, first_error, labels, name""",
    "label_histogram": "SELECT quality, count(*) AS n FROM labels GROUP BY quality",
    "stride_sample": "WITH n AS (SELECT count(*) AS n FROM documents) SELECT DISTINCT least(i * n // 77, n - 1)::BIGINT AS doc_id FROM n, range(77) t(i)",
    "batches": "SELECT doc_id // 16 AS batch, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY 1",
    "topn_ids": "SELECT doc_id::VARCHAR AS id FROM documents ORDER BY id LIMIT 20",
    "split_counts": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) <= round_even((SELECT count(*) FROM documents) * 0.2::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split FROM documents",
    "fingerprint": """SELECT doc_id, substr(sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}'), 1, 16) AS fp FROM documents""",
    "rle_area": "SELECT p_partkey, (p_partkey * 2 % 17 + p_partkey * 4 % 17 + p_partkey * 6 % 17 + p_partkey * 8 % 17)::BIGINT AS area FROM part",
    "rle_roundtrip": """WITH r AS (SELECT p_partkey, list_transform(range(1, 10), lambda i: p_partkey * i * 31 % 1700) AS v FROM part),
x AS (SELECT p_partkey, v, unnest(list_transform(range(1, 10), lambda i: CASE WHEN i > 3 THEN v[i] - v[i - 2] ELSE v[i] END)) AS x FROM r)
SELECT p_partkey, sum(CASE WHEN x BETWEEN -16 AND 15 THEN 1 WHEN x BETWEEN -512 AND 511 THEN 2 ELSE 3 END)::INT AS n_chars, array_to_string(any_value(v), ',') AS runs FROM x GROUP BY p_partkey""",
    "convert_records": "WITH " + _RAW + """,
o AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS line_no FROM im),
v AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY p, s, n) - 1 AS k, class IS NOT NULL AND x1 < x2 AND y1 < y2 AS ok FROM nm),
g AS (SELECT image_id, count(*) FILTER (WHERE NOT ok) AS bad FROM v GROUP BY image_id)
SELECT o.line_no, 'cfg_a_' || printf('%06d', o.line_no + 1) AS sample_id, '../sets/pics/' || o.image_id || '.jpg' AS uri, coalesce(bad, 0) AS invalid,
  'obj_' || lpad(k::VARCHAR, 5, '0') AS instance_id, category_id + 1 AS label_id, regexp_replace(class, '[^A-Za-z0-9_.:-]+', '_', 'g') AS label_name, x1, y1, x2, y2,
  round_even((x1 + x2) / 2, 0)::BIGINT AS cx, round_even((y1 + y2) / 2, 0)::BIGINT AS cy
FROM o LEFT JOIN g ON g.image_id = o.image_id LEFT JOIN v ON v.image_id = o.image_id AND ok""",
    "task_match": """WITH s AS (SELECT doc_id AS line_no, doc_id::VARCHAR AS sample_id, 'doc_' || lpad(doc_id::VARCHAR, 5, '0') || '.jpg' AS name FROM documents),
t AS (SELECT page_id AS task_no, CASE WHEN page_id % 6 = 0 THEN page_id::VARCHAR END AS key,
  CASE page_id % 6 WHEN 0 THEN 'none.png' WHEN 1 THEN 'doc_' || lpad(page_id::VARCHAR, 5, '0') || '.jpg' WHEN 2 THEN '4f2-doc_' || lpad(page_id::VARCHAR, 5, '0') || '.jpg'
    WHEN 3 THEN 'doc_' || lpad((page_id // 10)::VARCHAR, 4, '0') WHEN 4 THEN 'zz' END AS base FROM pages),
m AS (SELECT task_no, min(line_no) FILTER (WHERE sample_id = key) AS a, min(line_no) FILTER (WHERE name = base) AS b, min(line_no) FILTER (WHERE contains(name, base) OR contains(base, name)) AS c
  FROM t JOIN s ON base IS NOT NULL AND (sample_id = key OR name = base OR contains(name, base) OR contains(base, name)) GROUP BY task_no)
SELECT task_no, coalesce(a, b, c) AS line_no FROM m""",
    # a polygon's corners are cut to whole pixels, and all its edges are drawn
    "reviewed_instances": """WITH k AS (SELECT p_partkey AS line_no, p_partkey % 10 * 5 AS xp, p_partkey % 7 * 10 AS yp FROM part),
b AS (SELECT *, round_even(xp / 100 * 40, 0)::BIGINT AS x, round_even(yp / 100 * 20, 0)::BIGINT AS y, trunc(xp / 100 * 40)::BIGINT AS px1, trunc((xp + 20) / 100 * 40)::BIGINT AS px2, trunc(yp / 100 * 20)::BIGINT AS py1, trunc((yp + 30) / 100 * 20)::BIGINT AS py2 FROM k),
q AS (SELECT *, (px1 + px2) / 2 AS mx, (py1 + py2) / 2 AS my, (px2 - px1 + 1) * (py2 - py1 + 1) AS area FROM b)
SELECT line_no, 'ls_r' AS instance_id, 'box' AS label, x AS x1, y AS y1, round_even(xp / 100 * 40 + (xp + 7) / 100 * 40, 0)::BIGINT AS x2, round_even(yp / 100 * 20 + (yp + 3) / 100 * 20, 0)::BIGINT AS y2,
  NULL::DOUBLE AS px, NULL::DOUBLE AS py, NULL::BIGINT AS area, false AS has_mask FROM q
UNION ALL SELECT line_no, 'ls_p', 'poly', px1, py1, px2 + 1, py2 + 1, round(xp / 100 * 40, 6), round(yp / 100 * 20, 6), area, true FROM q
UNION ALL SELECT line_no, 'ls_o', 'mask', px1, py1, px2 + 1, py2 + 1, mx, my, area, true FROM q
UNION ALL SELECT line_no, 'inst_0004', 'late', 4, 2, 24, 12, NULL, NULL, NULL, false FROM q
UNION ALL SELECT line_no, 'ls_t', 'corner', 0, 0, 11, 11, round(10 / 3, 6), round(10 / 3, 6), 66, true FROM q
UNION ALL SELECT line_no, 'ls_b', 'brushed', 5, 2, 8, 3, 6, 2, 2, true FROM q""",
    "synced_records": """WITH k AS (SELECT p_partkey AS k, p_partkey % 7 > 0 AS known, p_partkey % 4 = 0 AS emptied, p_partkey % 10 * 5 AS xp, p_partkey % 7 * 10 AS yp FROM part),
s AS (SELECT *, k::VARCHAR AS sample_id, CASE WHEN k % 2 = 0 OR (known AND NOT emptied) THEN '40x20' END AS size, CASE WHEN known AND (NOT emptied OR k % 3 = 0) THEN 'label_studio_manual' WHEN k % 3 = 0 THEN 'none' END AS mask_source, CASE WHEN k % 3 = 0 THEN k END AS part,
  round_even(xp / 100 * 40, 0)::BIGINT AS x, round_even(yp / 100 * 20, 0)::BIGINT AS y, trunc(xp / 100 * 40)::BIGINT AS px1, trunc((xp + 20) / 100 * 40)::BIGINT AS px2, trunc(yp / 100 * 20)::BIGINT AS py1, trunc((yp + 30) / 100 * 20)::BIGINT AS py2 FROM k),
-- instances in the order of their first results: the rectangle r, then o, whose last label and mask count
i AS (SELECT k, 0 AS pos, 'ls_r' AS instance_id, 1 AS label_id, 'box' AS label_name, NULL AS mask_format, NULL AS source, x AS tl_x, y AS tl_y, round_even(xp / 100 * 40 + (xp + 7) / 100 * 40, 0)::BIGINT AS br_x, round_even(yp / 100 * 20 + (yp + 3) / 100 * 20, 0)::BIGINT AS br_y, NULL::DOUBLE AS px, NULL::DOUBLE AS py FROM s WHERE known AND NOT emptied
  UNION ALL SELECT k, 1, 'ls_o', 2, 'mask', 'coco_rle', 'label_studio_manual', px1, py1, px2 + 1, py2 + 1, (px1 + px2) / 2, (py1 + py2) / 2 FROM s WHERE known AND NOT emptied
  UNION ALL SELECT k, 0, 'old_' || k, 1, 'box', NULL, NULL, k % 9, k % 7, k % 9 + 3, k % 7 + 2, NULL, NULL FROM s WHERE NOT known)
SELECT sample_id, size, mask_source, part, pos, instance_id, label_id, label_name, mask_format, source, tl_x, tl_y, br_x, br_y, px, py FROM s LEFT JOIN i ON i.k = s.k""",
    "coco_records": "WITH " + _RAW + """,
c AS (SELECT *, category_id IN (3, 5) AS chosen, category_id IN (3, 5) AND x1 < x2 AND y1 < y2 AS ok FROM bx),
g AS (SELECT image_id, count(*) FILTER (WHERE chosen AND NOT ok) AS invalid, row_number() OVER (ORDER BY image_id) AS no FROM c GROUP BY image_id HAVING count(*) FILTER (WHERE ok) > 0)
SELECT 't-' || printf('%06d', no) AS sample_id, image_id, invalid, 'obj_' || p || '-' || n AS instance_id, category_id AS label_id, CASE category_id WHEN 3 THEN 'three' ELSE 'five' END AS label_name, x1, y2 FROM g JOIN c USING (image_id) WHERE ok""",
    "coco_export": "WITH" + _BOXES + """,
im AS (SELECT DISTINCT o_orderkey // 8 AS image FROM orders),
i AS (SELECT image, row_number() OVER (ORDER BY image) AS image_id, 'i/' || image AS file_name FROM im WHERE image % 7 > 0),
a AS (SELECT image_id, file_name, r_name AS name, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, row_number() OVER (ORDER BY image_id, side, idx) AS id
  FROM i JOIN b ON b.sample_id = image AND l_linenumber < 5 JOIN region ON r_regionkey = ascii(label) % 5)
SELECT id, image_id, file_name, name, x, y, w, h, (w * h)::BIGINT AS area, 0 AS iscrowd FROM a""",
    "parse_json": "WITH" + _BOXES + """,
c AS (SELECT sample_id, count(*) AS n, sum(least(159, round_even(round_even(x1 / 160 * 1000, 0) / 1000 * 160, 0)) + least(159, round_even(round_even(y1 / 160 * 1000, 0) / 1000 * 160, 0))
  + greatest(1, least(160, round_even(round_even(x2 / 160 * 1000, 0) / 1000 * 160, 0))) + greatest(1, least(160, round_even(round_even(y2 / 160 * 1000, 0) / 1000 * 160, 0))))::BIGINT AS s FROM b WHERE side = 1 GROUP BY sample_id)
SELECT sample_id, sample_id % 17 <> 0 AS valid, sample_id % 17 <> 0 AND sample_id % 13 = 0 AS is_empty, CASE WHEN sample_id % 17 = 0 OR sample_id % 13 = 0 THEN 0 ELSE n END::INT AS n_items,
  -- a text without a list, an object without a label, and an item of which one number is none are an error each
  (sample_id % 17 = 0 OR (sample_id % 13 > 0 AND sample_id % 11 > 0 AND (sample_id % 7 = 0 OR sample_id % 5 = 0)))::INT AS n_errors, CASE WHEN sample_id % 17 = 0 OR sample_id % 13 = 0 THEN 0 ELSE s END AS corner_sum FROM c""",
    # printf rounds by a number's binary value, as Python's round does
    "unit_boxes": "WITH " + _RAW + """ SELECT image_id, p, s, n, printf('%.4f', x / width)::DOUBLE AS x1, printf('%.4f', y / height)::DOUBLE AS y1,
  printf('%.4f', (x + w) / width)::DOUBLE AS x2, printf('%.4f', (y + h) / height)::DOUBLE AS y2, round((x + w) - x, 6) AS across, round(((x + w) - x) * ((y + h) - y), 4) AS area FROM rb""",
    "prompt_boxes": "WITH " + _RAW + """, r AS (SELECT *, least(greatest(round_even(x, 0), 0), width - 1)::BIGINT AS x1, least(greatest(round_even(y, 0), 0), height - 1)::BIGINT AS y1,
  least(greatest(round_even(x + w, 0), 0), width)::BIGINT AS x2, least(greatest(round_even(y + h, 0), 0), height)::BIGINT AS y2 FROM (SELECT image_id, width, height, p, s, n, x, y, w, h FROM rb))
SELECT image_id, p, s, n, x1, y1, CASE WHEN x2 <= x1 THEN x1 + 1 ELSE x2 END AS x2, CASE WHEN y2 <= y1 THEN y1 + 1 ELSE y2 END AS y2 FROM r""",
    "image_places": """WITH i AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '/d/im/' ELSE '' END || p_name || ' *é~(1)/' || p_brand || '.v2.jpg' AS image FROM part
  UNION ALL SELECT -1 - page_id, url FROM pages WHERE url IS NOT NULL),
r AS (SELECT *, regexp_matches(image, '^(https?|s3|gs)://') AS remote, regexp_extract(image, '([^/]*)$', 1) AS name FROM i)
SELECT k, CASE WHEN remote OR image[1] = '/' THEN image ELSE '/data/set/' || image END AS place,
  CASE WHEN NOT remote THEN '/data/local-files/?d=' || replace(url_encode(CASE WHEN starts_with(image, '/d/im/') THEN image[7:] ELSE image END), '%2F', '/') END AS task_url,
  CASE WHEN strpos(name[2:], '.') > 0 THEN left(name, length(name) - strpos(reverse(name), '.')) ELSE name END AS stem, name FROM r""",
    "attribute_texts": """SELECT event_id, CASE event_id % 6 WHEN 1 THEN CASE WHEN value > 100 THEN 'True' ELSE 'False' END WHEN 2 THEN props->>'k' WHEN 3 THEN event_type
  WHEN 4 THEN '["' || event_type || '",1]' ELSE '' END AS text FROM events""",
    "plot_series": """WITH m AS (SELECT l_returnflag AS model, CASE l_linenumber WHEN 3 THEN 'n/a' WHEN 5 THEN 'NaN' ELSE l_discount::VARCHAR END AS threshold,
  CASE WHEN l_quantity::BIGINT % 7 = 0 THEN '' ELSE l_tax::VARCHAR END AS f1 FROM lineitem)
SELECT model, try_cast(threshold AS DOUBLE) AS threshold, try_cast(f1 AS DOUBLE) AS f1 FROM m
WHERE try_cast(threshold AS DOUBLE) IS NOT NULL AND NOT isnan(try_cast(threshold AS DOUBLE)) AND try_cast(f1 AS DOUBLE) IS NOT NULL""",
    "variant_metadata": "SELECT event_type, coalesce(json_type(props) = 'OBJECT', false) AS is_object, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS k, 0::BIGINT AS none FROM events GROUP BY 1, 2",
}

_LINE = "string_agg('    <Label value=\"' || r_name || '\" background=\"' || c[(k % 8 + 1)::INT] || '\"' || {more} || '/>', chr(10) ORDER BY r_regionkey)"
ORACLE["label_xml"] = (
    f"WITH r AS (SELECT *, row_number() OVER (ORDER BY r_regionkey) - 1 AS k, {list(COLOURS)} AS c FROM region) SELECT '{CONFIG_HEAD}' || "
    + _LINE.format(more="' showInline=\"true\"' || CASE WHEN k < 9 THEN ' hotkey=\"' || (k + 1) || '\"' ELSE '' END")
    + f" || '{CONFIG_MIDDLE}' || " + _LINE.format(more="''") + f" || '{CONFIG_TAIL}' AS xml FROM r"
)
