"""SQL for DuckDB that gives the same rows as the queries of this subpackage."""

ORACLE = {}

ORACLE["op4_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""


def _mix_sql(rounds: int = 3) -> str:
    sql = r"""
WITH w AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(greatest(0.1::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (len(regexp_extract_all(text, '[!#$%&*|]'))::DOUBLE / greatest(length(text), 1))), 1.0::DOUBLE) AS q,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, ''))) || '/17'), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
d AS (SELECT doc_id, coalesce('s' || source, 'n') AS sid, source, size, pow(u, 1.0::DOUBLE / q) AS key FROM w),
s AS (SELECT sid, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY sid),
c AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER b, 0)::DOUBLE)
             / ((SELECT sum(weight) FROM c) - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level,
             row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS k
      FROM c WINDOW b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, k) AS level FROM l WHERE level <= cap::DOUBLE / weight),
p0 AS (SELECT sid, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM f) * weight, cap::DOUBLE)) AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM p0),
t0 AS (SELECT d.*, source_size, target, epochs, floor(target - epochs * source_size)::BIGINT AS rest, false AS got FROM d JOIN p USING (sid))"""
    for k in range(rounds):
        sql += f""",
u{k} AS (SELECT *, CASE WHEN NOT got AND size > 0 AND size <= rest THEN sum(size) FILTER (WHERE NOT got AND size > 0 AND size <= rest)
                 OVER (PARTITION BY sid ORDER BY key DESC, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto FROM t{k}),
t{k + 1} AS (SELECT doc_id, sid, size, key, source_size, target, epochs,
                 (rest - coalesce(max(upto) FILTER (WHERE upto <= rest) OVER (PARTITION BY sid), 0))::BIGINT AS rest,
                 got OR coalesce(upto <= rest, false) AS got FROM u{k})"""
    return sql + f"\nSELECT doc_id, size, source_size, target, size * (epochs + got::BIGINT) AS taken FROM t{rounds}"


ORACLE["op5_mixing"] = _mix_sql()

ORACLE["op7_warc_revisit"] = r"""
WITH a AS (
  SELECT page_id, html, regexp_replace(regexp_replace(url, '#(.|\n)*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
b AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
         || regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/index\.html?$', '/'), '/+$', '') AS site,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?((.|\n)*)$', 1), '&'),
                   lambda t: t <> '' AND NOT regexp_matches(t, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS parts,
         ('0x' || substr(md5(page_id::VARCHAR), 1, 1))::INT AS nibble, (page_id // 16384)::VARCHAR AS version
  FROM a),
c AS (SELECT *, site || CASE WHEN len(parts) > 0 THEN '?' || array_to_string(parts, '&') ELSE '' END AS canonical FROM b),
r AS (
  SELECT page_id AS record_id, canonical, CASE WHEN nibble < 6 THEN 304 ELSE 200 END AS status,
         CASE WHEN nibble % 4 <> 3 THEN '"' || substr(md5(canonical || version), 1, 8) || '"' END AS etag,
         CASE WHEN nibble % 4 <> 1 THEN 'version ' || version END AS modified,
         CASE WHEN nibble >= 6 THEN sha256(html) END AS sha, length(html)::VARCHAR AS size
  FROM c),
j AS (SELECT r.*, f.record_id AS f_id, f.etag AS f_etag, f.modified AS f_modified, f.sha AS f_sha, f.size AS f_size
      FROM r ASOF LEFT JOIN (SELECT * FROM r WHERE status = 200) f ON r.canonical = f.canonical AND r.record_id > f.record_id),
o AS (
  SELECT *, CASE WHEN status = 200 THEN 'full' WHEN f_id IS NULL THEN 'no_base'
    WHEN etag IS NOT NULL AND f_etag IS NOT NULL THEN CASE WHEN etag = f_etag THEN 'resolved' ELSE 'changed' END
    WHEN modified IS NOT NULL AND f_modified IS NOT NULL THEN CASE WHEN modified = f_modified THEN 'resolved' ELSE 'changed' END
    ELSE 'unchecked' END AS outcome FROM j)
SELECT record_id, canonical, outcome,
  CASE outcome WHEN 'full' THEN record_id WHEN 'resolved' THEN f_id END AS base_id,
  CASE outcome WHEN 'full' THEN sha WHEN 'resolved' THEN f_sha END AS resolved_sha256,
  CASE WHEN outcome IN ('full', 'resolved') THEN
    'content-length=' || CASE outcome WHEN 'full' THEN size ELSE f_size END || '; date=' || record_id
    || coalesce('; etag=' || coalesce(etag, CASE WHEN outcome = 'resolved' THEN f_etag END), '')
    || coalesce('; last-modified=' || coalesce(modified, CASE WHEN outcome = 'resolved' THEN f_modified END), '') END AS merged
FROM o
"""

ORACLE["op8_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLE["op11_hard_negatives"] = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
           FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""

ORACLE["op13_near_vectors"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(any_value(n.n), 0) AS n_links, min(reached) AS component_id, vec_id = min(reached) AS kept FROM r LEFT JOIN n ON n.a = vec_id GROUP BY vec_id
"""
