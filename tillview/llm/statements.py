"""DuckDB statements for the operators that SQL can express."""

WARC = """
WITH p AS (
  SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS winner, count(*) AS met
  FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
), r AS (
  SELECT p.*, CASE WHEN g.met > 1 AND g.winner IS NOT NULL AND p.page_id IS DISTINCT FROM g.winner THEN g.winner END AS refers_to
  FROM p LEFT JOIN g USING (payload_digest)
)
SELECT page_id, url, payload_bytes, payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r
"""

LINES = """
WITH l AS (
  SELECT doc_id, source, unnest(list_distinct(list_filter(
    list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))),
    lambda x: regexp_matches(x, '[\\p{L}\\p{N}]')))) AS line
  FROM documents
), s AS (
  SELECT line, min(doc_id) AS keeper FROM l GROUP BY line HAVING count(DISTINCT source) >= 3
), gone AS (
  SELECT doc_id, list(DISTINCT line) AS lines FROM l JOIN s USING (line) WHERE doc_id <> keeper GROUP BY doc_id
), k AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS met, CASE WHEN gone.doc_id IS NULL THEN string_split(d.text, chr(10))
    ELSE list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(gone.lines, trim(x, ' ' || chr(9) || chr(13)))) END AS kept
  FROM documents d LEFT JOIN gone ON d.doc_id = gone.doc_id
)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text,
  CAST(coalesce(len(met), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(met) - len(kept), 0) AS BIGINT) AS n_removed
FROM k
"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

LEAKS = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT item_id, least(len(w), 10) AS long, unnest(range(1, CAST(len(w) - least(len(w), 10) + 2 AS BIGINT))) AS pos, w
  FROM i WHERE len(w) > 0
), win AS (SELECT DISTINCT item_id, long, array_to_string(w[pos : pos + long - 1], ' ') AS ngram FROM iw),
lens AS (SELECT DISTINCT long FROM win),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
g AS (SELECT r, pos, long, array_to_string(w[pos : pos + long - 1], ' ') AS ngram FROM p, lens WHERE pos + long - 1 <= len(w)),
h AS (SELECT r, pos, g.long, item_id FROM g JOIN win ON g.long = win.long AND g.ngram = win.ngram),
spots AS (SELECT r, unnest(range(pos, pos + long)) AS spot FROM h),
nh AS (SELECT r, count(DISTINCT spot) AS n_hit FROM spots GROUP BY r),
ni AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM h GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (r) LEFT JOIN ni USING (r)
"""

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""

NEGATIVES = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.id AS a, a.label = b.label AS same, b.id AS id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.q) = len(b.q)
), p AS (
  SELECT a, id AS p, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5
)
SELECT p.a AS anchor_id, p.p AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""
