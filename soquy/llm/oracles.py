"""Corpus queries a second time as SQL, where SQL can say them; shares no code with the operators."""

BASE32 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS best FROM p),
c AS (
  SELECT page_id, k, CAST('0x' || substr(s, CAST(1 + 5 * k AS BIGINT), 5) AS INTEGER) AS v
  FROM d, (SELECT unnest(range(0, 8)) AS k) x
),
b AS (
  SELECT page_id, string_agg(
    substr(a, 1 + (v >> 15), 1) || substr(a, 1 + (v >> 10) % 32, 1) || substr(a, 1 + (v >> 5) % 32, 1) || substr(a, 1 + v % 32, 1),
    '' ORDER BY k) AS payload_digest
  FROM c, (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a) y GROUP BY page_id
)
"""

WARC_CAPTURES = BASE32 + """
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM d JOIN b USING (page_id)
"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

POSITIONAL_INDEX = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
start AS (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM item WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS gram FROM start
),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w
  FROM doc, (SELECT DISTINCT n FROM win) k WHERE len(w) >= n
),
hit AS (
  SELECT doc_id, s, p.n, item_id
  FROM (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS gram FROM place) p JOIN win USING (gram)
  WHERE p.n = win.n
),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM hit) u GROUP BY doc_id
),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) i GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

EXACT_DEDUP = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
),
best AS (SELECT t, first(doc_id ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN best USING (t)
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pair AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS alike, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0
),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN pair n ON p.anchor_id = n.anchor_id AND NOT n.alike
WHERE 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

_TERMS = _WORDS.replace("x3A-\\x60", "x3A-\\x40\\x5B-\\x60")

RANKED_SEARCH = f"""
WITH item AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
doc AS (SELECT doc_id, {_TERMS} AS w FROM documents),
total AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM doc WHERE len(w) > 0),
tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM doc) x
  WHERE term IN (SELECT term FROM item) GROUP BY ALL
),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, total GROUP BY term, docs
),
scored AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
  FROM item JOIN tf USING (term) JOIN weight USING (term), total GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

ORACLES = {
    "op1_warc_captures": WARC_CAPTURES,
    "op8_positional_index": POSITIONAL_INDEX,
    "op11_exact_dedup": EXACT_DEDUP,
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_ranked_search": RANKED_SEARCH,
}
