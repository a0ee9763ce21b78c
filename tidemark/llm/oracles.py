"""SQL for DuckDB that gives the rows of exact operators: windows, shingles and links written out plainly."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUBSTRING_DEDUP = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), words AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs
), windows AS (SELECT r, doc_id, i, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h, count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS n FROM words
), firsts AS (SELECT h, min(doc_id) AS low FROM windows WHERE n = 50 GROUP BY h
), gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (h) WHERE n = 50 AND doc_id > low
), left_over AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.i) AS kept, count(*) AS n FROM words ANTI JOIN gone ON gone.r = words.r AND gone.i = words.i GROUP BY words.r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN left_over USING (r)
"""

DECONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents
), items AS (SELECT item_id, {_ITEM_WORDS} AS w, least(13, len({_ITEM_WORDS})) AS m FROM benchmark
), patterns AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM items WHERE m > 0)
), words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs
), windows AS (SELECT r, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS ws FROM words
), found AS (SELECT r, i, m, item_id FROM (SELECT r, i, m, array_to_string(ws[1:m], ' ') AS p FROM windows, (SELECT DISTINCT m FROM patterns) WHERE len(ws) >= m) JOIN patterns USING (m, p)
), hit AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS i FROM found) GROUP BY r
), named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

JACCARD_JOIN = f"""
WITH RECURSIVE docs AS (SELECT doc_id, text, {_WORDS} AS w FROM documents
), texts AS (SELECT row_number() OVER () AS t, * FROM (SELECT text, any_value(w) AS w, min(doc_id) AS first, count(*) AS n_copies FROM docs WHERE len(w) > 0 GROUP BY text)
), words AS (SELECT t, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM texts
), shingles AS (SELECT DISTINCT t, s FROM (SELECT t, i, n, md5(string_agg(word, ' ') OVER (PARTITION BY t ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS s FROM words) WHERE i <= greatest(n - 4, 1)
), sizes AS (SELECT t, count(*) AS n FROM shingles GROUP BY t
), links AS (SELECT c.a, c.b FROM (SELECT x.t AS a, y.t AS b, count(*) AS n FROM shingles x JOIN shingles y USING (s) WHERE x.t <> y.t GROUP BY x.t, y.t) c JOIN sizes p ON p.t = c.a JOIN sizes q ON q.t = c.b WHERE c.n >= 0.8 * (p.n + q.n - c.n) - 1e-9
), walk AS (SELECT t, t AS u FROM texts UNION SELECT walk.t, links.b FROM walk JOIN links ON walk.u = links.a
), classes AS (SELECT walk.t, min(first) AS class_id FROM walk JOIN texts ON texts.t = walk.u GROUP BY walk.t
), counts AS (SELECT a AS t, count(*) AS n_links FROM links GROUP BY a
)
SELECT doc_id, CASE WHEN len(docs.w) = 0 THEN doc_id ELSE class_id END AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_copies, 1)::BIGINT AS n_copies
FROM docs LEFT JOIN texts USING (text) LEFT JOIN classes USING (t) LEFT JOIN counts USING (t)
"""
