"""SQL, for DuckDB, that says plainly what some of the operators return."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: All windows of all items, joined with all stretches of those lengths in the documents.
CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT item_id, k, list_slice(w, s, s + k - 1) AS x FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM i)),
stretches AS (SELECT doc_id, s, k, list_slice(w, s, s + k - 1) AS x
              FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
found AS (SELECT doc_id, s, k, item_id FROM stretches JOIN windows USING (k, x)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM (SELECT DISTINCT doc_id, s, k FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN named ON d.doc_id = named.doc_id"""

#: Stretches of 13 words of items that documents have, joined along item and document to the longest ones from each start.
LONGEST = f"""
WITH d AS (SELECT row_number() OVER () AS row, {_WORDS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
x AS (SELECT item, item_id, s, list_slice(w, s + 1, s + 13) AS x FROM (SELECT item, item_id, w, unnest(range(0, len(w) - 12)) AS s FROM i WHERE len(w) >= 13)),
y AS (SELECT row, p, list_slice(w, p + 1, p + 13) AS x FROM (SELECT row, w, unnest(range(0, len(w) - 12)) AS p FROM d WHERE len(w) >= 13)),
met AS (SELECT item, item_id, row, p - s AS shift, s, s - row_number() OVER (PARTITION BY item, row, p - s ORDER BY s) AS run FROM x JOIN y USING (x)),
runs AS (SELECT item_id, s, max(s) OVER (PARTITION BY item, row, shift, run) - s + 13 AS length FROM met)
SELECT item_id, s::BIGINT AS item_start, max(length)::BIGINT AS length FROM runs GROUP BY item_id, s"""

#: All stretches of 50 words, grouped, and the repeated ones joined to passages.
PASSAGES = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, pos, md5(array_to_string(list_slice(w, pos + 1, pos + 50), ' ')) AS x FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS pos FROM d WHERE len(w) >= 50)),
g AS (SELECT x, min(doc_id) AS low, max(doc_id) AS high FROM s GROUP BY x HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, pos, CASE WHEN doc_id = low THEN high ELSE low END AS other, doc_id = low AS first FROM s JOIN g USING (x)),
n AS (SELECT *, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 1 ELSE 0 END AS new FROM r),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS passage FROM n)
SELECT doc_id, min(pos)::BIGINT AS start, (max(pos) - min(pos) + 50)::BIGINT AS n_words, min(other) AS other_id, bool_and(first) AS first
FROM p GROUP BY doc_id, passage"""

#: All pairs of documents that share a shingle, and the closure of their links.
JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (
    SELECT doc_id, array_to_string(list_slice(w, pos, pos + 4), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS pos FROM d WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON d.doc_id = a"""
