"""SQL of the llm queries that SQL can express, for DuckDB."""

#: Pairs of vectors by cosine in double precision; components by reachability.
OP1 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
u AS (SELECT vec_id, list_transform(e, lambda x: x / n) AS e FROM g WHERE n > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.9),
r(id, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.id = vec_id LEFT JOIN k ON k.a = vec_id"""

#: The shortest runs with 50 words from each line, forwards and backwards; all but the first of equal ones go.
OP5 = """WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l0 AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
l AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM l0),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l WHERE w > 0),
t AS (SELECT doc_id, list(line ORDER BY k) AS ls, list(upto ORDER BY k) AS us FROM f GROUP BY 1),
n AS (SELECT f.doc_id, k, pos, upto - w AS before, upto, len(list_filter(us, lambda u: u < upto - w + 50)) + 1 AS to_k, len(list_filter(us, lambda u: u <= upto - 50)) AS since_k FROM f JOIN t USING (doc_id)),
r AS (SELECT doc_id, k AS a, to_k AS b FROM n JOIN t USING (doc_id) WHERE to_k <= len(ls) UNION SELECT doc_id, since_k + 1, k FROM n WHERE upto >= 50),
c AS (SELECT r.doc_id, a, b, row_number() OVER (PARTITION BY array_to_string(ls[a:b], chr(10)) ORDER BY r.doc_id, a) AS place FROM r JOIN t USING (doc_id)),
x AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS k FROM c WHERE place > 1),
g AS (SELECT doc_id, list(pos) AS gone, count(*) AS n FROM x JOIN f USING (doc_id, k) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1),
o AS (SELECT d.doc_id, text, ls, gone, coalesce(g.n, 0) AS n_deleted, coalesce(m.n, 0) AS n_lines, list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: ls[i + 1]) AS kept FROM d LEFT JOIN g USING (doc_id) LEFT JOIN m USING (doc_id))
SELECT doc_id, CASE WHEN n_deleted = 0 THEN text WHEN n_deleted = n_lines THEN '' ELSE array_to_string(kept, chr(10)) END AS text, n_lines::BIGINT AS n_lines, n_deleted::BIGINT AS n_deleted FROM o"""

_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Windows of items joined with windows of documents by their words; items of fewer words are windows of their own length.
OP6 = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
v AS (SELECT DISTINCT item, least(8, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(8, len(w)) + 2), lambda k: array_to_string(w[k:k + least(8, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
s AS (SELECT DISTINCT n FROM v),
e AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g FROM d, s WHERE len(w) >= n),
h AS (SELECT doc_id, k, e.n, item FROM e JOIN v ON v.n = e.n AND v.g = e.g),
p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY 1),
q AS (SELECT doc_id, count(*) AS n_items, array_to_string(list_sort(list(item)), ',') AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)"""

ORACLES = {"op1_pivots": OP1, "op5_lines": OP5, "op6_decontaminate": OP6}
