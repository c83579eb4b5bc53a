"""SQL of the queries that DuckDB can express over whole tables: by brute force, for small scales."""

from __future__ import annotations

#: Every pair of vectors of one label, then the smallest id that links reach.
OP4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS id, vec_id AS root FROM embeddings
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id WHERE reach.root < links.b
), least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY 1),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON id = vec_id LEFT JOIN counted ON a = vec_id
"""

#: Every vector against every query.
OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 20
"""

#: Every window of 35 words as a string, counted.
OP9 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS t
  FROM w, unnest(range(1, len(ws) - 33)) AS r(i)
), often AS (SELECT t FROM windows GROUP BY 1 HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, j FROM windows JOIN often USING (t), unnest(range(i, i + 35)) AS r(j)
), lost AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY 1),
kept AS (
  SELECT doc_id, string_agg(ws[i], ' ' ORDER BY i) AS t
  FROM w, unnest(range(1, len(ws) + 1)) AS r(i)
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = w.doc_id AND gone.j = i)
  GROUP BY 1
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN lost ON lost.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

_ITEM_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: Every window of a document of each length that the benchmark has, joined with the benchmark's windows.
OP11 = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
wanted AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i : i + 9], ' ') AS t
  FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS r(i) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT k FROM wanted),
windows AS (
  SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS t
  FROM d, sizes, unnest(range(1, len(ws) - k + 2)) AS r(i)
), hits AS (SELECT doc_id, k, i, item_id FROM windows JOIN wanted USING (k, t)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM hits, unnest(range(i, i + k)) AS r(j) GROUP BY 1),
held AS (
  SELECT doc_id, count(DISTINCT item_id) AS n,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM hits GROUP BY 1
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(held.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN held ON held.doc_id = d.doc_id
"""
