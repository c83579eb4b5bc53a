"""The derived tables of ``sources.views`` as DuckDB common table expressions."""

from __future__ import annotations

from ledgerleaf.sources.views import RULES

PAGES = "v_pages AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_number, text FROM conversations)"
LINES = "v_lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) s, unnest(range(1, len(s.ls) + 1)) AS t(i))"
TOKENS = (
    LINES
    + """, v_words AS (SELECT doc_id, line_no, CAST(i - 1 AS INTEGER) AS token_idx, ws[i] AS str FROM (SELECT doc_id, line_no, string_split(line, ' ') AS ws FROM v_lines) s, unnest(range(1, len(s.ws) + 1)) AS t(i)),
v_tokens AS (SELECT doc_id, CAST(line_no // 40 AS INTEGER) AS page0, line_no, token_idx, str, 50.0 + 8 * before AS x, CAST(50 + 15 * line_no AS DOUBLE) AS y, CAST(8 * length(str) AS DOUBLE) AS width, CAST(15.0 AS DOUBLE) AS height FROM
 (SELECT *, CAST(coalesce(sum(length(str) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY token_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS before FROM v_words) WHERE length(trim(str)) > 0)"""
)
_HITS = " UNION ALL ".join(
    f"SELECT doc_id, line_no, line, {i} AS rule_id, '{name}' AS error_type, '{kind}' AS type, '{category}' AS category, '{severity}' AS severity, regexp_extract_all(line, '{pattern}') AS hits FROM v_lines"
    for i, name, pattern, kind, category, severity in RULES
)
ISSUES = (
    LINES
    + f""", v_hits AS ({_HITS}),
v_issues AS (SELECT doc_id || '-' || line_no || '-' || rule_id || '-' || (k - 1) AS id, doc_id, type, category, error_type || ' found: ' || hits[k] AS description, severity, CAST(line_no // 10 + 1 AS INTEGER) AS page_number,
 CAST(50 + 8 * (instr(line, hits[k]) - 1) AS DOUBLE) AS x, CAST(50 + 15 * line_no AS DOUBLE) AS y, CAST(8 * length(hits[k]) AS DOUBLE) AS width, CAST(15.0 AS DOUBLE) AS height, hits[k] AS anchor_text, error_type, CAST(0.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * rule_id AS confidence,
 CASE WHEN rule_id % 2 = 0 THEN 'vision' ELSE 'pattern' END AS method, CAST(line_no AS BIGINT) * 1000000 + rule_id * 100000 + (k - 1) AS seq FROM v_hits h, unnest(range(1, len(h.hits) + 1)) AS t(k))"""
)
TABLES = LINES + ", v_tables AS (SELECT doc_id, line_no, list_transform(string_split(line, '|'), lambda c: trim(c)) AS cells FROM v_lines WHERE contains(line, ' | '))"
CALLS = "v_calls AS (SELECT user_id AS doc_id, event_id AS call_id, ts, CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) // 2 AS output_tokens, CAST(CASE WHEN event_type = 'view' THEN 100 ELSE 0 END AS BIGINT) AS image_tokens, event_type AS request_type FROM events)"
STATUS = "v_status AS (SELECT user_id AS source, ts, event_id, CASE WHEN event_type = 'error' THEN 'offline' ELSE 'online' END AS status FROM events)"
ACCOUNTS = """v_accounts AS (SELECT c_custkey AS account_id, c_name AS name, c_mktsegment AS account_type, balance, c_acctbal AS credit_limit, opened, statuses FROM customer JOIN
 (SELECT o_custkey, round(sum(o_totalprice), 2) AS balance, CAST(min(o_orderdate) AS DATE) AS opened, list_sort(list(DISTINCT o_orderstatus)) AS statuses FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""
PAYMENTS = "v_payments AS (SELECT o_custkey AS account_id, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS amount, l_linestatus AS status, l_orderkey AS order_key, l_linenumber AS line_number FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
DOC_PAGES = "v_docs AS (SELECT conv_id AS doc_id, count(*) AS total_pages FROM conversations GROUP BY 1)"


def q(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
