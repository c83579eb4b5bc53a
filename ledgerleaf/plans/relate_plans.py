"""Queries on relations, places and detection rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerleaf.operators import detect, locate
from ledgerleaf.operators import issues as i
from ledgerleaf.operators import relate as r
from ledgerleaf.operators import report
from ledgerleaf.plans import sql_views as v
from ledgerleaf.plans.chunk_plans import SECTIONS, sections
from ledgerleaf.plans.sql_views import q
from ledgerleaf.sources import views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return add


CH = "v_chunks AS (SELECT conv_id AS doc_id, conv_id * 1000 + turn AS chunk_id, CASE role WHEN 'user' THEN 'account_data' ELSE 'dispute_info' END AS semantic_type, text AS content, CAST(turn + 1 AS INTEGER) AS p FROM conversations)"


def chunks(spark, d):
    c = views.table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.when(F.col("role") == "user", "account_data").otherwise("dispute_info").alias("semantic_type"), F.col("text").alias("content"), F.array((F.col("turn") + 1).cast("int")).alias("page_numbers"))


@query("j1_pages_in_sections", q("SELECT s.doc_id, section_type, page_number FROM v_sections s JOIN v_pages p ON p.doc_id = s.doc_id AND page_number BETWEEN page_start AND page_end", v.PAGES, SECTIONS))
def _(spark, d):
    return r.pages_in_sections(sections(spark, d), views.pages(spark, d))


@query("j2_pages_of", q("SELECT doc_id, page_number FROM v_pages WHERE page_number IN (2, 4)", v.PAGES))
def _(spark, d):
    ent = views.pages(spark, d).select("doc_id").distinct().withColumn("page_numbers", F.array(F.lit(2), F.lit(4)))
    return r.pages_of(ent, views.pages(spark, d)).select("doc_id", "page_number")


@query("j3_near_pairs", q("SELECT a.doc_id, a.chunk_id AS a, b.chunk_id AS b, b.p - a.p AS distance FROM v_chunks a JOIN v_chunks b ON a.doc_id = b.doc_id AND a.chunk_id < b.chunk_id AND b.p - a.p <= 3", CH))
def _(spark, d):
    return r.near_pairs(chunks(spark, d), 3)


IDS = "v_ids AS (SELECT DISTINCT doc_id, chunk_id, semantic_type, unnest(regexp_extract_all(content, '([a-z]{9,})', 1)) AS identifier FROM v_chunks)"
J4 = "SELECT a.doc_id, a.chunk_id AS a, b.chunk_id AS b, count(*) AS shared FROM v_ids a JOIN v_ids b ON a.doc_id = b.doc_id AND a.identifier = b.identifier WHERE a.semantic_type = 'account_data' AND b.semantic_type = 'dispute_info' GROUP BY 1, 2, 3"


@query("j4_identifier_pairs", q(J4, CH, IDS))
def _(spark, d):
    return r.identifier_pairs(chunks(spark, d), "([a-z]{9,})")


J5 = "SELECT a.doc_id, a.chunk_id AS a, b.chunk_id AS b, b.p - a.p AS distance FROM v_chunks a JOIN v_chunks b ON a.doc_id = b.doc_id AND a.chunk_id < b.chunk_id AND b.p - a.p <= 4 AND a.semantic_type = b.semantic_type"


@query("j5_same_type_near", q(J5, CH))
def _(spark, d):
    return r.near_pairs(chunks(spark, d), 4, same_type=True)


@query("j6_relationships", q("SELECT 'rel-' || a.chunk_id || '-' || b.chunk_id AS id, CASE WHEN a.semantic_type = 'account_data' AND b.semantic_type = 'dispute_info' THEN 'account_dispute_link' ELSE 'contextual_relationship' END AS type, a.semantic_type || ' -> ' || b.semantic_type AS relationship, CAST(0.8 AS DOUBLE) AS confidence FROM v_chunks a JOIN v_chunks b ON a.doc_id = b.doc_id AND a.chunk_id < b.chunk_id AND b.p - a.p <= 2", CH))
def _(spark, d):
    own = chunks(spark, d)
    return r.relationships(r.near_pairs(own, 2).select("a", "b"), own)


@query("j7_sections_of_chunk", q("SELECT c.doc_id, chunk_id, section_type FROM v_chunks c JOIN v_sections s ON s.doc_id = c.doc_id AND p BETWEEN page_start AND page_end", v.PAGES, SECTIONS, CH))
def _(spark, d):
    return r.sections_of_chunk(chunks(spark, d), sections(spark, d))


@query("j8_neighbours", q("SELECT doc_id, a, b, CAST(n AS INTEGER) AS rank FROM (SELECT a.doc_id, a.chunk_id AS a, b.chunk_id AS b, row_number() OVER (PARTITION BY a.doc_id, a.chunk_id ORDER BY b.chunk_id) AS n FROM v_chunks a JOIN v_chunks b ON a.doc_id = b.doc_id AND a.chunk_id <> b.chunk_id AND abs(b.p - a.p) <= 2) WHERE n <= 3", CH))
def _(spark, d):
    return r.neighbours(chunks(spark, d))


@query("j9_relate_chunks", q(f"SELECT doc_id, a, b, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (SELECT doc_id, a, b, 'near' AS kind FROM ({J5}) UNION ALL SELECT doc_id, a, b, 'identifier' FROM ({J4})) GROUP BY 1, 2, 3", CH, IDS))
def _(spark, d):
    own = chunks(spark, d)
    return r.relate_chunks(near=r.near_pairs(own, 4, same_type=True), identifier=r.identifier_pairs(own, "([a-z]{9,})"))


def line_tokens(spark, d):
    return views.tokens(spark, d).withColumn("page_number", (F.expr("line_no div 10") + 1).cast("int"))


TP = "v_tp AS (SELECT *, CAST(line_no // 10 + 1 AS INTEGER) AS page_number FROM v_tokens)"
HITC = "SELECT i.id, i.type, i.x, i.y, i.width, i.height, count(t.x) AS token_count FROM v_issues i LEFT JOIN v_tp t ON t.doc_id = i.doc_id AND t.page_number = i.page_number AND i.x < t.x + t.width AND t.x < i.x + i.width AND i.y < t.y + t.height AND t.y < i.y + i.height GROUP BY ALL"
BOTH = (v.ISSUES, v.TOKENS.replace(v.LINES + ", ", ""), TP)


@query("j10_token_hits", q(f"SELECT id, token_count FROM ({HITC})", *BOTH))
def _(spark, d):
    return locate.token_hits(views.issues(spark, d), line_tokens(spark, d)).select("id", "token_count")


@query("d23_gate", q(f"SELECT id, CASE WHEN NOT (x >= 0 AND y >= 0 AND x + width <= 612 AND y + height <= 792) THEN 'out_of_bounds' WHEN token_count = 0 AND type <> 'critical' THEN 'no_tokens' ELSE 'kept' END AS gate FROM ({HITC})", *BOTH))
def _(spark, d):
    return locate.gate(i.in_bounds(locate.token_hits(views.issues(spark, d), line_tokens(spark, d)))).select("id", "gate")


@query("j11_with_page_meta", q("SELECT id, CASE WHEN page_number % 2 = 0 THEN 150 ELSE 300 END AS dpi FROM v_issues", v.ISSUES))
def _(spark, d):
    own = views.issues(spark, d)
    meta = own.select("doc_id", "page_number").distinct().withColumn("dpi", F.when(F.col("page_number") % 2 == 0, 150).otherwise(300))
    return i.pixels_to_points(own, meta).select("id", "dpi")


NORM = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


#: Lines of tokens as lists, so that a phrase is a slice of a line.
TOKEN_LINES = f"""v_token_lines AS (SELECT doc_id, line_no, list({NORM.format('str')} ORDER BY token_idx) AS ws, list(token_idx ORDER BY token_idx) AS ts,
 list(x ORDER BY token_idx) AS xs, list(width ORDER BY token_idx) AS wd, any_value(y) AS y, any_value(height) AS height FROM v_tokens GROUP BY 1, 2)"""


@query("j12_match_phrase", q(f"""SELECT i.id, i.doc_id, l.line_no, l.ts[p] AS token_idx, l.xs[p] AS x, l.y, l.xs[p + n - 1] + l.wd[p + n - 1] - l.xs[p] AS width, l.height
 FROM (SELECT id, doc_id, want, len(want) AS n FROM (SELECT id, doc_id, string_split({NORM.format('anchor_text')}, ' ') AS want FROM v_issues) WHERE want[1] <> '') i
 JOIN v_token_lines l ON l.doc_id = i.doc_id AND list_contains(l.ws, i.want[1]), unnest(range(1, len(l.ws) + 1)) AS t(p) WHERE l.ws[p:p + n - 1] = i.want""", v.ISSUES, v.TOKENS.replace(v.LINES + ", ", ""), TOKEN_LINES))  # fmt: skip
def _(spark, d):
    return locate.match_phrase(views.issues(spark, d), views.tokens(spark, d))


@query("j13_match_token", q("SELECT id, line_no, token_idx, x, y FROM (SELECT i.id, t.line_no, t.token_idx, t.x, t.y, row_number() OVER (PARTITION BY i.id ORDER BY t.line_no, t.token_idx) AS n FROM v_issues i JOIN v_tokens t ON t.doc_id = i.doc_id AND contains(lower(t.str), lower(i.anchor_text))) WHERE n = 1", v.ISSUES, v.TOKENS.replace(v.LINES + ", ", "")))
def _(spark, d):
    return locate.match_token(views.issues(spark, d), views.tokens(spark, d))


@query("j14_word_index", q("SELECT word, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, lower(str) AS word FROM v_tokens) WHERE length(word) > 2 GROUP BY 1", v.TOKENS))
def _(spark, d):
    return locate.word_index(views.words(spark, d))


LINKS = "SELECT a.doc_id, a.id AS source_id, b.id AS target_id, CASE WHEN 'collection' IN (a.category, b.category) OR 'dispute' IN (a.category, b.category) THEN 'account_dispute' ELSE 'general' END AS link_type, CASE WHEN a.category = 'dispute' AND b.category = 'FCRA_violation' THEN 'Dispute related to FCRA violation' WHEN a.category = 'collection' AND b.category = 'accuracy' THEN 'Collection accuracy concern' ELSE 'Related: ' || a.category || ' and ' || b.category END AS relationship FROM r a JOIN r b ON b.id = a.nxt WHERE a.page_number <> b.page_number"


@query("j16_cross_page_links", q(LINKS, v.ISSUES, "r AS (SELECT *, lead(id) OVER (PARTITION BY doc_id ORDER BY seq, id) AS nxt FROM v_issues)"))
def _(spark, d):
    from pyspark.sql import Window

    own = views.issues(spark, d).withColumn("nxt", F.lead("id").over(Window.partitionBy("doc_id").orderBy("seq", "id")))
    return r.cross_page_links(own.withColumn("related_ids", F.array_compact(F.array("nxt"))))


@query("j18_check_alignment", q("SELECT i.doc_id, count(*) AS total, count_if(EXISTS (SELECT 1 FROM v_issues t WHERE t.type = 'warning' AND t.doc_id = i.doc_id AND t.page_number = i.page_number AND i.x <= t.x + t.width AND t.x <= i.x + i.width AND i.y <= t.y + t.height AND t.y <= i.y + i.height)) AS matched FROM v_issues i GROUP BY 1", v.ISSUES))
def _(spark, d):
    own = views.issues(spark, d)
    return r.check_alignment(own, own.where("type = 'warning'"))


@query("j20_has_image", q("SELECT doc_id, page_number, page_number % 3 = 0 AS has_image FROM v_pages", v.PAGES))
def _(spark, d):
    own = views.pages(spark, d)
    return r.has_image(own, own.where("page_number % 3 = 0")).select("doc_id", "page_number", "has_image")


@query("j22_decode_status", q("SELECT order_key, line_number, CASE status WHEN 'O' THEN 'open' WHEN 'F' THEN 'fulfilled' ELSE 'unknown' END AS status_text FROM v_payments", v.PAYMENTS))
def _(spark, d):
    return r.decode_status(views.payments(spark, d), {"O": "open", "F": "fulfilled"}).select("order_key", "line_number", "status_text")


@query("j23_page_at", q("SELECT o.doc_id, o.offset_id, coalesce(max(s.page_number), 1) AS page_number FROM (SELECT doc_id, page_number AS offset_id, page_number * 137 AS place FROM v_pages) o LEFT JOIN (SELECT doc_id, page_number, CAST(coalesce(sum(length('Page ' || page_number || ':' || chr(10) || text) + 2) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM v_pages) s ON s.doc_id = o.doc_id AND s.start <= o.place GROUP BY 1, 2", v.PAGES))
def _(spark, d):
    own = views.pages(spark, d)
    return locate.page_at(own.select("doc_id", F.col("page_number").alias("offset_id"), (F.col("page_number") * 137).alias("offset")), locate.page_starts(own))


@query("j24_restore_fields", q("SELECT id, CASE WHEN type = 'info' THEN 'other' ELSE category END AS category, CASE WHEN type = 'info' THEN 'medium' ELSE severity END AS severity FROM v_issues", v.ISSUES))
def _(spark, d):
    own = views.issues(spark, d)
    return r.restore_fields(own.select("id"), own.where("type <> 'info'")).select("id", "category", "severity")


@query("d6_short_account_lines", q("SELECT doc_id, line_no FROM v_lines WHERE (contains(lower(line), 'the') OR contains(lower(line), 'les')) AND contains(lower(line), 'an') AND length(trim(line)) < 60", v.LINES))
def _(spark, d):
    return detect.short_lines(views.lines(spark, d), ["the", "les"], 60, ["an"]).select("doc_id", "line_no")


@query("d7_short_creditor_lines", q("SELECT doc_id, line_no FROM v_lines WHERE (contains(lower(line), 'en') OR contains(lower(line), 'de')) AND length(trim(line)) < 25", v.LINES))
def _(spark, d):
    return detect.short_lines(views.lines(spark, d), ["en", "de"], 25).select("doc_id", "line_no")


@query("d8_payment_gap", q("SELECT h.doc_id, h.line_no, min(g.line_no) AS gap_line FROM v_lines h JOIN v_lines g ON g.doc_id = h.doc_id AND g.line_no BETWEEN h.line_no + 1 AND h.line_no + 9 WHERE contains(h.line, 'The') AND length(trim(g.line)) > 5 AND length(trim(g.line)) - length(replace(trim(g.line), ' ', '')) > 3 AND contains(g.line, 'Th') GROUP BY 1, 2", v.LINES))
def _(spark, d):
    return detect.payment_gap(views.lines(spark, d), F.col("line").contains("The"), F.col("line").contains("Th")).select("doc_id", "line_no", "gap_line")


@query("d9_balance_lines", q("SELECT doc_id, line_no FROM v_lines WHERE contains(lower(line), 'en') AND regexp_matches(line, '[0-9]')", v.LINES))
def _(spark, d):
    return detect.balance_lines(views.lines(spark, d), "en").select("doc_id", "line_no")


PAY = "([A-Za-z]+) \\| ([a-z]+) \\| ([a-z]+) \\| ([a-z]+)"


@query("d10_parse_payment_rows", q(f"SELECT doc_id, line_no, trim(regexp_extract(line, '{PAY}', 1)) AS name, regexp_extract(line, '{PAY}', 4) AS status FROM v_lines WHERE regexp_matches(line, '{PAY}')", v.LINES))
def _(spark, d):
    return detect.parse_payment_rows(views.lines(spark, d), PAY).select("doc_id", "line_no", "name", "status")


@query("d12_late_markers", q("SELECT order_key, line_number FROM v_payments WHERE status IN ('F', 'C')", v.PAYMENTS))
def _(spark, d):
    return detect.late_markers(views.payments(spark, d), ["F", "C"]).select("order_key", "line_number")


@query("d13_missing_months", q("SELECT account_id, CAST(m AS VARCHAR) AS month FROM (SELECT account_id, CAST(unnest(generate_series(min(date_trunc('month', date)), max(date_trunc('month', date)), INTERVAL 1 MONTH)) AS DATE) AS m FROM v_payments GROUP BY 1) x WHERE NOT EXISTS (SELECT 1 FROM v_payments p WHERE p.account_id = x.account_id AND CAST(date_trunc('month', p.date) AS DATE) = m)", v.PAYMENTS))
def _(spark, d):
    return detect.missing_months(views.payments(spark, d)).select("account_id", F.col("month").cast("string").alias("month"))


@query("d15_utilization", q("SELECT account_id, CASE WHEN u > 1 THEN 'over_limit' WHEN u >= 0.9 THEN 'maxed_out' ELSE 'high' END AS issue FROM (SELECT account_id, round(balance / credit_limit, 6) AS u FROM v_accounts WHERE credit_limit > 0) WHERE u > 0.3", v.ACCOUNTS))
def _(spark, d):
    return detect.utilization_issues(report.utilization(views.accounts(spark, d))).select("account_id", "issue")


@query("d16_missing_values", "SELECT o_orderkey, field FROM (SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders) WHERE v IS NULL OR v IN ('', 'P', '5-LOW')")
def _(spark, d):
    return detect.missing_values(views.table(spark, d, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"], ["P", "5-LOW"])


@query("d18_duplicate_entities", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS copies FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) > 1")
def _(spark, d):
    return detect.duplicate_entities(views.table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"]).select("c_custkey", "copies")


@query("d19_repeated_inquiries", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 12")
def _(spark, d):
    return detect.repeated_inquiries(views.table(spark, d, "events"), ["user_id", "event_type"], 12)


@query("d21_contradictions", "SELECT o_custkey AS entity, count(DISTINCT o_orderstatus) AS n_status, count(DISTINCT o_orderkey) AS n_pages, min(o_orderkey) AS first_page FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1 AND count(DISTINCT o_orderkey) > 1")
def _(spark, d):
    o = views.table(spark, d, "orders")
    return r.contradictions(o.select(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("page")))


@query("d22_check_extraction", "SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'missing_list' ELSE 'count_mismatch' END AS violation FROM events WHERE event_id % 4 < 2")
def _(spark, d):
    e = views.table(spark, d, "events")
    json = F.when(F.col("event_id") % 4 == 0, F.lit("broken")).when(F.col("event_id") % 4 == 1, F.lit('{"count": 3, "items": ["a"]}')).otherwise(F.lit('{"count": 1, "items": ["a"]}'))
    return detect.check_extraction(e.select(F.col("event_id").alias("id"), json.alias("json")), "count int, items array<string>", "count", "items")


@query("d24_hybrid_audit", q("SELECT 'type' AS dimension, error_type AS value, count(*) AS n FROM k GROUP BY 2 UNION ALL SELECT 'method', method, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'page', CAST(page_number AS VARCHAR), count(*) FROM k GROUP BY 2", v.ISSUES, "k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, cx, cy, error_type ORDER BY confidence DESC, seq) AS n FROM (SELECT *, round_even(x / 10, 0) * 10 AS cx, round_even(y / 10, 0) * 10 AS cy FROM v_issues)) WHERE n = 1)"))
def _(spark, d):
    own = views.issues(spark, d)
    both = i.union_sources(pattern=own.where("method = 'pattern'"), external=own.where("method = 'vision'"))
    return report.detection_report(i.dedup_grid_confidence(both))
