"""Queries on issues, detections, reports and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerleaf.operators import issues as i
from ledgerleaf.operators import report as r
from ledgerleaf.plans import sql_views as v
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


SEV, TYP = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END", "CASE type WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'attention' THEN 2 WHEN 'info' THEN 3 ELSE 4 END"
COLS = ["doc_id", "id", "page_number"]


@query("flagship_audit", q("""SELECT lang, source, count(*) AS total, count_if(type = 'critical') AS critical, count_if(type = 'warning') AS warning, count_if(type = 'attention') AS attention, count_if(type = 'info') AS info
 FROM (SELECT DISTINCT ON (doc_id, description, page_number) doc_id, type FROM v_issues ORDER BY seq) JOIN documents USING (doc_id) GROUP BY 1, 2""", v.ISSUES))
def _(spark, d):
    kept = i.dedup_exact(views.issues(spark, d)).select("doc_id", "type")
    one = lambda t: F.count_if(F.col("type") == t).alias(t)
    return kept.join(views.table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("total"), one("critical"), one("warning"), one("attention"), one("info"))


@query("d1_detect_patterns", q("SELECT id, doc_id, error_type, description, page_number, x, y, width, height FROM v_issues", v.ISSUES))
def _(spark, d):
    return views.issues(spark, d).select("id", "doc_id", "error_type", "description", "page_number", "x", "y", "width", "height")


RAW = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN props ELSE '{\"summary\": \"s' || event_id || '\", \"confidence\": ' || CASE WHEN event_id % 2 = 0 THEN '0' ELSE '0.75' END || ', \"totalIssues\": 2, \"issues\": [{\"type\": \"critical\"}]}' END AS r FROM events"


@query("s3_parse_findings", "SELECT event_id, event_id % 5 <> 0 AS parsed_ok, CAST(CASE WHEN event_id % 5 <> 0 THEN 2 ELSE 0 END AS INTEGER) AS total_issues, CASE WHEN event_id % 5 <> 0 THEN 's' || event_id ELSE 'Analysis completed - no issues identified' END AS summary, CAST(CASE WHEN event_id % 5 = 0 THEN 0.5 WHEN event_id % 2 = 0 THEN 0 ELSE 0.75 END AS DOUBLE) AS confidence, CAST(CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS n_issues FROM events")
def _(spark, d):
    e = views.table(spark, d, "events")
    made = F.format_string('```json\n{"summary": "s%d", "confidence": %s, "totalIssues": 2, "issues": [{"type": "critical"}]}\n```', "event_id", F.when(F.col("event_id") % 2 == 0, "0").otherwise("0.75"))
    raw = e.select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit("not json")).otherwise(made).alias("response_raw"))
    return i.parse_findings(raw).select("event_id", "parsed_ok", "total_issues", "summary", "confidence", "n_issues")


@query("s4_harmonize_rects", q("""SELECT id, type, CAST(n AS INTEGER) AS rect_no, x + 100 * n AS x, y, width, height FROM v_issues, unnest(range(0, CASE WHEN seq % 3 = 0 THEN 1 ELSE 2 END)) AS t(n)""", v.ISSUES))
def _(spark, d):
    own = views.issues(spark, d)
    box = lambda dx: F.struct((F.col("x") + dx).alias("x"), F.col("y").alias("y"), F.col("width").alias("width"), F.col("height").alias("height"))
    none = F.lit(None).cast("struct<x:double,y:double,width:double,height:double>")
    k = F.col("seq") % 3
    flat = lambda dx: F.struct(none.alias("bbox"), (F.col("x") + dx).alias("x"), F.col("y").alias("y"), F.col("width").alias("width"), F.col("height").alias("height"))
    return i.harmonize_rects(own.select("id", "type", F.when(k == 0, box(0)).alias("bbox"), F.when(k == 1, F.array(box(0), box(100))).alias("bboxes"), F.when(k == 2, F.array(flat(0), flat(100))).alias("evidence")))


@query("s8_highlight_payload", q("SELECT doc_id, page_number, count(*) AS n, string_agg(id || '~' || type || '~' || description, chr(10) ORDER BY seq) AS payload FROM v_issues GROUP BY 1, 2", v.ISSUES))
def _(spark, d):
    return i.highlight_payload(views.issues(spark, d))


@query("s9_audit_report", q("SELECT doc_id, CAST(n AS INTEGER) AS line, n || '. [' || upper(type) || '] ' || description || ' (page ' || page_number || ')' AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM v_issues)", v.ISSUES))
def _(spark, d):
    return i.audit_report(views.issues(spark, d))


@query("p8_sanitize_enums", "SELECT event_id, CASE WHEN event_type IN ('critical', 'warning', 'attention', 'info') THEN event_type ELSE 'info' END AS type, CASE event_type WHEN 'error' THEN 'dispute' ELSE 'other' END AS category, CASE event_type WHEN 'view' THEN 'high' ELSE 'medium' END AS severity FROM events")
def _(spark, d):
    e = views.table(spark, d, "events").select("event_id", F.col("event_type").alias("type"), F.when(F.col("event_type") == "error", "dispute").otherwise("?").alias("category"), F.when(F.col("event_type") == "view", "high").alias("severity"))
    return i.sanitize_enums(e)


@query("p9_clamp_page", "SELECT event_id, CAST(CASE WHEN event_id % 7 = 0 THEN 1 ELSE greatest(1, least(user_id - 5, 20)) END AS INTEGER) AS page_number FROM events")
def _(spark, d):
    e = views.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.concat((F.col("user_id") - 5).cast("string"), F.lit("th"))).alias("page_number"), F.lit(20).alias("total_pages"))
    return i.clamp_page(e).select("event_id", "page_number")


@query("p10_clamp_confidence", "SELECT event_id, least(1.0, greatest(0.0, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN NULL ELSE value / 20 END, 0), 0.7))) AS confidence FROM events")
def _(spark, d):
    e = views.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, 0.0).when(F.col("event_id") % 3 == 2, F.col("value") / 20).alias("confidence"))
    return i.clamp_confidence(e)


@query("p12_cut_anchor", q("SELECT id, substr(anchor_text, 1, 8) AS anchor_text FROM v_issues", v.ISSUES))
def _(spark, d):
    return i.cut_anchor(views.issues(spark, d), 8).select("id", "anchor_text")


@query("p21_valid_coordinates", q("SELECT id, seq % 4 <> 0 AS valid FROM v_issues", v.ISSUES))
def _(spark, d):
    bad = F.when(F.col("seq") % 8 == 0, F.lit(float("nan"))).when(F.col("seq") % 4 == 0, F.lit(None).cast("double")).otherwise(F.col("x"))
    ok, rejects = i.valid_coordinates(views.issues(spark, d).withColumn("x", bad))
    return ok.select("id", F.lit(True).alias("valid")).union(rejects.select("id", F.lit(False)))


@query("p22_pixels_to_points", q("SELECT id, round(x * 72 / CASE WHEN page_number % 2 = 0 THEN 150 ELSE 300 END, 6) AS x, round(height * 72 / CASE WHEN page_number % 2 = 0 THEN 150 ELSE 300 END, 6) AS height FROM v_issues WHERE page_number % 3 <> 0", v.ISSUES))
def _(spark, d):
    own = views.issues(spark, d)
    meta = own.select("doc_id", "page_number").distinct().where("page_number % 3 <> 0").withColumn("dpi", F.when(F.col("page_number") % 2 == 0, 150))
    return i.pixels_to_points(own, meta).select("id", F.round("x", 6).alias("x"), F.round("height", 6).alias("height"))


@query("p24_in_bounds", q("SELECT id, x >= 0 AND y >= 0 AND x + width <= 612 AND y + height <= 792 AS contained, x >= 0 AND y >= 0 AND width > 0 AND height > 0 AND x + width <= 2000 AND y + height <= 3000 AS positive, x < 612 AND y < 792 AND x + width > 0 AND y + height > 0 AS intersects FROM v_issues", v.ISSUES))
def _(spark, d):
    out = views.issues(spark, d)
    for mode in ("contained", "positive", "intersects"):
        out = i.in_bounds(out, mode).withColumnRenamed("in_bounds", mode)
    return out.select("id", "contained", "positive", "intersects")


@query("p26_tooltip", q("SELECT id, description || chr(10) || 'Severity: ' || severity || CASE WHEN category = 'FCRA_violation' THEN chr(10) || 'FCRA Section: 611' ELSE '' END AS tooltip FROM v_issues", v.ISSUES))
def _(spark, d):
    own = views.issues(spark, d).withColumns({"fcra_section": F.when(F.col("category") == "FCRA_violation", "611"), "recommended_action": F.lit(None).cast("string")})
    return i.tooltip(own).select("id", "tooltip")


WHY = "CASE WHEN w = '' THEN 'Pattern matching analysis flagged this content' ELSE w END"


@query("p27_why_flagged", q(f"SELECT id, {WHY} AS why_flagged FROM (SELECT id, concat_ws('; ', CASE WHEN type = 'critical' THEN 'Critical accuracy issue detected' END, CASE WHEN length(anchor_text) BETWEEN 1 AND 19 THEN 'Text appears incomplete or missing' END, CASE WHEN contains(lower(description), 'missing') THEN 'Missing required information' END, CASE WHEN contains(lower(description), 'inconsistent') THEN 'Data inconsistency detected' END, CASE WHEN contains(lower(description), 'account number') THEN 'Account identification issue' END, CASE WHEN contains(lower(description), 'payment history') THEN 'Payment record anomaly' END) AS w FROM v_issues)", v.ISSUES))
def _(spark, d):
    return i.why_flagged(views.issues(spark, d)).select("id", "why_flagged")


@query("p28_recommend_action", q("SELECT id, CASE WHEN type = 'critical' THEN 'Immediate review required - contact credit bureau for correction' WHEN contains(lower(description), 'missing account number') THEN 'Request complete account information from creditor' WHEN contains(lower(description), 'payment history') THEN 'Verify payment records with original creditor' WHEN contains(lower(description), 'balance') THEN 'Cross-reference balance with creditor statements' ELSE 'Review and verify accuracy with relevant party' END AS recommended_action FROM v_issues", v.ISSUES))
def _(spark, d):
    return i.recommend_action(views.issues(spark, d).withColumn("recommended_action", F.lit(None).cast("string"))).select("id", "recommended_action")


@query("p30_color", q("SELECT id, CASE type WHEN 'critical' THEN '#ff4444' WHEN 'warning' THEN '#ff9944' WHEN 'attention' THEN '#ffdd44' ELSE '#44ddff' END AS color, CAST(CASE type WHEN 'info' THEN 68 ELSE 255 END AS INTEGER) AS red, CAST(CASE type WHEN 'critical' THEN 68 WHEN 'warning' THEN 153 ELSE 221 END AS INTEGER) AS green, CAST(CASE type WHEN 'info' THEN 255 ELSE 68 END AS INTEGER) AS blue FROM v_issues", v.ISSUES))
def _(spark, d):
    return i.color_of(views.issues(spark, d)).select("id", "color", "red", "green", "blue")


@query("p31_severity_score", q("SELECT id, CAST(CASE category WHEN 'collection' THEN 5 WHEN 'dispute' THEN 1 ELSE 3 END AS INTEGER) AS severity_score FROM v_issues", v.ISSUES))
def _(spark, d):
    return i.severity_score(views.issues(spark, d), "category").select("id", "severity_score")


@query("p35_enhance_issues", q("SELECT id, 'pattern' AS mapping_method, category || ' | ' || description AS context FROM v_issues", v.ISSUES))
def _(spark, d):
    return i.enhance_issues(views.issues(spark, d)).select("id", "mapping_method", "context")


@query("w1_dedup_exact", q("SELECT doc_id, id, page_number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, description, page_number ORDER BY seq) AS n FROM v_issues) WHERE n = 1", v.ISSUES))
def _(spark, d):
    return i.dedup_exact(views.issues(spark, d)).select(*COLS)


@query("w2_dedup_context", "WITH RECURSIVE " + v.ISSUES + """, ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, description, category ORDER BY seq) AS n FROM v_issues),
 fold AS (SELECT doc_id, description, category, n, seq, page_number, id, [page_number] AS kept, TRUE AS keep FROM ordered WHERE n = 1 UNION ALL
 SELECT o.doc_id, o.description, o.category, o.n, o.seq, o.page_number, o.id, CASE WHEN len(list_filter(f.kept, lambda p: abs(p - o.page_number) <= 1)) > 0 THEN f.kept ELSE list_append(f.kept, o.page_number) END, len(list_filter(f.kept, lambda p: abs(p - o.page_number) <= 1)) = 0
 FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.description = f.description AND o.category = f.category AND o.n = f.n + 1) SELECT doc_id, description, category, seq, page_number, id FROM fold WHERE keep""")
def _(spark, d):
    return i.dedup_context(views.issues(spark, d))


@query("w3_dedup_keep_severest", q(f"SELECT doc_id, id, page_number, position FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, substr(description, 1, 50) ORDER BY {SEV}, seq) AS n, min(seq) OVER (PARTITION BY doc_id, page_number, substr(description, 1, 50)) AS position FROM v_issues) WHERE n = 1", v.ISSUES))
def _(spark, d):
    return i.dedup_keep_severest(views.issues(spark, d)).select(*COLS, "position")


@query("w4_dedup_by_text", q("SELECT doc_id, id, page_number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, anchor_text ORDER BY seq) AS n FROM v_issues) WHERE n = 1", v.ISSUES))
def _(spark, d):
    return i.dedup_by_text(views.issues(spark, d)).select(*COLS)


GRID = "round_even(x / 10, 0) * 10 AS cell_x, round_even(y / 10, 0) * 10 AS cell_y"


@query("w5_dedup_grid_confidence", q(f"SELECT doc_id, id, page_number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, cell_x, cell_y, error_type ORDER BY confidence DESC, seq) AS n FROM (SELECT *, {GRID} FROM v_issues)) WHERE n = 1", v.ISSUES))
def _(spark, d):
    return i.dedup_grid_confidence(views.issues(spark, d)).select(*COLS)


@query("w6_dedup_grid_first", q(f"SELECT doc_id, id, page_number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, category, cell_x, cell_y ORDER BY seq) AS n FROM (SELECT *, {GRID} FROM v_issues)) WHERE n = 1", v.ISSUES))
def _(spark, d):
    return i.dedup_grid_first(views.issues(spark, d)).select(*COLS)


@query("w7_rank_issues", q(f"SELECT id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {SEV}, {TYP}, seq) AS INTEGER) AS position FROM v_issues", v.ISSUES))
def _(spark, d):
    return i.rank_issues(views.issues(spark, d)).select("id", "position")


@query("w14_number_rows", q("SELECT id, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY seq) AS INTEGER) AS number, count(*) OVER (PARTITION BY doc_id, page_number) AS of FROM v_issues", v.ISSUES))
def _(spark, d):
    return i.number_rows(views.issues(spark, d), ["doc_id", "page_number"], ["seq"]).select("id", "number", "of")


@query("w15_first_per", q("SELECT doc_id, category, arg_min(id, seq) AS id FROM v_issues GROUP BY 1, 2", v.ISSUES))
def _(spark, d):
    return i.first_per(views.issues(spark, d).select("doc_id", "category", "id", "seq"), ["doc_id", "category"], ["seq"]).select("doc_id", "category", "id")


@query("w16_top_k", q("SELECT doc_id, id, n AS rank FROM (SELECT doc_id, id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, seq) AS INTEGER) AS n FROM v_issues) WHERE n <= 3", v.ISSUES))
def _(spark, d):
    return i.top_k(views.issues(spark, d), ["doc_id"], [F.desc("confidence"), F.col("seq")], 3).select("doc_id", "id", "rank")


@query("u1_union_sources", q("SELECT source, count(*) AS n FROM (SELECT 'model' AS source FROM v_issues WHERE method = 'vision' UNION ALL SELECT 'validation' FROM v_issues WHERE type = 'critical' UNION ALL SELECT 'consistency' FROM v_issues WHERE type = 'warning') GROUP BY 1", v.ISSUES))
def _(spark, d):
    own = views.issues(spark, d)
    return i.union_sources(model=own.where("method = 'vision'"), validation=own.where("type = 'critical'").drop("method"), consistency=own.where("type = 'warning'")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("u6_difference", q("SELECT id FROM v_issues WHERE type <> 'info'", v.ISSUES))
def _(spark, d):
    own = views.issues(spark, d)
    return i.difference(own, own.where("type = 'info'"), ["id"]).select("id")


@query("j17_keep_mapped", q("SELECT id, type = 'critical' AS mapped FROM v_issues", v.ISSUES))
def _(spark, d):
    own = views.issues(spark, d)
    yes, no = i.keep_mapped(own, own.where("type = 'critical'"))
    return yes.select("id", F.lit(True).alias("mapped")).union(no.select("id", F.lit(False)))


@query("a1_count_by_type", q("SELECT doc_id, count(*) AS total, count_if(type = 'critical') AS critical, count_if(type = 'warning') AS warning, count_if(type = 'attention') AS attention, count_if(type = 'info') AS info FROM v_issues GROUP BY 1", v.ISSUES))
def _(spark, d):
    return r.count_by_type(views.issues(spark, d))


@query("a2_count_by_category", q("SELECT category, count(*) AS n FROM v_issues GROUP BY 1", v.ISSUES))
def _(spark, d):
    return r.count_by(views.issues(spark, d), "category")


@query("a3_detection_report", q("SELECT 'type' AS dimension, error_type AS value, count(*) AS n FROM v_issues GROUP BY 2 UNION ALL SELECT 'method', method, count(*) FROM v_issues GROUP BY 2 UNION ALL SELECT 'page', CAST(page_number AS VARCHAR), count(*) FROM v_issues GROUP BY 2", v.ISSUES))
def _(spark, d):
    return r.detection_report(views.issues(spark, d))


@query("a4_mean_confidence", q("SELECT doc_id, round(avg(confidence), 6) AS confidence FROM v_issues GROUP BY 1", v.ISSUES))
def _(spark, d):
    return r.mean_confidence(views.issues(spark, d))


@query("a5_merge_summaries", "SELECT conv_id AS doc_id, string_agg('Chunk ' || (turn + 1) || ': ' || substr(text, 1, 30), chr(10) ORDER BY turn) AS summary FROM conversations GROUP BY 1")
def _(spark, d):
    rows = views.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.substring("text", 1, 30).alias("s"))
    return r.merge_summaries(rows, "s", "turn")


@query("a6_pages_analyzed", q("SELECT doc_id, string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) AS pages, count(*) AS n_pages FROM (SELECT DISTINCT doc_id, page_number FROM v_issues) GROUP BY 1", v.ISSUES))
def _(spark, d):
    return r.pages_analyzed(views.issues(spark, d))


@query("a7_inconsistent_entities", q("SELECT account_id, count(DISTINCT status) AS n_status, CAST(arg_min(date, struct_pack(order_key, line_number, date, amount)) AS VARCHAR) AS first_date, arg_min(amount, struct_pack(order_key, line_number, date, amount)) AS first_amount FROM v_payments GROUP BY 1 HAVING count(DISTINCT status) > 1", v.PAYMENTS))
def _(spark, d):
    return r.inconsistent_entities(views.payments(spark, d)).withColumn("first_date", F.col("first_date").cast("string"))


@query("a9_call_cost", q("SELECT call_id, round(input_tokens / 1000000 * 1.25 + output_tokens / 1000000 * 10.0 + image_tokens / 1000000 * 2.0, 9) AS total_cost FROM v_calls", v.CALLS))
def _(spark, d):
    return r.call_cost(views.calls(spark, d)).select("call_id", F.round("total_cost", 9).alias("total_cost"))


def doc_pages(spark, d):
    return views.pages(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_pages"))


EST = "round(total_pages * 800 / 1000000 * 1.25 + total_pages * 1000 / 1000000 * 2.0 + least(total_pages * 200, 50000) / 1000000 * 10.0, 8)"


@query("a10_initial_estimate", q(f"SELECT doc_id, total_pages, {EST} AS estimate FROM v_docs", v.DOC_PAGES))
def _(spark, d):
    return r.initial_estimate(doc_pages(spark, d))


SUMMARY = """v_cost AS (SELECT d.doc_id, ceil(total_pages / 4) AS expected, coalesce(total, 0) AS total, coalesce(n, 0) AS n FROM v_docs d LEFT JOIN
 (SELECT doc_id, sum(input_tokens / 1000000 * 1.25 + output_tokens / 1000000 * 10.0 + image_tokens / 1000000 * 2.0) AS total, count(*) AS n FROM v_calls GROUP BY 1) c ON c.doc_id = d.doc_id),
 v_sum AS (SELECT doc_id, round(total, 8) AS total_cost, n AS chunks_processed, round(CASE WHEN n > 0 THEN total / n ELSE 0 END, 8) AS average_cost, round(greatest(0, expected - n) * CASE WHEN n > 0 THEN total / n ELSE 0 END, 8) AS remaining_cost, CASE WHEN n = 0 THEN 'estimating' WHEN n < expected THEN 'processing' ELSE 'completed' END AS status FROM v_cost)"""


@query("a11_cost_summary", q("SELECT * FROM v_sum", v.DOC_PAGES, v.CALLS, SUMMARY))
def _(spark, d):
    return r.cost_summary(views.calls(spark, d), doc_pages(spark, d))


@query("a12_over_budget", q("SELECT * FROM v_sum WHERE total_cost + remaining_cost > 0.05", v.DOC_PAGES, v.CALLS, SUMMARY))
def _(spark, d):
    return r.over_budget(r.cost_summary(views.calls(spark, d), doc_pages(spark, d)), 0.05)


@query("a13_final_cost_report", q(f"SELECT d.doc_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(image_tokens) AS BIGINT) AS image_tokens, round(sum(input_tokens / 1000000 * 1.25 + output_tokens / 1000000 * 10.0 + image_tokens / 1000000 * 2.0), 8) AS total_cost, round(sum(input_tokens / 1000000 * 1.25 + output_tokens / 1000000 * 10.0 + image_tokens / 1000000 * 2.0) / any_value({EST}), 6) AS efficiency FROM v_docs d JOIN v_calls c ON c.doc_id = d.doc_id GROUP BY 1", v.DOC_PAGES, v.CALLS))
def _(spark, d):
    return r.final_cost_report(views.calls(spark, d), doc_pages(spark, d))


@query("a14_length_cost", "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS estimated_tokens, round(ceil(length(text) / 4) / 1000000 * 1.27, 10) AS estimated_cost FROM documents")
def _(spark, d):
    return r.length_cost(views.table(spark, d, "documents")).select("doc_id", "estimated_tokens", "estimated_cost")


@query("a16_bounding_box", q("SELECT doc_id, line_no, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM v_tokens GROUP BY 1, 2", v.TOKENS))
def _(spark, d):
    from ledgerleaf.operators.locate import bounding_box

    return bounding_box(views.tokens(spark, d), ["doc_id", "line_no"])


INB = "x >= 0 AND y >= 0 AND x + width <= 612 AND y + height <= 792"
FUNNEL = f"v_funnel AS (SELECT doc_id, count(*) AS total, count(*) AS normalised, count_if({INB}) AS validated, count(DISTINCT CASE WHEN {INB} THEN page_number || '|' || category || '|' || x || '|' || y END) AS deduped FROM v_issues GROUP BY 1)"


@query("a17_validation_funnel", q("SELECT * FROM v_funnel", v.ISSUES, FUNNEL))
def _(spark, d):
    return r.validation_funnel(i.in_bounds(views.issues(spark, d)))


@query("a18_issue_quality", q("SELECT doc_id, count(*) AS n, count_if(page_number > 0) AS with_page, count_if(length(anchor_text) > 5) AS with_anchor, count_if(category = 'FCRA_violation') AS with_section FROM v_issues GROUP BY 1", v.ISSUES))
def _(spark, d):
    return r.issue_quality(views.issues(spark, d))


@query("a19_run_summary", q("SELECT count(*) AS documents, count_if(total = 0) AS without_issues, round(avg(total), 6) AS mean_issues, max(total) AS most_issues FROM (SELECT d.doc_id, count(i.id) AS total FROM documents d LEFT JOIN v_issues i ON i.doc_id = d.doc_id GROUP BY 1)", v.ISSUES))
def _(spark, d):
    per = views.table(spark, d, "documents").select("doc_id").join(r.count_by_type(views.issues(spark, d)).select("doc_id", "total"), "doc_id", "left")
    return r.run_summary(per.withColumn("total", F.coalesce("total", F.lit(0))))


@query("a20_issues_by_category", q("SELECT doc_id, category, count(*) AS n, string_agg(id, ',' ORDER BY seq) AS ids FROM v_issues GROUP BY 1, 2", v.ISSUES))
def _(spark, d):
    return r.issues_by_category(views.issues(spark, d))


@query("a21_account_type_summary", q("SELECT coalesce(account_type, 'Total') AS account_type, count(*) AS n, round(sum(balance), 2) AS balance FROM v_accounts GROUP BY ROLLUP (account_type)", v.ACCOUNTS))
def _(spark, d):
    return r.account_type_summary(views.accounts(spark, d))


@query("a23_quality_ratios", q("SELECT doc_id, round(validated / normalised, 6) AS in_bounds_ratio, round(CASE WHEN validated > 0 THEN deduped / validated ELSE 0 END, 6) AS dedup_ratio FROM v_funnel", v.ISSUES, FUNNEL))
def _(spark, d):
    return r.quality_ratios(r.validation_funnel(i.in_bounds(views.issues(spark, d))))


@query("a24_keyword_tallies", q("SELECT page_number, count(*) AS n, count_if(contains(lower(description), 'email')) AS n_email, count_if(contains(lower(description), 'digits')) AS n_digits FROM v_issues GROUP BY 1", v.ISSUES))
def _(spark, d):
    return r.keyword_tallies(views.issues(spark, d), ["email", "digits"])


@query("a25_distinct_counts", q("SELECT account_id, count(DISTINCT status) AS n_status, count(DISTINCT amount) AS n_amount FROM v_payments GROUP BY 1", v.PAYMENTS))
def _(spark, d):
    return r.distinct_counts(views.payments(spark, d), ["account_id"], ["status", "amount"])


@query("a26_utilization", q("SELECT account_id, CASE WHEN credit_limit > 0 THEN round(balance / credit_limit, 6) END AS utilization FROM v_accounts", v.ACCOUNTS))
def _(spark, d):
    return r.utilization(views.accounts(spark, d)).select("account_id", "utilization")
