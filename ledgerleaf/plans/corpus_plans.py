"""Queries on documents, pages and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerleaf.functions import text as t
from ledgerleaf.operators import corpus as c
from ledgerleaf.plans import sql_views as v
from ledgerleaf.plans.sql_views import q
from ledgerleaf.sources import views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
KEYWORDS = [("the", "english"), ("que", "romance"), ("der", "german")]
WORDS = ["the", "que"]


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return add


def docs(spark, d):
    return views.table(spark, d, "documents")


@query("s1_page_scan", q("SELECT doc_id, page_number, length(text) AS n FROM v_pages", v.PAGES))
def _(spark, d):
    return views.pages(spark, d).select("doc_id", "page_number", F.length("text").cast("long").alias("n"))


@query("s5_admissible", "SELECT doc_id, source || '/' || doc_id || '.PDF' AS path, n_chars AS length FROM documents WHERE n_chars BETWEEN 1 AND 2000")
def _(spark, d):
    files = docs(spark, d).select("doc_id", F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".PDF")).alias("path"), F.col("n_chars").alias("length"))
    return c.admissible(files, 2000)


@query("s6_document_id", "SELECT doc_id, substr(sha256(text), 1, 16) AS document_id FROM documents")
def _(spark, d):
    return c.document_id(docs(spark, d)).select("doc_id", "document_id")


@query("s11_batch_scan", "SELECT * FROM (SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier)")
def _(spark, d):
    one = spark.read.parquet(f"{d}/customer.parquet", ).select(F.lit("customer").alias("name"))
    return one.union(spark.read.parquet(f"{d}/supplier.parquet").select(F.lit("supplier"))).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("s12_cap_pages", q("SELECT doc_id, page_number FROM v_pages WHERE page_number <= 5", v.PAGES))
def _(spark, d):
    return c.cap_pages(views.pages(spark, d)).select("doc_id", "page_number")


@query("s13_page_meta", q("SELECT doc_id, page_number, CASE WHEN page_number % 2 = 0 THEN 150 ELSE 300 END AS dpi FROM v_pages WHERE page_number % 3 <> 0", v.PAGES))
def _(spark, d):
    meta = views.pages(spark, d).select("doc_id", "page_number", F.when(F.col("page_number") % 3 != 0, F.lit(2550)).alias("image_width_px"), F.lit(3300).alias("image_height_px"), F.when(F.col("page_number") % 2 == 0, 150).alias("dpi"))
    return c.page_meta(meta).select("doc_id", "page_number", "dpi")


@query("p1_normalize_text", "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", t.normalize_text(F.col("text")).alias("text"))


FULL = q("SELECT doc_id, string_agg('Page ' || page_number || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY page_number) AS full_text, count(*) AS total_pages FROM v_pages GROUP BY 1", v.PAGES)


@query("p2_full_text", FULL)
def _(spark, d):
    return c.full_text(views.pages(spark, d))


@query("p3_span_pages", q(f"""SELECT doc_id, CASE WHEN len(m) > 0 THEN array_to_string(list_sort(list_distinct(m)), ',') ELSE CAST(greatest(1, CAST(floor(0.5 * 10) AS INTEGER) + 1) AS VARCHAR) END AS pages
 FROM (SELECT doc_id, list_transform(regexp_extract_all(substr(full_text, 1 + length(full_text) // 2, 800), 'Page (\\d+):', 1), lambda x: CAST(x AS INTEGER)) AS m FROM ({FULL}))"""))
def _(spark, d):
    full = c.full_text(views.pages(spark, d))
    part = full.select("doc_id", F.expr("substr(full_text, 1 + length(full_text) div 2, 800)").alias("text"), F.lit(0.5).alias("start"), F.lit(1.0).alias("total_length"))
    return c.span_pages(part).select("doc_id", F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ",").alias("pages"))


@query("p4_span_pages_capped", q(f"""SELECT doc_id, CASE WHEN len(m) > 0 THEN array_to_string(m, ',') ELSE '1' END AS pages FROM (SELECT doc_id, list_filter(list_sort(list_distinct(list_transform(regexp_extract_all(full_text, 'Page (\\d+):', 1), lambda x: CAST(x AS INTEGER)))), lambda p: p <= 3) AS m FROM ({FULL}))"""))
def _(spark, d):
    full = c.full_text(views.pages(spark, d)).select("doc_id", F.col("full_text").alias("text"), F.lit(3).alias("total_pages"))
    return c.span_pages_capped(full).select("doc_id", F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ",").alias("pages"))


@query("p5_estimate_tokens", "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS up, CAST(length(text) // 4 AS BIGINT) AS down FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", t.estimate_tokens(F.col("text")).alias("up"), t.estimate_tokens(F.col("text"), "floor").alias("down"))


@query("p6_truncate_tokens", "SELECT doc_id, substr(text, 1, 400) AS text FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", t.truncate_tokens(F.col("text"), 100).alias("text"))


@query("p7_normalize_anchor", "SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS anchor FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", t.normalize_anchor(F.col("text")).alias("anchor"))


@query("p11_strip_fence", "SELECT event_id, trim(props) AS props FROM events")
def _(spark, d):
    fenced = views.table(spark, d, "events").select("event_id", F.concat(F.lit("```json\n"), "props", F.lit("\n```")).alias("props"))
    return fenced.select("event_id", t.strip_fence(F.col("props")).alias("props"))


COMPLEX = "v_complex AS (SELECT doc_id, page_number, text, page_number % 4 AS n_tables, page_number % 3 AS n_images, 2 * (page_number % 4) + page_number % 3 + length(text) // 1000 AS score FROM v_pages), v_class AS (SELECT *, CASE WHEN score <= 2 THEN 'simple' WHEN score <= 5 THEN 'moderate' WHEN score <= 10 THEN 'complex' ELSE 'very_complex' END AS content_complexity FROM v_complex)"


def complex_pages(spark, d):
    return c.page_complexity(views.pages(spark, d).withColumns({"n_tables": F.col("page_number") % 4, "n_images": F.col("page_number") % 3}))


@query("p13_page_complexity", q("SELECT doc_id, page_number, content_complexity FROM v_class", v.PAGES, COMPLEX))
def _(spark, d):
    return complex_pages(spark, d).select("doc_id", "page_number", "content_complexity")


SCORED = f"v_scored AS (SELECT doc_id, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS total_text, CAST(0.5 * count(*) + 2.0 * sum(n_tables) + sum(n_images) + 3.0 * count_if(content_complexity = 'very_complex') + 1.5 * count_if(page_number <= 2) + 2.0 * count_if(page_number > 6) AS DOUBLE) AS complexity FROM v_class GROUP BY 1)"


def scored(spark, d):
    pages = complex_pages(spark, d)
    return c.doc_complexity(pages, pages.where("page_number <= 2"), pages.where("page_number > 6"))


@query("p14_doc_complexity", q("SELECT doc_id, n_pages, total_text, complexity FROM v_scored", v.PAGES, COMPLEX, SCORED))
def _(spark, d):
    return scored(spark, d)


@query("p15_route_strategy", q("SELECT doc_id, CASE WHEN total_text > 50000 OR n_pages > 20 OR complexity > 8 THEN 'enhanced_late_chunking' WHEN total_text > 20000 OR n_pages > 10 OR complexity > 4 THEN 'streaming' ELSE 'traditional' END AS strategy FROM v_scored", v.PAGES, COMPLEX, SCORED))
def _(spark, d):
    return c.route_strategy(scored(spark, d)).select("doc_id", "strategy")


@query("p16_complex_layout", q("SELECT doc_id, bool_or(regexp_matches(text, '[│┌┐└┘├┤┬┴┼─]| {5,}')) AS complex_layout FROM v_pages GROUP BY 1", v.PAGES))
def _(spark, d):
    return c.has_complex_layout(views.pages(spark, d))


@query("p17_doc_type", q("SELECT doc_id, CASE WHEN bool_or(contains(lower(text), 'the')) THEN 'english' WHEN bool_or(contains(lower(text), 'que')) THEN 'romance' WHEN bool_or(contains(lower(text), 'der')) THEN 'german' ELSE 'unknown' END AS document_type FROM v_pages GROUP BY 1", v.PAGES))
def _(spark, d):
    return c.detect_doc_type(views.pages(spark, d), KEYWORDS)


def paged_tokens(spark, d):
    own = views.tokens(spark, d)
    return own.withColumns({"page_number": F.col("page0") + 1, "y": F.col("y") - 600.0 * F.col("page0")})


PTOK = "v_ptok AS (SELECT doc_id, page0 + 1 AS page_number, line_no, token_idx, str, x, y - 600.0 * page0 AS y FROM v_tokens)"


@query("p18_header_footer", q("SELECT doc_id, page_number, bool_or(y < 79.2) AS has_header, bool_or(y > 712.8) AS has_footer FROM v_ptok GROUP BY 1, 2", v.TOKENS, PTOK))
def _(spark, d):
    return c.header_footer(paged_tokens(spark, d))


@query("p19_columns", q("SELECT doc_id, page_number, CAST(least(3, count(DISTINCT floor(x / 50 + 0.5) * 50)) AS BIGINT) AS columns FROM v_ptok GROUP BY 1, 2", v.TOKENS, PTOK))
def _(spark, d):
    return c.estimate_columns(paged_tokens(spark, d))


@query("p20_page_labels", q("SELECT doc_id, page_number, string_agg(str, ' ' ORDER BY line_no, token_idx) AS labels FROM (SELECT doc_id, page_number, str, min(struct_pack(line_no, token_idx)).line_no AS line_no, min(struct_pack(line_no, token_idx)).token_idx AS token_idx FROM v_ptok WHERE length(str) BETWEEN 4 AND 99 AND regexp_matches(lower(str), 'tion|ment') GROUP BY 1, 2, 3) GROUP BY 1, 2", v.TOKENS, PTOK))
def _(spark, d):
    return c.page_labels(paged_tokens(spark, d), ["tion", "ment"]).select("doc_id", "page_number", F.array_join("labels", " ").alias("labels"))


@query("p25_estimate_layout", q("SELECT doc_id, line_no, token_idx, str, x, y, width, height FROM v_tokens", v.TOKENS))
def _(spark, d):
    return views.tokens(spark, d).select("doc_id", "line_no", "token_idx", "str", "x", "y", "width", "height")


@query("p32_account_lines", q("SELECT doc_id, page_number, array_to_string(list_filter(string_split(text, chr(10)), lambda l: contains(lower(l), 'the') OR contains(lower(l), 'que')), chr(10)) AS account_text FROM v_pages", v.PAGES))
def _(spark, d):
    return c.account_lines(views.pages(spark, d), WORDS).select("doc_id", "page_number", "account_text")


@query("p33_table_to_text", q("SELECT doc_id, 'Headers: ' || string_agg(array_to_string(cells, ' | '), chr(10) ORDER BY line_no) AS content FROM v_tables GROUP BY 1", v.TABLES))
def _(spark, d):
    return c.table_to_text(views.page_tables(spark, d))


@query("p36_classify_intent", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'late chunking') THEN 'late_chunking' WHEN contains(lower(text), 'fcra') THEN 'fcra' WHEN contains(lower(text), 'collection') THEN 'collections' WHEN contains(lower(text), 'dispute') THEN 'disputes' WHEN contains(lower(text), 'custom') THEN 'custom' ELSE 'late_chunking' END AS analysis_type FROM conversations WHERE role = 'user'")
def _(spark, d):
    return c.classify_intent(views.table(spark, d, "conversations").where("role = 'user'")).select("conv_id", "turn", "analysis_type")


@query("p37_mask_secret", "SELECT c_custkey, substr(c_name, 1, 4) || repeat('*', greatest(4, length(c_name) - 8)) || right(c_name, 4) AS masked FROM customer")
def _(spark, d):
    return views.table(spark, d, "customer").select("c_custkey", t.mask_secret(F.col("c_name")).alias("masked"))


@query("p40_doc_metadata", "SELECT o_orderkey AS doc_id, o_orderpriority AS title, o_orderdate AS creation_date FROM orders")
def _(spark, d):
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), F.try_to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).cast("timestamp_ntz").alias("creation_date"))


REG = " UNION ALL ".join(
    f"SELECT doc_id, page_number, 'region-' || page_number || '-{i}' AS id, '{kind}' AS type, '{imp}' AS importance, substr(lower(text), 1, 500) AS content FROM v_pages WHERE {' OR '.join(f'''contains(lower(text), '{w}')''' for w in words)}"
    for i, (kind, words, imp) in enumerate([("english", ["the ", "and "], "high"), ("romance", [" que ", " de "], "critical")])
)


@query("d2_semantic_regions", q(REG, v.PAGES))
def _(spark, d):
    return c.semantic_regions(views.pages(spark, d), [("english", ["the ", "and "], "high"), ("romance", [" que ", " de "], "critical")])


@query("d3_classify_table", q("""SELECT doc_id, line_no, CASE WHEN contains(t, 'payment') AND contains(t, 'history') THEN 'payment_history' WHEN contains(t, 'account') AND (contains(t, 'balance') OR contains(t, 'status')) THEN 'account_summary'
 WHEN contains(t, 'inquiry') OR contains(t, 'inquiries') THEN 'inquiry_list' WHEN contains(t, 'dispute') THEN 'dispute_history' ELSE 'other' END AS table_type FROM (SELECT doc_id, line_no, lower(array_to_string(cells, ' ')) AS t FROM v_tables)""", v.TABLES))
def _(spark, d):
    return c.classify_table(views.page_tables(spark, d)).select("doc_id", "line_no", "table_type")


@query("d4_accounts_from_tables", q("SELECT doc_id, line_no, coalesce(nullif(cells[1], ''), 'Unknown') AS creditor_name, coalesce(nullif(cells[2], ''), 'Unknown') AS account_number, coalesce(nullif(cells[3], ''), 'Unknown') AS account_type, coalesce(nullif(cells[4], ''), 'Unknown') AS status FROM v_tables WHERE line_no > (SELECT min(line_no) FROM v_tables m WHERE m.doc_id = v_tables.doc_id)", v.TABLES))
def _(spark, d):
    return c.accounts_from_tables(views.page_tables(spark, d))
