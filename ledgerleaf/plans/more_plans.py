"""Queries on composed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerleaf.operators import chunking, compose, corpus, detect, embed, issues, locate, relate
from ledgerleaf.plans import chunk_plans, relate_plans
from ledgerleaf.plans import sql_views as v
from ledgerleaf.plans.sql_views import q
from ledgerleaf.sources import views
from ledgerleaf.sources.shared import new_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return add


@query("s2_flatten_spans", q("SELECT doc_id, page0 + 1 AS page_number, line_no AS l, str AS text, round(x + 0.004, 2) AS x FROM v_tokens", v.TOKENS))
def _(spark, d):
    blank = F.struct(F.lit("  ").alias("text"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("width"), F.lit(0.0).alias("height"))
    moved = lambda s: s.withField("x", s["x"] + 0.004)
    lines = lambda b: F.transform(b["lines"], lambda n: F.struct(F.concat(F.transform(n["spans"], moved), F.array(blank)).alias("spans")))
    pages = views.page_spans(spark, d).withColumn("blocks", F.transform("blocks", lambda b: F.struct(lines(b).alias("lines"))))
    own_lines = pages.select(F.struct("doc_id", "line_no").alias("doc_id"), "page_index", "blocks")
    return compose.flatten_spans(own_lines).select("doc_id.doc_id", "page_number", F.col("doc_id.line_no").alias("l"), "text", "x")


@query("s7_artifacts", q("SELECT lang, count(*) AS n FROM documents GROUP BY 1"))
def _(spark, d):
    path = new_folder(spark, "artifacts")
    compose.write_artifacts({"documents": views.table(spark, d, "documents").select("doc_id", "lang", "n_chars")}, path, "doc_id")
    return compose.read_artifact(spark, path, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("p29_context_clues", q("SELECT id, array_to_string(list_distinct_keep[1:8], ' ') AS clues FROM (SELECT id, [x for x, i in all_words if list_position(all_words, x) = i] AS list_distinct_keep FROM (SELECT id, list_concat(CASE WHEN contains(lower(description), 'email') THEN ['email'] ELSE [] END, CASE WHEN contains(lower(description), 'digits') THEN ['digits'] ELSE [] END, w[greatest(len(w) - 2, 1):len(w)], w[1:3]) AS all_words FROM (SELECT id, description, list_filter(string_split_regex(category || ' ' || description, '\\s+'), lambda x: length(x) > 0) AS w FROM v_issues)))", v.ISSUES))
def _(spark, d):
    own = views.issues(spark, d).withColumn("context", F.concat_ws(" ", "category", "description"))
    return compose.context_clues(own, ["email", "digits"]).select("id", F.array_join("clues", " ").alias("clues"))


@query("p34_map_semantic", "SELECT event_id, CASE event_type WHEN 'view' THEN 'account_data' WHEN 'error' THEN 'dispute_info' ELSE 'mixed' END AS semantic_type, CASE WHEN event_type IN ('view', 'error') THEN 'high' ELSE 'medium' END AS priority FROM events")
def _(spark, d):
    e = views.table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "account_summary").when(F.col("event_type") == "error", "dispute_history").otherwise("other").alias("t"))
    return compose.map_semantic(e, "t", "table").select("event_id", "semantic_type", "priority")


PROMPT = "CASE role WHEN 'assistant' THEN 'Check ' || text ELSE 'Audit chunk ' || turn || ' (pages ' || (turn + 1) || '): ' || text END"


@query("p39_render_prompts", f"SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS chunk_index, {PROMPT} AS prompt FROM conversations")
def _(spark, d):
    return prompts(spark, d).select("doc_id", "chunk_index", "prompt")


def prompts(spark, d):
    c = views.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_index"), F.col("role").alias("analysis_type"), (F.col("turn") + 1).cast("string").alias("pages"), "text")
    return compose.render_prompts(c, {"user": "Audit chunk {index} (pages {pages}): {text}", "assistant": "Check {text}"})


@query("x5_call_model", f"SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS chunk_index, CAST(length({PROMPT}) AS VARCHAR) AS response_raw FROM conversations")
def _(spark, d):
    return compose.call_model(prompts(spark, d), lambda p: p.str.len().astype(str))


@query("c10_table_region_chunks", q("SELECT doc_id, 'table' AS level, 'Headers: ' || string_agg(array_to_string(cells, ' | '), chr(10) ORDER BY line_no) AS text FROM v_tables GROUP BY 1 UNION ALL SELECT doc_id, 'region', substr(lower(text), 1, 500) FROM v_pages WHERE contains(lower(text), 'the ')", v.TABLES, v.PAGES))
def _(spark, d):
    table = corpus.table_to_text(views.page_tables(spark, d)).select("doc_id", F.lit("table").alias("level"), F.col("content").alias("text"))
    regions = corpus.semantic_regions(views.pages(spark, d), [("english", ["the "], "high"), ("other", ["zzzz"], "low")]).where("importance in ('high', 'critical')")
    return table.union(regions.select("doc_id", F.lit("region"), F.col("content")))


@query("c15_contextualize", q("SELECT c.chunk_id, concat_ws(chr(10), 'Document: ' || c.doc_id, 'Type: ' || c.semantic_type, 'Pages: ' || c.p, 'Related: ' || near, c.content) AS contextual_text FROM v_chunks c LEFT JOIN (SELECT a, string_agg(head, chr(10) ORDER BY n) AS near FROM (SELECT a.chunk_id AS a, substr(b.content, 1, 100) AS head, row_number() OVER (PARTITION BY a.chunk_id ORDER BY b.chunk_id) AS n FROM v_chunks a JOIN v_chunks b ON a.doc_id = b.doc_id AND a.chunk_id <> b.chunk_id AND abs(a.p - b.p) <= 2) WHERE n <= 3 GROUP BY 1) x ON x.a = c.chunk_id", relate_plans.CH))
def _(spark, d):
    own = relate_plans.chunks(spark, d)
    return compose.contextualize(own, relate.neighbours(own))


@query("c18_late_chunk", chunk_plans.ADAPTIVE.replace('CAST(stop AS INTEGER) AS "end", substr(text, start + 1, stop - start) AS text FROM fold', "CAST(stop AS INTEGER) AS \"end\", CAST(CASE WHEN floor(stop / n * 64) > floor(start / n * 64) THEN floor(stop / n * 64) - floor(start / n * 64) ELSE 6 END AS INTEGER) AS n_pooled FROM fold"))
def _(spark, d):
    chunks = chunking.chunk_adaptive(chunk_plans.docs(spark, d), 500)
    whole = chunk_plans.docs(spark, d).select("doc_id", F.length("text").alias("total"), F.array_repeat(F.lit(0.5), 64).alias("doc_vector"))
    return embed.pool_slice(chunks.join(whole, "doc_id")).select("doc_id", "chunk_index", "start", "end", F.size("pooled").alias("n_pooled"))


@query("a8_processing_metrics", q("SELECT doc_id, count(*) AS n_pages, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens, max((page_number - 1) // 5) + 1 AS n_chunks FROM v_pages GROUP BY 1", v.PAGES))
def _(spark, d):
    own = views.pages(spark, d)
    return compose.processing_metrics(own, chunking.group_pages(own))


@query("a15_validate_fields", "SELECT doc_id, 'licence' AS field, 'missing' AS problem, CAST(0 AS INTEGER) AS hit_no FROM documents WHERE NOT contains(text, 'License') UNION ALL SELECT doc_id, 'assigned', 'missing', 0 FROM documents WHERE NOT regexp_matches(text, 'token =(.?)')")
def _(spark, d):
    return compose.validate_fields(chunk_plans.docs(spark, d), [("licence", "License", True, None), ("assigned", "token =(.?)", True, None)])


@query("a22_other_items", "SELECT user_id AS doc_id, count_if(event_type = 'click') AS inquiry, count_if(event_type = 'view') AS record, count_if(event_type = 'error') AS collection, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    e = views.table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.when(F.col("event_type") == "click", "inquiry").when(F.col("event_type") == "view", "record").when(F.col("event_type") == "error", "collection").alias("kind"))
    return compose.other_items_summary(e)


@query("a27_analysis_result", q("SELECT r.doc_id, confidence, summary, coalesce(total, 0) AS total, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, coalesce(attention, 0) AS attention, coalesce(info, 0) AS info FROM (SELECT conv_id AS doc_id, round(avg(0.5 + turn / 100), 6) AS confidence, array_to_string(list(substr(text, 1, 20) ORDER BY turn)[1:3], '; ') AS summary FROM conversations GROUP BY 1) r LEFT JOIN (SELECT doc_id, count(*) AS total, count_if(type = 'critical') AS critical, count_if(type = 'warning') AS warning, count_if(type = 'attention') AS attention, count_if(type = 'info') AS info FROM v_issues GROUP BY 1) i ON i.doc_id = r.doc_id", v.ISSUES))
def _(spark, d):
    results = views.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.substring("text", 1, 20).alias("summary"), (0.5 + F.col("turn") / 100).alias("confidence"))
    return compose.analysis_result(views.issues(spark, d), results)


@query("w8_rank_chunks", q("SELECT chunk_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, chunk_id) AS INTEGER) AS position FROM v_chunks", chunk_plans.EMB))
def _(spark, d):
    from pyspark.sql import Window

    rank = issues.mapped(F.col("priority"), {"critical": 0, "high": 1, "medium": 2, "low": 3}, 4)
    return chunk_plans.chunks(spark, d).select("chunk_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "chunk_id")).alias("position"))


@query("u2_union_detections", q("SELECT source, error_type, count(*) AS n FROM (SELECT 'external' AS source, error_type FROM v_issues WHERE method = 'vision' UNION ALL SELECT 'pattern', error_type FROM v_issues WHERE method = 'pattern') GROUP BY 1, 2", v.ISSUES))
def _(spark, d):
    own = views.issues(spark, d)
    return issues.union_sources(pattern=own.where("method = 'pattern'"), external=own.where("method = 'vision'").drop("seq")).groupBy("source", "error_type").agg(F.count(F.lit(1)).alias("n"))


@query("u3_cells_to_issues", q("SELECT doc_id, line_no, CAST(i - 1 AS INTEGER) AS column_no, 'attention' AS type, 'Empty cell ' || (i - 1) || ' in row ' || line_no AS description FROM v_tables t, unnest(range(1, len(t.cells) + 1)) AS u(i) WHERE cells[i] = '' OR cells[i] = 'is'", v.TABLES))
def _(spark, d):
    own = views.page_tables(spark, d).withColumn("cells", F.transform("cells", lambda c: F.when(c == "is", "").otherwise(c)))
    return compose.cells_to_issues(own)


@query("u5_shares_identifier", "SELECT a.conv_id, a.turn, len(list_intersect(regexp_extract_all(a.text, '([a-z]{9,})', 1), regexp_extract_all(b.text, '([a-z]{9,})', 1))) > 0 AS shares FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def _(spark, d):
    c = views.table(spark, d, "conversations")
    ids = F.regexp_extract_all("text", F.lit("([a-z]{9,})"), F.lit(1))
    a, b = c.select("conv_id", "turn", ids.alias("a")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), ids.alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", compose.shares_identifier(F.col("a"), F.col("b")).alias("shares"))


@query("u7_union_levels", q("SELECT level, count(*) AS n FROM (SELECT 'page' AS level FROM v_pages UNION ALL SELECT 'group' FROM v_pages GROUP BY doc_id, (page_number - 1) // 5) GROUP BY 1", v.PAGES))
def _(spark, d):
    own = views.pages(spark, d)
    both = chunking.hierarchical_chunks(group=chunking.group_pages(own), page=own)
    return both.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("d5_detect_tables", q("SELECT doc_id, count(*) AS n_rows, min(line_no) AS header_row, max(line_no) AS last_row FROM (SELECT *, sum(CASE WHEN n >= 8 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (SELECT doc_id, line_no, count(*) AS n FROM v_tokens GROUP BY 1, 2)) WHERE n >= 8 GROUP BY doc_id, run HAVING count(*) >= 2", v.TOKENS))
def _(spark, d):
    rows = views.tokens(spark, d).groupBy("doc_id", F.col("line_no").alias("row_no")).agg(F.count(F.lit(1)).alias("n_cells"))
    return locate.table_runs(rows, 8)


TABLES_SQL = """
WITH {tokens}, t AS (SELECT doc_id, line_no // 40 + 1 AS page_number, line_no, token_idx, x, x + width AS e, str FROM v_tokens WHERE str <> '|'),
c AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, line_no ORDER BY x, e ROWS UNBOUNDED PRECEDING) AS cell
  FROM (SELECT *, CASE WHEN x - max(e) OVER (PARTITION BY doc_id, line_no ORDER BY x, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 20 THEN 0 ELSE 1 END AS new FROM t)
), cells AS (
  SELECT doc_id, page_number, line_no, cell, string_agg(str, ' ' ORDER BY x, token_idx) AS text, min(x) AS x, max(e) AS e FROM c GROUP BY 1, 2, 3, 4
), rs AS (SELECT doc_id, page_number, line_no, list(text ORDER BY cell) AS texts FROM cells GROUP BY 1, 2, 3),
runs AS (
  SELECT * FROM (SELECT *, sum(CASE WHEN len(texts) >= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_number ORDER BY line_no) AS run FROM rs)
  WHERE len(texts) >= 3
), cols AS (
  SELECT doc_id, page_number, run, sum(new) AS n_columns
  FROM (
    SELECT *, CASE WHEN x - max(e) OVER (PARTITION BY doc_id, page_number, run ORDER BY x, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 20 THEN 0 ELSE 1 END AS new
    FROM runs JOIN cells USING (doc_id, page_number, line_no)
  ) GROUP BY 1, 2, 3
), found AS (
  SELECT doc_id, page_number, run, min(line_no) AS first_line, count(*) AS n_rows, min_by(texts, line_no) AS header, flatten(list(texts ORDER BY line_no)) AS cells
  FROM runs GROUP BY 1, 2, 3 HAVING count(*) >= 2
), low AS (SELECT *, lower(array_to_string(cells, ' ')) AS l FROM found)
SELECT doc_id, page_number, CAST(50 + 15 * first_line AS DOUBLE) AS header_y, n_rows, n_columns, header, cells,
  CASE WHEN contains(l, 'payment') AND contains(l, 'history') THEN 'payment_history'
    WHEN contains(l, 'account') AND (contains(l, 'balance') OR contains(l, 'status')) THEN 'account_summary'
    WHEN contains(l, 'inquiry') OR contains(l, 'inquiries') THEN 'inquiry_list'
    WHEN contains(l, 'dispute') THEN 'dispute_history' ELSE 'other' END AS table_type
FROM low JOIN cols USING (doc_id, page_number, run)
""".replace("{tokens}", v.TOKENS)


@query("d5_tables", TABLES_SQL)
def _(spark, d):
    return locate.detect_tables(views.word_runs(spark, d))


LATE = """
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end",
  CAST(start // 1000 + 1 AS INTEGER) AS first_page, CAST(greatest(stop - 1, start) // 1000 + 1 AS INTEGER) AS last_page,
  len(pooled) AS n_pooled, round(list_sum(pooled), 6) + 0.0 AS total,
  contains(lower(t), 'license') AS has_table, starts_with(ltrim(lower(t), ' '), 'the') AS starts_section,
  coalesce(right(rtrim(lag(t) OVER (PARTITION BY doc_id ORDER BY chunk_index), ' '), 1) NOT IN ('.', '!', '?'), false) AS continues
FROM (
  SELECT f.*, substr(text, start + 1, stop - start) AS t,
    CASE WHEN floor(stop / n * 64) > floor(start / n * 64)
      THEN e.v[CAST(floor(start / n * 64) AS INTEGER) + 1 : CAST(floor(stop / n * 64) AS INTEGER)] ELSE e.v[1:6] END AS pooled
  FROM fold f JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e ON e.vec_id = f.doc_id % 100
)
"""


@query("c18_late_vectors", chunk_plans.ADAPTIVE.replace("SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS \"end\", substr(text, start + 1, stop - start) AS text FROM fold", LATE))
def _(spark, d):
    docs = chunk_plans.docs(spark, d)
    vectors = views.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("doc_vector"))
    whole = docs.select("doc_id", F.length("text").alias("total"), (F.col("doc_id") % 100).alias("vec_id")).join(vectors.hint("merge"), "vec_id").drop("vec_id")
    last = F.expr("cast((greatest(length(text), 1) - 1) div 1000 as int) + 1")
    starts = docs.select("doc_id", F.explode(F.sequence(F.lit(1), last)).alias("page_number")).withColumn("start", (F.col("page_number") - 1) * 1000)
    out = chunking.late_chunks(chunking.chunk_adaptive(docs, 500), whole, starts, ["license"], ["the"])
    total = F.round(F.aggregate("pooled", F.lit(0.0), lambda a, x: a + x), 6) + F.lit(0.0)
    return out.select("doc_id", "chunk_index", "start", "end", F.array_min("page_numbers").alias("first_page"), F.array_max("page_numbers").alias("last_page"), F.size("pooled").alias("n_pooled"), total.alias("total"), "has_table", "starts_section", "continues")


READ = """
SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS folder, count_if(NOT broken) AS n_pages, CAST(sum(CASE WHEN broken THEN 0 ELSE length(text) END) AS BIGINT) AS n_chars, count_if(broken) AS n_bad
FROM (SELECT *, (doc_id + page_number) % 7 = 0 AS broken FROM v_pages) GROUP BY 1
"""


@query("s11_read_folders", q(READ, v.PAGES))
def _(spark, d):
    path = new_folder(spark, "pages")
    pages = views.pages(spark, d)
    line = F.to_json(F.struct("doc_id", "page_number", "text", "width", "height"))
    cut = F.when((F.col("doc_id") + F.col("page_number")) % 7 == 0, F.substring(line, 1, 12)).otherwise(line)
    pages.where("doc_id % 2 = 0").select(cut.alias("value")).write.text(f"{path}/even")
    pages.where("doc_id % 2 = 1").select(cut.alias("value")).write.text(f"{path}/odd")
    rows = views.read_corpus(spark, {"json": [f"{path}/even", f"{path}/odd"]})
    bad = F.col("bad_record").isNotNull()
    folder = F.regexp_extract("source_file", "/(even|odd)/", 1).alias("folder")
    return rows.groupBy(folder).agg(F.count_if(~bad).alias("n_pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"), F.count_if(bad).alias("n_bad"))


CONFORM = """
SELECT c_custkey AS id, violation, path FROM customer, (VALUES
  (0, 'invalid_json', '$'), (1, 'extra_key', '$.notes'), (2, 'missing_key', '$.inquiries'), (3, 'wrong_order', '$.creditAccountsSummary'),
  (4, 'code_count', '$.accounts[1].paymentHistory'), (5, 'history_shape', '$.accounts[0].balanceHistory'), (5, 'history_shape', '$.accounts[1].creditLimitHistory'),
  (6, 'unmasked_id', '$.accounts[0].accountNumber'), (7, 'count_mismatch', '$.collections.collectionCount'), (8, 'unmasked_id', '$.personalInformation.socialSecurityNumber')
) AS t(k, violation, path) WHERE c_custkey % 10 = k
"""


@query("d22_conformance", CONFORM)
def _(spark, d):
    spec = detect.ExtractionSpec()
    k = F.col("c_custkey") % 10
    text = lambda v: F.to_json(v)
    year = lambda short: F.map_from_arrays(F.array(*[F.lit(x) for x in ("year", *spec.months)]), F.array_repeat(F.lit("-"), 13)) if not short else F.create_map(F.lit("year"), F.lit("-"))
    full = F.array_repeat(year(False), 3)

    def account(at: int):
        shape = {name: full for name in spec.histories}
        shape["balanceHistory"] = F.when((k == 5) & F.lit(at == 0), F.array_repeat(year(False), 2)).otherwise(full)
        shape["creditLimitHistory"] = F.when((k == 5) & F.lit(at == 1), F.array_repeat(year(True), 3)).otherwise(full)
        number = F.when((k == 6) & F.lit(at == 0), F.concat(F.lit("4000-1234-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))).otherwise(F.concat(F.lit("XXXX-"), F.lpad(F.substring(F.col("c_custkey").cast("string"), -4, 4), 4, "0")))
        codes = F.array_repeat(F.lit("OK"), F.when((k == 4) & F.lit(at == 1), 35).otherwise(36))
        return F.struct(F.col("c_name").alias("accountName"), number.alias("accountNumber"), codes.alias("paymentHistory"), *[c.alias(n) for n, c in shape.items()])

    kinds = lambda order: F.array(*[F.struct(F.lit(x).alias("accountType")) for x in order])
    ssn = F.when(k == 8, "123-45-6789").otherwise("XXX-XX-6789")
    parts = {
        "reportConfirmationDetails": F.struct(F.col("c_name").alias("consumerName")), "personalInformation": F.struct(F.col("c_name").alias("name"), ssn.alias("socialSecurityNumber")), "summary": F.struct(F.lit("x").alias("creditFileStatus")),
        "creditAccountsSummary": F.when(k == 3, kinds(spec.order[::-1])).otherwise(kinds(spec.order)),
        "otherItemsSummary": F.struct(F.array(F.lit("a")).alias("inquiries"), F.lit(1).alias("inquiryCount"), F.expr("cast(array() as array<string>)").alias("publicRecords"), F.lit(0).alias("publicRecordCount")),
        "accounts": F.array(account(0), account(1)), "collections": F.struct(F.array(F.lit("a"), F.lit("b")).alias("collections"), F.when(k == 7, 3).otherwise(2).alias("collectionCount")),
        "inquiries": F.when(k != 2, F.struct(F.lit(0).alias("n"))), "notes": F.when(k == 1, F.struct(F.lit("x").alias("n"))),
    }
    whole = text(F.struct(*[c.alias(n) for n, c in parts.items()]))
    own = views.spread(views.table(spark, d, "customer"))  # a row of some bytes becomes a document of some thousand
    rows = own.select(F.col("c_custkey").alias("id"), F.when(k == 0, F.substring(whole, 1, 40)).otherwise(whole).alias("json"))
    return detect.check_conformance(rows)


A15 = r"""
SELECT doc_id, 'secret' AS field, 'missing' AS problem, CAST(0 AS INTEGER) AS hit_no FROM documents WHERE NOT regexp_matches(text, '[Tt]he ([a-z]*)')
UNION ALL
SELECT doc_id, 'secret', 'empty', CAST(i - 1 AS INTEGER) FROM (SELECT doc_id, regexp_extract_all(text, '[Tt]he ([a-z]*)', 1) AS hits FROM documents), unnest(range(1, len(hits) + 1)) AS r(i) WHERE hits[i] = ''
"""


@query("a15_empty_values", A15)
def _(spark, d):
    return compose.validate_fields(chunk_plans.docs(spark, d), [("secret", "[Tt]he ([a-z]*)", True, 1)])


META = """
SELECT o_orderkey AS doc_id, o_orderpriority AS title, o_orderstatus AS author, CAST(NULL AS VARCHAR) AS subject, 'scan' AS creator, CAST(o_custkey AS VARCHAR) AS producer,
  CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS creation_date, CAST(NULL AS TIMESTAMP) AS modification_date FROM orders
"""


@query("p40_seven_fields", META)
def _(spark, d):
    told = F.create_map(F.lit("Title"), F.col("o_orderpriority"), F.lit("Author"), F.col("o_orderstatus"), F.lit("Creator"), F.lit("scan"), F.lit("Producer"), F.col("o_custkey").cast("string"), F.lit("CreationDate"), F.date_format("o_orderdate", "'D:'yyyyMMdd'000000Z'"), F.lit("ModDate"), F.lit("unknown"))
    return corpus.doc_metadata(views.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), told.alias("info")))


CONTEXT = """
SELECT c.chunk_id, concat_ws(chr(10), 'Document: Talk ' || c.doc_id, 'Section: ' || CASE WHEN c.p <= 2 THEN 'opening' END, 'Type: ' || c.semantic_type,
  'Priority: ' || CASE WHEN c.p = 1 THEN 'critical' ELSE 'medium' END, 'Pages: ' || c.p, 'Related: ' || near, c.content) AS contextual_text
FROM v_chunks c LEFT JOIN (
  SELECT a, string_agg(head, chr(10) ORDER BY n) AS near
  FROM (
    SELECT a.chunk_id AS a, substr(b.content, 1, 100) AS head, row_number() OVER (PARTITION BY a.chunk_id ORDER BY b.chunk_id) AS n
    FROM v_chunks a JOIN v_chunks b ON a.doc_id = b.doc_id AND a.chunk_id <> b.chunk_id AND abs(a.p - b.p) <= 2
  ) WHERE n <= 3 GROUP BY 1
) x ON x.a = c.chunk_id
"""


@query("c15_full_context", q(CONTEXT, relate_plans.CH))
def _(spark, d):
    page = F.element_at("page_numbers", 1)
    own = relate_plans.chunks(spark, d).withColumns({"title": F.concat(F.lit("Talk "), F.col("doc_id").cast("string")), "section_type": F.when(page <= 2, "opening"), "priority": F.when(page == 1, "critical").otherwise("medium")})
    return compose.contextualize(own, relate.neighbours(own))


SUMMARY = """
SELECT doc_id, substr(string_agg(t, chr(10) ORDER BY part, n), 1, 8000) AS summary
FROM (
  SELECT doc_id, 0 AS part, page_number AS n, 'Page ' || page_number || ': ' || substr(text, 1, 500) AS t FROM v_pages WHERE page_number <= 10
  UNION ALL
  SELECT doc_id, 1, 0, 'Table (other): ' || array_to_string(string_split('Headers: ' || string_agg(array_to_string(cells, ' | '), chr(10) ORDER BY line_no), chr(10))[1:3], chr(10)) FROM v_tables GROUP BY 1
  UNION ALL
  SELECT doc_id, 2, page_number, 'Region (english): ' || substr(lower(text), 1, 500) FROM v_pages WHERE contains(lower(text), 'the ') AND page_number <= 10
) GROUP BY 1
"""


@query("c16_full_summary", q(SUMMARY, v.PAGES, v.TABLES))
def _(spark, d):
    pages = views.pages(spark, d)
    tables = corpus.table_to_text(views.page_tables(spark, d)).withColumn("table_type", F.lit("other"))
    regions = corpus.semantic_regions(pages, [("english", ["the "], "high"), ("other", ["zzzz"], "low")])
    return chunking.summary_text(pages, tables=tables, regions=regions)


GATE = """
SELECT doc_id, page_number, substr(lower(text), 1, 500) AS content FROM v_pages
WHERE contains(lower(text), 'the ') AND (page_number % 5 = 0 OR page_number % 4 = 3)
"""


@query("c10_complex_pages", q(GATE, v.PAGES))
def _(spark, d):
    pages = views.pages(spark, d)
    regions = corpus.semantic_regions(pages, [("english", ["the "], "high"), ("other", ["zzzz"], "low")])
    weighed = pages.select("doc_id", "page_number", F.when(F.col("page_number") % 5 == 0, "very_complex").otherwise("simple").alias("complexity"), (F.col("page_number") % 4).alias("n_tables"))
    return chunking.complex_pages_only(regions, weighed).select("doc_id", "page_number", "content")
