"""Queries on the pattern library and on what follows from its hits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerleaf.operators import compose, config, detect, issues, locate, patterns
from ledgerleaf.operators.issues import SEVERITY_SCORE
from ledgerleaf.plans import sql_views as v
from ledgerleaf.plans.sql_views import q
from ledgerleaf.sources import views
from ledgerleaf.sources.shared import shared_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: A rule table of the caller's own, with classes that the driver's texts hold, beside the library's.
OWN_RULES = {**patterns.PATTERNS, "contact": [r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", r"\bLICENSE\b"], "amount": [r"\b\d{3,}\b"]}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return add


HITS = "v_found AS (" + " UNION ALL ".join(
    f"SELECT doc_id, line_no, {n} AS pass_no, '{name}' AS error_type, {k} AS pattern_no, regexp_extract_all(line, '(?i){p}') AS hits, {SEVERITY_SCORE.get(name, 3)} AS severity FROM v_lines"
    for n, (name, ps) in enumerate(OWN_RULES.items(), 1)
    for k, p in enumerate(ps)
) + "), v_hits AS (SELECT doc_id, line_no, pass_no, error_type, pattern_no, CAST(i - 1 AS INTEGER) AS hit_no, hits[i] AS hit, severity FROM v_found f, unnest(range(1, len(f.hits) + 1)) AS t(i))"


def hits(spark, d):
    return patterns.detect_patterns(views.lines(spark, d), OWN_RULES)


@query("d1_pattern_library", q("SELECT *, 'Pattern match: ' || hit AS description, CAST(0.95 AS DOUBLE) AS confidence, 'pattern' AS method FROM v_hits", v.LINES, HITS))
def _(spark, d):
    return hits(spark, d)


@query("d20_multi_pass_scan", q("SELECT pass_no, error_type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM v_hits GROUP BY 1, 2", v.LINES, HITS))
def _(spark, d):
    return patterns.pass_counts(hits(spark, d))


@query("a3_severe_list", q("SELECT doc_id, line_no, error_type, pattern_no, hit_no, hit FROM v_hits WHERE severity >= 3", v.LINES, HITS))
def _(spark, d):
    return patterns.severe(hits(spark, d), 3).select("doc_id", "line_no", "error_type", "pattern_no", "hit_no", "hit")


@query("j21_apply_rules", q("SELECT error_type, severity, count(*) AS n FROM v_hits GROUP BY 1, 2", v.LINES, HITS))
def _(spark, d):
    return hits(spark, d).groupBy("error_type", "severity").agg(F.count(F.lit(1)).alias("n"))


BY_TABLE = """v_rules AS (SELECT DISTINCT lang AS error_type, '(^|[^A-Za-z])' || lang || '([^A-Za-z]|$)' AS pattern FROM documents),
 v_told AS (SELECT doc_id, line_no, error_type, regexp_extract_all(line, '(?i)' || pattern) AS hits FROM v_lines, v_rules)"""


@query("x1_rules_by_analysis", q("""SELECT doc_id, line_no, error_type, CAST(i - 1 AS INTEGER) AS hit_no, hits[i] AS hit
 FROM v_told, unnest(range(1, len(hits) + 1)) AS t(i)""", v.LINES, BY_TABLE))  # fmt: skip
def _(spark, d):
    names = views.table(spark, d, "documents").select(F.col("lang").alias("error_type"))
    mentions = names.select(F.lit("mentions").alias("analysis"), "error_type", F.concat(F.lit("(^|[^A-Za-z])"), "error_type", F.lit("([^A-Za-z]|$)")).alias("pattern"))
    whole = names.select(F.lit("whole_lines").alias("analysis"), "error_type", F.concat(F.lit("^"), "error_type", F.lit("$")).alias("pattern"))
    hits = patterns.detect_patterns(views.lines(spark, d), mentions.union(whole), analysis="mentions")
    return hits.select("doc_id", "line_no", "error_type", "hit_no", "hit")


@query("x2_configured_audit", q("""SELECT doc_id, line_no, error_type, hit, severity, CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY severity DESC, line_no, pass_no, pattern_no, hit_no) AS rank FROM (
  SELECT *, lag(line_no) OVER (PARTITION BY doc_id, error_type, hit ORDER BY line_no, pass_no, pattern_no, hit_no) AS before FROM v_hits WHERE severity >= 2)
 WHERE before IS NULL OR line_no - before > 3) WHERE rank <= 20""", v.LINES, HITS))  # fmt: skip
def _(spark, d):
    own = config.override(config.AuditConfig(), {"detect": {"rules": OWN_RULES, "least_severity": 2}, "findings": {"gap": 3, "top": 20}})
    return config.audit_lines(views.lines(spark, d), own).select("doc_id", "line_no", "error_type", "hit", "severity", "rank")


NOTATIONS = [*patterns.DISPUTES, "license", "error"]


@query("d19_dispute_notations", q("SELECT doc_id, line_no, CASE " + " ".join(f"WHEN contains(lower(line), '{w}') THEN '{w}'" for w in NOTATIONS) + " END AS notation FROM v_lines WHERE " + " OR ".join(f"contains(lower(line), '{w}')" for w in NOTATIONS), v.LINES))
def _(spark, d):
    return patterns.dispute_notations(views.lines(spark, d), NOTATIONS).select("doc_id", "line_no", "notation")


@query("d11_truncated_ids", q("SELECT doc_id, line_no FROM v_lines WHERE regexp_matches(line, '[X*]{3,}[ -]?[A-Za-z0-9]*|[.]{3,}[0-9]{4}')", v.LINES))
def _(spark, d):
    return patterns.truncated_ids(views.lines(spark, d)).select("doc_id", "line_no")


STALE = """v_stale AS (SELECT account_id, opened, list_contains(statuses, 'P') AS negative, CASE WHEN len(statuses) = 1 THEN opened END AS closed_on,
 CASE WHEN account_id % 2 = 0 THEN opened END AS inquired_on FROM v_accounts)"""


@query("d17_stale_items", q("""SELECT account_id, 'old_negative' AS reason FROM v_stale WHERE negative AND opened < DATE '2003-06-01' - INTERVAL 84 MONTH
 UNION ALL SELECT account_id, 'old_closed' FROM v_stale WHERE closed_on < DATE '2003-06-01' - INTERVAL 120 MONTH
 UNION ALL SELECT account_id, 'old_inquiry' FROM v_stale WHERE inquired_on < DATE '2003-06-01' - INTERVAL 24 MONTH""", v.ACCOUNTS, STALE))  # fmt: skip
def _(spark, d):
    own = views.accounts(spark, d)
    items = own.select("account_id", "opened", F.array_contains("statuses", "P").alias("negative"), F.when(F.size("statuses") == 1, F.col("opened")).alias("closed_on"), F.when(F.col("account_id") % 2 == 0, F.col("opened")).alias("inquired_on"))
    return detect.stale_items(items, "2003-06-01").select("account_id", "reason")


@query("d14_collection_entries", q("SELECT account_id FROM v_accounts WHERE list_contains(statuses, 'P')", v.ACCOUNTS))
def _(spark, d):
    return detect.collection_entries(views.accounts(spark, d), ["P", "C"]).select("account_id")


@query("w19_status_changes", q("SELECT source, event_id, status FROM (SELECT *, lag(status) OVER (PARTITION BY source ORDER BY ts, event_id) AS before FROM v_status) WHERE before IS NULL OR before <> status", v.STATUS))
def _(spark, d):
    return detect.status_changes(views.status(spark, d)).select("source", "event_id", "status")


@query("u4_distinct_values", q("SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, lower(str) AS w FROM v_tokens) GROUP BY 1", v.TOKENS))
def _(spark, d):
    return compose.distinct_values(views.words(spark, d), "doc_id", F.lower("str"))


@query("x6_model_audit", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN (SELECT o FROM (SELECT 'view' AS o UNION ALL SELECT 'click')) GROUP BY 1")
def _(spark, d):
    allowed = spark.createDataFrame([("view",), ("click",)], "event_type string")
    return detect.unapproved(views.table(spark, d, "events"), allowed, "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("x3_progress", "SELECT count(*) AS rows, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors FROM events")
def _(spark, d):
    rows, watch = compose.observed(views.table(spark, d, "events"), "events", errors=F.count_if(F.col("event_type") == "error"))
    rows.write.format("noop").mode("overwrite").save()
    got = watch.get
    return spark.createDataFrame([(got["rows"], got["errors"])], "rows long, errors long")


CONTEXT = "v_context AS (SELECT conv_id AS doc_id, turn AS chunk_index, CASE WHEN length(text) % 3 <> 0 THEN substr(text, 1, 40) END AS s FROM conversations)"


@query("w13_carry_context", q("""SELECT doc_id, chunk_index, coalesce(lag(s) OVER w, '') AS carried, coalesce(last_value(s IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS kept
 FROM v_context WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""".replace("OVER (w ROWS", "OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS"), CONTEXT))  # fmt: skip
def _(spark, d):
    c = views.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.when(F.length("text") % 3 != 0, F.substring("text", 1, 40)).alias("context_summary"))
    kept = issues.carry_context(c, keep=True).withColumnRenamed("carried", "kept")
    return issues.carry_context(kept).select("doc_id", "chunk_index", "carried", "kept")


@query("s10_latest_audit", "SELECT 'last' AS asked, user_id AS source, max(ts) AS ts, max_by(event_id, struct_pack(ts, event_id)) AS event_id FROM events GROUP BY 2 UNION ALL SELECT 'then', user_id, max(ts), max_by(event_id, struct_pack(ts, event_id)) FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 2")
def _(spark, d):
    path = f"{shared_dir(spark)}/ledgerleaf-audit-{uuid.uuid4().hex}"
    e = views.table(spark, d, "events").select(F.col("user_id").alias("source"), "ts", "event_id", F.to_date("ts").alias("date"))
    compose.append_audit(e.where("event_id % 2 = 0"), path)
    compose.append_audit(e.where("event_id % 2 = 1"), path)
    log = spark.read.parquet(path)
    then = compose.latest_audit(log, at="2024-01-15 00:00:00")
    return compose.latest_audit(log).select(F.lit("last").alias("asked"), "*").union(then.select(F.lit("then").alias("asked"), "*"))


@query("s4_coordinates", q("SELECT id, type, CAST(n AS INTEGER) AS rect_no, x + 100 * n AS x, y, width, height FROM v_issues, unnest(range(0, CASE WHEN seq % 3 = 0 THEN 1 ELSE 2 END)) AS t(n)", v.ISSUES))
def _(spark, d):
    own = views.issues(spark, d)
    box = lambda dx: F.struct((F.col("x") + dx).alias("x"), "y", "width", "height")
    given = F.when(F.col("seq") % 3 == 0, F.to_json(box(0))).when(F.col("seq") % 3 == 1, F.to_json(F.array(box(0), box(100))))
    none = "array<struct<bbox:struct<x:double,y:double,width:double,height:double>,x:double,y:double,width:double,height:double>>"
    rest = F.when(F.col("seq") % 3 == 2, F.array(box(0), box(100)))
    return issues.harmonize_rects(own.select("id", "type", given.alias("coordinates"), F.lit(None).cast("struct<x:double,y:double,width:double,height:double>").alias("bbox"), rest.alias("bboxes"), F.lit(None).cast(none).alias("evidence")))


@query("p23_flip_origin", q("SELECT doc_id, line_no, token_idx, 20000.0 - y - h AS y, CASE WHEN token_idx % 4 = 0 THEN length(str) * h / 2 ELSE width END AS width FROM (SELECT *, CASE WHEN token_idx % 3 = 0 THEN 12.0::DOUBLE ELSE height END AS h FROM v_tokens)", v.TOKENS))
def _(spark, d):
    gaps = views.tokens(spark, d).withColumns({"height": F.when(F.col("token_idx") % 3 != 0, F.col("height")), "width": F.when(F.col("token_idx") % 4 != 0, F.col("width"))})
    return locate.flip_origin(gaps, 20000.0).select("doc_id", "line_no", "token_idx", "y", "width")


@query("j15_locate_hits", q("SELECT id, line_no, lx, lw FROM (SELECT i.id, l.line_no, l.lx, l.lw, row_number() OVER (PARTITION BY i.id ORDER BY l.line_no) AS n FROM v_issues i JOIN (SELECT doc_id, line_no, line, 50.0 AS lx, CAST(8 * length(line) AS DOUBLE) AS lw FROM v_lines) l ON l.doc_id = i.doc_id AND contains(l.line, i.anchor_text)) WHERE n = 1", v.ISSUES))
def _(spark, d):
    return locate.match_line(views.issues(spark, d), views.lines(spark, d))


MERGE = f"""WITH RECURSIVE {v.ISSUES}, v_boxes AS (SELECT doc_id, page_number, error_type AS key, list(struct_pack(x := x, y := y, x2 := x + width, y2 := y + height) ORDER BY seq) AS rs FROM v_issues GROUP BY 1, 2, 3),
fold AS (SELECT doc_id, page_number, key, rs, 1 AS i, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, x2 DOUBLE, y2 DOUBLE, n INTEGER)[]) AS acc FROM v_boxes
 UNION ALL SELECT doc_id, page_number, key, rs, i + 1, CASE WHEN slot > 0 THEN list_transform(acc, lambda m, k: CASE WHEN k = slot THEN struct_pack(x := least(m.x, rs[i].x), y := least(m.y, rs[i].y), x2 := greatest(m.x2, rs[i].x2), y2 := greatest(m.y2, rs[i].y2), n := m.n + 1) ELSE m END)
  ELSE list_append(acc, struct_pack(x := rs[i].x, y := rs[i].y, x2 := rs[i].x2, y2 := rs[i].y2, n := CAST(1 AS INTEGER))) END
 FROM (SELECT *, coalesce(list_position(list_transform(acc, lambda m: rs[i].x <= m.x2 + 10 AND m.x <= rs[i].x2 + 10 AND rs[i].y <= m.y2 + 10 AND m.y <= rs[i].y2 + 10), true), 0) AS slot FROM fold WHERE i <= len(rs)))
SELECT doc_id, page_number, key, m.x AS x, m.y AS y, m.x2 - m.x AS width, m.y2 - m.y AS height, m.n AS n FROM (SELECT doc_id, page_number, key, unnest(acc) AS m FROM fold WHERE i = len(rs) + 1)"""


@query("w12_merge_regions", MERGE)
def _(spark, d):
    return compose.merge_regions(views.issues(spark, d).withColumn("key", F.col("error_type")), 10.0)
