"""Queries on chunkers and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerleaf.functions import vectors as vec
from ledgerleaf.operators import chunking as c
from ledgerleaf.operators import config
from ledgerleaf.operators import corpus, embed, locate
from ledgerleaf.plans import sql_views as v
from ledgerleaf.plans.corpus_plans import FULL
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


def docs(spark, d):
    return views.table(spark, d, "documents").select("doc_id", "text")


def last(delim: str, width: int) -> str:
    """Last start (from 0) of ``delim`` at or before ``full``, or -1."""
    head = f"substr(text, 1, full_end + {width})"
    return f"CASE WHEN strpos(reverse({head}), reverse({delim})) = 0 THEN -1 ELSE length({head}) - strpos(reverse({head}), reverse({delim})) - {width} + 1 END"


def folded(size: str, rule: str, rest: str) -> str:
    breaks = f"{last('chr(10) || chr(10)', 2)} AS pp, {last(repr('. '), 2)} AS st, {last('chr(10)', 1)} AS nl"
    return f"""WITH RECURSIVE base AS (SELECT doc_id, text, length(text) AS n, {size} AS size FROM documents WHERE length(text) > 0),
 fold AS (SELECT doc_id, text, n, size, 0 AS chunk_index, 0 AS start, (SELECT CASE WHEN full_end >= n THEN n ELSE CAST({rule} AS INTEGER) END FROM (SELECT *, {breaks} FROM (SELECT text, n, 0 AS pos, size, least(size, n) AS full_end))) AS stop FROM base
 UNION ALL SELECT doc_id, text, n, size, chunk_index + 1, stop, CASE WHEN full_end >= n THEN n ELSE CAST({rule} AS INTEGER) END FROM (SELECT *, {breaks} FROM (SELECT doc_id, text, n, size, chunk_index, stop, stop AS pos, least(stop + size, n) AS full_end FROM fold WHERE stop < n)))
 {rest}"""


NATURAL = folded("700", "CASE WHEN pp > pos + size * 0.6 THEN pp + 2 WHEN st > pos + size * 0.7 THEN st + 2 WHEN nl > pos + size * 0.8 THEN nl + 1 ELSE full_end END", "SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS \"end\", regexp_replace(substr(text, start + 1, stop - start), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') AS text FROM fold WHERE length(regexp_replace(substr(text, start + 1, stop - start), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')) > 0")


@query("c1_chunk_natural", NATURAL)
def _(spark, d):
    return c.chunk_natural(docs(spark, d), 700)


ADAPTIVE = folded("CASE WHEN ceil(length(text) / 4) > 1000 THEN 1000 WHEN ceil(length(text) / 4) > 500 THEN 750 ELSE 500 END", "CASE WHEN greatest(pp, st, nl) > pos + size * 0.5 THEN greatest(pp, st, nl) + 1 ELSE full_end END", "SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS \"end\", substr(text, start + 1, stop - start) AS text FROM fold")


@query("c2_chunk_adaptive", ADAPTIVE)
def _(spark, d):
    return c.chunk_adaptive(docs(spark, d), 500)


@query("x2_configured_chunks", ADAPTIVE)
def _(spark, d):
    own = config.override(config.AuditConfig(), {"chunk": {"method": "adaptive", "small": 500}})
    return config.chunk(docs(spark, d), own.chunk)


def packed(div: str) -> str:
    return f"""WITH RECURSIVE {v.PAGES}, p AS (SELECT doc_id, page_number, CAST({div} + CASE WHEN page_number % 3 = 0 THEN 120 ELSE 0 END AS INTEGER) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS i FROM v_pages),
 fold AS (SELECT doc_id, page_number, n, i, 0 AS chunk, n AS total FROM p WHERE i = 1 UNION ALL
 SELECT p.doc_id, p.page_number, p.n, p.i, CASE WHEN f.total + p.n <= 500 THEN f.chunk ELSE f.chunk + 1 END, CASE WHEN f.total + p.n <= 500 THEN f.total + p.n ELSE p.n END FROM fold f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1)"""


def imaged(spark, d):
    return views.pages(spark, d).withColumn("has_image", F.col("page_number") % 3 == 0)


@query("c3_pack_pages", packed("ceil(length(text) / 4)") + " SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_index, min(page_number) AS page_start, max(page_number) AS page_end, CAST(sum(n) AS BIGINT) AS tokens FROM fold GROUP BY 1, 2")
def _(spark, d):
    return c.chunk_ranges(c.pack_pages(imaged(spark, d), 500, 120))


@query("c4_pack_pages_labeled", packed("length(text) // 4") + " SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_index, page_number, n AS tokens FROM fold")
def _(spark, d):
    return c.pack_pages(imaged(spark, d), 500, 120, "floor")


@query("c5_group_pages", q("SELECT doc_id, CAST((rn - 1) // 5 AS INTEGER) AS chunk_index, 'Pages ' || min(page_number) || '-' || max(page_number) AS caption, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS rn FROM v_pages) GROUP BY 1, 2", v.PAGES))
def _(spark, d):
    return c.group_pages(views.pages(spark, d))


@query("c6_pack_paragraphs", f"""WITH RECURSIVE whole AS ({FULL}), para AS (SELECT doc_id, p, i, CAST(ceil(length(p) / 4) AS INTEGER) AS n FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split_regex(full_text, '\\n[ \\t\\n\\r\\f\\v]*\\n'), lambda x: length(trim(x)) > 0) AS ps FROM whole)), LATERAL (SELECT ps[i] AS p)),
 fold AS (SELECT doc_id, i, 0 AS chunk, n AS total FROM para WHERE i = 1 UNION ALL SELECT a.doc_id, a.i, CASE WHEN f.total + a.n <= 400 THEN f.chunk ELSE f.chunk + 1 END, CASE WHEN f.total + a.n <= 400 THEN f.total + a.n ELSE a.n END FROM fold f JOIN para a ON a.doc_id = f.doc_id AND a.i = f.i + 1)
 SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_index, trim(string_agg(p, chr(10) || chr(10) ORDER BY i)) AS text, CAST(sum(n) AS INTEGER) AS tokens FROM fold JOIN para USING (doc_id, i) GROUP BY 1, 2""")
def _(spark, d):
    full = corpus.full_text(views.pages(spark, d)).withColumnRenamed("full_text", "text")
    return c.pack_paragraphs(full, 400)


SECTIONS = "v_sections AS (SELECT doc_id, 'intro' AS section_type, 'critical' AS importance, 1 AS page_start, 2 AS page_end FROM v_pages GROUP BY 1 UNION ALL SELECT doc_id, 'body', 'medium', 3, 5 FROM v_pages GROUP BY 1)"


def sections(spark, d):
    ids = views.pages(spark, d).select("doc_id").distinct()
    made = F.array(F.struct(F.lit("intro").alias("section_type"), F.lit("critical").alias("importance"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end")), F.struct(F.lit("body").alias("section_type"), F.lit("medium").alias("importance"), F.lit(3).alias("page_start"), F.lit(5).alias("page_end")))
    return ids.select("doc_id", F.explode(made).alias("s")).select("doc_id", "s.*")


@query("c7_section_chunks", q("SELECT s.doc_id, section_type, CASE WHEN importance = 'critical' THEN 'critical' ELSE 'medium' END AS priority, count(*) AS n_pages, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text FROM v_sections s JOIN v_pages p ON p.doc_id = s.doc_id AND page_number BETWEEN page_start AND page_end GROUP BY 1, 2, 3", v.PAGES, SECTIONS))
def _(spark, d):
    return c.section_chunks(sections(spark, d), views.pages(spark, d).select("doc_id", "page_number", "text"))


def entities(spark, d):
    ids = views.pages(spark, d).select("doc_id").distinct()
    return ids.select("doc_id", F.col("doc_id").alias("entity_id"), F.concat(F.lit("Account "), F.col("doc_id").cast("string")).alias("header"), (F.col("doc_id") % 3 == 0).alias("disputed"), F.array(F.lit(1), F.lit(3)).alias("page_numbers"))


ENT = "SELECT doc_id, doc_id AS entity_id, '{level}' AS level, CASE WHEN doc_id % 3 = 0 THEN 'critical' ELSE 'high' END AS priority, 'Account ' || doc_id || chr(10) || string_agg(text, chr(10) ORDER BY page_number) AS text FROM v_pages WHERE page_number IN (1, 3) GROUP BY 1"


@query("c8_account_chunks", q(ENT.format(level="account"), v.PAGES))
def _(spark, d):
    return c.entity_chunks(entities(spark, d), views.pages(spark, d).select("doc_id", "page_number", "text"), "account")


@query("c9_dispute_chunks", q("SELECT * FROM (" + ENT.format(level="dispute") + ") WHERE priority = 'critical'", v.PAGES))
def _(spark, d):
    return c.entity_chunks(entities(spark, d).where("disputed"), views.pages(spark, d).select("doc_id", "page_number", "text"), "dispute")


@query("c11_hierarchical_chunks", q("SELECT doc_id, level_no, level, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY level_no, place) AS INTEGER) AS chunk_index FROM (SELECT doc_id, 0 AS level_no, 'document' AS level, string_agg(text, ' ' ORDER BY page_number) AS text, 0 AS place FROM v_pages GROUP BY 1 UNION ALL SELECT doc_id, 1, 'page', text, page_number FROM v_pages)", v.PAGES))
def _(spark, d):
    pages = views.pages(spark, d)
    whole = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), " ").alias("text"))
    return c.hierarchical_chunks(document=whole, page=pages)


@query("c12_remaining_text", "SELECT doc_id, substr(text, done + 1) AS text FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN length(substr(text, 1, 500)) ELSE 0 END AS done FROM documents) WHERE length(text) > 2 * done")
def _(spark, d):
    own = docs(spark, d)
    return c.remaining_text(own, own.where("doc_id % 2 = 0").select("doc_id", F.substring("text", 1, 500).alias("text")))


WORDS = [("license", "License"), ("the", "The "), ("les", "Les ")]
HITS = " UNION ALL ".join(f"SELECT doc_id, text, '{k}' AS section_type, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * {len(w)} AS INTEGER) AS start FROM (SELECT doc_id, text, string_split(text, '{w}') AS parts FROM documents) s, unnest(range(1, len(s.parts))) AS t(i)" for k, w in WORDS)


@query("c13_find_sections", f"WITH hits AS ({HITS}) SELECT h.doc_id, h.section_type, h.start, CAST(least(h.start + 2000, length(any_value(h.text)), min(m.start)) AS INTEGER) AS \"end\" FROM hits h LEFT JOIN hits m ON m.doc_id = h.doc_id AND m.start > h.start + 100 GROUP BY 1, 2, 3")
def _(spark, d):
    return c.find_sections(docs(spark, d), WORDS)


@query("c14_batch_pages", q("""SELECT m.doc_id, m.batch, first_page, n_pages, coalesce(context, '') AS context FROM (SELECT doc_id, place // 3 AS batch, min(page_number) AS first_page, count(*) AS n_pages FROM n GROUP BY 1, 2) m LEFT JOIN
 (SELECT doc_id, place // 3 + 1 AS batch, string_agg(substr(text, 1, 50), chr(10) ORDER BY page_number) AS context FROM n WHERE place % 3 >= 1 GROUP BY 1, 2) c ON c.doc_id = m.doc_id AND c.batch = m.batch""", v.PAGES, "n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) - 1 AS place FROM v_pages)"))
def _(spark, d):
    return c.batch_pages(views.pages(spark, d), 3, 2, 50)


@query("c16_summary_text", q("SELECT doc_id, substr(string_agg('Page ' || page_number || ': ' || substr(text, 1, 500), chr(10) ORDER BY page_number), 1, 8000) AS summary FROM v_pages WHERE page_number <= 10 GROUP BY 1", v.PAGES))
def _(spark, d):
    return c.summary_text(views.pages(spark, d))


EMB = "v_chunks AS (SELECT vec_id AS chunk_id, label AS doc_id, CAST(embedding AS DOUBLE[]) AS embedding, CASE vec_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS priority, CASE vec_id % 3 WHEN 0 THEN 'account_data' WHEN 1 THEN 'dispute_info' ELSE 'mixed' END AS semantic_type FROM embeddings)"
DOCV = "v_docv AS (SELECT doc_id, list(v ORDER BY dim) AS dv FROM (SELECT doc_id, dim, avg(embedding[dim]) AS v FROM v_chunks c, unnest(range(1, len(c.embedding) + 1)) AS t(dim) GROUP BY 1, 2) GROUP BY 1)"


def chunks(spark, d):
    pick = lambda n, values, rest: F.coalesce(*[F.when(F.col("vec_id") % n == i, x) for i, x in enumerate(values)], F.lit(rest))
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"), pick(4, ["critical", "high", "medium"], "low").alias("priority"), pick(3, ["account_data", "dispute_info"], "mixed").alias("semantic_type"))


def with_doc(spark, d):
    own = chunks(spark, d)
    return own.join(embed.doc_vectors(own), "doc_id")


def flat(df):
    return df.select("chunk_id", F.posexplode("pooled").alias("dim", "v")).select("chunk_id", "dim", (F.round("v", 6) + F.lit(0.0)).alias("v"))


def pooled(expr: str, ctes: str = "") -> str:
    return q(f"SELECT chunk_id, CAST(dim - 1 AS INTEGER) AS dim, round({expr}, 6) + 0.0 AS v FROM (SELECT c.*, dv, list_cosine_similarity(embedding, dv) AS cs FROM v_chunks c JOIN v_docv USING (doc_id)) x, unnest(range(1, 65)) AS t(dim)", v_chunks(), DOCV)


def v_chunks() -> str:
    return EMB


@query("e1_cosine", q("SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS similarity FROM v_chunks a JOIN v_chunks b ON b.chunk_id = a.chunk_id + 1", EMB))
def _(spark, d):
    own = chunks(spark, d)
    nxt = own.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("embedding").alias("other"))
    return own.join(nxt, "chunk_id").select(F.col("chunk_id").alias("a"), (F.col("chunk_id") + 1).alias("b"), F.round(vec.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("e2_pool_slice", q("SELECT chunk_id, CAST(len(pooled) AS INTEGER) AS n, round(list_sum(pooled), 6) AS total FROM (SELECT chunk_id, CASE WHEN b > a THEN embedding[a + 1:b] ELSE embedding[1:6] END AS pooled FROM (SELECT chunk_id, embedding, CAST(floor((chunk_id % 7) * 100 / 1000 * 64) AS INTEGER) AS a, CAST(floor((chunk_id % 7 + chunk_id % 2) * 100 / 1000 * 64) AS INTEGER) AS b FROM v_chunks))", EMB))
def _(spark, d):
    own = chunks(spark, d).select("chunk_id", F.col("embedding").alias("doc_vector"), (F.col("chunk_id") % 7 * 100).alias("start"), ((F.col("chunk_id") % 7 + F.col("chunk_id") % 2) * 100).alias("end"), F.lit(1000).alias("total"))
    return embed.pool_slice(own).select("chunk_id", F.size("pooled").alias("n"), F.round(F.aggregate("pooled", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("e3_pool_average", pooled("(embedding[dim] + dv[dim]) / 2"))
def _(spark, d):
    return flat(embed.pool(with_doc(spark, d), "average"))


W = "least(0.9, (CASE priority WHEN 'critical' THEN 0.9 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.6 ELSE 0.4 END + CASE semantic_type WHEN 'account_data' THEN 0.8 WHEN 'dispute_info' THEN 0.9 ELSE 0.5 END) / 2)"


@query("e4_pool_weighted", pooled(f"embedding[dim] * {W} + dv[dim] * (1 - {W})"))
def _(spark, d):
    return flat(embed.pool(with_doc(spark, d), "weighted"))


@query("e5_pool_attention", pooled("embedding[dim] * greatest(0.3, cs) + dv[dim] * (1 - greatest(0.3, cs))"))
def _(spark, d):
    return flat(embed.pool(with_doc(spark, d), "attention"))


@query("e7_similar_pairs", q("SELECT a.doc_id, a.chunk_id AS a, b.chunk_id AS b, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS similarity FROM v_chunks a JOIN v_chunks b ON b.doc_id = a.doc_id AND a.chunk_id < b.chunk_id WHERE list_cosine_similarity(a.embedding, b.embedding) > 0.3", EMB))
def _(spark, d):
    return embed.similar_pairs(chunks(spark, d), 0.3, exact=True).withColumn("similarity", F.round("similarity", 6))


@query("e8_embed_once", "SELECT count(*) AS n_chunks, count(DISTINCT text) AS n_cached, count(*) - count(DISTINCT text) AS hits FROM documents")
def _(spark, d):
    own = docs(spark, d)
    cache = own.where("doc_id % 10 = 0").groupBy(F.sha2("text", 256).alias("key")).agg(F.array(F.lit(0.5)).alias("embedding"))
    out, grown = embed.embed_once(own, cache, lambda new: new.select("key", F.array(F.length("text").cast("double")).alias("embedding")))
    return out.agg(F.count("embedding").alias("n_chunks"), F.count_distinct("key").alias("n_cached")).withColumn("hits", F.col("n_chunks") - F.col("n_cached"))


@query("e9_doc_vectors", q("SELECT doc_id, CAST(dim - 1 AS INTEGER) AS dim, round(dv[dim], 6) + 0.0 AS v FROM v_docv, unnest(range(1, 65)) AS t(dim)", EMB, DOCV))
def _(spark, d):
    return embed.doc_vectors(chunks(spark, d)).select("doc_id", F.posexplode("doc_vector").alias("dim", "v")).withColumn("v", F.round("v", 6) + F.lit(0.0))


@query("e10_nearest", q("SELECT doc_id, a, b, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM (SELECT a.doc_id, a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.embedding, b.embedding) AS s FROM v_chunks a JOIN v_chunks b ON b.doc_id = a.doc_id AND a.chunk_id <> b.chunk_id)) WHERE rank <= 5", EMB))
def _(spark, d):
    return embed.nearest(chunks(spark, d), 5).withColumn("similarity", F.round("similarity", 6))


JIT = "v_jit AS (SELECT doc_id, page0 + 1 AS page_number, line_no, token_idx, y + (token_idx % 3) * 2.0 AS y FROM v_tokens)"


def jittered(spark, d):
    own = views.tokens(spark, d)
    return own.select("doc_id", (F.col("page0") + 1).alias("page_number"), "x", (F.col("y") + F.col("token_idx") % 3 * 2.0).alias("y"), (F.col("line_no").cast("long") * 100000 + F.col("token_idx")).alias("token_id"))


@query("w9_group_rows", q("SELECT doc_id, page_number, CAST(line_no AS BIGINT) * 100000 + token_idx AS token_id, first_value(y) OVER (PARTITION BY doc_id, line_no ORDER BY token_idx) AS row_y FROM v_jit", v.TOKENS, JIT))
def _(spark, d):
    return locate.group_rows(jittered(spark, d))


@query("w10_group_lines", q("SELECT doc_id, page_number, CAST(line_no AS BIGINT) * 100000 + token_idx AS token_id, CAST(dense_rank() OVER (PARTITION BY doc_id, page_number ORDER BY line_no) - 1 AS INTEGER) AS line FROM v_jit", v.TOKENS, JIT))
def _(spark, d):
    return locate.group_lines(jittered(spark, d))


@query("w11_table_runs", q("SELECT doc_id, count(*) AS n_rows, min(line_no) AS header_row, max(line_no) AS last_row FROM (SELECT *, sum(CASE WHEN n >= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (SELECT doc_id, line_no, len(string_split(line, ' ')) AS n FROM v_lines)) WHERE n >= 3 GROUP BY doc_id, run HAVING count(*) >= 2", v.LINES))
def _(spark, d):
    rows = views.lines(spark, d).select("doc_id", F.col("line_no").alias("row_no"), F.size(F.split("line", " ")).alias("n_cells"))
    return locate.table_runs(rows)


#: All pairs above the usual threshold, which the hyperplane index has to find.
CLOSE = """v_close AS (
 SELECT a.doc_id, a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.embedding, b.embedding) AS s
 FROM v_chunks a JOIN v_chunks b ON b.doc_id = a.doc_id AND a.chunk_id <> b.chunk_id
 WHERE list_cosine_similarity(a.embedding, b.embedding) > 0.8)"""


@query("e7_similar_lsh", q("SELECT doc_id, a, b, round(s, 6) AS similarity FROM v_close WHERE a < b", EMB, CLOSE))
def _(spark, d):
    return embed.similar_pairs(chunks(spark, d), 0.8, recall=0.9999).withColumn("similarity", F.round("similarity", 6))


NEAREST = """SELECT doc_id, a, b, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank
 FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM v_close) WHERE rank <= 5"""


@query("e10_nearest_lsh", q(NEAREST, EMB, CLOSE))
def _(spark, d):
    return embed.nearest(chunks(spark, d), 5, threshold=0.8, recall=0.9999).withColumn("similarity", F.round("similarity", 6))
