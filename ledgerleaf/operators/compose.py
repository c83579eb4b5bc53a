"""Operators made of others: ingest, prompts, validation, end-to-end results, region merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import text as t
from ledgerleaf.operators.issues import mapped

#: Semantic class by section, table and region type.
SECTION_KIND = {"personal_info": "personal_info", "accounts": "account_data", "disputes": "dispute_info", "inquiries": "inquiry_data"}
TABLE_KIND = {"account_summary": "account_data", "payment_history": "payment_history", "inquiry_list": "inquiry_data", "dispute_history": "dispute_info"}
REGION_KIND = {"personal_info": "personal_info", "account_section": "account_data", "dispute_section": "dispute_info", "inquiry_section": "inquiry_data"}


def flatten_spans(pages: DataFrame) -> DataFrame:
    """Nested blocks, lines and spans as token rows: blank text drops, numbers are rounded to two places, pages count from 1."""
    block = pages.select("doc_id", (F.col("page_index") + 1).alias("page_number"), F.posexplode("blocks").alias("b", "block"))
    line = block.select("doc_id", "page_number", "b", F.posexplode("block.lines").alias("l", "line"))
    span = line.select("doc_id", "page_number", "b", "l", F.posexplode("line.spans").alias("s", "span")).where(F.length(F.trim("span.text")) > 0)
    return span.select("doc_id", "page_number", "b", "l", "s", F.col("span.text").alias("text"), *[F.round(F.col(f"span.{c}"), 2).alias(c) for c in ("x", "y", "width", "height")])


def map_semantic(df: DataFrame, col: str, kind: str) -> DataFrame:
    """Semantic class and priority of a section, table or region type."""
    c = F.col(col)
    priority = F.when(c.isin("account_summary", "dispute_history"), "high").otherwise("medium")
    return df.withColumns({"semantic_type": mapped(c, {"section": SECTION_KIND, "table": TABLE_KIND, "region": REGION_KIND}[kind], "mixed"), "priority": priority})


def context_clues(issues: DataFrame, fields: list[str], most: int = 8) -> DataFrame:
    """Up to eight distinct clues: field keywords in the description, and the first and last three words of the context."""
    words = F.filter(F.split("context", "\\s+"), lambda w: F.length(w) > 0)
    named = F.filter(F.array(*[F.lit(f) for f in fields]), lambda f: F.contains(F.lower("description"), f))
    last = F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), F.lit(3))
    return issues.withColumn("clues", F.slice(F.array_distinct(F.concat(named, last, F.slice(words, 1, 3))), 1, most))


def render_prompts(chunks: DataFrame, templates: dict[str, str]) -> DataFrame:
    """The prompt of each chunk: its analysis type's template with {text}, {pages} and {index} filled in; unknown types take the first."""
    template = mapped(F.col("analysis_type"), templates, next(iter(templates.values())))
    filled = F.replace(F.replace(F.replace(template, F.lit("{index}"), F.col("chunk_index").cast("string")), F.lit("{pages}"), F.col("pages")), F.lit("{text}"), F.col("text"))
    return chunks.withColumn("prompt", filled)


def call_model(chunks: DataFrame, respond: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Responses of a caller-supplied function on batches of prompts; the library itself has no network."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "chunk_index": batch["chunk_index"], "response_raw": respond(batch["prompt"])})

    return chunks.select("doc_id", "chunk_index", "prompt").mapInPandas(run, "doc_id long, chunk_index int, response_raw string")


def contextualize(chunks: DataFrame, neighbours: DataFrame, k: int = 3, head: int = 100) -> DataFrame:
    """Chunk texts with their document (its title, if there is one), section, type, priority, pages and the heads of up to ``k`` neighbours before them; title, section_type and priority may be absent or null."""
    near = neighbours.join(chunks.select(F.col("chunk_id").alias("b"), F.substring("content", 1, head).alias("head")).hint("merge"), "b").where(F.col("rank") <= k)
    near = near.groupBy(F.col("a").alias("chunk_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "head"))), lambda x: x["head"]), "\n").alias("near"))
    given = lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast("string")
    said = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    text = F.concat_ws("\n", said("Document", F.coalesce(given("title"), F.col("doc_id").cast("string"))), said("Section", given("section_type")), said("Type", F.col("semantic_type")), said("Priority", given("priority")), F.concat(F.lit("Pages: "), F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ", ")), F.concat(F.lit("Related: "), F.col("near")), "content")
    return chunks.join(near.hint("merge"), "chunk_id", "left").select("chunk_id", text.alias("contextual_text"))


def processing_metrics(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages, chunks and estimated tokens of each document."""
    p = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(t.estimate_tokens(F.col("text"))).alias("tokens"))
    c = chunks.groupBy("doc_id").agg(F.count_distinct("chunk_index").alias("n_chunks"))
    return p.join(c, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def validate_fields(docs: DataFrame, rules: list[tuple[str, str, bool, int | None]]) -> DataFrame:
    """One issue for each required field (name, pattern, required, value group) that a text lacks, and one for each hit whose value group is empty.

    A rule without a value group makes no check for emptiness.
    """
    found = [F.struct(F.lit(name).alias("field"), F.lit(required).alias("required"), F.lit(group is not None).alias("checked"), F.regexp_extract_all("text", F.lit(pattern), F.lit(group or 0)).alias("hits")) for name, pattern, required, group in rules]
    each = docs.select("doc_id", F.explode(F.array(*found)).alias("r"))
    missing = F.when(F.col("r.required") & (F.size("r.hits") == 0), F.array(F.struct(F.lit("missing").alias("problem"), F.lit(0).alias("hit_no"))))
    empty = F.when(F.col("r.checked"), F.filter(F.transform("r.hits", lambda h, i: F.when(F.length(F.trim(h)) == 0, F.struct(F.lit("empty").alias("problem"), i.alias("hit_no")))), lambda x: x.isNotNull()))
    return each.select("doc_id", "r.field", F.explode(F.coalesce(missing, empty)).alias("x")).select("doc_id", "field", "x.problem", "x.hit_no")


def analysis_result(issues: DataFrame, results: DataFrame) -> DataFrame:
    """The final row of each document: counts by type, mean confidence and merged summary. Results hold seq, summary, confidence."""
    from ledgerleaf.operators import report

    counts = report.count_by_type(issues)
    own = report.mean_confidence(results).join(report.merge_summaries(results, "summary", "seq", 3), "doc_id")
    return own.join(counts, "doc_id", "left").na.fill(0, ["total", "critical", "warning", "attention", "info"])


def merge_regions(regions: DataFrame, gap: float = 10.0) -> DataFrame:
    """Regions of one page and issue merged where both gaps are at most ``gap``: from each unused seed in order, one pass over the rest, growing as it goes.

    An ordered fold over the regions of one issue on one page.
    """
    own = F.array_sort(F.collect_list(F.struct("seq", "x", "y", (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2"))))
    start = F.expr("cast(array() as array<struct<x:double,y:double,x2:double,y2:double,n:int>>)")

    def step(acc, r):
        near = lambda m: (r["x"] <= m["x2"] + gap) & (m["x"] <= r["x2"] + gap) & (r["y"] <= m["y2"] + gap) & (m["y"] <= r["y2"] + gap)
        at = F.array_position(F.transform(acc, near), True).cast("int") - 1
        grown = F.transform(acc, lambda m, i: F.when(i == at, F.struct(F.least(m["x"], r["x"]).alias("x"), F.least(m["y"], r["y"]).alias("y"), F.greatest(m["x2"], r["x2"]).alias("x2"), F.greatest(m["y2"], r["y2"]).alias("y2"), (m["n"] + 1).alias("n"))).otherwise(m))
        return F.when(at >= 0, grown).otherwise(F.concat(acc, F.array(F.struct(r["x"].alias("x"), r["y"].alias("y"), r["x2"].alias("x2"), r["y2"].alias("y2"), F.lit(1).alias("n")))))

    merged = regions.groupBy("doc_id", "page_number", "key").agg(F.aggregate(own, start, step).alias("m"))
    each = merged.select("doc_id", "page_number", "key", F.explode("m").alias("m"))
    return each.select("doc_id", "page_number", "key", "m.x", "m.y", (F.col("m.x2") - F.col("m.x")).alias("width"), (F.col("m.y2") - F.col("m.y")).alias("height"), "m.n")


def cells_to_issues(cells: DataFrame) -> DataFrame:
    """Empty table cells as issues."""
    each = cells.select("doc_id", "line_no", F.posexplode("cells").alias("column_no", "value")).where(F.length("value") == 0)
    return each.select("doc_id", "line_no", "column_no", F.lit("attention").alias("type"), F.format_string("Empty cell %d in row %d", "column_no", "line_no").alias("description"))


def shares_identifier(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def other_items_summary(items: DataFrame) -> DataFrame:
    """Counts by kind as columns with their sum."""
    one = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return items.groupBy("doc_id").agg(one("inquiry"), one("record"), one("collection"), F.count(F.lit(1)).alias("n"))


def append_audit(rows: DataFrame, path: str, by: str = "date") -> None:
    """Append to the audit log, in folders by ``by``."""
    rows.write.mode("append").partitionBy(by).parquet(path)


def latest_audit(log: DataFrame, key: str = "source", at: str | None = None) -> DataFrame:
    """Each key's last row of the audit log, or its last up to the time ``at``; ties go to the greater event_id."""
    own = log if at is None else log.where(F.col("ts") <= F.to_timestamp(F.lit(at)))
    return own.groupBy(key).agg(F.max("ts").alias("ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def distinct_values(df: DataFrame, key: str, value: Column) -> DataFrame:
    """How many distinct values each key has."""
    return df.select(key, value.alias("_v")).distinct().groupBy(key).agg(F.count("_v").alias("n"))


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` with metrics that fill in as it runs: the way to follow progress."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *[m.alias(n) for n, m in metrics.items()]), watch


def write_artifacts(frames: dict[str, DataFrame], path: str, key: str = "document_id", buckets: int = 64) -> None:
    """Each table as Parquet under its name, in ``buckets`` folders by the hash of its document, so that a document is found in one of them and folders do not grow with the documents."""
    for name, df in frames.items():
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        df.withColumn("bucket", bucket).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{path}/{name}")


def read_artifact(spark: SparkSession, path: str, name: str, key: str | None = None, value: object = None, buckets: int = 64) -> DataFrame:
    """An artifact table; with ``key`` and ``value``, that document's rows alone, from its folder."""
    rows = spark.read.parquet(f"{path}/{name}")
    if key is not None:
        own = F.lit(value).cast(rows.schema[key].dataType)
        rows = rows.where((F.col("bucket") == F.pmod(F.xxhash64(own), F.lit(buckets)).cast("int")) & (F.col(key) == own))
    return rows.drop("bucket")
