"""Counts, reports, quality ratios and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: USD for a million input, output and image tokens.
RATES = (1.25, 10.0, 2.0)


def count_by_type(issues: DataFrame) -> DataFrame:
    one = lambda t: F.count_if(F.col("type") == t).alias(t)
    return issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), one("critical"), one("warning"), one("attention"), one("info"))


def count_by(issues: DataFrame, key: str, default: str = "unknown") -> DataFrame:
    return issues.groupBy(F.coalesce(F.col(key), F.lit(default)).alias(key)).agg(F.count(F.lit(1)).alias("n"))


def detection_report(detections: DataFrame) -> DataFrame:
    """Counts by class, by method and by page in one pass of grouping sets."""
    d = detections.select("error_type", "method", "page_number")
    sets = d.groupingSets([[d.error_type], [d.method], [d.page_number]], d.error_type, d.method, d.page_number)
    return sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")).select(F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "method").otherwise("page").alias("dimension"), F.coalesce("error_type", "method", F.col("page_number").cast("string")).alias("value"), "n")


def mean_confidence(results: DataFrame) -> DataFrame:
    """Mean confidence, a missing one counting as zero, and 0.5 where there are no rows."""
    return results.groupBy("doc_id").agg(F.round(F.coalesce(F.avg(F.coalesce("confidence", F.lit(0.0))), F.lit(0.5)), 6).alias("confidence"))


def merge_summaries(results: DataFrame, text: str, order: str, k: int | None = None) -> DataFrame:
    """Numbered summaries a line each, or the first ``k`` joined by semicolons."""
    own = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text])
    if k is None:
        joined = F.array_join(F.transform(own, lambda s, i: F.concat(F.lit("Chunk "), (i + 1).cast("string"), F.lit(": "), s)), "\n")
    else:
        joined = F.array_join(F.slice(own, 1, k), "; ")
    return results.groupBy("doc_id").agg(joined.alias("summary"))


def pages_analyzed(issues: DataFrame) -> DataFrame:
    return issues.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("page_number")), lambda p: p.cast("string")), ",").alias("pages"), F.count_distinct("page_number").alias("n_pages"))


def issues_by_category(issues: DataFrame) -> DataFrame:
    return issues.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda i: i["id"]), ",").alias("ids"))


def issue_quality(issues: DataFrame) -> DataFrame:
    return issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("page_number") > 0).alias("with_page"), F.count_if(F.length("anchor_text") > 5).alias("with_anchor"), F.count_if(F.col("category") == "FCRA_violation").alias("with_section"))


def keyword_tallies(issues: DataFrame, words: list[str]) -> DataFrame:
    return issues.groupBy("page_number").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.contains(F.lower("description"), F.lit(w))).alias(f"n_{w}") for w in words])


def validation_funnel(issues: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Total, normalised (has a box), validated (in bounds) and distinct (box and class) issues of a document."""
    box = F.col("x").isNotNull() & F.col("y").isNotNull()
    return issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(box).alias("normalised"), F.count_if(box & F.col("in_bounds")).alias("validated"), F.count_distinct(F.when(box & F.col("in_bounds"), F.struct("page_number", "category", "x", "y"))).alias("deduped"))


def quality_ratios(funnel: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return funnel.select("doc_id", ratio(F.col("validated"), F.col("normalised")).alias("in_bounds_ratio"), ratio(F.col("deduped"), F.col("validated")).alias("dedup_ratio"))


def distinct_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def inconsistent_entities(payments: DataFrame) -> DataFrame:
    """Accounts with more than one status, with the first payment's date."""
    own = payments.groupBy("account_id").agg(F.count_distinct("status").alias("n_status"), F.min_by("date", F.struct("order_key", "line_number", "date", "amount")).alias("first_date"), F.min_by("amount", F.struct("order_key", "line_number", "date", "amount")).alias("first_amount"))
    return own.where("n_status > 1")


def account_type_summary(accounts: DataFrame) -> DataFrame:
    """Counts and balances by account type with a total row."""
    return accounts.rollup("account_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"), F.grouping("account_type").alias("g")).select(F.when(F.col("g") == 1, "Total").otherwise(F.col("account_type")).alias("account_type"), "n", "balance")


def utilization(accounts: DataFrame) -> DataFrame:
    """Balance over limit; null where the limit is zero or less."""
    return accounts.withColumn("utilization", F.when(F.col("credit_limit") > 0, F.round(F.col("balance") / F.col("credit_limit"), 6)))


def call_cost(calls: DataFrame, rates: tuple[float, float, float] = RATES) -> DataFrame:
    part = lambda c, r: F.col(c) / 1000000 * r
    cost = {"input_cost": part("input_tokens", rates[0]), "output_cost": part("output_tokens", rates[1]), "image_cost": part("image_tokens", rates[2])}
    return calls.withColumns(cost).withColumn("total_cost", F.col("input_cost") + F.col("output_cost") + F.col("image_cost"))


def initial_estimate(docs: DataFrame, rates: tuple[float, float, float] = RATES) -> DataFrame:
    p = F.col("total_pages")
    out = F.least(p * 200, F.lit(50000))
    return docs.withColumn("estimate", F.round(p * 800 / 1000000 * rates[0] + p * 1000 / 1000000 * rates[2] + out / 1000000 * rates[1], 8))


def cost_summary(calls: DataFrame, docs: DataFrame) -> DataFrame:
    """Totals, average, expected rest and status of each document; four pages make a chunk."""
    own = call_cost(calls).groupBy("doc_id").agg(F.sum("total_cost").alias("total"), F.count(F.lit(1)).alias("n_calls"))
    both = docs.select("doc_id", F.ceil(F.col("total_pages") / 4).alias("expected")).join(own, "doc_id", "left").withColumns({"total": F.coalesce("total", F.lit(0.0)), "n_calls": F.coalesce("n_calls", F.lit(0))})
    average = F.coalesce(F.try_divide(F.col("total"), F.col("n_calls")), F.lit(0.0))
    rest = F.greatest(F.lit(0), F.col("expected") - F.col("n_calls")) * average
    return both.select("doc_id", F.round("total", 8).alias("total_cost"), F.col("n_calls").cast("long").alias("chunks_processed"), F.round(average, 8).alias("average_cost"), F.round(rest, 8).alias("remaining_cost"), F.when(F.col("n_calls") == 0, "estimating").when(F.col("n_calls") < F.col("expected"), "processing").otherwise("completed").alias("status"))


def over_budget(costs: DataFrame, limit: float) -> DataFrame:
    return costs.where(F.col("total_cost") + F.col("remaining_cost") > limit)


def final_cost_report(calls: DataFrame, docs: DataFrame) -> DataFrame:
    own = call_cost(calls).groupBy("doc_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("image_tokens").alias("image_tokens"), F.sum("total_cost").alias("total"))
    return initial_estimate(docs).join(own, "doc_id").select("doc_id", "input_tokens", "output_tokens", "image_tokens", F.round("total", 8).alias("total_cost"), F.round(F.coalesce(F.try_divide(F.col("total"), F.col("estimate")), F.lit(1.0)), 6).alias("efficiency"))


def length_cost(docs: DataFrame, embedding_rate: float = 0.02, analysis_rate: float = 1.25) -> DataFrame:
    n = F.ceil(F.length("text") / 4)
    return docs.withColumns({"estimated_tokens": n.cast("long"), "estimated_cost": F.round(n / 1000000 * (embedding_rate + analysis_rate), 10)})


def run_summary(docs: DataFrame) -> DataFrame:
    """One row over a run: documents, failures and averages."""
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("total") == 0).alias("without_issues"), F.round(F.avg("total"), 6).alias("mean_issues"), F.max("total").alias("most_issues"))
