"""Queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerleaf.llm.token_output import token_corpus

    return token_corpus(_table(spark, sf_dir, "documents"), end_id=2)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerleaf.llm.simhash import simhash_dedup

    return simhash_dedup(_table(spark, sf_dir, "documents"), ngram=4, bits=4)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerleaf.llm.secrets import secret_spans

    rows = secret_spans(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(F.filter("spans", lambda x: x["kind"] != "random")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerleaf.llm.pq_dedup import embedding_dedup

    return embedding_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerleaf.llm.sentencepiece import piece_digests

    return piece_digests(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerleaf.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), size=2048, end_id=0).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerleaf.llm.quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerleaf.llm.vptree import nearest_neighbours

    rows = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerleaf.llm.substring import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerleaf.llm.lm import lm_scores

    return lm_scores(_table(spark, sf_dir, "documents"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerleaf.llm.decontamination import decontaminate

    rows = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def _with_period(docs: DataFrame) -> DataFrame:
    """``docs``, a tenth of them with a period written into the words from some place on, as the contract of op12 sets it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    due = docs.where((h % 10 == 0) & F.col("text").isNotNull()).select("doc_id", "text", words.alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    due = due.withColumns({"n": n, "a": (g % n).cast("int")}).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    told = F.transform("words", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    changed = due.select("doc_id", F.array_join(told, " ").alias("text"))
    plain = docs.where(F.coalesce(h % 10 != 0, F.lit(True)) | F.col("text").isNull() | ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    return plain.select("doc_id", "text").union(changed)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerleaf.llm.periodic import periodic_runs

    rows = periodic_runs(_with_period(_table(spark, sf_dir, "documents")), exponent=4, least=6)
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    rows = rows.withColumn("top", F.when(F.size("runs") > 0, longest))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    length, period = -F.col("top.length"), F.col("top.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerleaf.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"), components=16)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_token_output, op2_simhash_dedup, op3_secret_scan, op4_embedding_dedup, op5_sentencepiece, op6_best_fit_packing, op7_quality_classifier, op8_nearest_neighbours, op9_substring_dedup, op10_lm_scoring, op11_benchmark_decontamination, op12_periodic_runs, op13_embedding_whitening)
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it gives every column; the others learn, pack, tokenize or sum in an order of their own."""
    return {"op4_embedding_dedup": sql.OP4, "op8_nearest_neighbours": sql.OP8, "op9_substring_dedup": sql.OP9, "op11_benchmark_decontamination": sql.OP11}
