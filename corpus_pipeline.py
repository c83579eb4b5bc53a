"""A corpus from raw documents to packed sequences: quality, near-dedup, substring dedup, secrets, packing.

``STAGES`` are applied in order; each works on what the one before kept, and
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.packing import pack_documents
from ledgerleaf.llm.quality import quality_scores
from ledgerleaf.llm.secrets import redact, secret_spans
from ledgerleaf.llm.simhash import simhash_dedup
from ledgerleaf.llm.staging import scope, settled, staged
from ledgerleaf.llm.substring import substring_dedup


def _carried(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): all other columns are one, so that no name of an operator's can clash with theirs."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, text, row), written: a key of its own for each row, as ids may repeat or be null."""
    return staged(_carried(docs).select(F.monotonically_increasing_id().alias("key"), "text", "row"), "rows")


def _restored(rows: DataFrame, docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """The columns of ``docs`` from text and row; n_chars, where there is one, is counted anew if the text is ``changed``."""
    new = {"text": F.col("text")}
    if changed is not None and "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Null, empty and wordless texts are judged like any other, by a feature row
    of zeros; very long texts whole; equal texts alike, so ties and repeated
    rows stand or fall together. An empty table gives none; without labels of
    both classes all stay. Columns of any name pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _restored(quality_scores(_carried(docs), labels, keep=["row", "text"]).where("predicted = 1"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id; without an id only if no row of the group has one.

    Near copies have a Jaccard similarity of 0.8 or more between their sets of
    five-word shingles, or are linked by such; SimHash finds the candidates.
    Repeated rows and rows that share an id are told apart by a row key, which
    decides ties. Null, empty and wordless texts are one group; very long texts
    are read whole; an empty table gives none. Columns of any name pass through.
    """
    with scope() as own:
        rows = _keyed(docs)
        groups = simhash_dedup(rows, id_col="key", ngram=5, similarity=0.8)
        first = F.min(F.struct(F.col("row.doc_id").isNull().alias("missing"), F.col("row.doc_id").alias("doc_id"), "key")).alias("first")
        kept = rows.join(groups.hint("merge"), "key").groupBy("component_id").agg(first).select(F.col("first.key").alias("key"))
        return settled(_restored(rows.join(kept.hint("merge"), "key", "left_semi"), docs), "unique", own)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that occur elsewhere; texts that lose nothing stay as they are, texts that lose all go.

    Null, empty and short texts stay. Repeated rows and ids are told apart by
    a row key, and each copy loses what it shares. Very long texts are read
    whole; an empty table gives none. Columns of any name pass through.
    """
    with scope() as own:
        rows = _keyed(docs)
        cut = substring_dedup(rows, window=35, id_col="key", unique=True).where("kept is not null").select("key", "kept")
        out = rows.join(cut.hint("merge"), "key", "left").where("kept is null or kept <> ''")
        out = out.select("row", "kept", F.coalesce("kept", "text").alias("text"))
        return settled(_restored(out, docs, F.col("kept").isNotNull()), "passages", own)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark.

    Null texts stay null and empty ones empty; very long texts are read whole;
    repeated rows each return; an empty table gives none. Columns of any name
    pass through.
    """
    return _restored(redact(secret_spans(_carried(docs), keep=["row", "text"])), docs, F.size("spans") > 0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place there.

    Null and empty texts are the end token alone; longer texts than a sequence
    are cut, no token is lost; repeated rows and ids are packed each; an empty
    table gives none. Only doc_id and text are read.
    """
    return pack_documents(docs, size=2048, end_id=0)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
    ("secrets", secrets), ("packing", packing),
]

#: Learnt scores, fingerprints and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
