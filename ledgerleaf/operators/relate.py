"""Relations between pages, sections, chunks and issues, as equi-joins on exploded or bucketed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.operators.issues import mapped


def pages_in_sections(sections: DataFrame, pages: DataFrame) -> DataFrame:
    own = sections.withColumn("page_number", F.explode(F.sequence("page_start", "page_end")))
    return own.join(pages.select("doc_id", "page_number").hint("merge"), ["doc_id", "page_number"]).select("doc_id", "section_type", "page_number")


def pages_of(entities: DataFrame, pages: DataFrame) -> DataFrame:
    return entities.withColumn("page_number", F.explode("page_numbers")).join(pages.hint("merge"), ["doc_id", "page_number"])


def near_pairs(chunks: DataFrame, window: int = 5, same_type: bool = False) -> DataFrame:
    """Pairs of a document's chunks with pages at most ``window`` apart.

    Pages fall into buckets of ``window``; a page meets its own bucket and
    the next, so that the band join is an equi-join.
    """
    each = chunks.select("doc_id", "chunk_id", "semantic_type", F.explode("page_numbers").alias("p")).withColumn("bucket", F.expr(f"p div {window}"))
    left = each.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1))).select("doc_id", "bucket", F.col("chunk_id").alias("a"), F.col("p").alias("pa"), F.col("semantic_type").alias("ta"))
    right = each.select("doc_id", "bucket", F.col("chunk_id").alias("b"), F.col("p").alias("pb"), F.col("semantic_type").alias("tb"))
    ok = (F.col("a") < F.col("b")) & (F.abs(F.col("pa") - F.col("pb")) <= window)
    ok = ok & (F.col("ta") == F.col("tb")) if same_type else ok
    return left.join(right.hint("merge"), ["doc_id", "bucket"]).where(ok).groupBy("doc_id", "a", "b").agg(F.min(F.abs(F.col("pa") - F.col("pb"))).alias("distance"))


def identifier_pairs(chunks: DataFrame, pattern: str, left_type: str = "account_data", right_type: str = "dispute_info") -> DataFrame:
    """Account and dispute chunks of a document that share an identifier (the pattern's first group)."""
    ids = chunks.select("doc_id", "chunk_id", "semantic_type", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))).alias("identifier"))
    a = ids.where(F.col("semantic_type") == left_type).select("doc_id", "identifier", F.col("chunk_id").alias("a"))
    b = ids.where(F.col("semantic_type") == right_type).select("doc_id", "identifier", F.col("chunk_id").alias("b"))
    return a.join(b.hint("merge"), ["doc_id", "identifier"]).groupBy("doc_id", "a", "b").agg(F.count(F.lit(1)).alias("shared"))


def relationships(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges typed by their chunks' semantic types."""
    ends = lambda side: chunks.select(F.col("chunk_id").alias(side), F.col("semantic_type").alias(f"t{side}"))
    own = edges.join(ends("a").hint("merge"), "a").join(ends("b").hint("merge"), "b")
    kind = F.when((F.col("ta") == "account_data") & (F.col("tb") == "dispute_info"), "account_dispute_link").when((F.col("ta") == "account_data") & (F.col("tb") == "payment_history"), "account_payment_link").otherwise("contextual_relationship")
    return own.select(F.concat_ws("-", F.lit("rel"), F.col("a").cast("string"), F.col("b").cast("string")).alias("id"), kind.alias("type"), F.concat_ws(" -> ", "ta", "tb").alias("relationship"), F.lit(0.8).alias("confidence"))


def sections_of_chunk(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    own = sections.withColumn("p", F.explode(F.sequence("page_start", "page_end"))).select("doc_id", "p", "section_type")
    return chunks.select("doc_id", "chunk_id", F.explode("page_numbers").alias("p")).join(own.hint("merge"), ["doc_id", "p"]).select("doc_id", "chunk_id", "section_type").distinct()


def neighbours(chunks: DataFrame, window: int = 2, k: int = 3) -> DataFrame:
    pairs = near_pairs(chunks, window)
    both = pairs.select("doc_id", "a", "b").union(pairs.select("doc_id", F.col("b"), F.col("a")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "a").orderBy("b"))).where(F.col("rank") <= k)


def relate_chunks(**edges: DataFrame) -> DataFrame:
    """Distinct edges of all kinds, each with the sorted list of its kinds."""
    from functools import reduce

    both = reduce(lambda x, y: x.union(y), [df.select("doc_id", "a", "b", F.lit(kind).alias("kind")) for kind, df in edges.items()])
    return both.groupBy("doc_id", "a", "b").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def link_type(links: DataFrame) -> DataFrame:
    """Kind and wording of a link between two issues by category and words. Needs category_a/b and description_a/b."""
    either = lambda value: (F.col("category_a") == value) | (F.col("category_b") == value)
    says = lambda word: F.contains(F.lower("description_a"), F.lit(word)) | F.contains(F.lower("description_b"), F.lit(word))
    kind = F.when(either("collection") | either("dispute"), "account_dispute").when(says("payment"), "payment_history").when(says("inquiry"), "inquiry_reference").otherwise("general")
    text = F.when((F.col("category_a") == "dispute") & (F.col("category_b") == "FCRA_violation"), "Dispute related to FCRA violation").when((F.col("category_a") == "collection") & (F.col("category_b") == "accuracy"), "Collection accuracy concern").otherwise(F.concat(F.lit("Related: "), F.col("category_a"), F.lit(" and "), F.col("category_b")))
    return links.withColumns({"link_type": kind, "relationship": text})


def cross_page_links(issues: DataFrame) -> DataFrame:
    """Issues that name related ids, linked where the pages differ. Needs related_ids."""
    a = issues.select("doc_id", F.col("id").alias("source_id"), F.col("page_number").alias("pa"), F.col("category").alias("category_a"), F.col("description").alias("description_a"), F.explode("related_ids").alias("target_id"))
    b = issues.select(F.col("id").alias("target_id"), F.col("page_number").alias("pb"), F.col("category").alias("category_b"), F.col("description").alias("description_b"))
    return link_type(a.join(b.hint("merge"), "target_id").where("pa <> pb")).select("doc_id", "source_id", "target_id", "link_type", "relationship")


def has_image(pages: DataFrame, meta: DataFrame) -> DataFrame:
    own = meta.select("doc_id", "page_number").distinct().withColumn("_m", F.lit(True))
    return pages.join(own, ["doc_id", "page_number"], "left").withColumn("has_image", F.col("_m").isNotNull()).drop("_m")


def decode_status(payments: DataFrame, legend: dict[str, str], default: str = "unknown") -> DataFrame:
    """The legend is a parameter of fixed size, so it becomes an expression and needs no join."""
    return payments.withColumn("status_text", mapped(F.col("status"), legend, default))


def restore_fields(located: DataFrame, issues: DataFrame) -> DataFrame:
    """Category and severity of located issues from the originals, with defaults."""
    own = issues.select("id", "category", "severity")
    return located.join(own.hint("merge"), "id", "left").withColumns({"category": F.coalesce("category", F.lit("other")), "severity": F.coalesce("severity", F.lit("medium"))})


def check_alignment(issues: DataFrame, regions: DataFrame) -> DataFrame:
    """Per document, how many issues meet a region of their page (touching counts)."""
    r = regions.select("doc_id", "page_number", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("width").alias("rw"), F.col("height").alias("rh"))
    touch = (F.col("x") <= F.col("rx") + F.col("rw")) & (F.col("rx") <= F.col("x") + F.col("width")) & (F.col("y") <= F.col("ry") + F.col("rh")) & (F.col("ry") <= F.col("y") + F.col("height"))
    met = issues.join(r.hint("merge"), (issues.doc_id == r.doc_id) & (issues.page_number == r.page_number) & touch, "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("matched"))
    return issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total")).join(met.hint("merge"), "doc_id", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))


def contradictions(mentions: DataFrame) -> DataFrame:
    """Entities with different statuses on different pages: counts instead of pairs."""
    return mentions.groupBy("entity").agg(F.count_distinct("status").alias("n_status"), F.count_distinct("page").alias("n_pages"), F.min("page").alias("first_page")).where("n_status > 1 and n_pages > 1")
