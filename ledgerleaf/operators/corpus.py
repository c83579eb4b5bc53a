"""Documents and pages: admission, identity, assembly, complexity, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import text as t


def admissible(files: DataFrame, max_bytes: int = 50 * 1024 * 1024, path_col: str = "path", size_col: str = "length") -> DataFrame:
    """Files that end in .pdf and hold between 1 and ``max_bytes`` bytes; contents are not read."""
    return files.where(F.lower(path_col).endswith(".pdf") & F.col(size_col).between(1, max_bytes))


def document_id(docs: DataFrame, content_col: str = "text") -> DataFrame:
    """Content id: the first 16 hex digits of the SHA-256."""
    return docs.withColumn("document_id", F.substring(F.sha2(F.col(content_col).cast("binary"), 256), 1, 16))


def cap_pages(pages: DataFrame, n: int = 5) -> DataFrame:
    return pages.where(F.col("page_number") <= n)


def page_meta(meta: DataFrame, dpi: int = 300) -> DataFrame:
    """Image metadata without malformed rows; a missing resolution is ``dpi``."""
    return meta.where(F.col("page_number").isNotNull() & F.col("image_width_px").isNotNull() & F.col("image_height_px").isNotNull()).withColumn("dpi", F.coalesce("dpi", F.lit(dpi)))


def full_text(pages: DataFrame) -> DataFrame:
    """One text per document: ``Page n:`` and the page's text, joined by blank lines in page order."""
    own = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))))
    joined = F.array_join(F.transform(own, lambda p: F.concat(F.lit("Page "), p["page_number"].cast("string"), F.lit(":\n"), p["text"])), "\n\n")
    return pages.groupBy("doc_id").agg(joined.alias("full_text"), F.count(F.lit(1)).alias("total_pages"))


def span_pages(chunks: DataFrame, text_col: str = "text", start_col: str = "start", length_col: str = "total_length") -> DataFrame:
    """Page numbers marked in a chunk, or one estimated from its place (tenths of the text)."""
    marked = t.page_markers(F.col(text_col))
    guess = F.greatest(F.lit(1), F.floor(F.col(start_col) / F.col(length_col) * 10).cast("int") + 1)
    return chunks.withColumn("page_numbers", F.when(F.size(marked) > 0, marked).otherwise(F.array(guess)))


def span_pages_capped(sections: DataFrame, text_col: str = "text", total_col: str = "total_pages") -> DataFrame:
    """Page numbers marked in a section, up to the document's last page; [1] if none."""
    marked = F.filter(t.page_markers(F.col(text_col)), lambda p: p <= F.col(total_col))
    return sections.withColumn("page_numbers", F.when(F.size(marked) > 0, marked).otherwise(F.array(F.lit(1))))


def page_complexity(pages: DataFrame) -> DataFrame:
    """simple, moderate, complex or very_complex by tables, images and length; needs n_tables and n_images."""
    score = 2 * F.col("n_tables") + F.col("n_images") + F.floor(F.length("text") / 1000)
    return pages.withColumn("content_complexity", F.when(score <= 2, "simple").when(score <= 5, "moderate").when(score <= 10, "complex").otherwise("very_complex"))


def doc_complexity(pages: DataFrame, accounts: DataFrame, disputes: DataFrame) -> DataFrame:
    """Complexity score of each document from its pages and its accounts and disputes (one row each)."""
    own = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum(F.length("text")).alias("total_text"),
        (0.5 * F.count(F.lit(1)) + 2.0 * F.sum("n_tables") + F.sum("n_images") + 3.0 * F.count_if(F.col("content_complexity") == "very_complex")).alias("base"),
    )
    a, d = accounts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_accounts")), disputes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_disputes"))
    score = F.col("base") + 1.5 * F.coalesce("n_accounts", F.lit(0)) + 2.0 * F.coalesce("n_disputes", F.lit(0))
    return own.join(a, "doc_id", "left").join(d, "doc_id", "left").select("doc_id", "n_pages", "total_text", score.alias("complexity"))


def route_strategy(docs: DataFrame) -> DataFrame:
    """Late chunking, streaming or traditional, by length, pages and complexity."""
    large = (F.col("total_text") > 50000) | (F.col("n_pages") > 20) | (F.col("complexity") > 8)
    medium = (F.col("total_text") > 20000) | (F.col("n_pages") > 10) | (F.col("complexity") > 4)
    return docs.withColumn("strategy", F.when(large, "enhanced_late_chunking").when(medium, "streaming").otherwise("traditional"))


def has_complex_layout(pages: DataFrame) -> DataFrame:
    """Does any page of the document hold box characters or five spaces in a row?"""
    return pages.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("text").rlike("[│┌┐└┘├┤┬┴┼─]| {5,}"), F.lit(False))).alias("complex_layout"))


def detect_doc_type(pages: DataFrame, keywords: list[tuple[str, str]]) -> DataFrame:
    """The label of the first keyword of the ordered list that any page holds, case-blind; else unknown."""
    found = [F.bool_or(F.coalesce(F.contains(F.lower("text"), F.lit(k)), F.lit(False))) for k, _ in keywords]
    return pages.groupBy("doc_id").agg(F.coalesce(*[F.when(f, F.lit(label)) for f, (_, label) in zip(found, keywords, strict=True)], F.lit("unknown")).alias("document_type"))


def classify_intent(turns: DataFrame, text_col: str = "text") -> DataFrame:
    """Analysis type that a request names; late_chunking by default or when named itself."""
    c = F.lower(text_col)
    named = lambda word: F.contains(c, F.lit(word)) & ~F.contains(c, F.lit("late chunking"))
    return turns.withColumn("analysis_type", F.when(named("fcra"), "fcra").when(named("collection"), "collections").when(named("dispute"), "disputes").when(named("custom"), "custom").otherwise("late_chunking"))


def account_lines(pages: DataFrame, indicators: list[str]) -> DataFrame:
    """The lines of a page that hold any indicator, case-blind, in order and joined."""
    wanted = F.array(*[F.lit(i.lower()) for i in indicators])
    kept = F.filter(F.split("text", "\n"), lambda line: F.exists(wanted, lambda i: F.contains(F.lower(line), i)))
    return pages.withColumn("account_text", F.array_join(kept, "\n"))


def semantic_regions(pages: DataFrame, keywords: list[tuple[str, list[str], str]]) -> DataFrame:
    """One row for each region type of which a page holds a keyword; content is the first 500 lower-case characters."""
    low = F.lower("text")
    kinds = F.array(*[F.when(F.reduce(F.array(*[F.contains(low, F.lit(w)) for w in words]), F.lit(False), lambda a, b: a | b), F.struct(F.lit(i).alias("idx"), F.lit(kind).alias("type"), F.lit(importance).alias("importance"))) for i, (kind, words, importance) in enumerate(keywords)])
    each = pages.select("doc_id", "page_number", F.substring(low, 1, 500).alias("content"), F.explode(F.array_compact(kinds)).alias("r"))
    return each.select("doc_id", "page_number", F.format_string("region-%d-%d", "page_number", "r.idx").alias("id"), "r.type", "r.importance", "content")


#: Region types with their keywords and importance.
REGIONS = [
    ("personal_info", ["name", "address", "ssn", "social security"], "critical"),
    ("account_section", ["account", "balance", "payment", "creditor"], "high"),
    ("dispute_section", ["dispute", "investigation", "verified"], "high"),
    ("inquiry_section", ["inquiry", "inquiries", "requested by"], "medium"),
    ("score_section", ["score", "fico", "rating"], "critical"),
]


def header_footer(tokens: DataFrame, height: float = 792.0) -> DataFrame:
    """Does a page have tokens in its top or bottom tenth?"""
    return tokens.groupBy("doc_id", "page_number").agg(F.bool_or(F.col("y") < 0.1 * height).alias("has_header"), F.bool_or(F.col("y") > 0.9 * height).alias("has_footer"))


def estimate_columns(tokens: DataFrame) -> DataFrame:
    """Distinct token positions, rounded to 50 points, at most three."""
    return tokens.groupBy("doc_id", "page_number").agg(F.least(F.lit(3), F.count_distinct(F.floor(F.col("x") / 50 + 0.5) * 50)).cast("long").alias("columns"))


def page_labels(tokens: DataFrame, keywords: list[str], least: int = 4, most: int = 99) -> DataFrame:
    """Distinct tokens of 4 to 99 characters that hold a keyword, in order of their first place."""
    own = tokens.where(F.length("str").between(least, most) & F.lower("str").rlike("|".join(keywords)))
    first = own.groupBy("doc_id", "page_number", "str").agg(F.min(F.struct("line_no", "token_idx")).alias("at"))
    return first.groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "str"))), lambda x: x["str"]).alias("labels"))


def classify_table(page_tables: DataFrame) -> DataFrame:
    """Table class by keywords of its cells; the first rule wins."""
    c = F.lower(F.array_join("cells", " "))
    has = lambda w: F.contains(c, F.lit(w))
    kind = F.when(has("payment") & has("history"), "payment_history").when(has("account") & (has("balance") | has("status")), "account_summary").when(has("inquiry") | has("inquiries"), "inquiry_list").when(has("dispute"), "dispute_history").otherwise("other")
    return page_tables.withColumn("table_type", kind)


def accounts_from_tables(page_tables: DataFrame) -> DataFrame:
    """Four account columns from table rows after a document's first (the header); missing cells are Unknown."""
    cell = lambda i: F.coalesce(F.when(F.get("cells", F.lit(i)) != "", F.get("cells", F.lit(i))), F.lit("Unknown"))
    header = page_tables.groupBy("doc_id").agg(F.min("line_no").alias("header_no"))
    return page_tables.join(header.hint("merge"), "doc_id").where("line_no > header_no").select("doc_id", "line_no", cell(0).alias("creditor_name"), cell(1).alias("account_number"), cell(2).alias("account_type"), cell(3).alias("status"))


def table_to_text(page_tables: DataFrame) -> DataFrame:
    """Each document's table as text: a header line and its rows, cells joined by bars."""
    own = F.array_sort(F.collect_list(F.struct("line_no", F.array_join("cells", " | ").alias("row"))))
    rows = F.transform(own, lambda x: x["row"])
    return page_tables.groupBy("doc_id").agg(F.concat(F.lit("Headers: "), F.element_at(rows, 1), F.when(F.size(rows) > 1, F.concat(F.lit("\n"), F.array_join(F.slice(rows, F.lit(2), F.size(rows)), "\n"))).otherwise("")).alias("content"))


#: A document's properties as its file names them, and as columns.
METADATA = {"Title": "title", "Author": "author", "Subject": "subject", "Creator": "creator", "Producer": "producer", "CreationDate": "creation_date", "ModDate": "modification_date"}


def doc_metadata(docs: DataFrame) -> DataFrame:
    """The seven properties of each document from its map ``info``: five texts and two times; what is absent or no time is null. Times as 2024-01-31T12:00:00 or D:20240131120000."""
    value = lambda key: F.col("info")[key]
    digits = lambda key: F.substring(F.regexp_replace(value(key), "[^0-9]", ""), 1, 14)
    time = lambda key: F.try_to_timestamp(digits(key), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    return docs.select("doc_id", *[(time(key) if name.endswith("_date") else value(key)).alias(name) for key, name in METADATA.items()])
