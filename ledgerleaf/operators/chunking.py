"""Chunkers: one document in, many chunks out, by ordered folds over its own breaks or pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.operators.embed import pool_slice
from ledgerleaf.operators.locate import page_at

NONE = "cast(array() as array<struct<start:int,stop:int>>)"


def offsets(text: Column, pattern: str, width: int) -> Column:
    """Places (from 0) of non-overlapping matches of fixed width, from the lengths between them."""
    gaps = F.split(text, pattern, -1)
    start = F.expr("struct(0 as at, cast(array() as array<int>) as out)")
    step = lambda acc, g: F.struct((acc["at"] + F.length(g) + width).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(g))).alias("out"))
    return F.aggregate(F.slice(gaps, F.lit(1), F.size(gaps) - 1), start, step, lambda acc: acc["out"])


def paragraph_offsets(newlines: Column) -> Column:
    """Places of two newlines in a row."""
    return F.filter(newlines, lambda x: F.array_contains(newlines, x + 1))


def _last(places: Column, limit: Column) -> Column:
    return F.coalesce(F.array_max(F.filter(places, lambda x: x <= limit)), F.lit(-1))


def _fold(docs: DataFrame, size: Column, least: float, rule) -> DataFrame:
    """Chunk boundaries: from each place up to ``size`` on, or to where ``rule`` breaks. Every break lies past ``least`` of the size."""
    own = docs.withColumns({"_nl": offsets(F.col("text"), "\n", 1), "_st": offsets(F.col("text"), "\\. ", 2)}).withColumns({"_pp": paragraph_offsets(F.col("_nl")), "_n": F.length("text"), "_size": size})
    steps = F.sequence(F.lit(0), (F.col("_n") / (F.col("_size") * least)).cast("int") + 1)
    start = F.expr(f"struct(0 as at, {NONE} as out)")

    def step(acc, _):
        full = F.least(acc["at"] + F.col("_size"), F.col("_n"))
        end = F.when(full < F.col("_n"), rule(acc["at"], full)).otherwise(full).cast("int")
        grown = F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("stop")))).alias("out"))
        return F.when(acc["at"] >= F.col("_n"), acc).otherwise(grown)

    spans = F.aggregate(steps, start, step, lambda acc: acc["out"])
    each = own.select("doc_id", "text", F.posexplode(spans).alias("chunk_index", "s"))
    return each.select("doc_id", "chunk_index", F.col("s.start").alias("start"), F.col("s.stop").alias("end"), F.expr("substring(text, s.start + 1, s.stop - s.start)").alias("text"))


def chunk_natural(docs: DataFrame, size: int = 6000) -> DataFrame:
    """Chunks of at most ``size``, broken at a paragraph past 60 %, else a sentence past 70 %, else a line past 80 %; trimmed, without empty ones."""

    def rule(at, full):
        p, s, n = _last(F.col("_pp"), full), _last(F.col("_st"), full), _last(F.col("_nl"), full)
        past = lambda place, tenths: (place - at) * 10 > size * tenths  # noqa: E731  whole numbers: 700 * 0.7 is below 490 in doubles
        return F.when(past(p, 6), p + 2).when(past(s, 7), s + 2).when(past(n, 8), n + 1).otherwise(full)

    out = _fold(docs, F.lit(size), 0.6, rule)
    return out.withColumn("text", F.regexp_replace("text", "^\\s+|\\s+$", "")).where(F.length("text") > 0)


def chunk_adaptive(docs: DataFrame, small: int = 16000, overlap: int = 0) -> DataFrame:
    """Chunks of ``small``, 1.5 or 2 times that by document size, broken at the last paragraph, sentence or line past half; ``overlap`` characters repeat."""
    tokens = F.ceil(F.length("text") / 4)
    size = F.when(tokens > 2 * small, 2 * small).when(tokens > small, small * 3 // 2).otherwise(small)

    def rule(at, full):
        best = F.greatest(*[_last(F.col(c), full) for c in ("_pp", "_st", "_nl")])
        return F.when(best > at + F.col("_size") * 0.5, best + 1).otherwise(full)

    out = _fold(docs, size, 0.5, rule)
    if overlap:
        whole = docs.select("doc_id", F.col("text").alias("_whole"))
        out = out.join(whole.hint("merge"), "doc_id").withColumn("start", F.greatest(F.lit(0), F.col("start") - overlap)).withColumn("text", F.expr("substring(_whole, start + 1, end - start)")).drop("_whole")
    return out


def pack_pages(pages: DataFrame, target: int = 8000, image_tokens: int = 1200, mode: str = "ceil") -> DataFrame:
    """Greedy page packing to a token budget; a page over the budget is a chunk of its own. Needs has_image."""
    n = (F.ceil(F.length("text") / 4) if mode == "ceil" else F.floor(F.length("text") / 4)).cast("int") + F.when(F.col("has_image"), image_tokens).otherwise(0)
    own = F.array_sort(F.collect_list(F.struct("page_number", n.alias("n"))))
    start = F.expr("struct(-1 as chunk, 0 as total, cast(array() as array<struct<page_number:int,chunk:int,n:int>>) as out)")

    def step(acc, p):
        fits = (acc["chunk"] >= 0) & (acc["total"] + p["n"] <= target)
        chunk = F.when(fits, acc["chunk"]).otherwise(acc["chunk"] + 1)
        total = F.when(fits, acc["total"] + p["n"]).otherwise(p["n"])
        return F.struct(chunk.alias("chunk"), total.alias("total"), F.concat(acc["out"], F.array(F.struct(p["page_number"].alias("page_number"), chunk.alias("chunk"), p["n"].alias("n")))).alias("out"))

    packed = pages.groupBy("doc_id").agg(F.aggregate(own, start, step, lambda acc: acc["out"]).alias("p"))
    return packed.select("doc_id", F.explode("p").alias("p")).select("doc_id", F.col("p.chunk").alias("chunk_index"), "p.page_number", F.col("p.n").alias("tokens"))


def chunk_ranges(packed: DataFrame) -> DataFrame:
    return packed.groupBy("doc_id", "chunk_index").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.sum("tokens").alias("tokens"))


def group_pages(pages: DataFrame, n: int = 5) -> DataFrame:
    """Fixed groups of pages with a caption."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number"))
    own = pages.withColumn("chunk_index", ((at - 1) / n).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n\n")
    return own.groupBy("doc_id", "chunk_index").agg(F.format_string("Pages %d-%d", F.min("page_number"), F.max("page_number")).alias("caption"), text.alias("text"))


def pack_paragraphs(docs: DataFrame, limit: int = 1000) -> DataFrame:
    """Greedy packing of blank-line paragraphs to a token limit, joined by blank lines."""
    parts = F.filter(F.split("text", "\n\\s*\n"), lambda p: F.length(F.trim(p)) > 0)
    start = F.expr("struct(0 as total, cast(array() as array<struct<text:string,tokens:int>>) as out)")

    def step(acc, p):
        n = F.ceil(F.length(p) / 4).cast("int")
        last = F.element_at(acc["out"], -1)
        fits = (F.size(acc["out"]) > 0) & (acc["total"] + n <= limit)
        joined = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.struct(F.concat(last["text"], F.lit("\n\n"), p).alias("text"), (last["tokens"] + n).alias("tokens"))))
        return F.when(fits, F.struct((acc["total"] + n).alias("total"), joined.alias("out"))).otherwise(F.struct(n.alias("total"), F.concat(acc["out"], F.array(F.struct(p.alias("text"), n.alias("tokens")))).alias("out")))

    chunks = F.aggregate(parts, start, step, lambda acc: acc["out"])
    each = docs.select("doc_id", F.posexplode(chunks).alias("chunk_index", "c"))
    return each.select("doc_id", "chunk_index", F.trim("c.text").alias("text"), F.col("c.tokens").alias("tokens"))


def section_chunks(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Each section's pages as one chunk, with priority from importance."""
    span = F.explode(F.sequence("page_start", "page_end"))
    own = sections.where("page_start <= page_end").withColumn("page_number", span).join(pages.hint("merge"), ["doc_id", "page_number"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n\n")
    priority = F.when(F.col("importance") == "critical", "critical").when(F.col("importance") == "high", "high").otherwise("medium")
    return own.groupBy("doc_id", "section_type", "importance").agg(text.alias("text"), F.count(F.lit(1)).alias("n_pages")).select("doc_id", "section_type", priority.alias("priority"), "n_pages", "text")


def entity_chunks(entities: DataFrame, pages: DataFrame, level: str) -> DataFrame:
    """Account or dispute chunks: a header of known fields and the entity's pages; disputed ones are critical. Needs page_numbers, header and disputed."""
    own = entities.withColumn("page_number", F.explode("page_numbers")).join(pages.hint("merge"), ["doc_id", "page_number"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n")
    return own.groupBy("doc_id", "entity_id", "header", "disputed").agg(text.alias("body")).select("doc_id", "entity_id", F.lit(level).alias("level"), F.when(F.col("disputed"), "critical").otherwise("high").alias("priority"), F.concat_ws("\n", "header", "body").alias("text"))


def complex_pages_only(chunks: DataFrame, pages: DataFrame, most_tables: int = 2) -> DataFrame:
    """Table and region chunks of pages that need them: very complex ones, or with over ``most_tables`` tables. ``pages`` has doc_id, page_number, complexity and n_tables."""
    hard = pages.where((F.col("complexity") == "very_complex") | (F.col("n_tables") > most_tables)).select("doc_id", "page_number").distinct()
    return chunks.join(hard.hint("merge"), ["doc_id", "page_number"], "left_semi")


def hierarchical_chunks(**levels: DataFrame) -> DataFrame:
    """All levels' chunks (doc_id, text, and page_number where the level has pages) numbered through in a document: levels in the order given, pages in order."""
    page = lambda df: F.col("page_number") if "page_number" in df.columns else F.lit(0)
    tagged = [df.select("doc_id", F.lit(i).alias("level_no"), F.lit(name).alias("level"), "text", page(df).alias("place")) for i, (name, df) in enumerate(levels.items())]
    both = reduce(lambda a, b: a.unionByName(b), tagged)
    numbered = Window.partitionBy("doc_id").orderBy("level_no", "place", "text")
    return both.withColumn("chunk_index", F.row_number().over(numbered)).drop("place")


def remaining_text(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The text after the chunked length, only if the document is over twice as long as that."""
    done = chunks.groupBy("doc_id").agg(F.sum(F.length("text")).alias("done"))
    own = docs.select("doc_id", "text").join(done, "doc_id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return own.where(F.length("text") > 2 * F.col("done")).select("doc_id", F.expr("substring(text, cast(done as int) + 1)").alias("text"))


def find_sections(docs: DataFrame, patterns: list[tuple[str, str]], max_len: int = 2000) -> DataFrame:
    """Every hit of a section word starts a section, up to ``max_len`` or the nearest later hit over 100 characters on.

    A hit is a row of its place alone. The hit that ends it is looked for in a range frame, which holds no more than the hits in ``max_len`` characters.
    """
    named = lambda kind: lambda at: F.struct(at.alias("start"), F.lit(kind).alias("section_type"))
    hits = F.concat(*[F.transform(offsets(F.col("text"), p, len(p)), named(kind)) for kind, p in patterns])
    own = docs.select("doc_id", F.length("text").alias("n"), F.explode(hits).alias("h")).select("doc_id", "n", "h.*")
    frame = Window.partitionBy("doc_id").orderBy("start").rangeBetween(101, max_len)
    end = F.least(F.col("start") + max_len, F.col("n"), F.min("start").over(frame))
    return own.select("doc_id", "section_type", "start", end.alias("end"))


def batch_pages(pages: DataFrame, n: int = 10, context: int = 2, head: int = 500) -> DataFrame:
    """Batches of ``n`` pages with the heads of the last ``context`` pages before each."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number")) - 1
    own = pages.withColumns({"at": at}).withColumn("batch", F.expr(f"at div {n}"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", c))), lambda p: p[c]), "\n")
    main = own.groupBy("doc_id", "batch").agg(F.min("page_number").alias("first_page"), F.count(F.lit(1)).alias("n_pages"))
    before = own.where(F.col("at") % n >= n - context).select("doc_id", (F.col("batch") + 1).alias("batch"), "page_number", F.substring("text", 1, head).alias("head")).groupBy("doc_id", "batch").agg(joined("head").alias("context"))
    return main.join(before.hint("merge"), ["doc_id", "batch"], "left").withColumn("context", F.coalesce("context", F.lit("")))


def summary_text(pages: DataFrame, first: int = 10, head: int = 500, cut: int = 8000, tables: DataFrame | None = None, regions: DataFrame | None = None, rows: int = 3) -> DataFrame:
    """Page heads, then the class and first rows of each table and the content of regions of high importance, as one text of at most ``cut`` characters.

    ``tables`` has doc_id, table_type and content (rows on lines); ``regions`` has doc_id, page_number, id, type, importance and content.
    """
    page = pages.where(F.col("page_number") <= first).select("doc_id", F.lit(0).alias("part"), F.col("page_number").cast("string").alias("at"), F.col("page_number").alias("n"), F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit(": "), F.substring("text", 1, head)).alias("t"))
    parts = page
    if tables is not None:
        top = F.array_join(F.slice(F.split("content", "\n"), 1, rows), "\n")
        parts = parts.union(tables.select("doc_id", F.lit(1), F.col("table_type"), F.lit(0), F.concat(F.lit("Table ("), F.col("table_type"), F.lit("): "), top)))
    if regions is not None:
        own = regions.where("importance in ('high', 'critical') and page_number <= " + str(first))
        parts = parts.union(own.select("doc_id", F.lit(2), F.col("id"), F.col("page_number"), F.concat(F.lit("Region ("), F.col("type"), F.lit("): "), F.substring("content", 1, head))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "n", "at", "t"))), lambda p: p["t"]), "\n")
    return parts.groupBy("doc_id").agg(F.substring(text, 1, cut).alias("summary"))


def late_chunks(chunks: DataFrame, vectors: DataFrame, pages: DataFrame, table_words: list[str], starts: list[str]) -> DataFrame:
    """Chunks with the slice of their document's vector, the pages they lie on and what context they keep.

    Needs doc_id, chunk_index, start, end and text; ``vectors`` has doc_id, total and doc_vector, ``pages`` doc_id, page_number and start, the place of
    each page in the text. A chunk's first and last page come from one as-of join. Flags: has_table (a word of
    ``table_words``), starts_section (begins with one of ``starts``), continues (the one before ends in mid-sentence).
    """
    key = F.col("chunk_index").cast("long")
    ends = F.array(F.struct((2 * key).alias("offset_id"), F.col("start").alias("offset")), F.struct((2 * key + 1).alias("offset_id"), F.greatest(F.col("end") - 1, F.col("start")).alias("offset")))
    edges = chunks.select("doc_id", F.explode(ends).alias("e")).select("doc_id", "e.*")
    at = page_at(edges, pages).withColumn("chunk_index", F.expr("cast(offset_id div 2 as int)"))
    at = at.groupBy("doc_id", "chunk_index").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"))
    low = F.lower("text")
    any_of = lambda tests: F.coalesce(reduce(lambda x, y: x | y, tests, F.lit(False)), F.lit(False))
    before = F.lag(F.rtrim("text")).over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    flagged = chunks.withColumns({
        "has_table": any_of([F.contains(low, F.lit(w)) for w in table_words]), "starts_section": any_of([F.startswith(F.ltrim(low), F.lit(w)) for w in starts]),
        "continues": before.isNotNull() & ~F.substring(before, -1, 1).isin(".", "!", "?"),
    })
    pooled = pool_slice(flagged.join(vectors.hint("merge"), "doc_id"))
    return pooled.join(at.hint("merge"), ["doc_id", "chunk_index"]).withColumn("page_numbers", F.sequence("first_page", "last_page")).drop("first_page", "last_page", "doc_vector", "total")
