"""Where findings lie on a page: boxes, phrases, tokens, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions.text import normalize_anchor
from ledgerleaf.operators.corpus import classify_table
from ledgerleaf.sources.shared import written


def bounding_box(rects: DataFrame, keys: list[str]) -> DataFrame:
    return rects.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"))


def of_documents(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of documents that ``wanted`` has. Where rows are exploded from a document, the optimizer asks this of the document. They are not sorted: the ids alone are hashed."""
    return rows.join(wanted.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")


def token_hits(issues: DataFrame, tokens: DataFrame, cell: float = 100.0) -> DataFrame:
    """Number of tokens that each issue's box strictly meets.

    Boxes and tokens meet by (document, page, vertical band), so a dense page
    is compared band by band; a pair is counted in the first band they share.
    Tokens of documents without issues are not looked at, and a token is put
    into bands only once it is known that its document has any. Tokens stream past the boxes of their part, which are hashed, and are never sorted.
    """
    issues = written(issues, "issues")
    bands = lambda y, h: F.sequence(F.floor(F.col(y) / cell).cast("int"), F.floor((F.col(y) + F.col(h)) / cell).cast("int"))
    left = issues.select("id", "doc_id", "page_number", *[F.col(c).alias(f"i{c}") for c in ("x", "y", "width", "height")])
    left = left.withColumn("band", F.explode(bands("iy", "iheight")))
    right = of_documents(tokens.select("doc_id", "page_number", "x", "y", "width", "height"), issues).withColumn("band", F.explode(bands("y", "height")))
    first = F.greatest(F.floor(F.col("iy") / cell), F.floor(F.col("y") / cell)).cast("int")
    meets = (F.col("ix") < F.col("x") + F.col("width")) & (F.col("x") < F.col("ix") + F.col("iwidth")) & (F.col("iy") < F.col("y") + F.col("height")) & (F.col("y") < F.col("iy") + F.col("iheight"))
    hits = right.join(left.hint("shuffle_hash"), ["doc_id", "page_number", "band"]).where(meets & (F.col("band") == first)).groupBy("id").agg(F.count(F.lit(1)).alias("token_count"))
    return issues.join(hits.hint("merge"), "id", "left").withColumn("token_count", F.coalesce("token_count", F.lit(0)))


def gate(issues: DataFrame) -> DataFrame:
    """Keep issues in bounds that meet a token or are critical; needs in_bounds and token_count."""
    ok = F.col("in_bounds") & ((F.col("token_count") > 0) | (F.col("type") == "critical"))
    reason = F.when(~F.col("in_bounds"), "out_of_bounds").when(~ok, "no_tokens").otherwise("kept")
    return issues.withColumn("gate", reason)


def match_phrase(issues: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each run of tokens of a line whose normalised text is the issue's normalised anchor, with its box; anchors of any length.

    Every word of an anchor meets the tokens that equal it; a run matches
    where all words point to the same first position. Tokens of documents
    without a wanted anchor are not looked at.
    """
    words = F.split(normalize_anchor(F.col("anchor_text")), " ")
    wanted = issues.select("id", "doc_id", words.alias("want")).where(F.element_at("want", 1) != "")
    wanted = wanted.select("id", "doc_id", F.size("want").alias("k"), F.posexplode("want").alias("i", "norm"))
    line = Window.partitionBy("doc_id", "line_no").orderBy("token_idx")
    placed = of_documents(tokens.select("doc_id", "line_no", "token_idx", "str", "x", "y", "width", "height"), wanted).withColumns({"norm": normalize_anchor(F.col("str")), "place": F.row_number().over(line)})
    met = placed.join(wanted.hint("shuffle_hash"), ["doc_id", "norm"]).withColumn("first_place", F.col("place") - F.col("i"))
    box = [F.min_by(c, "i").alias(c) for c in ("token_idx", "x", "y", "height")]
    end = F.max_by(F.col("x") + F.col("width"), "i")
    runs = met.groupBy("id", "doc_id", "line_no", "first_place", "k").agg(F.count(F.lit(1)).alias("n"), *box, end.alias("end"))
    return runs.where("n = k").select("id", "doc_id", "line_no", "token_idx", "x", "y", (F.col("end") - F.col("x")).alias("width"), "height")


def pieces(rows: DataFrame, text: str, size: str) -> DataFrame:
    """Each piece of ``text`` of ``size`` characters as a row with column piece; an empty text has one of size 0."""
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length(text) - F.col(size) + 1, F.lit(1)))).alias("_at")
    own = rows.where(F.col(size) <= F.length(text)).select("*", at)
    return own.withColumn("piece", F.substring(F.col(text), F.col("_at"), F.col(size))).drop("_at")


def piece_masks(asked: DataFrame, words: int = 64) -> DataFrame:
    """(doc_id, masks): for each size, which hashes of pieces a document asks for, as bits of ``words`` longs. Needs doc_id, size and piece."""
    h = F.pmod(F.xxhash64("piece"), F.lit(64 * words)).cast("int")
    bits = asked.select("doc_id", "size", h.alias("h")).groupBy("doc_id", "size", F.expr("h div 64").alias("word"))
    bits = bits.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.expr("h % 64"))).alias("bits"))
    held = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    mask = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(words - 1).cast("bigint")), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long")))
    each = bits.groupBy("doc_id", "size").agg(held.alias("held")).select("doc_id", F.struct("size", mask.alias("mask")).alias("m"))
    return each.groupBy("doc_id").agg(F.collect_list("m").alias("masks"))


def first_holding(wants: DataFrame, found: DataFrame, text: str, order: list[str], blind: bool = False, q: int = 6) -> DataFrame:
    """For each row of ``wants`` (id, doc_id, want) the first row of ``found`` in its document whose ``text`` holds it; others drop.

    An inverted index of pieces of ``q`` characters: a wanted text meets only
    the found texts that hold its rarest piece in the document, and is then
    looked for in them. A wanted text shorter than ``q`` is its own piece, so
    texts are cut into the lengths that their document asks for; the empty
    one stands in the empty piece of every text. A piece whose hash the document does not ask for is
    not indexed. Where ``wants`` has a page_number that is not null, only
    that page, which ``found`` then names, is searched.
    """
    low = F.lower if blind else F.col
    hint = ["page_number"] if "page_number" in wants.columns else []
    own = written(wants.select("id", "doc_id", low("want").alias("want"), *hint), "wants")
    rest = [c for c in found.columns if c not in ("doc_id", text)]
    keys = own.select("doc_id", "want", *hint).distinct()
    asked = pieces(keys.withColumn("size", F.least(F.length("want"), F.lit(q))), "want", "size")
    masks = piece_masks(asked.select("doc_id", "size", "piece"))
    row = F.struct(*[F.col(c) for c in [*order, *[c for c in rest if c not in order]]]).alias("t")
    texts = of_documents(found, own).select("doc_id", low(text).alias("_text"), row).join(masks.hint("merge"), "doc_id")
    texts = texts.select("doc_id", "_text", "t", F.explode("masks").alias("m")).select("doc_id", "_text", "t", F.col("m.size").alias("size"), F.col("m.mask").alias("mask"))
    h = F.pmod(F.xxhash64("piece"), 64 * F.size("mask")).cast("int")
    known = F.call_function("getbit", F.element_at("mask", (F.floor(h / 64) + 1).cast("int")), h % 64) == 1
    postings = written(pieces(texts, "_text", "size").where(known).select("doc_id", "piece", "_text", "t"), "postings")
    counts = postings.groupBy("doc_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    # a piece that no text of the document holds ends the search
    rarest = asked.join(counts.hint("merge"), ["doc_id", "piece"], "left").groupBy("doc_id", "want", *hint).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r"))
    rarest = rarest.where("r.n > 0").select("doc_id", "want", *hint, F.col("r.piece").alias("piece"))
    met = rarest.join(postings.hint("merge"), ["doc_id", "piece"]).where(F.contains("_text", "want"))
    if hint:
        met = met.where(F.col("page_number").isNull() | (F.col("t.page_number") == F.col("page_number")))
    first = met.groupBy("doc_id", "want", *hint).agg(F.min("t").alias("t"))
    first = first.select(F.col("doc_id").alias("_doc"), F.col("want").alias("_want"), *[F.col(c).alias(f"_{c}") for c in hint], "t")
    same = (F.col("doc_id") == F.col("_doc")) & (F.col("want") == F.col("_want"))
    for c in hint:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return own.join(first.hint("merge"), same).select("id", *[f"t.{c}" for c in rest])


def match_token(issues: DataFrame, tokens: DataFrame, page_hint: bool = False) -> DataFrame:
    """The first token of the document that holds the anchor, case-blind; issues without one drop.

    With ``page_hint``, an issue whose page_number is not null looks at that page's tokens only.
    """
    page = ["page_number"] if page_hint else []
    wants = issues.select("id", "doc_id", F.col("anchor_text").alias("want"), *page)
    return first_holding(wants, tokens.select("doc_id", "str", "line_no", "token_idx", "x", "y", *page), "str", ["line_no", "token_idx"], blind=True)


def match_line(issues: DataFrame, lines: DataFrame) -> DataFrame:
    """The first line of the document that holds the anchor, as a box; issues without one drop."""
    wants = issues.select("id", "doc_id", F.col("anchor_text").alias("want"))
    boxes = lines.select("doc_id", "line", "line_no", F.lit(50.0).alias("lx"), (8.0 * F.length("line")).alias("lw"))
    return first_holding(wants, boxes, "line", ["line_no"])


def flip_origin(tokens: DataFrame, page_height: float = 792.0) -> DataFrame:
    """Places from the bottom left to the top left; a missing height is 12, a missing width half a height a character."""
    height = F.coalesce("height", F.lit(12.0))
    return tokens.withColumns({"y": F.lit(page_height) - F.col("y") - height, "width": F.coalesce("width", F.length("str") * height / 2), "height": height})


def word_index(tokens: DataFrame) -> DataFrame:
    """Postings of words over two characters, from (doc_id, str): how many tokens and documents hold each."""
    word = F.explode(F.split(F.lower("str"), "\\s+"))
    return tokens.select("doc_id", word.alias("word")).where(F.length("word") > 2).groupBy("word").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("doc_id").alias("n_docs"))


def page_starts(pages: DataFrame) -> DataFrame:
    """Offset at which each page's marker starts in the assembled text."""
    size = F.length(F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit(":\n"), "text")) + 2
    before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0))).select("doc_id", "page_number", "start")


def page_at(offsets: DataFrame, starts: DataFrame) -> DataFrame:
    """The page of each offset: the last one that starts at or before it, else 1.

    As-of join by one sorted union: starts come before offsets at the same place.
    """
    cols = ["doc_id", "place", "kind", "page_number", "offset_id"]
    left = starts.select("doc_id", F.col("start").cast("long").alias("place"), F.lit(0).alias("kind"), "page_number", F.lit(None).cast("long").alias("offset_id"))
    right = offsets.select("doc_id", F.col("offset").cast("long").alias("place"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("page_number"), F.col("offset_id").cast("long").alias("offset_id"))
    w = Window.partitionBy("doc_id").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = left.select(cols).union(right.select(cols)).withColumn("page", F.last("page_number", ignorenulls=True).over(w))
    return both.where("kind = 1").select("doc_id", "offset_id", F.coalesce("page", F.lit(1)).alias("page_number"))


def group_rows(tokens: DataFrame, tol: float = 5.0) -> DataFrame:
    """Rows of a page: each token, in order, joins the first row whose first y is within ``tol``, or opens one; a row is named by that y.

    Tokens of equal y are of one row, that of the first of them, as later rows come after it. So the fold runs over a page's distinct
    heights in the order of their first tokens and holds the rows it opened, which are over ``tol`` apart. A page bounds the group.
    """
    heights = tokens.groupBy("doc_id", "page_number", "y").agg(F.min("token_id").alias("first"), F.collect_list("token_id").alias("held"))
    return rows_of_heights(heights, tol).select("doc_id", "page_number", F.explode("held").alias("token_id"), "row_y")


def rows_of_heights(heights: DataFrame, tol: float) -> DataFrame:
    """The row of each distinct height of a page, from the height y, its first token and what it holds (``held``)."""
    paged = heights.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("first", "y", "held"))).alias("own"))
    near = lambda rows, y: F.get(F.filter(rows, lambda r: F.abs(r - y) <= tol), F.lit(0))
    step = lambda rows, t: F.when(near(rows, t["y"]).isNull(), F.concat(rows, F.array(t["y"]))).otherwise(rows)
    rows = F.aggregate("own", F.expr("cast(array() as array<double>)"), step)
    # the rows are an array of one, so that they are worked out once
    each = paged.select("doc_id", "page_number", "own", F.explode(F.array(rows)).alias("rows")).select("doc_id", "page_number", "rows", F.explode("own").alias("t"))
    return each.select("doc_id", "page_number", F.col("t.held").alias("held"), near(F.col("rows"), F.col("t.y")).alias("row_y"))


def group_lines(tokens: DataFrame, tol: float = 5.0) -> DataFrame:
    """Lines of a page: tokens by y, each joining the first line whose running mean is within ``tol``, or opening one; lines are numbered from 0.

    Tokens come by rising y, so a line that one of them misses is never met again: only the latest line can
    take the next token, and the fold holds its sum and count. Tokens of equal y stay together and are folded once.
    """
    heights = tokens.groupBy("doc_id", "page_number", "y").agg(F.collect_list("token_id").alias("ids"))
    own = F.array_sort(F.collect_list(F.struct("y", "ids")))
    start = F.expr("struct(0D as total, 0L as n, -1 as line, cast(array() as array<int>) as out)")

    def step(acc, t):
        k = F.size(t["ids"]).cast("long")
        joins = (acc["n"] > 0) & (F.abs(acc["total"] / acc["n"] - t["y"]) <= tol)
        line = F.when(joins, acc["line"]).otherwise(acc["line"] + 1)
        total, n = F.when(joins, acc["total"]).otherwise(0.0) + t["y"] * k, F.when(joins, acc["n"]).otherwise(0) + k
        return F.struct(total.alias("total"), n.alias("n"), line.alias("line"), F.concat(acc["out"], F.array(line)).alias("out"))

    paged = heights.groupBy("doc_id", "page_number").agg(own.alias("own"))
    line_of = F.aggregate("own", start, step, lambda acc: acc["out"])
    each = paged.select("doc_id", "page_number", F.explode(F.arrays_zip(F.col("own"), line_of.alias("line"))).alias("r"))
    return each.select("doc_id", "page_number", F.explode("r.own.ids").alias("token_id"), F.col("r.line").alias("line"))


def table_runs(rows: DataFrame, least_cells: int = 3, least_rows: int = 2) -> DataFrame:
    """Maximal runs of rows with enough cells, of at least two rows; the first row is the header."""
    w = Window.partitionBy("doc_id").orderBy("row_no")
    flag = F.col("n_cells") >= least_cells
    grouped = rows.withColumn("run", F.sum(F.when(flag, 0).otherwise(1)).over(w)).where(flag)
    return grouped.groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_no").alias("header_row"), F.max("row_no").alias("last_row")).where(F.col("n_rows") >= least_rows).drop("run")


def detect_tables(tokens: DataFrame, gap: float = 20.0, tol: float = 5.0, least_cells: int = 3, least_rows: int = 2) -> DataFrame:
    """The tables of pages: doc_id, page_number, header_y, n_rows, n_columns, header, cells and table_type.

    Tokens become rows by their y (``group_rows``); in a row, a distance of over ``gap`` from the furthest end so far begins a cell.
    Maximal runs of rows with enough cells are tables, the first row being the header. Columns are the
    sessions of a table's sorted cell edges: one begins where no cell of any row reaches within ``gap``. Needs doc_id, page_number, token_id, x, y, width and str.
    Tokens are shuffled once, by page, and all the rest happens where a page lies; a page bounds the group.
    """
    page = ["doc_id", "page_number"]
    dealt = tokens.select(*page, "token_id", "x", "y", (F.col("x") + F.col("width")).alias("end"), "str").repartition(*page)
    heights = dealt.groupBy(*page, "y").agg(F.min("token_id").alias("first"), F.collect_list(F.struct("token_id", "x", "end", "str")).alias("held"))
    rows = rows_of_heights(heights, tol).select(*page, "row_y", F.explode("held").alias("t")).select(*page, "row_y", "t.*")

    def sessions(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("x", "end")
        far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn("_new", F.when(far.isNull() | (F.col("x") - far > gap), 1).otherwise(0)).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")

    row = [*page, "row_y"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "token_id", "str"))), lambda t: t["str"]), " ")
    cells = sessions(rows, row, "cell").groupBy(*row, "cell").agg(text.alias("text"), F.min("x").alias("x"), F.max("end").alias("end"))
    line = Window.partitionBy(*page).orderBy("row_y")
    sized = cells.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("cell", "text", "x", "end"))).alias("cells"))
    few = F.sum(F.when(F.size("cells") >= least_cells, 0).otherwise(1)).over(line)
    runs = sized.withColumn("run", few).where(F.size("cells") >= least_cells)
    table = [*page, "run"]
    placed = sessions(runs.select(*table, "row_y", F.explode("cells").alias("c")).select(*table, "row_y", "c.*"), table, "column")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda c: c["text"])
    lined = placed.groupBy(*table, "row_y").agg(texts.alias("texts"), F.max("column").alias("column"))
    found = lined.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("row_y", "texts"))).alias("rows"), (F.max("column") + 1).cast("int").alias("n_columns")).where(F.size("rows") >= least_rows)
    out = found.withColumn("cells", F.flatten(F.transform("rows", lambda r: r["texts"])))
    first = F.element_at("rows", 1)
    return classify_table(out).select(*page, first["row_y"].alias("header_y"), F.size("rows").alias("n_rows"), "n_columns", first["texts"].alias("header"), "cells", "table_type")
