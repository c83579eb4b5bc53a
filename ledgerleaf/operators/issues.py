"""Findings to issues: parsing, sanitising, explaining, de-duplicating, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Allowed values and defaults.
TYPES, CATEGORIES, SEVERITIES = ["critical", "warning", "attention", "info"], ["FCRA_violation", "collection", "dispute", "accuracy", "other"], ["high", "medium", "low"]
COLORS = {"critical": "#ff4444", "warning": "#ff9944", "attention": "#ffdd44", "info": "#44ddff"}
SEVERITY_SCORE = {"charge_off": 5, "collection": 5, "truncated_account": 5, "late_payment": 3, "high_utilization": 2, "derogatory": 4, "missing_data": 2, "dispute": 1}
FINDINGS = "totalIssues int, critical int, warning int, attention int, info int, summary string, confidence double, issues array<struct<id:string,type:string,category:string,description:string,severity:string,pageNumber:string,anchorText:string>>"


def mapped(c: Column, values: dict, default: object) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in values.items()], F.lit(default))


def parse_findings(raw: DataFrame, col: str = "response_raw") -> DataFrame:
    """Parsed response text beside its row: parsed_ok, and defaults where it fails; a true zero confidence counts as missing."""
    from ledgerleaf.functions.text import strip_fence

    parsed = F.from_json(strip_fence(F.col(col)), FINDINGS, {"mode": "PERMISSIVE"})
    own = raw.withColumn("_p", parsed)
    ok = F.col("_p.issues").isNotNull() | F.col("_p.summary").isNotNull() | F.col("_p.totalIssues").isNotNull()
    return own.select(
        *raw.columns, F.coalesce(ok, F.lit(False)).alias("parsed_ok"), F.greatest(F.lit(0), F.coalesce("_p.totalIssues", F.lit(0))).alias("total_issues"),
        F.coalesce("_p.summary", F.when(ok, "Analysis completed").otherwise("Analysis completed - no issues identified")).alias("summary"), F.when(ok, clamp(F.col("_p.confidence"), 0.0)).otherwise(F.lit(0.5)).alias("confidence"),
        F.coalesce(F.size("_p.issues"), F.lit(0)).alias("n_issues"), F.col("_p.issues").alias("issues"),
    )


def harmonize_rects(findings: DataFrame) -> DataFrame:
    """One row per rectangle of findings whose boxes come as ``coordinates`` (JSON, an object or a list), ``bbox``, ``bboxes`` or inside ``evidence``; findings without any keep one row of nulls."""
    inside = F.transform("evidence", lambda e: F.coalesce(e["bbox"], F.struct(e["x"].alias("x"), e["y"].alias("y"), e["width"].alias("width"), e["height"].alias("height"))))
    given = F.from_json("coordinates", "array<struct<x:double,y:double,width:double,height:double>>") if "coordinates" in findings.columns else F.lit(None)
    rects = F.coalesce(given, F.when(F.col("bbox").isNotNull(), F.array("bbox")), F.col("bboxes"), inside)
    each = findings.select("id", "type", F.posexplode_outer(rects).alias("rect_no", "r"))
    return each.select("id", "type", "rect_no", "r.x", "r.y", "r.width", "r.height")


def clamp(c: Column, default: float) -> Column:
    """Into 0..1; missing and zero take the default."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(default))))


def clamp_confidence(df: DataFrame, default: float = 0.7) -> DataFrame:
    return df.withColumn("confidence", clamp(F.col("confidence"), default))


def sanitize_enums(issues: DataFrame) -> DataFrame:
    pick = lambda c, allowed, default: F.when(F.col(c).isin(allowed), F.col(c)).otherwise(F.lit(default))
    return issues.withColumns({"type": pick("type", TYPES, "info"), "category": pick("category", CATEGORIES, "other"), "severity": pick("severity", SEVERITIES, "medium")})


def clamp_page(issues: DataFrame, total_col: str = "total_pages", page_col: str = "page_number") -> DataFrame:
    """Leading integer of the page, into 1..total; 1 if there is none."""
    page = F.expr(f"try_cast(regexp_extract(cast({page_col} as string), '^[ ]*(-?[0-9]+)', 1) as int)")
    return issues.withColumn(page_col, F.when(page.isNull(), 1).otherwise(F.greatest(F.lit(1), F.least(page, F.col(total_col)))))


def cut_anchor(issues: DataFrame, n: int = 120) -> DataFrame:
    return issues.withColumn("anchor_text", F.substring("anchor_text", 1, n))


def tooltip(issues: DataFrame) -> DataFrame:
    """Description and what is known of severity, section and action, a line each."""
    filled = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(label), F.col(c)))
    return issues.withColumn("tooltip", F.concat_ws("\n", "description", filled("Severity: ", "severity"), filled("FCRA Section: ", "fcra_section"), filled("Action: ", "recommended_action")))


def why_flagged(issues: DataFrame) -> DataFrame:
    says = lambda word: F.contains(F.lower("description"), F.lit(word))
    rules = [
        (F.col("type") == "critical", "Critical accuracy issue detected"), ((F.length("anchor_text") > 0) & (F.length("anchor_text") < 20), "Text appears incomplete or missing"), (says("missing"), "Missing required information"),
        (says("inconsistent"), "Data inconsistency detected"), (says("account number"), "Account identification issue"), (says("payment history"), "Payment record anomaly"),
    ]
    joined = F.concat_ws("; ", *[F.when(c, F.lit(text)) for c, text in rules])
    return issues.withColumn("why_flagged", F.when(joined != "", joined).otherwise("Pattern matching analysis flagged this content"))


def recommend_action(issues: DataFrame) -> DataFrame:
    says = lambda word: F.contains(F.lower("description"), F.lit(word))
    action = F.when(F.col("type") == "critical", "Immediate review required - contact credit bureau for correction").when(says("missing account number"), "Request complete account information from creditor").when(says("payment history"), "Verify payment records with original creditor").when(says("balance"), "Cross-reference balance with creditor statements")
    return issues.withColumn("recommended_action", F.coalesce("recommended_action", action, F.lit("Review and verify accuracy with relevant party")))


def color_of(issues: DataFrame) -> DataFrame:
    """Colour of the type and its red, green and blue; yellow for other types."""
    hexa = mapped(F.col("type"), COLORS, "#ffff00")
    part = lambda at: F.conv(F.substring(hexa, at, 2), 16, 10).cast("int")
    return issues.withColumns({"color": hexa, "red": part(2), "green": part(4), "blue": part(6)})


def severity_score(detections: DataFrame, col: str = "error_type") -> DataFrame:
    return detections.withColumn("severity_score", mapped(F.col(col), SEVERITY_SCORE, 3))


def enhance_issues(issues: DataFrame) -> DataFrame:
    return issues.withColumns({"mapping_method": F.lit("pattern"), "context": F.concat_ws(" | ", "category", "description")})


def valid_coordinates(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) by four finite numbers."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = F.coalesce(reduce(lambda a, b: a & b, [finite(c) for c in ("x", "y", "width", "height")]), F.lit(False))
    return issues.where(ok), issues.where(~ok)


def pixels_to_points(issues: DataFrame, meta: DataFrame, strict: bool = False) -> DataFrame:
    """Boxes in points by their page's resolution. Issues of pages without metadata go, or with ``strict`` raise when read."""
    scale = F.lit(72.0) / F.coalesce("dpi", F.lit(300))
    own = issues.join(meta.select("doc_id", "page_number", "dpi").hint("merge"), ["doc_id", "page_number"], "left" if strict else "inner")
    if strict:
        own = own.withColumn("dpi", F.when(F.col("dpi").isNull(), F.raise_error(F.lit("page without metadata"))).otherwise(F.col("dpi")))
    return own.withColumns({c: F.col(c) * scale for c in ("x", "y", "width", "height")})


def in_bounds(issues: DataFrame, mode: str = "contained", width: float = 612.0, height: float = 792.0) -> DataFrame:
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    ok = {
        "contained": (x >= 0) & (y >= 0) & (x + w <= width) & (y + h <= height),
        "positive": (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 2000) & (y + h <= 3000),
        "intersects": (x < width) & (y < height) & (x + w > 0) & (y + h > 0),
    }[mode]
    return issues.withColumn("in_bounds", ok)


def highlight_payload(issues: DataFrame) -> DataFrame:
    """Each page's issues as an ordered list of (seq, id, type, description), as text."""
    own = F.array_sort(F.collect_list(F.struct("seq", "id", "type", "description")))
    return issues.groupBy("doc_id", "page_number").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(own, lambda i: F.concat_ws("~", i["id"], i["type"], i["description"])), "\n").alias("payload"))


def audit_report(issues: DataFrame) -> DataFrame:
    """Numbered report lines of a document."""
    at = Window.partitionBy("doc_id").orderBy("seq")
    n = F.row_number().over(at)
    return issues.select("doc_id", n.alias("line"), F.format_string("%d. [%s] %s (page %d)", n, F.upper("type"), F.col("description"), F.col("page_number")).alias("text"))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; null keys are a key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedup_exact(issues: DataFrame) -> DataFrame:
    return first_by(issues, ["doc_id", "description", "page_number"], [F.col("seq")])


def dedup_context(issues: DataFrame, gap: int = 1) -> DataFrame:
    """Drop an issue within ``gap`` pages of a kept one of the same description and category, in order of seq."""
    own = F.array_sort(F.collect_list(F.struct("seq", "page_number", "id")))
    none = F.expr("cast(array() as array<struct<seq:bigint,page_number:int,id:string>>)")
    kept = F.aggregate(own, none, lambda acc, i: F.when(F.exists(acc, lambda k: F.abs(k["page_number"] - i["page_number"]) <= gap), acc).otherwise(F.concat(acc, F.array(i))))
    each = issues.groupBy("doc_id", "description", "category").agg(kept.alias("kept"))
    return each.select("doc_id", "description", "category", F.explode("kept").alias("k")).select("doc_id", "description", "category", "k.seq", "k.page_number", "k.id")


def severity_rank(c: str = "severity") -> Column:
    return mapped(F.col(c), {"high": 0, "medium": 1, "low": 2}, 3)


def type_rank(c: str = "type") -> Column:
    return mapped(F.col(c), {"critical": 0, "warning": 1, "attention": 2, "info": 3}, 4)


def dedup_keep_severest(issues: DataFrame) -> DataFrame:
    """Of equal page and first 50 characters the severest, at the first one's position."""
    key = Window.partitionBy("doc_id", "page_number", F.substring("description", 1, 50))
    own = issues.withColumns({"_n": F.row_number().over(key.orderBy(severity_rank(), "seq")), "position": F.min("seq").over(key)})
    return own.where("_n = 1").drop("_n")


def dedup_by_text(issues: DataFrame) -> DataFrame:
    return first_by(issues, ["doc_id", "anchor_text"], [F.col("seq")])


def dedup_grid_confidence(detections: DataFrame, grid: int = 10) -> DataFrame:
    """Of equal page, grid cell and class the most confident, the first on ties."""
    cells = detections.withColumns({"cell_x": F.bround(F.col("x") / grid) * grid, "cell_y": F.bround(F.col("y") / grid) * grid})
    return first_by(cells, ["doc_id", "page_number", "cell_x", "cell_y", "error_type"], [F.desc("confidence"), F.col("seq")])


def dedup_grid_first(issues: DataFrame, grid: int = 10) -> DataFrame:
    cells = issues.withColumns({"cell_x": F.bround(F.col("x") / grid) * grid, "cell_y": F.bround(F.col("y") / grid) * grid})
    return first_by(cells, ["doc_id", "page_number", "category", "cell_x", "cell_y"], [F.col("seq")])


def rank_issues(issues: DataFrame) -> DataFrame:
    """Position of each issue in its document by severity, type and order."""
    return issues.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(severity_rank(), type_rank(), "seq")))


def number_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumns({"number": F.row_number().over(w.orderBy(*order)), "of": F.count(F.lit(1)).over(w)})


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a partial minimum, without a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def union_sources(**sources: DataFrame) -> DataFrame:
    """All sources with their name in ``source``; columns that one lacks are null."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def carry_context(findings: DataFrame, keep: bool = False) -> DataFrame:
    """The summary that a document's chunk before left, blank at the start. With ``keep``, a chunk without one leaves the older summary."""
    chunks = Window.partitionBy("doc_id").orderBy("chunk_index")
    before = F.last("context_summary", ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1)) if keep else F.lag("context_summary").over(chunks)
    return findings.withColumn("carried", F.coalesce(before, F.lit("")))


def difference(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(kept.select(*keys), keys, "left_anti")


def keep_mapped(issues: DataFrame, located: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapped, unmapped) by id."""
    ids = located.select("id").distinct()
    return issues.join(ids, "id", "left_semi"), issues.join(ids, "id", "left_anti")
