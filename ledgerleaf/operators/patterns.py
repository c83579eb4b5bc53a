"""Detection by a table of patterns over lines: one scan of the text serves all classes and passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.operators.issues import SEVERITY_SCORE, mapped

#: Classes of findings and their patterns, without regard to case.
PATTERNS = {
    "collection": [r"\bCOLLECTION\b", r"Collection Agency", r"PORTFOLIO RECOVERY", r"CAVALRY PORTFOLIO", r"Debt Buyer"],
    "charge_off": [r"CHARGE[\s\-_]?OFF", r"Charged Off", r"Written Off"],
    "late_payment": [r"\b(30|60|90|120|150|180)\s*Days?\s*Past\s*Due", r"\b(30|60|90|120|150|180)\s*Days?\s*Late", r"PAST[\s\-_]?DUE"],
    "truncated_account": [r"[X\*]{4,}[\s\-]?\d{4}", r"\.{3,}\d{4}"],
    "high_utilization": [r"(8[0-9]|9[0-9]|100)%?\s*Utilization", r"Over[\s\-]?Limit", r"Maxed[\s\-]?Out"],
    "derogatory": ["DEROGATORY", "DELINQUENT", "DEFAULT", "REPOSSESSION", "FORECLOSURE", "BANKRUPTCY"],
}
CONFIDENCE = 0.95
#: Notations of a dispute.
DISPUTES = ["consumer disputes this account", "disputed", "under investigation", "dispute"]


def rules_of(table: DataFrame, analysis: str | None = None, most: int = 1000) -> dict[str, list[str]]:
    """The rules of one analysis, or of all, as classes with their patterns, from a table with columns analysis, error_type and pattern.

    Classes and their patterns are in alphabetical order; equal rules count once, rows with a null class or pattern not at all.
    Rules become one expression, so there may be at most ``most`` of them: a larger table raises ValueError, as does an
    analysis without rules.
    """
    own = table.where("error_type is not null and pattern is not null")
    own = own if analysis is None else own.where(F.col("analysis") == analysis)
    found = own.select("error_type", "pattern").distinct().limit(most + 1).collect()
    if not found or len(found) > most:
        raise ValueError(f"analysis {analysis!r} has {'no rules' if not found else f'more than {most} rules'}")
    out: dict[str, list[str]] = {}
    for name, pattern in sorted(map(tuple, found)):
        out.setdefault(name, []).append(pattern)
    return out


def detect_patterns(lines: DataFrame, rules: dict[str, list[str]] | DataFrame = PATTERNS, confidence: float = CONFIDENCE, analysis: str | None = None) -> DataFrame:
    """One row per hit of each pattern of each class in a line: class, pass number, pattern number, hit number and text.

    ``rules`` may be a table, of which ``analysis`` names the part to apply (``rules_of``). Lines that no pattern meets go
    before the patterns are applied one by one.
    """
    rules = rules_of(rules, analysis) if isinstance(rules, DataFrame) else rules
    every = "(?i)" + "|".join(f"(?:{p})" for patterns in rules.values() for p in patterns)
    known = [F.struct(F.lit(n).alias("pass_no"), F.lit(name).alias("error_type"), F.lit(k).alias("pattern_no"), F.lit(f"(?i){p}").alias("pattern")) for n, (name, patterns) in enumerate(rules.items(), 1) for k, p in enumerate(patterns)]
    each = lines.where(F.col("line").rlike(every)).select("doc_id", "line_no", "line", F.explode(F.array(*known)).alias("r"))
    hits = each.select("doc_id", "line_no", "r.pass_no", "r.error_type", "r.pattern_no", F.posexplode(F.regexp_extract_all("line", F.col("r.pattern"), F.lit(0))).alias("hit_no", "hit"))
    severity = mapped(F.col("error_type"), SEVERITY_SCORE, 3)
    return hits.select("*", F.concat(F.lit("Pattern match: "), "hit").alias("description"), F.lit(confidence).alias("confidence"), F.lit("pattern").alias("method"), severity.alias("severity"))


def pass_counts(hits: DataFrame) -> DataFrame:
    """Hits and documents of each class with the number of its pass."""
    return hits.groupBy("pass_no", "error_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def severe(hits: DataFrame, least: int = 4) -> DataFrame:
    """The list of findings of severity ``least`` and above."""
    return hits.where(F.col("severity") >= least)


def dispute_notations(lines: DataFrame, words: list[str] = DISPUTES) -> DataFrame:
    """Lines that hold a notation, with the first of ``words`` that they hold."""
    low = F.lower("line")
    first = F.coalesce(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in words])
    return lines.withColumn("notation", first).where("notation is not null")


def truncated_ids(lines: DataFrame) -> DataFrame:
    """Lines with a masked or cut identifier."""
    return lines.where(F.col("line").rlike(r"[X*]{3,}[ -]?[A-Za-z0-9]*|[.]{3,}[0-9]{4}"))
