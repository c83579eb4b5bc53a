"""Rules over lines, accounts and payments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.sources.shared import written


def short_lines(lines: DataFrame, words: list[str], limit: int, others: list[str] | None = None) -> DataFrame:
    """Trimmed lines under ``limit`` characters that hold any of ``words`` (and any of ``others``)."""
    low = F.lower("line")
    any_of = lambda ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(low, w))
    ok = any_of(words) & (F.length(F.trim("line")) < limit)
    return lines.where(ok & any_of(others) if others else ok)


def balance_lines(lines: DataFrame, word: str = "balance") -> DataFrame:
    return lines.where(F.contains(F.lower("line"), F.lit(word)) & F.col("line").rlike("\\d"))


def payment_gap(lines: DataFrame, header: Column, gap: Column, ahead: int = 9) -> DataFrame:
    """After a header line, the first of the next ``ahead`` lines that looks like a data row and has a gap."""
    trimmed = F.trim("line")
    data = (F.length(trimmed) > 5) & (F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "))) > 3)
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, ahead)
    hit = F.min(F.when(data & gap, F.col("line_no"))).over(w)
    return lines.withColumn("gap_line", hit).where(header & F.col("gap_line").isNotNull())


def parse_payment_rows(lines: DataFrame, pattern: str) -> DataFrame:
    """Four groups of a row pattern: name, date, amount, status."""
    part = lambda i: F.regexp_extract("line", pattern, i)
    return lines.where(F.col("line").rlike(pattern)).withColumns({"name": F.trim(part(1)), "date": part(2), "amount": part(3), "status": part(4)})


def late_markers(payments: DataFrame, codes: list[str], col: str = "status") -> DataFrame:
    return payments.where(F.col(col).isin(codes))


def missing_months(payments: DataFrame) -> DataFrame:
    """Months between an account's first and last payment without one."""
    month = F.trunc("date", "month")
    seen = payments.select("account_id", month.alias("month")).distinct()
    span = seen.groupBy("account_id").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    every = span.select("account_id", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return every.join(seen.hint("merge"), ["account_id", "month"], "left_anti")


def utilization_issues(accounts: DataFrame) -> DataFrame:
    """Classes of utilisation: over_limit (> 1), maxed_out (>= 0.9), high (> 0.3)."""
    u = F.col("utilization")
    return accounts.withColumn("issue", F.when(u > 1, "over_limit").when(u >= 0.9, "maxed_out").when(u > 0.3, "high")).where("issue is not null")


def missing_values(df: DataFrame, key: str, columns: list[str], marks: list[str]) -> DataFrame:
    """(key, field) of values that are null, blank or one of ``marks``."""
    long = df.select(key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(key, columns, "field", "value")
    return long.where(F.col("value").isNull() | F.trim("value").isin("", *marks)).select(key, "field")


def stale_items(items: DataFrame, as_of: str, years: int = 7, closed_years: int = 10, inquiry_years: int = 2) -> DataFrame:
    """One row per item and reason: negative and opened, closed, or inquired too long before ``as_of``. Needs opened, negative, closed_on, inquired_on."""
    before = lambda c, n: F.col(c) < F.add_months(F.to_date(F.lit(as_of)), -12 * n)
    reasons = F.array_compact(F.array(F.when(F.col("negative") & before("opened", years), F.lit("old_negative")), F.when(before("closed_on", closed_years), F.lit("old_closed")), F.when(before("inquired_on", inquiry_years), F.lit("old_inquiry"))))
    return items.withColumn("reason", F.explode(reasons))


def collection_entries(accounts: DataFrame, codes: list[str]) -> DataFrame:
    """Accounts with any of the status ``codes``."""
    return accounts.where(F.arrays_overlap("statuses", F.array(*[F.lit(c) for c in codes])))


def status_changes(status: DataFrame) -> DataFrame:
    """Rows whose status differs from the source's row before, and each source's first."""
    own = status.withColumn("before", F.lag("status").over(Window.partitionBy("source").orderBy("ts", "event_id")))
    return own.where("before is null or before <> status")


def unapproved(calls: DataFrame, allowed: DataFrame, key: str = "model") -> DataFrame:
    """Calls of models that the list of allowed ones lacks."""
    return calls.join(allowed.select(key).hint("merge"), key, "left_anti")


def duplicate_entities(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur more than once, by a join with the counted keys."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return df.join(many, keys)


def repeated_inquiries(inquiries: DataFrame, keys: list[str], least: int) -> DataFrame:
    return inquiries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def check_extraction(docs: DataFrame, schema: str, count_col: str, list_col: str) -> DataFrame:
    """Violations of a JSON document: broken JSON, or a stated count that is not its list's size. Needs id and json."""
    own = docs.select("id", F.from_json("json", schema).alias("p"))
    broken = F.when(F.col("p").isNull() | F.col(f"p.{list_col}").isNull(), F.lit("missing_list"))
    wrong = F.when(F.col(f"p.{count_col}") != F.size(f"p.{list_col}"), F.lit("count_mismatch"))
    return own.select("id", F.explode(F.array_compact(F.array(broken, wrong))).alias("violation"))


@dataclass(frozen=True)
class ExtractionSpec:
    """What an extracted document has to look like: its keys, the shape of its accounts, and what must agree."""

    #: The names and sizes of the extraction format.
    keys: tuple[str, ...] = ("reportConfirmationDetails", "personalInformation", "summary", "creditAccountsSummary", "otherItemsSummary", "accounts", "collections", "inquiries")
    histories: tuple[str, ...] = ("balanceHistory", "scheduledPaymentHistory", "actualPaymentHistory", "creditLimitHistory", "amountPastDueHistory", "activityDesignatorHistory")
    months: tuple[str, ...] = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
    years: int = 3
    codes: int = 36
    order: tuple[str, ...] = ("Revolving", "Mortgage", "Installment", "Other", "Total")
    #: (holder, list, count): the count a holder states for one of its lists.
    counts: tuple[tuple[str, str, str], ...] = (("otherItemsSummary", "inquiries", "inquiryCount"), ("otherItemsSummary", "publicRecords", "publicRecordCount"), ("collections", "collections", "collectionCount"))
    #: At most four digits of an identifier may be seen.
    masked: str = "^[^0-9]*[0-9]{0,4}$"


def check_conformance(docs: DataFrame, spec: ExtractionSpec = ExtractionSpec()) -> DataFrame:
    """(id, violation, path): one row for each way in which a document's JSON is not as ``spec`` says. Needs id and json.

    Violations: invalid_json, missing_key, extra_key, wrong_order (of account types), count_mismatch, history_shape
    (not ``years`` rows of a year and twelve months), code_count and unmasked_id. Values are read as maps of raw JSON, so that unknown keys are seen.
    """
    listed = lambda values: F.array(*[F.lit(v) for v in values])
    say = lambda kind, path: F.struct(F.lit(kind).alias("violation"), path.alias("path"))
    raw, rows = "map<string,string>", "array<map<string,string>>"
    # what several branches or rules read is parsed once: written, or held as the row of an array of one
    own = written(docs.select("id", F.from_json("json", raw).alias("top")), "parsed")
    fine = own.where(F.col("top").isNotNull())
    keys = F.map_keys("top")
    lost = F.transform(F.array_except(listed(spec.keys), keys), lambda k: say("missing_key", F.concat(F.lit("$."), k)))
    more = F.transform(F.array_except(keys, listed(spec.keys)), lambda k: say("extra_key", F.concat(F.lit("$."), k)))
    kinds = F.transform(F.from_json(F.col("top")["creditAccountsSummary"], rows), lambda x: x["accountType"])
    single = [F.when(F.coalesce(kinds != listed(spec.order), F.array_contains(keys, "creditAccountsSummary")), say("wrong_order", F.lit("$.creditAccountsSummary")))]
    for holder, items, count in spec.counts:
        held = F.from_json(F.col("top")[holder], raw)
        size = F.coalesce(F.size(F.from_json(held[items], "array<string>")), F.lit(0))
        single.append(F.when(held.isNotNull() & ~held[count].try_cast("int").eqNullSafe(size), say("count_mismatch", F.lit(f"$.{holder}.{count}"))))
    ssn = F.from_json(F.col("top")["personalInformation"], raw)["socialSecurityNumber"]
    single.append(F.when(~ssn.rlike(spec.masked), say("unmasked_id", F.lit("$.personalInformation.socialSecurityNumber"))))
    whole = fine.select("id", F.explode(F.concat(lost, more, F.array_compact(F.array(*single)))).alias("v"))
    each = fine.select("id", F.posexplode(F.from_json(F.col("top")["accounts"], rows)).alias("at", "account"))
    place = lambda key: F.concat(F.lit("$.accounts["), F.col("at").cast("string"), F.lit(f"].{key}"))
    inner = [F.when(~F.coalesce(F.col("account")["accountNumber"], F.lit("")).rlike(spec.masked), say("unmasked_id", place("accountNumber")))]
    inner.append(F.when(F.coalesce(F.size(F.from_json(F.col("account")["paymentHistory"], "array<string>")), F.lit(-1)) != spec.codes, say("code_count", place("paymentHistory"))))
    each = each.select("id", "at", "account", F.explode(F.array(F.struct(*[F.from_json(F.col("account")[name], rows).alias(name) for name in spec.histories]))).alias("held"))
    row_keys = listed(sorted(("year", *spec.months)))
    for name in spec.histories:
        years = F.col("held")[name]
        good = (F.size(years) == spec.years) & F.forall(years, lambda y: F.array_sort(F.map_keys(y)) == row_keys)
        inner.append(F.when(~F.coalesce(good, F.lit(False)), say("history_shape", place(name))))
    accounts = each.select("id", F.explode(F.array_compact(F.array(*inner))).alias("v"))
    broken = own.where(F.col("top").isNull()).select("id", say("invalid_json", F.lit("$")).alias("v"))
    return broken.union(whole).union(accounts).select("id", "v.violation", "v.path")
