"""Secret scans with DataFrame functions only.

Base kinds are found by pattern: assignments, access keys, long hex runs. The
randomness battery adds spans: tokens of 20 or more base64-like characters
get an inferred encoding, and under "uniform in that alphabet" a chi-squared
test of the character counts, a runs test about the middle of the alphabet
and a lag-one serial-correlation test. A token that any test rejects is not
random.

For the rest the same three features are held against the opposite
hypothesis, written text: which letters occur, how long the runs of lower
case, upper case, digits and marks are, and how vowels and consonants follow
each other. Under that hypothesis the likelihood ratio of uniform to written
characters is at least x with probability 1/x at most, whatever the length;
this bound, times the number of alphabets, is the p-value. Within each band of
token lengths the Benjamini-Hochberg rule picks the tokens for which written
text is rejected. The bands' p-values meet as histograms, so no task sees a
band's tokens. A number is written as it is drawn: decimal tokens get p-value
one and are found by a base kind only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.staging import staged

#: The patterns of the base kinds.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ["assign", "access", "hex", "random"]
#: Alphabets in the order in which they are tried: name, pattern of a member, characters.
ALPHABETS = [
    ("decimal", "^[0-9]+$", "0123456789"),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base36_upper", "^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
#: Lengths at which bands begin.
BANDS = [20, 24, 32, 40, 48, 64, 96, 128, 256]
#: The written-text model. How often a letter is written, of a thousand, over several European languages.
WRITTEN = {
    "a": 80, "b": 17, "c": 30, "d": 42, "e": 135, "f": 15, "g": 20, "h": 36, "i": 75, "j": 4, "k": 9, "l": 47, "m": 28, "n": 77, "o": 63, "p": 23,
    "q": 4, "r": 68, "s": 70, "t": 72, "u": 42, "v": 13, "w": 12, "x": 3, "y": 9, "z": 6,
}
VOWELS = "aeiou"
#: Chance of a vowel after a consonant, after a vowel and after anything else.
VOWEL_AFTER = [0.52, 0.18, 0.35]
#: Classes: upper case, lower case, digits, marks. Chance of each (columns) after each (rows), and at the beginning (last row).
CLASS_AFTER = [[0.72, 0.18, 0.05, 0.05], [0.05, 0.88, 0.03, 0.04], [0.12, 0.12, 0.70, 0.06], [0.25, 0.45, 0.20, 0.10], [0.25, 0.25, 0.25, 0.25]]
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
#: Histogram cells for one power of ten of a p-value, and powers kept.
CELLS, POWERS = 8, 40


def located(text: Column, pattern: str, keep=None) -> Column:
    """Leftmost non-overlapping matches as structs (s, e, m), in code points; ``keep`` filters by the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
        F.when(keep(x["m"]) if keep else F.lit(True), F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["g"])).alias("s"), (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("e"), x["m"].alias("m"))))).otherwise(acc["out"]).alias("out"),
    )
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("m"))
    return F.when(F.size(found) > 0, F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])).otherwise(none)


def _normal_tail(z: Column) -> Column:
    """Two-sided normal p-value, by a rational approximation of the error function (absolute error under 2e-7)."""
    x = F.abs(z) / F.lit(2**0.5)
    t = 1 / (1 + F.lit(0.3275911) * x)
    poly = reduce(lambda acc, c: acc * t + F.lit(c), [1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592], F.lit(0.0)) * t
    return poly * F.exp(-x * x)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also inside the lambdas of ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _logs(values: list[float]) -> Column:
    return F.array(*[F.lit(math.log10(v)) for v in values])


def _written(core: Column) -> Column:
    """log10 of the chance of these characters under the written-text model, in one pass."""
    vowel = [c in VOWELS for c in WRITTEN]
    total = {v: sum(n for n, own in zip(WRITTEN.values(), vowel, strict=True) if own == v) for v in (True, False)}
    letters = _logs([n / total[v] for n, v in zip(WRITTEN.values(), vowel, strict=True)])
    is_vowel = F.array(*[F.lit(int(v)) for v in vowel])
    kinds = _logs([1 - VOWEL_AFTER[0], VOWEL_AFTER[0], 1 - VOWEL_AFTER[1], VOWEL_AFTER[1], 1 - VOWEL_AFTER[2], VOWEL_AFTER[2]])
    classes = _logs([p for row in CLASS_AFTER for p in row])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(4).alias("cls"), F.lit(2).alias("kind"))

    def step(acc: Column, at: Column) -> Column:
        own = F.when(at <= 26, 0).when(at <= 52, 1).when(at <= 62, 2).otherwise(3)
        letter = F.pmod(at - 1, F.lit(26)) + 1
        of_class = F.get(classes, acc["cls"] * 4 + own)
        kind = F.when(own < 2, F.element_at(is_vowel, letter)).otherwise(2)
        spelt = F.when(own < 2, F.get(kinds, acc["kind"] * 2 + kind) + F.element_at(letters, letter)).when(own == 2, F.lit(-1.0)).otherwise(F.lit(math.log10(0.25)))
        return F.struct((acc["sum"] + of_class + spelt).alias("sum"), own.alias("cls"), kind.alias("kind"))

    places = F.transform(F.split(core, ""), lambda c: F.instr(F.lit(CHARACTERS), c))
    return F.aggregate(places, start, step, lambda acc: acc["sum"])


def battery(token: Column) -> Column:
    """Struct of a token's figures: n, encoding, p_chi, p_runs, p_serial under uniform characters, and log_p, log10 of the written-text p-value."""
    core = F.regexp_replace(token, "=+$", "")
    named = [F.when(core.rlike(p), F.struct(F.lit(name).alias("name"), F.lit(chars).alias("chars"))) for name, p, chars in ALPHABETS]
    rest = F.struct(F.lit("other").alias("name"), F.lit(CHARACTERS).alias("chars"))
    first = F.struct(core.alias("core"), F.coalesce(*named, rest).alias("alphabet"))
    codes = lambda x: F.transform(F.split(x["core"], ""), lambda c: (F.instr(x["alphabet"]["chars"], c) - 1).cast("double"))
    return _let(first, lambda x: _let(codes(x), lambda c: _let(F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c), lambda mean: _tests(x["core"], x["alphabet"]["name"], x["alphabet"]["chars"], c, mean))))


def _tests(core: Column, encoding: Column, letters: Column, codes: Column, mean: Column) -> Column:
    n, k = F.length(core).cast("double"), F.length(letters).cast("double")
    squares = F.aggregate(F.array_distinct(F.split(core, "")), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(core, c, F.lit(""))), F.lit(2.0)))
    chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    half = k / 2
    sides = F.aggregate(  # one pass: characters in the upper half, changes of side, squares and lag-one products about the mean
        codes,
        F.struct(F.lit(0.0).alias("high"), F.lit(0.0).alias("turns"), F.lit(0.0).alias("var"), F.lit(0.0).alias("lag"), F.lit(None).cast("double").alias("last")),
        lambda a, v: F.struct(
            (a["high"] + (v >= half).cast("double")).alias("high"),
            (a["turns"] + F.coalesce(((v >= half) != (a["last"] >= half)).cast("double"), F.lit(0.0))).alias("turns"),
            (a["var"] + (v - mean) * (v - mean)).alias("var"), (a["lag"] + F.coalesce((v - mean) * (a["last"] - mean), F.lit(0.0))).alias("lag"), v.alias("last"),
        ),
    )
    return _let(sides, lambda s: _figures(core, encoding, n, k, chi, s))


def _figures(core: Column, encoding: Column, n: Column, k: Column, chi: Column, s: Column) -> Column:
    both, runs = 2 * s["high"] * (n - s["high"]), 1 + s["turns"]
    z_runs = F.when((both > n) & (n > 1), (runs - 1 - both / n) / F.sqrt(both * (both - n) / (n * n * (n - 1)))).otherwise(F.lit(99.0))
    z_serial = F.when(s["var"] > 0, (s["lag"] / s["var"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
    log_p = F.when(encoding == "decimal", F.lit(0.0)).otherwise(F.least(_written(core) + n * F.log10(k) + math.log10(len(ALPHABETS) + 1), F.lit(0.0)))
    return F.struct(
        n.cast("int").alias("n"), encoding.alias("encoding"), F.when(chi > 0, _normal_tail(chi) / 2).otherwise(F.lit(0.5)).alias("p_chi"), _normal_tail(z_runs).alias("p_runs"), _normal_tail(z_serial).alias("p_serial"), log_p.alias("log_p"),
    )


def _band(n: Column) -> Column:
    return reduce(lambda acc, b: F.when(n >= b, F.lit(b)).otherwise(acc), BANDS, F.lit(0))


def secret_spans(docs: DataFrame, text_col: str = "text", alpha: float = 1e-3, fdr: float = 1e-3, keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` and spans: array of (start, end, kind, encoding), by start and then kind in the order of ``KINDS``.

    Starts and ends count code points, end exclusive. Null and empty texts
    have none; repeated rows each return; an empty table gives none; columns
    not in ``keep`` are not read. ``alpha`` is the level at which a test of the
    battery calls a token not random, ``fdr`` the false-discovery rate within
    a band of lengths. What the driver fetches is one threshold for each band.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    empty = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    rows = docs.select(
        *keep,
        located(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6).alias("_assign"), located(text, ACCESS).alias("_access"), located(text, HEX).alias("_hex"), located(text, TOKEN).alias("_token"),
    )
    bare = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    base = F.concat(F.col("_assign"), F.col("_access"), F.col("_hex"))
    free = F.filter(F.col("_token"), lambda t: ~F.exists(base, lambda b: (t["s"] < b["e"]) & (b["s"] < t["e"])))
    rows = rows.withColumn("_token", F.coalesce(free, empty))
    rows = rows.select(
        *keep, *[bare(F.col(c)).alias(c) for c in ("_assign", "_access", "_hex")],
        F.transform("_token", lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), battery(t["m"]).alias("b"))).alias("_token"),
    )
    rows = staged(rows, "spans")
    limits = _thresholds(rows, fdr)
    passes = lambda b: (b["p_chi"] >= alpha) & (b["p_runs"] >= alpha) & (b["p_serial"] >= alpha)
    under = lambda b: reduce(lambda acc, x: F.when(b["n"] >= x[0], b["log_p"] <= x[1]).otherwise(acc), sorted(limits.items()), F.lit(False))
    chosen = F.filter("_token", lambda t: passes(t["b"]) & under(t["b"]))
    rank = lambda c, kind: F.transform(c, lambda x: F.struct(x["s"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), x["e"].alias("end"), F.lit(kind).alias("kind"), (x["b"]["encoding"] if kind == "random" else F.lit(None).cast("string")).alias("encoding")))
    spans = F.array_sort(F.concat(rank(F.col("_assign"), "assign"), rank(F.col("_access"), "access"), rank(F.col("_hex"), "hex"), rank(chosen, "random")))
    return rows.select(*keep, F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["encoding"].alias("encoding"))).alias("spans"))


def _thresholds(rows: DataFrame, fdr: float) -> dict[int, float]:
    """For each band the largest log10 p-value that the Benjamini-Hochberg rule rejects, from a histogram of at most bands x cells rows."""
    each = rows.select(F.explode("_token.b").alias("b")).select(_band(F.col("b.n")).alias("band"), F.greatest(F.ceil(F.col("b.log_p") * CELLS), F.lit(-CELLS * POWERS)).cast("int").alias("cell"))
    out: dict[int, float] = {}
    seen: dict[int, int] = {}
    counts = {b: [] for b in BANDS}
    for r in each.groupBy("band", "cell").count().collect():
        counts.setdefault(r["band"], []).append((r["cell"], r["count"]))
    for band, cells in counts.items():
        total = sum(n for _, n in cells)
        out[band] = float("-inf")
        for cell, n in sorted(cells):
            seen[band] = seen.get(band, 0) + n
            if total * 10 ** (cell / CELLS) <= fdr * seen[band]:
                out[band] = cell / CELLS
    return out


def redact(rows: DataFrame, text_col: str = "text", spans_col: str = "spans", mark: str = "[SECRET]") -> DataFrame:
    """Replace each span of the text by ``mark``; spans that overlap or touch become one. Null texts stay null."""
    merged = F.aggregate(
        F.col(spans_col),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when((x["start"] < acc["at"]) | ((x["start"] == acc["at"]) & (acc["at"] > 0)), acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(F.col(text_col)))),
    )
    return rows.withColumn(text_col, F.when(F.size(spans_col) > 0, merged).otherwise(F.col(text_col)))
