"""Operators on hand-made rows that the driver's tables do not hold."""

import math
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions import text as t
from ledgerleaf.functions import vectors as vec
from ledgerleaf.operators import chunking, corpus, detect, issues, locate, patterns
from ledgerleaf.sources import views


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_masking(spark):
    for given, want in [(None, ""), ("  ", ""), ("abcd", "****"), ("abcdefgh", "********"), ("abcdefghi", "abcd****fghi"), ("sk-1234567890abcdef", "sk-1***********cdef")]:
        assert one(spark, t.mask_secret(F.lit(given).cast("string"))) == want


def test_fence_and_anchor(spark):
    assert one(spark, t.strip_fence(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, t.normalize_anchor(F.lit("  Acct #: 12-34, Été! "))) == "acct 12 34 été"


def test_cosine_of_unequal_lengths_is_zero(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0))
    assert one(spark, vec.cosine(a, b)) == 0 and one(spark, vec.cosine(a, a)) == 1


def test_parse_findings_falls_back(spark):
    raw = spark.createDataFrame([(1, '{"totalIssues": 3, "confidence": 0, "summary": "s", "issues": [{"type": "critical"}]}'), (2, "not json"), (3, None)], "k int, response_raw string")
    got = {r.k: (r.parsed_ok, r.total_issues, r.summary, r.confidence, r.n_issues) for r in issues.parse_findings(raw).collect()}
    assert got == {1: (True, 3, "s", 0.0, 1), 2: (False, 0, "Analysis completed - no issues identified", 0.5, 0), 3: (False, 0, "Analysis completed - no issues identified", 0.5, 0)}


def test_zero_confidence_counts_as_missing(spark):
    rows = spark.createDataFrame([(0.0,), (None,), (1.5,), (-1.0,), (0.4,)], "confidence double")
    assert [r.confidence for r in issues.clamp_confidence(rows).collect()] == [0.7, 0.7, 1.0, 0.0, 0.4]


def test_context_dedup_compares_with_kept_rows_only(spark):
    rows = spark.createDataFrame([(1, "d", "c", s, p, str(s)) for s, p in [(1, 1), (2, 2), (3, 3), (4, 9)]], "doc_id int, description string, category string, seq long, page_number int, id string")
    assert sorted(r.id for r in issues.dedup_context(rows).collect()) == ["1", "3", "4"]


def test_equal_severity_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, 1, "same", "low", 1), (1, 1, "same", "high", 2), (1, 1, "same", "high", 3)], "doc_id int, page_number int, description string, severity string, seq long")
    assert [(r.seq, r.position) for r in issues.dedup_keep_severest(rows).collect()] == [(2, 1)]


def test_oversized_page_is_a_chunk_of_its_own(spark):
    pages = spark.createDataFrame([(1, p, "x" * 4 * n, False) for p, n in enumerate([5, 50, 3, 4], 1)], "doc_id int, page_number int, text string, has_image boolean")
    got = sorted((r.chunk_index, r.page_start, r.page_end) for r in chunking.chunk_ranges(chunking.pack_pages(pages, 10)).collect())
    assert got == [(0, 1, 1), (1, 2, 2), (2, 3, 4)]


@pytest.mark.parametrize("size", [40, 100])
def test_adaptive_chunks_concatenate_to_the_text(spark, size):
    text = "One two. Three\nfour five.\n\nSix seven eight. Nine ten\n" * 9
    rows = chunking.chunk_adaptive(spark.createDataFrame([(1, text)], "doc_id int, text string"), size).orderBy("chunk_index").collect()
    assert "".join(r.text for r in rows) == text and all(r.end > r.start for r in rows)


def test_touching_boxes_do_not_meet(spark):
    a = spark.createDataFrame([("i", 1, 1, 0.0, 0.0, 10.0, 10.0)], "id string, doc_id int, page_number int, x double, y double, width double, height double")
    b = spark.createDataFrame([(1, 1, 10.0, 0.0, 5.0, 5.0), (1, 1, 9.0, 9.0, 5.0, 500.0)], "doc_id int, page_number int, x double, y double, width double, height double")
    assert locate.token_hits(a, b).first().token_count == 1


def test_phrase_of_two_tokens(spark):
    tokens = spark.createDataFrame([(1, 0, i, s, 50.0 + 60 * i, 50.0, 50.0, 15.0) for i, s in enumerate(["Account", "Number:", "x", "account", "number"])], "doc_id int, line_no int, token_idx int, str string, x double, y double, width double, height double")
    hits = locate.match_phrase(spark.createDataFrame([("i", 1, "ACCOUNT number")], "id string, doc_id int, anchor_text string"), tokens)
    assert sorted((r.token_idx, r.x, r.width) for r in hits.collect()) == [(0, 50.0, 110.0), (3, 230.0, 110.0)]


@pytest.mark.parametrize("k", [2, 5, 20])
def test_phrase_of_many_words(spark, k):
    """A phrase of k words is found wherever it stands whole, also twice in a line and overlapping itself, and not where a word is missing."""
    strings = [f"Word{i}," for i in range(k)]
    rows = [(1, 0, i, s) for i, s in enumerate([*strings, *strings, "x", *strings[:-1]])] + [(2, 0, i, s) for i, s in enumerate(strings)] + [(1, 1, i, "a") for i in range(k + 1)]
    tokens = spark.createDataFrame([(d, n, i, s, 10.0 * i, 15.0 * n, 8.0, 15.0) for d, n, i, s in rows], "doc_id int, line_no int, token_idx int, str string, x double, y double, width double, height double")
    issues_ = spark.createDataFrame([("i", 1, " ".join(f"word{i}" for i in range(k))), ("a", 1, " ".join("a" * k))], "id string, doc_id int, anchor_text string")
    hits = sorted((r.id, r.line_no, r.token_idx, r.x, r.width) for r in locate.match_phrase(issues_, tokens).collect())
    wide = 10.0 * (k - 1) + 8
    assert hits == [("a", 1, 0, 0.0, wide), ("a", 1, 1, 10.0, wide), ("i", 0, 0, 0.0, wide), ("i", 0, k, 10.0 * k, wide)]


def test_hierarchy_in_page_order(spark):
    pages = spark.createDataFrame([(1, 1, "zeta"), (1, 2, "alpha")], "doc_id int, page_number int, text string")
    got = chunking.hierarchical_chunks(document=spark.createDataFrame([(1, "whole")], "doc_id int, text string"), page=pages)
    assert [r.text for r in got.orderBy("chunk_index").collect()] == ["whole", "zeta", "alpha"]


def test_regions_and_payment_gap(spark):
    pages = spark.createDataFrame([(1, 1, "Your FICO score and account balance")], "doc_id int, page_number int, text string")
    assert sorted(r.type for r in corpus.semantic_regions(pages, corpus.REGIONS).collect()) == ["account_section", "score_section"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["Payment history", "Jan Feb Mar Apr May", "100 200 --- 300 400 500", "end"])], "doc_id int, line_no int, line string")
    low = F.lower("line")
    got = detect.payment_gap(lines, low.contains("payment") & low.contains("history"), F.col("line").contains("---"))
    assert [(r.line_no, r.gap_line) for r in got.collect()] == [(0, 2)]


def test_strict_metadata_raises(spark):
    own = spark.createDataFrame([(1, 1, 1.0, 1.0, 1.0, 1.0)], "doc_id int, page_number int, x double, y double, width double, height double")
    meta = spark.createDataFrame([(2, 1, 300)], "doc_id int, page_number int, dpi int")
    assert issues.pixels_to_points(own, meta).count() == 0
    with pytest.raises(Exception, match="without metadata"):
        issues.pixels_to_points(own, meta, strict=True).collect()


def test_every_pattern_class_is_found_without_regard_to_case(spark):
    texts = ["sent to collection today", "Debt Buyer", "charge-off", "written off", "60 days past due", "120 Day Late", "XXXX-1234", "...9876", "95% utilization", "over limit", "Bankruptcy", "recollections of a charger", None, ""]
    lines = spark.createDataFrame([(1, n, s) for n, s in enumerate(texts)], "doc_id long, line_no int, line string")
    found = patterns.detect_patterns(lines).collect()
    assert {(r.line_no, r.error_type) for r in found} == {
        (0, "collection"), (1, "collection"), (2, "charge_off"), (3, "charge_off"), (4, "late_payment"), (5, "late_payment"), (6, "truncated_account"), (7, "truncated_account"), (8, "high_utilization"), (9, "high_utilization"), (10, "derogatory"),
    }
    assert [r.hit for r in found if r.line_no == 4] == ["60 days past due", "past due"]
    assert sum(len(p) for p in patterns.PATTERNS.values()) == 22 and all(r.confidence == 0.95 for r in found)
    assert {r.error_type for r in patterns.severe(patterns.detect_patterns(lines)).collect()} == {"collection", "charge_off", "truncated_account", "derogatory"}


def test_offsets_of_a_long_line_are_the_lengths_before(spark):
    words = [("ab" * (i % 4)) for i in range(1000)]
    lines = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None), (4, " a  b "), (5, " ".join(words[:32])), (6, " ".join(words[:32]) + " ")], "n int, line string")
    got = views.placed_words(lines).collect()
    for n, line in [(1, words), (4, ["", "a", "", "b", ""]), (5, words[:32]), (6, [*words[:32], ""])]:
        at = 0
        own = sorted((r.token_idx, r.p, r.str) for r in got if r.n == n)
        for i, word in enumerate(line):
            if i < len(own):
                assert own[i] == (i, at, word)
            at += len(word) + 1
        # a line that ends behind a full piece has no empty last word
        assert len(own) == len(line) - (n == 6)
    assert not [r for r in got if r.n in (2, 3)]


def test_first_holding_takes_the_first_place_of_repeated_texts(spark):
    wants = spark.createDataFrame([(1, 7, "bc"), (2, 7, "BC"), (3, 7, "zz"), (4, 8, "bc"), (5, 7, None)], "id int, doc_id int, want string")
    found = spark.createDataFrame([(7, "abcd", 3), (7, "ABCD", 2), (7, "abcd", 1), (8, "x", 0)], "doc_id int, s string, n int")
    assert sorted(tuple(r) for r in locate.first_holding(wants, found, "s", ["n"]).collect()) == [(1, 1), (2, 2)]
    assert sorted(tuple(r) for r in locate.first_holding(wants, found, "s", ["n"], blind=True).collect()) == [(1, 1), (2, 1)]


def test_page_without_metadata(spark):
    boxes = spark.createDataFrame([(1, 1, 300.0), (1, 2, 300.0)], "doc_id int, page_number int, x double").selectExpr("*", "x as y", "x as width", "x as height")
    meta = spark.createDataFrame([(1, 1, 150)], "doc_id int, page_number int, dpi int")
    assert [(r.page_number, r.x) for r in issues.pixels_to_points(boxes, meta).collect()] == [(1, 144.0)]
    with pytest.raises(Exception, match="page without metadata"):
        issues.pixels_to_points(boxes, meta, strict=True).collect()


def test_carried_context_of_failed_parses(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "c"), (1, 3, None)], "doc_id int, chunk_index int, context_summary string")
    told = lambda keep: [r.carried for r in issues.carry_context(rows, keep).orderBy("chunk_index").collect()]
    assert told(False) == ["", "a", "", "c"] and told(True) == ["", "a", "a", "c"]


def test_stale_items_by_reason(spark):
    items = spark.sql("select 1 as id, date'2010-01-01' as opened, true as negative, date'2012-01-01' as closed_on, date'2020-01-01' as inquired_on union all select 2, date'2010-01-01', false, null, null")
    assert [(r.id, r.reason) for r in detect.stale_items(items, "2021-06-01").collect()] == [(1, "old_negative")]
    assert {r.reason for r in detect.stale_items(items, "2023-06-01").collect()} == {"old_negative", "old_closed", "old_inquiry"}


@pytest.mark.parametrize("q", [1, 3, 6])
def test_first_holding_is_a_search_of_every_text(spark, q):
    import random

    rng = random.Random(q)
    word = lambda: "".join(rng.choice("aAbB") for _ in range(rng.randrange(0, 12)))
    found = [(rng.randrange(3), word(), n, rng.randrange(1, 4)) for n in range(150)]
    wants = [(i, rng.randrange(4), word()[: rng.randrange(8)], rng.choice([None, 1, 2, 9])) for i in range(120)]
    texts = spark.createDataFrame(found, "doc_id int, s string, n int, page_number int")
    own = spark.createDataFrame(wants, "id int, doc_id int, want string, page_number int")
    for blind in (False, True):
        low = str.lower if blind else str
        for hinted in (False, True):
            got = locate.first_holding(own if hinted else own.drop("page_number"), texts, "s", ["n"], blind, q)
            want = {}
            for i, d, w, page in wants:
                own_rows = [n for e, s, n, p in found if d == e and low(w) in low(s) and (not hinted or page in (None, p))]
                if own_rows:
                    want[i] = min(own_rows)
            assert {r.id: r.n for r in got.collect()} == want


def test_lines_of_a_dense_page(spark):
    """A page of 6,000 tokens on 3,000 lines, and random heights, against the plain fold over all lines."""
    import random

    rng = random.Random(1)
    page = [(1, 1, i, 20.0 * (i // 2)) for i in range(6000)]
    loose = [(2, 1, i, rng.random() * 300) for i in range(400)]
    got = {(r.doc_id, r.token_id): r.line for r in locate.group_lines(spark.createDataFrame(page + loose, "doc_id int, page_number int, token_id long, y double")).collect()}
    assert all(got[1, i] == i // 2 for i in range(6000))
    lines = []
    for y, i in sorted((y, i) for _, _, i, y in loose):
        at = next((k for k, (total, n) in enumerate(lines) if abs(total / n - y) <= 5), len(lines))
        lines[at:] = [(lines[at][0] + y, lines[at][1] + 1), *lines[at + 1 :]] if at < len(lines) else [(y, 1)]
        assert got[2, i] == at


def test_hyperplane_index_finds_pairs_above_the_threshold(spark):
    """Of pairs at a cosine of about the threshold, 0.95 at least are found; every row found is right; the exact way finds all."""
    import numpy as np

    from ledgerleaf.operators import embed

    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        x = rng.normal(size=32)
        y = rng.normal(size=32)
        y -= x * (x @ y) / (x @ x)
        c = rng.uniform(0.8, 0.9)
        near = c * x / np.linalg.norm(x) + np.sqrt(1 - c * c) * y / np.linalg.norm(y)
        rows += [(2 * i, i % 2, x.tolist()), (2 * i + 1, i % 2, near.tolist())]
    rows += [(900, 0, None), (901, 0, []), (902, 0, [0.0] * 32), (903, 0, [float("nan")] * 32), (904, 0, [1.0, 2.0]), (905, 0, [1.0, 2.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id int, embedding array<double>")
    exact = {(r.a, r.b) for r in embed.similar_pairs(chunks.where("chunk_id < 900 or chunk_id > 903"), 0.8, exact=True).collect()}
    found = [(r.a, r.b) for r in embed.similar_pairs(chunks, 0.8, recall=0.999).collect()]
    assert len(found) == len(set(found)) and set(found) <= exact and (904, 905) in exact and len(exact) >= 140
    assert len(found) >= 0.95 * len(exact)
    bits, tables = embed.lsh_plan(0.8, 0.999, 1e6)
    agree = (1 - np.arccos(0.8) / np.pi) ** bits
    assert 1 - (1 - agree) ** tables >= 0.999 and tables / 2**bits < 0.05


def test_conformance_of_broken_and_odd_documents(spark):
    from ledgerleaf.operators import detect

    rows = [(1, None), (2, "{"), (3, "[]"), (4, "{}"), (5, '{"collections": {"collections": ["a"], "collectionCount": "one"}, "accounts": [{}]}')]
    got = {}
    for r in detect.check_conformance(spark.createDataFrame(rows, "id int, json string")).collect():
        got.setdefault(r.id, set()).add((r.violation, r.path))
    assert got[1] == got[2] == {("invalid_json", "$")}
    assert got[4] == {("missing_key", f"$.{k}") for k in detect.ExtractionSpec().keys}
    assert ("count_mismatch", "$.collections.collectionCount") in got[5] and ("code_count", "$.accounts[0].paymentHistory") in got[5]
    assert sum(v == "history_shape" for v, _ in got[5]) == 6 and ("unmasked_id", "$.accounts[0].accountNumber") not in got[5]


def test_an_artifact_is_read_from_one_folder(spark, tmp_path):
    from ledgerleaf.operators import compose

    rows = spark.createDataFrame([(i, f"t{i}") for i in range(300)], "document_id long, t string")
    compose.write_artifacts({"x": rows}, f"file://{tmp_path}", buckets=8)
    assert len([p for p in (tmp_path / "x").iterdir() if p.name.startswith("bucket=")]) == 8
    own = compose.read_artifact(spark, f"file://{tmp_path}", "x", "document_id", 7, buckets=8)
    assert [tuple(r) for r in own.collect()] == [(7, "t7")] and len(own.inputFiles()) >= 1
    assert compose.read_artifact(spark, f"file://{tmp_path}", "x").count() == 300


#: For each pattern of the library, in its order, a text that it meets and one that it must not meet by itself.
MET = {
    "collection": [("sent to collection.", "recollections"), ("a collection agency", "agency of collection"), ("Portfolio recovery", "portfolio for recovery"), ("CAVALRY PORTFOLIO", "cavalry"), ("debt buyer", "buyer of debt")],
    "charge_off": [("charge-off", "charge it off"), ("charged off", "charged, off"), ("WRITTEN OFF", "written of")],
    "late_payment": [("90 days past due", "91 days past due"), ("180 Day late", "18 days late"), ("past_due", "past its due")],
    "truncated_account": [("XXXX-1234", "XXX-1234"), ("...5678", "..5678")],
    "high_utilization": [("95% utilization", "75% utilization"), ("over-limit", "over the limit"), ("maxed out", "maxed it out")],
    "derogatory": [("Derogatory", "derogate"), ("delinquent", "delinquency"), ("default", "defaul"), ("repossession", "possession"), ("foreclosure", "closure"), ("bankruptcy", "bankrupt")],
}


def test_each_pattern_of_the_library(spark):
    from ledgerleaf.operators import patterns

    assert {k: len(v) for k, v in MET.items()} == {k: len(v) for k, v in patterns.PATTERNS.items()}
    told = [(name, k, yes, no) for name, pairs in MET.items() for k, (yes, no) in enumerate(pairs)]
    lines = spark.createDataFrame([(i * 2 + j, 0, t) for i, (_, _, *both) in enumerate(told) for j, t in enumerate(both)], "doc_id long, line_no int, line string")
    found = {(r.doc_id, r.error_type, r.pattern_no) for r in patterns.detect_patterns(lines).collect()}
    for i, (name, k, yes, no) in enumerate(told):
        assert (2 * i, name, k) in found, yes
        assert (2 * i + 1, name, k) not in found, no


def test_rules_of_a_table(spark):
    from ledgerleaf.operators import patterns

    table = spark.createDataFrame([("a", "late", "late"), ("a", "late", "late"), ("a", "paid", "paid|settled"), ("a", None, "x"), ("a", "none", None), ("b", "any", "\\w+")], "analysis string, error_type string, pattern string")
    assert patterns.rules_of(table, "a") == {"late": ["late"], "paid": ["paid|settled"]}
    assert set(patterns.rules_of(table)) == {"late", "paid", "any"}
    lines = spark.createDataFrame([(1, 0, "Settled late, late"), (2, 0, ""), (3, 0, None)], "doc_id long, line_no int, line string")
    got = sorted((r.doc_id, r.error_type, r.hit_no, r.hit) for r in patterns.detect_patterns(lines, table, analysis="a").collect())
    assert got == [(1, "late", 0, "late"), (1, "late", 1, "late"), (1, "paid", 0, "Settled")]
    for wrong in (lambda: patterns.rules_of(table, "c"), lambda: patterns.rules_of(table, most=2)):
        with pytest.raises(ValueError, match="rules"):
            wrong()


def test_partial_overrides():
    from ledgerleaf.operators import config

    base = config.AuditConfig()
    own = config.override(base, {"chunk": {"size": 10}, "findings": config.FindingsConfig(top=3)})
    assert (own.chunk.size, own.chunk.method, own.findings.top, own.pool) == (10, "natural", 3, base.pool) and base == config.AuditConfig()
    assert config.override(base, {}) == base
    with pytest.raises(TypeError, match="has no sizes"):
        config.override(base, {"chunk": {"sizes": 1}})
    with pytest.raises(AttributeError):
        own.chunk.size = 5


def test_audit_of_lines_by_configuration(spark):
    """Repeats within the gap go, a run of repeats keeps its first, the severest come first, top holds for each document."""
    from ledgerleaf.operators import config

    lines = ["default", "default", "30 days late", "default", "", "", "", "default", "collection default"]
    df = spark.createDataFrame([(d, n, t) for d in (1, 2) for n, t in enumerate(lines)], "doc_id long, line_no int, line string")
    every = config.audit_lines(df, config.override(config.AuditConfig(), {"findings": {"gap": 2}})).where("doc_id = 1").orderBy("rank").collect()
    assert [(r.line_no, r.error_type) for r in every] == [(8, "collection"), (0, "derogatory"), (7, "derogatory"), (2, "late_payment")]
    few = config.audit_lines(df, config.override(config.AuditConfig(), {"findings": {"gap": 2, "top": 2}, "detect": {"least_severity": 4}})).collect()
    assert sorted((r.doc_id, r["rank"], r.line_no) for r in few) == [(1, 1, 8), (1, 2, 0), (2, 1, 8), (2, 2, 0)]


@pytest.mark.parametrize("tile", [7, 4096])
def test_all_pairs_and_nearest_of_copies_and_odd_vectors(spark, monkeypatch, tile):
    """Tiles, copies, unequal lengths, zeros and nulls against a plain loop."""
    import numpy as np

    from ledgerleaf.operators import embed

    monkeypatch.setattr(embed, "TILE", tile)
    rng = np.random.default_rng(2)
    pool = [rng.normal(size=4).tolist() for _ in range(9)] + [[1.0, 2.0], [2.0, 1.0], [0.0] * 4, [], None, [1.0, None, 0.0, 0.0]]
    rows = [(i, int(rng.integers(2)), pool[int(rng.integers(len(pool)))] if i > 25 else pool[0]) for i in range(80)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id int, embedding array<double>")

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
            return 0.0
        dot = lambda x, y: reduce(lambda s, p: s + p[0] * p[1], zip(x, y, strict=True), 0.0)
        return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))

    every = {(a, b): cosine(v, w) for a, g, v in rows for b, h, w in rows if a != b and g == h}
    for least in (0.3, -2.0):
        got = {(r.a, r.b): r.similarity for r in embed.similar_pairs(chunks, least, exact=True).collect()}
        assert got == {p: s for p, s in every.items() if p[0] < p[1] and s > least}
    for least, recall in ((None, 0.999), (0.9, 1 - 1e-12)):
        want = {}
        for (a, b), s in sorted(every.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
            if (least is None or s > least) and len(want.setdefault(a, [])) < 4:
                want[a].append((b, s))
        got = {}
        for r in embed.nearest(chunks, 4, threshold=least, recall=recall).orderBy("a", "rank").collect():
            got.setdefault(r.a, []).append((r.b, r.similarity))
            assert r.rank == len(got[r.a])
        assert got == {a: x for a, x in want.items() if x}


def test_a_sentence_at_exactly_its_share_is_not_past_it(spark):
    """700 * 0.7 is 489.99999999999994 in doubles; a sentence that ends its chunk at 490 of 700 does not break it."""
    text = "a" * 490 + ". " + "b" * 400
    got = [(r.start, r.end) for r in chunking.chunk_natural(spark.createDataFrame([(1, text)], "doc_id int, text string"), 700).orderBy("chunk_index").collect()]
    assert got == [(0, 700), (700, 892)]


def test_rows_of_a_dense_page_are_those_of_a_plain_loop(spark):
    """Sixty thousand tokens of one page, of heights that come back, on which a fold over tokens takes minutes."""
    import random

    random.seed(4)
    tokens = [(1, n, float(random.randrange(0, 400)) / 2) for n in range(60_000)]
    opened, want = [], {}
    for _, n, y in tokens:
        near = next((r for r in opened if abs(r - y) <= 5), None)
        if near is None:
            opened.append(y)
        want[n] = y if near is None else near
    frame = spark.createDataFrame(tokens, "page_number int, token_id long, y double").withColumn("doc_id", F.lit(1))
    assert {r.token_id: r.row_y for r in locate.group_rows(frame).collect()} == want


def test_flattened_pages_are_not_shuffled(spark):
    from tests.conftest import SMALL

    plan = views.page_spans(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Sort" not in plan


def test_documents_are_parsed_once_for_all_rules(spark):
    """However many rules and branches there are, a document's JSON is asked for once."""
    from ledgerleaf.operators import detect

    asked = spark.sparkContext.accumulator(0)

    def told(k):
        asked.add(1)
        return "{}" if k else "{"

    json = F.udf(told).asNondeterministic()("id")
    rows = spark.range(2, numPartitions=1).select("id", json.alias("json"))
    assert detect.check_conformance(rows).count() == 9 and asked.value == 2


def test_runs_of_words_make_the_tables_of_words(spark, tmp_path):
    """Lines of words, bars and gaps of all kinds, some longer than a piece: joined words give the tables that the words alone give."""
    rng = random.Random(5)
    line = lambda n: "".join(rng.choice(["a", "bb", "é|", "|c", "||", "|", "|", "\t", "\r", "Balance", "account"]) + " " * rng.choice([1, 1, 1, 2, 3, 4, 9]) for _ in range(n))
    texts = ["\n".join(rng.choice(["", "  ", "|", "x"]) if rng.random() < 0.3 else " " * rng.randrange(5) + line(rng.choice([1, 2, 5, 40, 90])) for _ in range(60)) for _ in range(40)]
    spark.createDataFrame(list(enumerate([*texts, "", None])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = views.tokens(spark, str(tmp_path)).where("str <> '|'")
    words = words.select("doc_id", (F.col("page0") + 1).alias("page_number"), (F.col("line_no") * F.lit(1 << 32) + F.col("token_idx")).alias("token_id"), "x", "y", "width", "str")
    runs = views.word_runs(spark, str(tmp_path))
    assert runs.count() < words.count()
    want = sorted(map(str, locate.detect_tables(words).collect()))
    assert len(want) > 40 and sorted(map(str, locate.detect_tables(runs).collect())) == want


def test_tables_shuffle_tokens_once(spark):
    """One shuffle, by page, is all there is."""
    tokens = spark.createDataFrame([(1, 1, i, float(x), 50.0 + 15 * (i // 3), 20.0, "w") for i, x in enumerate([0, 100, 200] * 4)], "doc_id long, page_number int, token_id long, x double, y double, width double, str string")
    found = locate.detect_tables(tokens)
    assert [(r.n_rows, r.n_columns, r.header) for r in found.collect()] == [(4, 3, ["w"] * 3)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1
