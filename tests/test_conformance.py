"""Known answers of the column functions."""

import pytest
from pyspark.sql import functions as F

from factloom.functions.context import compare_periods, compare_scopes, parse_period
from factloom.functions.evidence import check_evidence, relation, validate_facts
from factloom.functions.numbers import clean_unit, compare_values, normalize_unit, number_tokens, parse_locale_number
from factloom.functions.text import display_name, entity_similarity, jaccard, quote_position
from factloom.operators.adjudicate import adjudicate
from factloom.sources.pages import parse_page_spec


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_numbers(spark):
    cases = [("1,234.56", 1234.56), ("1.234,56", 1234.56), ("12,345,678", 12345678.0), ("12.345.678", 12345678.0), ("1,234", 1234.0), ("1.234", 1.234), ("-5", -5.0), ("12d", None), ("", None), (None, None)]
    got = table(spark, cases, "s string, x double").select("x", parse_locale_number("s").alias("y")).collect()
    assert [r.y for r in got] == [r.x for r in got]


def test_tokens(spark):
    cases = [("loss of (452) and 3.5 then 12.5, up", [-452.0, 3.5, 12.5]), ("(6.3%) in Sep-25", [-6.3, -25.0]), (None, [])]
    got = table(spark, cases, "s string, x array<double>").select("x", number_tokens("s").alias("y")).collect()
    assert [r.y for r in got] == [r.x for r in got]
    assert table(spark, [("12.5, up",)], "s string").select(number_tokens("s", compat=True).alias("y")).first().y == [125.0]


def test_units(spark):
    cases = [(8142.0, "Cr", 8.142e10, "unit"), (8142.0, "INR Crore", 8.142e10, "inr"), (5.0, "lakh", 5e5, "unit"), (2.5, "billion", 2.5e9, "unit"), (1.4, "Mn Tons", 1.4e6, "tons"), (50.0, "bps", 0.5, "%"), (2.0, "Rs. crore", 2e7, "inr"), (1.0, "", None, None), (1.0, None, None, None)]
    got = table(spark, cases, "v double, u string, x double, b string").select("x", "b", normalize_unit("v", "u").alias("n")).collect()
    for r in got:
        assert (r.n.value if r.n else None) == pytest.approx(r.x) if r.x else r.n is None
        assert (r.n.base_unit if r.n else None) == r.b
    words = ["hours", "years", "cars", "workers", "liters", "gears", "tons"]
    assert [r.y for r in table(spark, [(w,) for w in words], "u string").select(clean_unit("u").alias("y")).collect()] == words


def test_values(spark):
    cases = [(8142.0, "INR Crore", 81415.38, "INR million", True, True, False), (85466.74, "INR million", 91446.46, "INR million", True, False, False), (85466.74, "INR million", 91446.46, "INR", True, False, True), (5.6, "%", 404.0, "INR Crore", False, None, False), (100.0, "million", 101.0, "million", True, True, False)]
    got = table(spark, cases, "a double, ua string, b double, ub string, c boolean, g boolean, s boolean").select("c", "g", "s", compare_values("a", "ua", "b", "ub").alias("r")).collect()
    for r in got:
        assert (r.r.comparable, r.r.agree, r.r.magnitude_suspect) == (r.c, r.g, r.s)


PERIODS = [("FY24", "fiscal_year", 2024), ("fiscal year 2024", "fiscal_year", 2024), ("FY2023-24", "fiscal_year", 2024), ("2023-2024", "fiscal_year", 2024), ("Q1 FY25", "quarter", 2025), ("H2FY2024", "half_year", 2024), ("2H2024", "half_year", 2024), ("HY2 FY24", "half_year", 2024), ("first half of 2024", "half_year", 2024), ("as of March 31, 2024", "as_of", 2024), ("YTD", "relative", None), ("sometime", None, None), ("2024-03-31", "as_of", 2024), (None, None, None)]


def test_parse_period(spark):
    got = table(spark, PERIODS, "s string, k string, y int").select("s", "k", "y", parse_period("s").alias("p")).collect()
    for r in got:
        assert ((r.p.kind, r.p.year) if r.p else (None, None)) == (r.k, r.y), r.s


def test_compare_periods(spark):
    cases = [("FY24", "FY2023-24", "same"), ("FY24", "FY23", "different"), ("Q1 FY25", "FY25", "overlapping"), ("Q1 FY25", "Q3 FY25", "different"), ("Q1 FY25", "Q1 2025", "same"), ("FY24", "2024", "overlapping"), ("Q1 2024", "H1 2024", "overlapping"), ("H1 2024", "1H FY24", "same"), ("FY24", None, "unknown"), ("year ended March 31, 2024", "FY2024", "same"), ("year ended March 31, 2024", "2024", "overlapping"), ("year ended March 31, 2024", "as of March 31, 2024", "overlapping")]
    got = table(spark, cases, "a string, b string, r string").select("a", "b", "r", compare_periods("a", "b")["relation"].alias("g")).collect()
    assert [(r.a, r.b, r.g) for r in got] == [(r.a, r.b, r.r) for r in got]


def test_compare_scopes(spark):
    cases = [("consolidated", "standalone", "different", "scope"), ("actual", "forecast", "different", "basis"), ("consolidated", "group", "same", "scope"), ("gross", "actual", "different", "scope"), ("segment: north", "segment: south", "overlapping", "scope"), ("larval", "adult", "different", "scope"), ("consolidated", None, "unknown", "scope")]
    got = table(spark, cases, "a string, b string, r string, d string").select("r", "d", compare_scopes("a", "b").alias("g")).collect()
    assert [(r.g.relation, r.g.dimension) for r in got] == [(r.r, r.d) for r in got]


def test_similarity(spark):
    r = table(spark, [("total revenue", "revenue", "Delhivery", "Delhivery Limited")], "a string, b string, c string, d string").select(jaccard("a", "b").alias("j"), entity_similarity("c", "d").alias("e")).first()
    assert (r.j, r.e) == (1.0, 0.85)


def test_quotes_and_names(spark):
    r = table(spark, [("a  b\nc", "b c", "0" * 32 + "_x.pdf")], "t string, q string, n string").select(quote_position("t", "q").alias("p"), display_name("n").alias("n")).first()
    assert r.p >= 0 and r.n == "x"


def test_evidence(spark):
    rows = [(True, 779.0, "Number of complaints filed during the year", "quote_grounded"), (True, 12.0, "in 2024 there were 120", "quote_grounded"), (True, 120.0, "in 2024 there were 120", "fact_validated"), (True, 120.0, "120", "quote_grounded"), (False, 120.0, "in 2024 there were 120", "ungrounded")]
    n = F.lit(None).cast("string")
    got = table(spark, rows, "g boolean, v double, q string, s string").select("s", check_evidence("g", "v", n, n, "q", n, n)["status"].alias("r")).collect()
    assert [x.r for x in got] == [x.s for x in got]


def test_validation(spark):
    raw = table(spark, [("s", "q", "1,234", "2"), (None, "q", "x", "0.5"), ("s", " ", "1", "n/a")], "statement string, quote string, value_numeric string, confidence string")
    good, issues = validate_facts(raw)
    r = good.collect()
    assert [(x.statement, x.value_numeric, x.confidence) for x in r] == [("s", 1234.0, None)] and issues.count() == 2
    assert table(spark, [("agree",)], "r string").select(relation("r").alias("r")).first().r == "corroborates"


def test_every_rule(spark):
    """(comparable, agree, suspect, period, scope, caveat, both, proposal) to (rule, relation, source)."""
    cases = [
        (False, None, False, "same", "same", None, True, "contradicts", 1, "related_but_not_comparable", "deterministic_override"),
        (True, False, True, "same", "same", None, True, "uncertain", 2, "uncertain", "deterministic_confirmed"),
        (True, True, False, "same", "same", "weak", True, "corroborates", 3, "uncertain", "deterministic_override"),
        (True, True, False, "unknown", "unknown", None, True, "corroborates", 4, "corroborates", "deterministic_confirmed"),
        (True, False, False, "same", "same", None, True, "corroborates", 5, "contradicts", "deterministic_override"),
        (True, False, False, "different", "same", None, True, "reconciled", 6, "reconciled", "deterministic_confirmed"),
        (True, False, False, "unknown", "same", None, True, "uncertain", 7, "insufficient_context", "deterministic_confirmed"),
        (True, True, False, "overlapping", "same", None, True, "unrelated", 8, "unrelated", "llm_unchecked"),
        (False, None, False, "same", "same", None, False, None, 8, "uncertain", "llm_unchecked"),
    ]
    df = table(spark, cases, "c boolean, g boolean, s boolean, p string, o string, w string, b boolean, l string, rule int, rel string, src string")
    cmp = F.struct(F.col("c").alias("comparable"), F.lit("r").alias("reason"), F.lit(1.0).alias("value_a"), F.lit(2.0).alias("value_b"), F.lit("u").alias("common_unit"), F.lit(5.0).alias("diff_pct"), F.col("g").alias("agree"), F.col("s").alias("magnitude_suspect"))
    per = F.struct(F.col("p").alias("relation"), F.lit("d").alias("detail"))
    sc = F.struct(F.col("o").alias("relation"), F.lit("d").alias("detail"), F.lit("scope").alias("dimension"))
    llm = F.struct(F.col("l").alias("relation_type"), F.lit("e").alias("explanation"), F.lit(None).cast("string").alias("reconciliation_context"), F.lit(0.5).alias("confidence"))
    got = df.select("rule", "rel", "src", "l", adjudicate(llm, cmp, per, sc, F.col("w"), F.col("b")).alias("a")).collect()
    for r in got:
        assert (r.a.rule, r.a.relation_type, r.a.decision_source) == (r.rule, r.rel, r.src)
    assert got[6].a.disagreement and got[6].a.confidence == 1.0


def test_page_spec():
    assert parse_page_spec("1,3,7-10") == [(1, 1), (3, 3), (7, 10)]
    for bad in ("24-24-24", "9-3", "", "0", "10001", "x"):
        with pytest.raises(ValueError):
            parse_page_spec(bad)
