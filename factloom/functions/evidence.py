"""Evidence checks and boundary validation, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import blank, first_of, let, normalize_unit, number_tokens, parse_locale_number, strip
from factloom.functions.text import quote_position

UNGROUNDED, QUOTE_GROUNDED, FACT_VALIDATED = "ungrounded", "quote_grounded", "fact_validated"

# Fixed values.
EVIDENCE_STOP = ("the", "a", "an", "of", "for", "in", "on", "at", "to", "and", "or", "is", "was", "were", "as", "by", "with", "from", "its", "their", "this", "that")
NULLISH = ("null", "none", "n/a", "na", "-", "")
LEAST_QUOTE = 12
RELATIONS = ("corroborates", "contradicts", "reconciled", "unrelated", "uncertain")
ALIASES = (
    ("corroborates", ("corroborate", "corroborated", "corroboration", "agrees", "agree")),
    ("contradicts", ("contradict", "contradicted", "contradiction", "conflicts")),
    ("reconciled", ("reconcile", "reconciles", "contextually_reconciled", "contextual_reconciliation")),
    ("unrelated", ("not_related", "none")),
    ("uncertain", ("unknown", "insufficient_evidence")),
)
ISSUES = ("malformed_fact", "llm_call_failed", "unparseable_response", "unexpected_shape", "unexpected_shape_recovered", "table_alignment_uncertain", "quote_regrounded", "quote_not_grounded", "value_not_evidenced", "relationship_classification_failed", "arithmetic_scale_anomaly", "graph_incoherence", "pipeline_crashed")


def value_in_quote(value_numeric: Column | str, value: Column | str, quote: Column | str, compat: bool = False) -> Column:
    """V1: whether a number of the fact is in the quote; null if the fact has none."""
    number = (F.col(value_numeric) if isinstance(value_numeric, str) else value_numeric).cast("double")
    targets = F.array_compact(F.concat(F.array(number), number_tokens(value, compat)))
    return let(targets, lambda t: let(number_tokens(quote, compat), lambda q: _supported(t, q)))


def _supported(targets: Column, there: Column) -> Column:
    near = F.exists(targets, lambda t: F.exists(there, lambda q: F.abs(t - q) < 1e-6 * F.greatest(F.lit(1.0), F.abs(t))))
    return first_of([(F.size(targets) == 0, F.lit(None).cast("boolean")), (F.size(there) == 0, F.lit(False))], near)


def unit_in_quote(unit: Column | str, quote: Column | str) -> Column:
    """V2: whether the unit, its base or a part of either is in the quote; null without a unit."""
    u = (F.col(unit) if isinstance(unit, str) else unit).cast("string")
    q = F.lower(F.coalesce((F.col(quote) if isinstance(quote, str) else quote).cast("string"), F.lit("")))
    whole = F.array_compact(F.array(F.lower(strip(u)), normalize_unit(F.lit(1.0), u)["base_unit"]))
    parts = F.concat(whole, F.flatten(F.transform(whole, lambda w: F.split(w, r"(?U)[^\w%₹$€£]+"))))
    seen = F.exists(F.filter(parts, lambda t: (F.length(t) > 1) | t.isin("%", "₹", "$", "€", "£")), lambda t: F.contains(q, t))
    return F.when(u.isNotNull() & (u != ""), seen)


def text_overlap(text: Column | str, quote: Column | str) -> Column:
    """V3: whether a word of the text is in the quote; null if the text has no word to look for."""
    t = F.lower(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")))
    q = F.lower(F.coalesce((F.col(quote) if isinstance(quote, str) else quote).cast("string"), F.lit("")))
    words = F.filter(F.split(t, r"(?U)\W+"), lambda w: (F.length(w) > 2) & ~w.isin(*EVIDENCE_STOP))
    return F.when(F.size(words) > 0, F.exists(words, lambda w: F.contains(q, w)))


def check_evidence(grounded: Column | str, value_numeric: Column | str = "value_numeric", value: Column | str = "value", unit: Column | str = "unit", quote: Column | str = "quote", subject: Column | str = "subject", time_period: Column | str = "time_period", compat: bool = False) -> Column:
    """V4: struct (status, value_supported, unit_supported, subject_supported, period_supported, notes).

    Only the value and the quote's length decide; unit, subject and period are reported.
    """
    g = F.col(grounded) if isinstance(grounded, str) else grounded
    q = F.coalesce((F.col(quote) if isinstance(quote, str) else quote).cast("string"), F.lit(""))
    seen = F.struct(unit_in_quote(unit, quote).alias("u"), text_overlap(subject, quote).alias("s"), text_overlap(time_period, quote).alias("p"))
    return let(value_in_quote(value_numeric, value, quote, compat), lambda v: let(F.length(strip(q)) < LEAST_QUOTE, lambda short: _evidence(g, v, short, seen)))


def _evidence(g: Column, supported: Column, short: Column, seen: Column) -> Column:
    status = first_of(
        [
            (~F.coalesce(g, F.lit(False)), F.lit(UNGROUNDED)),
            (F.coalesce(~supported, F.lit(False)), F.lit(QUOTE_GROUNDED)),
            (~short, F.lit(FACT_VALIDATED)),
        ],
        F.lit(QUOTE_GROUNDED),
    )
    notes = F.array_compact(F.array(F.when(short, F.lit("the quote is too short to judge")), F.when(~supported, F.lit("no number of the fact is in the quote"))))
    return F.struct(status.alias("status"), supported.alias("value_supported"), seen["u"].alias("unit_supported"), seen["s"].alias("subject_supported"), seen["p"].alias("period_supported"), notes.alias("notes"))


def evidence_detail(check: Column, table_context: Column | str | None = None) -> Column:
    """V5: the checks in words."""

    def told(name: str, c: Column) -> Column:
        return F.when(c.isNotNull(), F.concat(F.lit(name + ": "), F.when(c, "yes").otherwise("no")))

    parts = [told("value", check["value_supported"]), told("unit", check["unit_supported"]), told("subject", check["subject_supported"]), told("period", check["period_supported"]), F.when(F.size(check["notes"]) > 0, F.array_join(check["notes"], ", "))]
    if table_context is not None:
        context = F.col(table_context) if isinstance(table_context, str) else table_context
        parts.append(F.when(context == "plain_reconstruction_rejected", F.lit("the page's table could not be aligned")))
    return F.concat_ws("; ", *parts)


def grounded(text: Column | str, quote: Column | str) -> Column:
    """Whether the quote stands in the text."""
    return quote_position(text, quote) >= 0


def nullish(c: Column | str) -> Column:
    """The text, or null where it only says that there is none."""
    x = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(~F.lower(strip(x)).isin(*NULLISH), x)


def confidence(c: Column | str) -> Column:
    """A confidence from 0 to 1; anything else is null and never clamped."""
    x = nullish(c).try_cast("double")
    return F.when((x >= 0) & (x <= 1), x)


def validate_facts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid facts, and an issue for each row without a statement or a quote.

    All fields of ``raw`` may be strings; missing ones count as null.
    """
    fields = ("subject", "attribute", "value", "unit", "time_period", "scope")
    has = set(raw.columns)

    def get(c: str) -> Column:
        return F.col(c) if c in has else F.lit(None).cast("string")

    kept = [c for c in raw.columns if c not in (*fields, "statement", "quote", "value_numeric", "confidence")]
    numeric = nullish(get("value_numeric"))
    # Text written as a number by the source keeps its own reading; other spellings go by the separators.
    number = F.coalesce(F.when(numeric.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), numeric.try_cast("double")), parse_locale_number(numeric))
    cleaned = raw.select(*kept, *[strip(nullish(get(c))).alias(c) for c in fields], number.alias("value_numeric"), strip(nullish(get("statement"))).alias("statement"), nullish(get("quote")).alias("quote"), confidence(get("confidence")).alias("confidence"), F.to_json(F.struct(*raw.columns)).alias("_raw"))
    bad = F.col("statement").isNull() | F.col("quote").isNull() | blank(F.col("quote"))
    issues = cleaned.where(bad).select(*kept, F.lit("malformed_fact").alias("issue_type"), F.when(F.col("statement").isNull(), "statement is missing").otherwise("quote is missing").alias("detail"), F.substring("_raw", 1, 2000).alias("raw_excerpt"))
    return cleaned.where(~bad).drop("_raw"), issues


def same_metric(c: Column | str) -> Column:
    """V8: a judgment's boolean in its spellings; null if it cannot be read."""
    x = F.lower(strip((F.col(c) if isinstance(c, str) else c).cast("string")))
    number = x.try_cast("double")
    return first_of([(x.isin("true", "yes", "y", "1"), F.lit(True)), (x.isin("false", "no", "n", "0"), F.lit(False)), (number.isNotNull(), number != 0)], F.lit(None).cast("boolean"))


def relation(c: Column | str) -> Column:
    """V9: a proposed relation under its proper name; what is not known is uncertain."""
    x = F.translate(F.lower(strip((F.col(c) if isinstance(c, str) else c).cast("string"))), "- ", "__")
    return first_of([(x.isin(*RELATIONS), x), *[(x.isin(*names), F.lit(to)) for to, names in ALIASES]], F.lit("uncertain"))


def evidence_caveat(a: Column, b: Column) -> Column:
    """Why the values may not be trusted, or null; ``a`` and ``b`` are evidence states, null passes."""

    def weak(x: Column) -> Column:
        return F.coalesce(x.isin(UNGROUNDED, QUOTE_GROUNDED), F.lit(False))

    return first_of([(weak(a) & weak(b), F.lit("neither value is supported by its quote")), (weak(a), F.lit("the first value is not supported by its quote")), (weak(b), F.lit("the second value is not supported by its quote"))], F.lit(None).cast("string"))
