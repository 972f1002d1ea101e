"""Candidate scoring and the adjudication decision list, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.context import DIFFERENT, OVERLAPPING, SAME, UNKNOWN
from factloom.functions.numbers import compare_values, first_of, let, short_number
from factloom.functions.text import entity_similarity, jaccard

CONFIRMED, OVERRIDE, UNCHECKED = "deterministic_confirmed", "deterministic_override", "llm_unchecked"
STORED = ("corroborates", "contradicts", "reconciled", "uncertain", "related_but_not_comparable", "insufficient_context")

# Fixed values.
EMBEDDING_STRONG, ENTITY_STRONG, LEXICAL_LEAST, NUMERIC_TOLERANCE = 0.40, 0.5, 0.30, 2.0


def score_pair(a: Column, b: Column, embedding_score: Column) -> Column:
    """Struct (embedding_score, entity_score, lexical_score, numeric_match, triggers, detail) of two
    fact structs. The pair is a candidate if it has a trigger."""
    signals = F.struct(entity_similarity(a["subject"], b["subject"]).alias("entity"), jaccard(a["attribute"], b["attribute"]).alias("lexical"), compare_values(a["value_numeric"], a["unit"], b["value_numeric"], b["unit"], NUMERIC_TOLERANCE).alias("cmp"))
    return let(signals, lambda s: _scored(s["entity"], s["lexical"], s["cmp"], embedding_score))


def _scored(entity: Column, lexical: Column, cmp: Column, embedding_score: Column) -> Column:
    numeric = F.coalesce(cmp["comparable"] & cmp["agree"] & ~cmp["magnitude_suspect"] & (entity >= ENTITY_STRONG), F.lit(False))
    triggers = F.array_compact(F.array(F.when(embedding_score >= EMBEDDING_STRONG, F.lit("embedding")), F.when((entity >= ENTITY_STRONG) & (lexical >= LEXICAL_LEAST), F.lit("entity+lexical")), F.when(numeric, F.lit("numeric"))))
    same = F.when(numeric, F.concat(F.lit(", numeric_match("), short_number(cmp["diff_pct"]), F.lit("% apart)"))).otherwise("")
    detail = F.concat(F.when(F.size(triggers) > 0, F.array_join(triggers, "+")).otherwise("none"), F.format_string(" [embedding=%.2f, entity=%.2f, lexical=%.2f", embedding_score.cast("double"), entity, lexical), same, F.lit("]"))
    return F.struct(embedding_score.cast("double").alias("embedding_score"), entity.alias("entity_score"), lexical.alias("lexical_score"), numeric.alias("numeric_match"), triggers.alias("triggers"), detail.alias("detail"))


def adjudicate(llm: Column, comparison: Column, period: Column, scope: Column, caveat: Column, both_numeric: Column, slice_a: Column | None = None, slice_b: Column | None = None) -> Column:
    """The final relation of a pair.

    ``llm`` is a struct (relation_type, explanation, reconciliation_context, confidence) of the proposal,
    its fields maybe null; ``comparison``, ``period`` and ``scope`` come from the comparing functions and
    ``caveat`` is null if both values are evidenced. The first rule that fits decides.
    """
    given = F.struct(llm.alias("llm"), comparison.alias("comparison"), period.alias("period"), scope.alias("scope"), caveat.alias("caveat"), both_numeric.alias("both_numeric"), (slice_a if slice_a is not None else F.lit(None).cast("string")).alias("slice_a"), (slice_b if slice_b is not None else F.lit(None).cast("string")).alias("slice_b"))
    return let(given, lambda g: let(decide(g["llm"], g["comparison"], g["period"], g["scope"], g["caveat"], g["both_numeric"]), lambda chosen: result(chosen, g)))


def decide(llm: Column, comparison: Column, period: Column, scope: Column, caveat: Column, both_numeric: Column) -> Column:
    """The first rule that fits."""
    proposal = llm["relation_type"]
    comparable, suspect = F.coalesce(comparison["comparable"], F.lit(False)), F.coalesce(comparison["magnitude_suspect"], F.lit(False))
    trusted = comparable & ~suspect & caveat.isNull()
    agree, differ = trusted & comparison["agree"], trusted & ~comparison["agree"]
    period_apart, scope_apart = period["relation"].isin(DIFFERENT, OVERLAPPING), scope["relation"].isin(DIFFERENT, OVERLAPPING)
    gap = F.coalesce(short_number(comparison["diff_pct"]), F.lit("?"))
    synthesised = F.concat_ws("; ", F.when(period_apart, period["detail"]), F.when(scope["relation"] == DIFFERENT, scope["detail"]))
    context = F.coalesce(llm["reconciliation_context"], F.when(synthesised != "", synthesised), F.lit("the period or the scope differs"))

    def rule(number: int, relation: Column | str, confirming: Column, reason: Column, reconciliation: Column | None = None) -> Column:
        source = F.when(F.coalesce(confirming, F.lit(False)), CONFIRMED).otherwise(OVERRIDE)
        final = F.lit(relation) if isinstance(relation, str) else relation
        return F.struct(F.lit(number).alias("rule"), final.alias("relation_type"), source.alias("decision_source"), reason.alias("reason"), (reconciliation if reconciliation is not None else F.lit(None).cast("string")).alias("reconciliation_context"))

    unchecked = F.struct(F.lit(8).alias("rule"), F.coalesce(proposal, F.lit("uncertain")).alias("relation_type"), F.lit(UNCHECKED).alias("decision_source"), F.lit("no check applies to the pair").alias("reason"), llm["reconciliation_context"].alias("reconciliation_context"))
    return first_of(
        [
            (both_numeric & ~comparable, rule(1, "related_but_not_comparable", proposal == "related_but_not_comparable", F.concat(F.lit("the values cannot be compared: "), comparison["reason"]))),
            (comparable & suspect, rule(2, "uncertain", proposal == "uncertain", F.lit("the values are orders of magnitude apart, as if a scale was lost"))),
            (comparable & ~suspect & caveat.isNotNull() & proposal.isin("corroborates", "contradicts"), rule(3, "uncertain", F.lit(False), F.concat(F.lit("no firm relation can rest on it: "), caveat))),
            (agree & ~period_apart & ~scope_apart, rule(4, "corroborates", proposal == "corroborates", F.concat(F.lit("the values agree, "), gap, F.lit("% apart")))),
            (differ & (period["relation"] == SAME) & (scope["relation"] == SAME), rule(5, "contradicts", proposal == "contradicts", F.concat(F.lit("the values are "), gap, F.lit("% apart for one period and scope")))),
            (differ & (period_apart | (scope["relation"] == DIFFERENT)), rule(6, "reconciled", proposal == "reconciled", F.concat(F.lit("the values are "), gap, F.lit("% apart, which is explained: "), context), context)),
            (differ & ((period["relation"] == UNKNOWN) | scope["relation"].isin(UNKNOWN, OVERLAPPING)), rule(7, "insufficient_context", proposal.isin("uncertain", "insufficient_context"), F.concat(F.lit("the values are "), gap, F.lit("% apart and the context is not known: "), F.when(period["relation"] == UNKNOWN, period["detail"]).otherwise(scope["detail"])))),
        ],
        unchecked,
    )


def result(chosen: Column, g: Column | dict[str, Column]) -> Column:
    """The relation, its source, confidence and explanation from what ``decide`` chose."""
    llm, comparison, period, scope = g["llm"], g["comparison"], g["period"], g["scope"]
    proposal, suspect = llm["relation_type"], F.coalesce(comparison["magnitude_suspect"], F.lit(False))
    checked = chosen["decision_source"] != UNCHECKED
    disagreement = F.coalesce(checked & (proposal != chosen["relation_type"]), F.lit(False))
    told = llm["explanation"]
    said = F.coalesce(told, F.lit("")) != ""
    explanation = first_of([(~checked, F.when(said, told).otherwise(chosen["reason"])), (disagreement & said, F.concat(chosen["reason"], F.lit(" (proposed: "), proposal, F.lit("; "), told, F.lit(")"))), (disagreement, chosen["reason"]), (said, told)], chosen["reason"])
    checks = F.struct(
        comparison["comparable"].alias("comparable"), comparison["value_a"].alias("value_a"), comparison["value_b"].alias("value_b"), comparison["common_unit"].alias("common_unit"),
        comparison["diff_pct"].alias("diff_pct"), comparison["agree"].alias("agree"), suspect.alias("magnitude_suspect"), period["relation"].alias("period"), period["detail"].alias("period_detail"),
        scope["relation"].alias("scope"), scope["detail"].alias("scope_detail"), scope["dimension"].alias("scope_dimension"), g["caveat"].alias("evidence_caveat"), g["both_numeric"].alias("both_numeric"),
        g["slice_a"].alias("slice_a"), g["slice_b"].alias("slice_b"), comparison["reason"].alias("comparison_reason"),
    )
    return F.struct(
        chosen["rule"].alias("rule"),
        chosen["relation_type"].alias("relation_type"),
        chosen["decision_source"].alias("decision_source"),
        disagreement.alias("disagreement"),
        F.when(disagreement, chosen["reason"]).alias("disagreement_reason"),
        proposal.alias("llm_proposal"),
        explanation.alias("explanation"),
        F.when(checked, chosen["reconciliation_context"]).otherwise(llm["reconciliation_context"]).alias("reconciliation_context"),
        F.when(checked, 1.0).otherwise(llm["confidence"]).alias("confidence"),
        checks.alias("checks"),
    )
