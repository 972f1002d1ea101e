"""Review priority of facts and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import first_of
from factloom.operators.arithmetic import check_arithmetic
from factloom.operators.coherence import check_coherence, implicated_edges

# Fixed values.
LEVELS = (("critical", 80), ("high", 35), ("medium", 15))
RELATION_SCORE = (("contradicts", 40), ("uncertain", 25), ("insufficient_context", 20), ("reconciled", 4), ("related_but_not_comparable", 2))


def level(score: Column) -> Column:
    """R1."""
    return first_of([(score >= least, F.lit(name)) for name, least in LEVELS], F.lit("low"))


def level_order(name: Column) -> Column:
    return first_of([(name == n, F.lit(i)) for i, (n, _) in enumerate(LEVELS)], F.lit(len(LEVELS)))


def _reasons(*reasons: Column) -> Column:
    found = F.array_compact(F.array(*reasons))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("nothing stands out")))


def score_relationships(rels: DataFrame, implicated: DataFrame) -> DataFrame:
    """``rels`` with ``score``, ``level`` and ``reasons``."""
    hit = implicated.select(F.col("edge_id").alias("_e")).distinct()
    marked = rels.join(hit, rels.id == hit._e, "left").withColumn("_hit", F.col("_e").isNotNull()).drop("_e")
    r, sure = F.col("relation_type"), F.coalesce(F.col("confidence") >= 0.85, F.lit(False))
    disagreed = F.coalesce(F.col("disagreement"), F.lit(False))
    score = F.when(F.col("_hit"), 100).otherwise(0) + first_of([(r == n, F.lit(s)) for n, s in RELATION_SCORE], F.lit(0)) + F.when((r == "contradicts") & sure, 10).otherwise(0) + F.when(disagreed, 35).otherwise(0)
    reasons = _reasons(
        F.when(F.col("_hit"), F.lit("in a triangle that cannot be true")),
        F.when(r == "contradicts", F.when(sure, F.lit("a confident contradiction without explanation")).otherwise(F.lit("a contradiction without explanation"))),
        F.when(r == "uncertain", F.lit("the relation is not settled")),
        F.when(r == "insufficient_context", F.lit("the values differ and the context is not known")),
        F.when(disagreed, F.concat(F.lit("a check overrode the proposal "), F.coalesce("llm_proposal", F.lit("none")))),
    )
    scored = marked.withColumn("score", score.cast("double")).withColumn("reasons", reasons).drop("_hit")
    return scored.withColumn("level", level(F.col("score")))


def score_facts(facts: DataFrame, rels: DataFrame, implicated: DataFrame, suspects: DataFrame) -> DataFrame:
    """``facts`` with ``score``, ``level`` and ``reasons``; a self-edge counts at both its ends.

    Edges are counted by fact before they meet the facts, so a hub is one row in the join.
    """
    hit = implicated.select(F.col("edge_id").alias("id"), F.lit(1).alias("_hit")).distinct()
    ends = rels.select("id", "relation_type", F.explode(F.array("fact_id_a", "fact_id_b")).alias("_f")).join(hit, "id", "left")
    counts = ends.groupBy("_f").agg(F.count("*").alias("_degree"), F.count_if(F.col("relation_type") == "contradicts").alias("_contradicts"), F.count("_hit").alias("_implicated"))
    bad = suspects.select(F.col("suspect_id").alias("_s")).distinct()
    joined = facts.join(counts, facts.id == counts._f, "left").join(bad, facts.id == bad._s, "left").na.fill(0, ["_degree", "_contradicts", "_implicated"])
    e = F.coalesce("evidence_status", F.lit(""))
    n, m = F.col("_implicated"), F.col("_contradicts")
    score = first_of([(e == "ungrounded", F.lit(30)), (e == "quote_grounded", F.lit(15))], F.lit(0)) + F.when(F.col("_s").isNotNull(), 35).otherwise(0) + 80 * F.least(n, F.lit(2)) + 20 * F.least(m, F.lit(3)) + F.when(F.col("_degree") >= 5, 5).otherwise(0)
    reasons = _reasons(
        F.when(e == "ungrounded", F.lit("the quote is not in the source")),
        F.when(e == "quote_grounded", F.lit("the quote does not support the value")),
        F.when(F.col("_s").isNotNull(), F.lit("the unit looks misread by its sums")),
        F.when(n > 0, F.concat(F.lit("in "), n.cast("string"), F.lit(" edges of triangles that cannot be true"))),
        F.when(m > 0, F.concat(F.lit("in "), m.cast("string"), F.lit(" contradictions without explanation"))),
        F.when(F.col("_degree") >= 5, F.concat(F.lit("has "), F.col("_degree").cast("string"), F.lit(" relationships"))),
    )
    scored = joined.withColumn("score", score.cast("double")).withColumn("reasons", reasons).drop("_f", "_s", "_degree", "_contradicts", "_implicated")
    return scored.withColumn("level", level(F.col("score")))


def ranked(scored: DataFrame, newest_first: bool = False, limit: int | None = None) -> DataFrame:
    """The most urgent first; ties by id."""
    order = scored.orderBy(level_order(F.col("level")), F.desc("score"), F.desc("id") if newest_first else F.asc("id"))
    return order if limit is None else order.limit(limit)


def level_counts(scored: DataFrame) -> DataFrame:
    """A10: ``(level, n)`` over all scored rows."""
    return scored.groupBy("level").agg(F.count("*").alias("n"))


def priority(facts: DataFrame, rels: DataFrame, document_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Scored facts and relationships, of one document if asked for. Edges count as the document's if
    either end is in it; its facts' sums are checked among themselves."""
    if document_id is not None:
        facts = facts.where(F.col("document_id") == document_id)
        own = facts.select(F.col("id").alias("_f"))
        touched = rels.select("id", F.explode(F.array("fact_id_a", "fact_id_b")).alias("_f")).join(own, "_f", "left_semi").select("id").distinct()
        rels = rels.join(touched, "id", "left_semi")
    hit = implicated_edges(check_coherence(rels, facts, infer=False).violations)
    return score_facts(facts, rels, hit, check_arithmetic(facts).anomalies), score_relationships(rels, hit)
