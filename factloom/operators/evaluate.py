"""Evaluation: classification metrics, evidence metrics, failure analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.evidence import FACT_VALIDATED, UNGROUNDED, check_evidence, evidence_caveat
from factloom.functions.numbers import first_of
from factloom.operators.adjudicate import CONFIRMED, OVERRIDE
from factloom.operators.compare import adjudicate_pairs, compare_pairs
from factloom.scratch import stage

LEAST_SUPPORT = 3
CATEGORIES = (("contradicts", "CONTRADICTION"), ("reconciled", "CONTEXTUAL_RECONCILIATION"), ("related_but_not_comparable", "RELATED_NOT_COMPARABLE"), ("insufficient_context", "INSUFFICIENT_CONTEXT"), ("unrelated", "UNRELATED"))


def category(relation: Column, source: Column) -> Column:
    """A relation's category; a corroboration is exact only if a check decided it."""
    exact = F.coalesce(source.isin(CONFIRMED, OVERRIDE), F.lit(False))
    return first_of([(relation == "corroborates", F.when(exact, "EXACT_CORROBORATION").otherwise("SEMANTIC_CORROBORATION")), *[(relation == r, F.lit(c)) for r, c in CATEGORIES]], F.lit("UNCERTAIN"))


def confusion(pairs: DataFrame) -> DataFrame:
    """``(expected, predicted, n)``, the cells that are not zero."""
    return pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def confusion_matrix(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """A row for each expected label, a column for each of ``labels``."""
    return pairs.groupBy("expected").pivot("predicted", labels).count().na.fill(0)


def per_class(pairs: DataFrame) -> DataFrame:
    """``(label, support, predicted, tp, precision, recall, f1)`` of every label on either side.
    Precision is null if the label was never predicted, recall if it was never expected; then F1 is 0."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("expected").alias("label"), F.lit(1).alias("s"), F.lit(0).alias("p"), (F.col("expected") == F.col("predicted")).cast("int").alias("t")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x"))
    sums = ends.groupBy("x.label").agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted"), F.sum("x.t").alias("tp"))
    p, r = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")), F.when(F.col("support") > 0, F.col("tp") / F.col("support"))
    f1 = F.when((F.coalesce(p, F.lit(0.0)) > 0) & (F.coalesce(r, F.lit(0.0)) > 0), 2 * p * r / (p + r)).otherwise(0.0)
    return sums.select("label", "support", "predicted", "tp", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def macro(classes: DataFrame, least: int = LEAST_SUPPORT) -> DataFrame:
    """Averages over labels with enough support, nulls left out, 0 if there is none; and the labels with
    some but too little."""
    enough = F.col("support") >= least
    mean = lambda c: F.coalesce(F.avg(F.when(enough, F.col(c))), F.lit(0.0)).alias(f"macro_{c}")
    return classes.agg(mean("precision"), mean("recall"), mean("f1"), F.array_sort(F.collect_list(F.when((F.col("support") > 0) & ~enough, F.col("label")))).alias("low_support"))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n"), F.count_if(F.col("expected") == F.col("predicted")).alias("correct"), F.coalesce(F.avg((F.col("expected") == F.col("predicted")).cast("double")), F.lit(0.0)).alias("accuracy"))


def mean_hit(hits: DataFrame, hit: str = "hit") -> DataFrame:
    """The share of hits, 0 if there is no row."""
    return hits.agg(F.coalesce(F.avg(F.col(hit).cast("double")), F.lit(0.0)).alias("recall"))


def binary(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """``(tp, fp, fn, tn, precision, recall, f1)`` of two boolean columns; ratios of nothing are 0."""
    e, p = F.coalesce(F.col(expected), F.lit(False)), F.coalesce(F.col(predicted), F.lit(False))
    c = rows.agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.count_if(~e & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def run_override_cases(cases: DataFrame) -> DataFrame:
    """``cases(id, fact_a, fact_b, llm)`` adjudicated: adds ``adj``. Facts are structs, ``llm`` the proposal."""
    a, b = F.col("fact_a"), F.col("fact_b")
    sides = [{"value": x["value_numeric"], "unit": x["unit"], "time_period": x["time_period"], "scope": x["scope"]} for x in (a, b)]
    both = a["value_numeric"].isNotNull() & b["value_numeric"].isNotNull()
    return adjudicate_pairs(compare_pairs(cases, *sides), F.col("llm"), evidence_caveat(a["evidence_status"], b["evidence_status"]), both).drop("comparison", "period", "scope")


def root_cause(results: DataFrame) -> DataFrame:
    """Wrong results with ``root_cause``. ``results`` has (expected, predicted, decision_source, comparable,
    both_numeric, period, scope)."""
    hedge = ("UNCERTAIN", "INSUFFICIENT_CONTEXT")
    yes = lambda c: F.coalesce(c, F.lit(False))
    cause = first_of(
        [
            (yes(~F.col("comparable")) & yes(F.col("both_numeric")), F.lit("unit_normalization")),
            (yes(F.col("period") == "unknown") | yes(F.col("scope") == "unknown"), F.lit("context_ambiguity")),
            (F.col("predicted").isin(*hedge) & ~F.col("expected").isin(*hedge), F.lit("safe_but_imprecise_hedge")),
            (yes(F.col("decision_source") == "llm_unchecked"), F.lit("llm_semantic")),
            (F.col("expected") == "UNRELATED", F.lit("metric_matching")),
        ],
        F.lit("other"),
    )
    return results.where(~F.col("expected").eqNullSafe(F.col("predicted"))).withColumn("root_cause", cause)


def failures_by_cause(results: DataFrame) -> DataFrame:
    """``(root_cause, n, ids)``, the most frequent first; ``ids`` are the 20 smallest."""
    wrong = root_cause(results)
    first = wrong.withColumn("_n", F.row_number().over(Window.partitionBy("root_cause").orderBy("id"))).where("_n <= 20").groupBy("root_cause").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return wrong.groupBy("root_cause").agg(F.count("*").alias("n")).join(first, "root_cause").select("root_cause", "n", "ids").orderBy(F.desc("n"), "root_cause")


def override_accounting(results: DataFrame) -> DataFrame:
    """``results(expected, llm_category, predicted, disagreement)`` counted: disagreements, wrong proposals,
    those corrected, those still wrong, and errors that a check introduced."""
    wrong, right = F.col("llm_category") != F.col("expected"), F.col("predicted") == F.col("expected")
    known = F.col("llm_category").isNotNull()
    return results.agg(
        F.count_if(F.coalesce("disagreement", F.lit(False))).alias("disagreements"), F.count_if(known & wrong).alias("llm_wrong"), F.count_if(known & wrong & right).alias("corrected"),
        F.count_if(known & wrong & ~right).alias("still_wrong"), F.count_if(known & ~wrong & ~right).alias("introduced"),
    )


def audit(old: DataFrame, new: DataFrame, stored: tuple[str, ...], facts: DataFrame | None = None, document_id: int | None = None) -> DataFrame:
    """How a fresh judgment of stored pairs turns out: kept, relabelled or dropped. Both are (lo, hi,
    relation_type); with ``facts`` and a document only pairs with an end in it count."""
    if facts is not None and document_id is not None:
        own = facts.where(F.col("document_id") == document_id).select(F.col("id").alias("_f"))
        touched = old.select("lo", "hi", F.explode(F.array("lo", "hi")).alias("_f")).join(own, "_f", "left_semi").select("lo", "hi").distinct()
        old = old.join(touched, ["lo", "hi"], "left_semi")
    both = old.join(new.select("lo", "hi", F.col("relation_type").alias("fresh")), ["lo", "hi"], "left")
    kept = F.coalesce(F.col("fresh").isin(*stored), F.lit(False))
    return both.agg(F.count("*").alias("audited"), F.count_if(kept & (F.col("fresh") == F.col("relation_type"))).alias("kept"), F.count_if(kept & (F.col("fresh") != F.col("relation_type"))).alias("relabelled"), F.count_if(~kept).alias("dropped"))


def sampled_pairs(pairs: DataFrame, n: int = 300, seed: int = 42) -> DataFrame:
    """At most ``n`` pairs (lo, hi), the same in every run."""
    return pairs.orderBy(F.xxhash64("lo", "hi", F.lit(seed)), "lo", "hi").limit(n)


def evidence_scores(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """How well the evidence check agrees with ``labels(fact_id, should_validate)``, unlabelled ones left out. A stored
    fact's quote counts as grounded unless its status says otherwise (E8)."""
    grounded = ~F.coalesce(F.col("evidence_status") == UNGROUNDED, F.lit(False))
    both = facts.join(labels.where("should_validate is not null"), facts.id == labels.fact_id)
    return binary(both.withColumn("_p", check_evidence(grounded)["status"] == FACT_VALIDATED), "should_validate", "_p")


#: Facts that the evidence check must not validate: another number, a bare number, a quote that is not in the source.
PROBES = (("another number", 12.0, "in 2024 there were 120", True), ("a bare number", 120.0, "120", True), ("no quote", 120.0, "in 2024 there were 120", False))


def evidence_probes(spark: SparkSession) -> DataFrame:
    """E5: ``(probe, rejected)`` for each probe."""
    rows = spark.createDataFrame(PROBES, "probe string, value_numeric double, quote string, grounded boolean")
    none = F.lit(None).cast("string")
    return rows.select("probe", (check_evidence("grounded", "value_numeric", none, none, "quote", none, none)["status"] != FACT_VALIDATED).alias("rejected"))


FACT = "id long, document_id long, page_number int, subject string, attribute string, value string, value_numeric double, unit string, time_period string, scope string, statement string, quote string, evidence_status string"
CASES = f"id string, category string, trap string, notes string, fact_a struct<{FACT.replace(' ', ':').replace(',:', ',')}>, fact_b struct<{FACT.replace(' ', ':').replace(',:', ',')}>, llm struct<relation_type:string,explanation:string,reconciliation_context:string,confidence:double>, same_metric boolean"


def with_defaults(cases: DataFrame) -> DataFrame:
    """Cases whose facts have what cases leave out: negative ids, a page, a status, and a statement from the other fields."""

    def full(side: str, at: int) -> Column:
        f = F.col(side)
        said = F.concat_ws(" ", f["subject"], f["attribute"], F.lit("is"), f["value"], f["unit"], f["time_period"])
        own = {"id": F.coalesce(f["id"], -(F.xxhash64("id", F.lit(at)).bitwiseAND(F.lit(2**62 - 1).cast("long"))) - 1), "page_number": F.coalesce(f["page_number"], F.lit(1)), "statement": F.coalesce(f["statement"], said), "quote": F.coalesce(f["quote"], f["statement"], said), "evidence_status": F.coalesce(f["evidence_status"], F.lit(FACT_VALIDATED))}
        return F.struct(*[own.get(x.split(" ")[0], f[x.split(" ")[0]]).alias(x.split(" ")[0]) for x in FACT.split(", ")])

    return cases.withColumns({"fact_a": full("fact_a", 0), "fact_b": full("fact_b", 1)})


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from a JSON array, with defaults."""
    return with_defaults(spark.read.schema(CASES).option("multiLine", True).json(path))


def run_cases(cases: DataFrame) -> DataFrame:
    """Every case judged by its recorded answers: ``(id, expected, predicted, llm_category, decision_source,
    disagreement, comparable, both_numeric, period, scope)``. A case whose recorded first answer is that the metrics
    differ is unrelated, and only its proposal would have been asked for otherwise."""
    a, b = F.col("fact_a"), F.col("fact_b")
    sides = [{"value": x["value_numeric"], "unit": x["unit"], "time_period": x["time_period"], "scope": x["scope"]} for x in (a, b)]
    both = a["value_numeric"].isNotNull() & b["value_numeric"].isNotNull()
    judged = adjudicate_pairs(compare_pairs(cases, *sides), F.col("llm"), evidence_caveat(a["evidence_status"], b["evidence_status"]), both)
    same = F.coalesce("same_metric", F.lit(True))
    final, source = F.when(same, F.col("adj.relation_type")).otherwise("unrelated"), F.when(same, F.col("adj.decision_source"))
    return judged.select("id", F.col("category").alias("expected"), category(final, source).alias("predicted"), F.when(F.col("llm.relation_type").isNotNull(), category(F.col("llm.relation_type"), F.lit(None).cast("string"))).alias("llm_category"), source.alias("decision_source"), (same & F.col("adj.disagreement")).alias("disagreement"), F.col("comparison.comparable").alias("comparable"), both.alias("both_numeric"), F.col("period.relation").alias("period"), F.col("scope.relation").alias("scope"))


def write_report(results: DataFrame, path: str) -> str:
    """Results as JSON lines and, beside them, classes, causes and overrides; returns a text of the main figures."""
    kept = stage(results, "results")
    kept.write.mode("overwrite").json(f"{path}/results")
    per_class(kept).write.mode("overwrite").json(f"{path}/classes")
    failures_by_cause(kept).write.mode("overwrite").json(f"{path}/causes")
    n, m, o = accuracy(kept).first(), macro(per_class(kept)).first(), override_accounting(kept).first()
    return f"{n.correct} of {n.n} right ({n.accuracy:.3f}); macro F1 {m.macro_f1:.3f}; {o.disagreements} disagreements, {o.corrected} proposals corrected, {o.still_wrong} still wrong, {o.introduced} made wrong"
