"""Additive identities and scale anomalies inside groups of facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.context import parse_period
from factloom.functions.numbers import first_of, let, power_of_ten, strip
from factloom.operators.compare import once, scaled, with_units
from factloom.scratch import stage

# Fixed values.
TOLERANCE_PCT, SMALL_PART_PCT, LEAST_GROUP, MOST_GROUP = 0.5, 5.0, 3, 60


@dataclass
class Arithmetic:
    """``identities``, ``anomalies`` and a one-row ``summary``."""

    identities: DataFrame
    anomalies: DataFrame
    summary: DataFrame


def period_key(text: Column | str, compat: bool = False) -> Column:
    """The period's kind and numbers, or its own text if it has no year."""
    raw = F.col(text) if isinstance(text, str) else text
    return let(parse_period(raw, compat), lambda p: _period_key(p, raw))


def _period_key(p: Column, raw: Column) -> Column:
    number = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.when(p["year"].isNotNull(), F.concat_ws(":", p["kind"], number(p["year"]), number(p["quarter"]), number(p["half"]))).otherwise(F.lower(strip(F.coalesce(raw.cast("string"), F.lit("")))))


def grouped(facts: DataFrame, compat: bool = False) -> DataFrame:
    """Evidenced facts with a value and a unit that is no percentage: ``(id, statement, unit, v,
    base_unit, period, scope_key)``."""
    status = F.coalesce(F.col("evidence_status"), F.lit(""))
    own = facts.where(~status.isin("ungrounded", "quote_grounded")).select("id", "statement", "unit", "value_numeric", "time_period", F.lower(strip(F.coalesce("scope", F.lit("")))).alias("scope_key"))
    read = once(with_units(own, _u="unit"), {"period": "time_period"}, lambda t: period_key(t, compat), "period-keys")
    kept = read.withColumn("n", scaled(F.col("value_numeric"), F.col("_u")))
    return kept.where(F.col("n").isNotNull() & (F.col("n.base_unit") != "%") & (F.col("n.value") != 0)).select("id", "statement", "unit", F.col("n.value").alias("v"), F.col("n.base_unit").alias("base_unit"), "period", "scope_key")


def _once(found: DataFrame) -> DataFrame:
    """The first of those over the same three statements; facts without one stand for themselves."""
    who = lambda s: F.coalesce(F.col(f"{s}.statement"), F.concat(F.lit("#"), F.col(f"{s}.id").cast("string")))
    key = F.array_sort(F.array(who("a"), who("b"), who("c")))
    order = Window.partitionBy("_key").orderBy("a.i", "b.i", "c.i", "base_unit", "period", "scope_key")
    return found.withColumn("_key", key).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_key", "_n")


def check_arithmetic(facts: DataFrame, tolerance_pct: float = TOLERANCE_PCT, compat: bool = False) -> Arithmetic:
    """Triples a + b = c inside groups of one base unit, period and scope.

    A group's first 60 facts by id take part, so it has at most 102,660 triples; they meet in joins on the
    group and only those that hold go on. A triple whose sum is off by a power of ten and whose units are
    not all written alike is a scale anomaly.
    """
    key = ["base_unit", "period", "scope_key"]
    each = stage(grouped(facts, compat), "grouped")
    sizes = each.groupBy(*key).agg(F.count("*").alias("size"))
    summary = sizes.agg(F.count_if(F.col("size") >= LEAST_GROUP).alias("groups_checked"), F.count_if(F.col("size") > MOST_GROUP).alias("groups_truncated"), F.coalesce(F.sum("size"), F.lit(0)).alias("facts_considered"))
    # Only the first rows of a group pass each task's limit, so a large group is never gathered.
    first = each.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("i") <= MOST_GROUP)
    kept = stage(first.select(*key, F.struct("i", "id", "statement", "unit", "v").alias("f")), "first-of-groups")
    a, b, c = (kept.withColumnRenamed("f", n) for n in "abc")
    pairs = a.join(b, key).where("a.i < b.i and a.v + b.v <> 0")
    gap = F.abs(F.col("a.v") + F.col("b.v") - F.col("c.v"))
    off = gap / F.abs(F.col("c.v")) * 100
    holds = (off <= tolerance_pct) & (gap / F.least(F.abs("a.v"), F.abs("b.v")) * 100 <= SMALL_PART_PCT)
    unit = lambda s: F.lower(strip(F.coalesce(F.col(f"{s}.unit"), F.lit(""))))
    ratio = F.abs((F.col("a.v") + F.col("b.v")) / F.col("c.v"))
    mixed = (unit("a") != unit("b")) | (unit("b") != unit("c"))
    shifted = mixed & (F.abs(F.log10(ratio)) > 0.9) & (F.abs(F.log10(ratio) - F.round(F.log10(ratio))) < 0.01)
    triples = pairs.join(c, key).where("c.i <> a.i and c.i <> b.i").where(holds | shifted)
    told = [*key, *[F.col(f"{s}.id").alias(f"{s}_id") for s in "abc"], *[F.col(f"{s}.v").alias(f"{s}_value") for s in "abc"], *[F.col(f"{s}.statement").alias(f"{s}_statement") for s in "abc"]]
    identities = _once(triples.where(holds)).select(*told, F.round(off, 3).alias("error_pct"))
    factor = power_of_ten(ratio)
    alone = first_of([((unit("a") != unit("b")) & (unit("a") != unit("c")), F.col("a.id")), ((unit("b") != unit("a")) & (unit("b") != unit("c")), F.col("b.id"))], F.col("c.id"))
    anomalies = _once(triples.where(~holds & mixed).withColumn("factor", factor).where("factor is not null")).select(*told, F.round("factor", 4).alias("factor"), alone.alias("suspect_id"))
    return Arithmetic(identities, anomalies, summary)
