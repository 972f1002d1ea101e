"""Timelines of one metric over distinct periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.context import OVERLAPPING, related
from factloom.functions.numbers import strip
from factloom.operators.compare import scaled, with_periods, with_units
from factloom.operators.graph import components
from factloom.scratch import stage

CHAINS = ("corroborates", "reconciled")


def chain_edges(facts: DataFrame, rels: DataFrame, compat: bool = False) -> DataFrame:
    """``(a, b)`` of edges that carry a metric on: both facts exist, their periods do not overlap, and
    both or neither are parts of a year."""
    p = stage(with_periods(facts.select("id", "time_period"), compat, p="time_period").select("id", "p"), "fact-periods")
    x, y = p.select(F.col("id").alias("fact_id_a"), F.col("p").alias("x")), p.select(F.col("id").alias("fact_id_b"), F.col("p").alias("y"))
    both = rels.where(F.col("relation_type").isin(*CHAINS)).select("fact_id_a", "fact_id_b").join(x, "fact_id_a").join(y, "fact_id_b")
    part = lambda q: F.coalesce(F.col(f"{q}.period.kind").isin("quarter", "half_year"), F.lit(False))
    told = related(F.col("x.period"), F.col("y.period"), F.col("x.name"), F.col("y.name"))["relation"]
    return both.where((told != OVERLAPPING) & (part("x") == part("y"))).select(F.col("fact_id_a").alias("a"), F.col("fact_id_b").alias("b"))


def points(facts: DataFrame, rels: DataFrame, least: int = 2, compat: bool = False) -> DataFrame:
    """``(timeline, fact_id, document_id, period_label, year, half, quarter, value, base_unit,
    scope_used, pct_change, n_points)``; ``timeline`` is the smallest fact id of its component.

    Of facts on one period the first of the preferred scope stands, else the first; the preferred scope and
    the unit are the most frequent ones, ties to the smaller name. Components and points below ``least``
    are dropped at each step. All windows are over a timeline, whose points one task holds.
    """
    member = components(chain_edges(facts, rels, compat)).withColumnRenamed("component", "timeline")
    own = member.join(facts.select(F.col("id").alias("node"), "document_id", "scope", "time_period", F.col("value_numeric").alias("v"), "unit"), "node")
    dated = with_units(with_periods(stage(own, "members"), compat, p="time_period"), u="unit").withColumn("n", scaled(F.col("v"), F.col("u")))
    p = F.col("p.period")
    dated = dated.where(p["year"].isNotNull() & (p["kind"] != "relative") & F.col("n").isNotNull()).select("timeline", F.col("node").alias("fact_id"), "document_id", F.col("p.name").alias("period_label"), p["year"].alias("year"), F.coalesce(p["half"], F.lit(0)).alias("half"), F.coalesce(p["quarter"], F.lit(0)).alias("quarter"), F.col("n.value").alias("value"), F.col("n.base_unit").alias("base_unit"), F.lower(strip(F.coalesce("scope", F.lit("")))).alias("scope_key"))

    line = Window.partitionBy("timeline")

    def enough(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_c", F.count("*").over(line)).where(F.col("_c") >= least).drop("_c")

    def mode(rows: DataFrame, column: str, name: str, empty: bool) -> DataFrame:
        """The most frequent value of the timeline, without the empty one unless it counts."""
        many = F.count("*").over(Window.partitionBy("timeline", column))
        named = F.lit(True) if empty else F.col(column) != ""
        return rows.withColumn("_m", F.when(named, F.struct((-many).alias("c"), F.col(column).alias("v")))).withColumn(name, F.min("_m").over(line)["v"]).drop("_m")

    scoped = mode(enough(dated), "scope_key", "scope_used", False)
    first = Window.partitionBy("timeline", "year", "half", "quarter").orderBy(F.desc(F.coalesce(F.col("scope_key") == F.col("scope_used"), F.lit(False))), "fact_id")
    single = enough(scoped.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"))
    one_unit = enough(mode(single, "base_unit", "_unit", True).where(F.col("base_unit") == F.col("_unit")).drop("_unit"))
    time = line.orderBy("year", "half", "quarter")
    before = F.lag("value").over(time)
    change = F.when(before != 0, F.round((F.col("value") - before) / F.abs(before) * 100, 2))
    return one_unit.withColumn("pct_change", change).withColumn("n_points", F.count("*").over(line)).select("timeline", "fact_id", "document_id", "period_label", "year", "half", "quarter", "value", "base_unit", "scope_used", "pct_change", "n_points")


def timelines(found: DataFrame, facts: DataFrame, rels: DataFrame) -> DataFrame:
    """A row for each timeline, longest first, with its label and its points nested. The label comes
    from the member with the longest subject and attribute, ties to the smaller id."""
    member = components(chain_edges(facts, rels)).withColumnRenamed("component", "timeline")
    length = F.length(F.coalesce("subject", F.lit(""))) + F.length(F.coalesce("attribute", F.lit("")))
    label = member.join(facts.select(F.col("id").alias("node"), "subject", "attribute", length.alias("len")), "node").groupBy("timeline").agg(F.min(F.struct((-F.col("len")).alias("l"), "node", "subject", "attribute")).alias("m")).select("timeline", F.concat_ws(" - ", "m.subject", "m.attribute").alias("label"))
    nested = found.groupBy("timeline").agg(F.array_sort(F.collect_list(F.struct("year", "half", "quarter", "fact_id", "period_label", "value", "pct_change"))).alias("points"), F.first("base_unit").alias("base_unit"), F.first("scope_used").alias("scope_used"), F.count("*").alias("n_points"), F.min("fact_id").alias("first_fact_id"))
    return nested.join(label, "timeline").orderBy(F.desc("n_points"), "first_fact_id")
