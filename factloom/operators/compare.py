"""Comparing and adjudicating whole tables of pairs (F5, F6, F10, F13, F15, X).

Tables name few different units, periods and scopes, however many rows they have. So each different text is read once,
in a small table that is joined back (broadcast while it is counted to be small, else shuffled); what is left for each
row is plain arithmetic on columns. The functions in ``factloom.functions`` do the same for one row at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.context import describe_period, parse_period, related, scope_sides, scope_tokens, scoped
from factloom.functions.numbers import TOLERANCE_PCT, compared, let, normalize_unit
from factloom.operators.adjudicate import decide, result
from factloom.scratch import checked_broadcast, stage

#: Different texts that are broadcast, with what they were read as.
TEXTS = 100_000


def once(df: DataFrame, columns: dict[str, Column | str], read: Callable[[Column], Column], label: str) -> DataFrame:
    """``df`` with a column for each of ``columns``, whose text ``read`` has turned into something else: each different text
    is read once. A null text gives what ``read`` makes of null."""
    text = {name: (F.col(c) if isinstance(c, str) else c).cast("string") for name, c in columns.items()}
    different = df.select(F.explode(F.array(*text.values())).alias("text")).distinct()
    side = checked_broadcast(stage(different.select("text", read(F.col("text")).alias("made")), label), TEXTS)
    keyed = df.select("*", *[c.alias(f"_{name}_text") for name, c in text.items()])
    for name in columns:
        own = side.select(F.col("text").alias(f"_{name}_own"), F.col("made").alias(name))
        keyed = keyed.join(own, F.col(f"_{name}_text").eqNullSafe(F.col(f"_{name}_own")), "left").drop(f"_{name}_own", f"_{name}_text")
    return keyed


def with_units(df: DataFrame, **columns: Column | str) -> DataFrame:
    """for each name a struct (value, base_unit, original_unit) of one such unit: a value times ``value`` is in the
    base unit. Null for a blank unit."""
    return once(df, columns, lambda u: normalize_unit(F.lit(1.0), u), "units")


def scaled(value: Column, unit: Column) -> Column:
    """F5 of a value whose unit ``with_units`` has read."""
    return F.when(value.isNotNull() & unit.isNotNull(), F.struct((value.cast("double") * unit["value"]).alias("value"), unit["base_unit"].alias("base_unit"), unit["original_unit"].alias("original_unit")))


def with_periods(df: DataFrame, compat: bool = False, **columns: Column | str) -> DataFrame:
    """for each name a struct (period, name), whose fields are null if the text names no period."""
    return once(df, columns, lambda t: let(parse_period(t, compat), lambda p: F.struct(p.alias("period"), F.when(p.isNotNull(), describe_period(p)).alias("name"))), "periods")


def with_scopes(df: DataFrame, **columns: Column | str) -> DataFrame:
    """for each name a struct (text, words, sides)."""
    return once(df, columns, lambda t: let(scope_tokens(t), lambda w: F.struct(t.alias("text"), w.alias("words"), scope_sides(w).alias("sides"))), "scopes")


def compare_pairs(pairs: DataFrame, a: dict[str, Column], b: dict[str, Column], tolerance_pct: float = TOLERANCE_PCT, compat: bool = False) -> DataFrame:
    """``pairs`` with ``comparison``, ``period`` and ``scope``. ``a`` and ``b`` give for each side its ``value``,
    ``unit``, ``time_period`` and ``scope``; those that are missing on both sides are not compared."""
    out = pairs
    if "value" in a:
        out = with_units(out, _ua=a["unit"], _ub=b["unit"])
        out = out.withColumns({"_na": scaled(a["value"], F.col("_ua")), "_nb": scaled(b["value"], F.col("_ub"))})
        out = out.withColumn("comparison", compared(F.col("_na"), F.col("_nb"), a["value"], b["value"], tolerance_pct)).drop("_ua", "_ub", "_na", "_nb")
    if "time_period" in a:
        out = with_periods(out, compat, _pa=a["time_period"], _pb=b["time_period"])
        out = out.withColumn("period", related(F.col("_pa.period"), F.col("_pb.period"), F.col("_pa.name"), F.col("_pb.name"))).drop("_pa", "_pb")
    if "scope" in a:
        out = with_scopes(out, _sa=a["scope"], _sb=b["scope"])
        out = out.withColumn("scope", scoped(F.col("_sa.words"), F.col("_sb.words"), F.col("_sa.sides"), F.col("_sb.sides"), F.col("_sa.text"), F.col("_sb.text"))).drop("_sa", "_sb")
    return out


def adjudicate_pairs(pairs: DataFrame, llm: Column, caveat: Column, both_numeric: Column, slice_a: Column | None = None, slice_b: Column | None = None) -> DataFrame:
    """``pairs`` with ``comparison``, ``period`` and ``scope`` judged: adds ``adj``, as ``adjudicate`` gives it."""
    none = F.lit(None).cast("string")
    given = {"_llm": llm, "_caveat": caveat, "_both": both_numeric, "_slice_a": none if slice_a is None else slice_a, "_slice_b": none if slice_b is None else slice_b}
    named = pairs.withColumns(given)
    g = {"llm": F.col("_llm"), "comparison": F.col("comparison"), "period": F.col("period"), "scope": F.col("scope"), "caveat": F.col("_caveat"), "both_numeric": F.col("_both"), "slice_a": F.col("_slice_a"), "slice_b": F.col("_slice_b")}
    chosen = named.withColumn("_chosen", decide(g["llm"], g["comparison"], g["period"], g["scope"], g["caveat"], g["both_numeric"]))
    return chosen.withColumn("adj", result(F.col("_chosen"), g)).drop("_chosen", *given)
