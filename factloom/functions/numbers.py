"""Numbers and units: parsing, normalising and comparing, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SCALES = (("crore", 1e7), ("crores", 1e7), ("cr", 1e7), ("lakh", 1e5), ("lakhs", 1e5), ("lac", 1e5), ("billion", 1e9), ("bn", 1e9), ("million", 1e6), ("mn", 1e6), ("thousand", 1e3))
PERCENT = ("%", "percent", "percentage", "pct", "percentage points", "pp", "bps")
CURRENCIES = (("inr", ("₹", "rs", "rs.", "inr", "rupee", "rupees")), ("usd", ("$", "usd", "dollar", "dollars")), ("eur", ("€", "eur", "euros")), ("gbp", ("£", "gbp", "pounds")))
PAREN_NUMBER = r"\(\s*-?\d[\d.,]*\d?\s*%?\s*\)"
#: A number ends on a digit; the compatible form also takes a separator behind it.
NUMBER, NUMBER_COMPAT = r"-?\d(?:[\d.,]*\d)?", r"-?\d[\d.,]*\d?"
TOLERANCE_PCT, SUSPECT_RATIO = 2.0, 100.0


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once: a Column that is used many times would be copied into the plan
    each time, and nested copies multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_of(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """A decision list: the value of the first rule whose condition is true."""
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), otherwise)


def parse_locale_number(text: Column | str) -> Column:
    """a number in either separator convention, else null.

    With both separators the later one is the decimal point; a repeated separator groups thousands; a
    single comma groups thousands and a single point is decimal.
    """
    return _locale_number(F.trim(strip(_s(text))))


def _locale_number(s: Column) -> Column:
    """Of a text without white space at its ends. (It is short, so looking at it again costs less than a lambda.)"""
    comma, dot = s.contains(","), s.contains(".")
    # A point is dropped and a comma becomes the point; points alone are dropped if there are several; else commas are.
    plain = first_of([(comma & dot & s.rlike(r",[^.,]*$"), F.translate(s, ",.", ".")), (~comma & s.rlike(r"\..*\."), F.translate(s, ".", ""))], F.translate(s, ",", ""))
    return F.when(plain.rlike(r"^[+-]*(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.regexp_replace(plain, r"^[+-]+", "").try_cast("double") * F.when(s.startswith("-"), -1.0).otherwise(1.0))


def number_tokens(text: Column | str, compat: bool = False) -> Column:
    """numbers of a text; those in parentheses first, as negatives, then the others in order."""
    plain = NUMBER_COMPAT if compat else NUMBER
    s = F.coalesce(_s(text), F.lit(""))
    outside = lambda s: F.transform(F.regexp_extract_all(s, F.lit(plain), F.lit(0)), _locale_number)
    inside = F.transform(F.regexp_extract_all(s, F.lit(PAREN_NUMBER), F.lit(0)), lambda t: -F.abs(_locale_number(F.regexp_extract(t, plain, 0))))
    both = F.concat(inside, outside(F.regexp_replace(s, PAREN_NUMBER, "(")))
    return F.array_compact(F.when(s.contains("("), both).otherwise(outside(s)))


def _bare(unit: Column) -> Column:
    return F.regexp_replace(F.lower(strip(unit)), r"\.+$", "")


def is_percent_unit(unit: Column | str) -> Column:
    """F3; false for null."""
    return let(_bare(_s(unit)), lambda s: F.coalesce(s.isin(*PERCENT) | s.endswith("%"), F.lit(False)))


def clean_unit(unit: Column | str) -> Column:
    """lower case, currencies under one name, no commas or points, single spaces."""
    s = F.lower(strip(_s(unit)))
    names = sorted(((alias, to) for to, aliases in CURRENCIES for alias in aliases), key=lambda x: -len(x[0]))
    for alias, to in names:
        left, right = r"(?<![0-9a-z])" if alias[0].isalnum() else "", r"(?![0-9a-z])" if alias[-1].isalnum() else ""
        s = F.regexp_replace(s, f"{left}\\Q{alias}\\E{right}", to)
    return strip(F.regexp_replace(F.regexp_replace(s, "[,.]", ""), r"(?U)\s+", " "))


def _scaled(unit: Column) -> Column:
    """Struct of the unit's scale and what is left of it, without the longest scale word."""
    return let(clean_unit(unit), _scale_of)


def _scale_of(cleaned: Column) -> Column:
    rules = [
        (cleaned.rlike(rf"(?U)\b{word}\b"), F.struct(F.lit(scale).alias("scale"), strip(F.regexp_replace(F.regexp_replace(cleaned, rf"(?U)^(.*?)\b{word}\b", "$1"), r"(?U)\s+", " ")).alias("rest")))
        for word, scale in sorted(SCALES, key=lambda x: -len(x[0]))
    ]
    return first_of(rules, F.struct(F.lit(1.0).alias("scale"), cleaned.alias("rest")))


def normalize_unit(value: Column | str, unit: Column | str) -> Column:
    """struct (value, base_unit, original_unit), or null without a value or a unit."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")

    def other(u: Column, scaled: Column) -> Column:
        return F.struct((v * scaled["scale"]).alias("value"), F.when(scaled["rest"] == "", "unit").otherwise(scaled["rest"]).alias("base_unit"), u.alias("original_unit"))

    def normal(u: Column) -> Column:
        percent = F.struct((F.when(_bare(u) == "bps", v * 0.01).otherwise(v)).alias("value"), F.lit("%").alias("base_unit"), u.alias("original_unit"))
        return F.when(v.isNotNull() & ~blank(u), F.when(is_percent_unit(u), percent).otherwise(let(_scaled(u), lambda s: other(u, s))))

    return let(strip(_s(unit)), normal)


def compare_normalized(na: Column, nb: Column, va: Column, vb: Column, tolerance_pct: float = TOLERANCE_PCT) -> Column:
    """F6 over values that are normalised already; see ``compare_values``."""
    return let(na, lambda x: let(nb, lambda y: compared(x, y, va, vb, tolerance_pct)))


def compared(na: Column, nb: Column, va: Column, vb: Column, tolerance_pct: float = TOLERANCE_PCT) -> Column:
    """F6 over normalised values that are columns already."""
    a, b = na["value"], nb["value"]
    comparable = F.coalesce(na["base_unit"] == nb["base_unit"], F.lit(False))
    high, low = F.greatest(F.abs(a), F.abs(b)), F.least(F.abs(a), F.abs(b))
    diff = F.when(a == b, 0.0).otherwise(F.abs(a - b) / high * 100)
    reason = first_of(
        [
            (va.isNull() | vb.isNull(), F.lit("a value is missing")),
            (na.isNull() | nb.isNull(), F.lit("a unit is missing or unknown")),
            (~comparable, F.concat(F.lit("units do not convert: "), na["base_unit"], F.lit(" and "), nb["base_unit"])),
        ],
        F.concat(F.lit("both in "), na["base_unit"]),
    )
    return F.struct(
        comparable.alias("comparable"),
        reason.alias("reason"),
        F.when(comparable, a).alias("value_a"),
        F.when(comparable, b).alias("value_b"),
        F.when(comparable, na["base_unit"]).alias("common_unit"),
        F.when(comparable, F.round(diff, 3)).alias("diff_pct"),
        F.when(comparable, diff <= tolerance_pct).alias("agree"),
        F.coalesce(comparable & (low > 0) & (high / low >= SUSPECT_RATIO), F.lit(False)).alias("magnitude_suspect"),
    )


def compare_values(va: Column | str, ua: Column | str, vb: Column | str, ub: Column | str, tolerance_pct: float = TOLERANCE_PCT) -> Column:
    """struct (comparable, reason, value_a, value_b, common_unit, diff_pct, agree, magnitude_suspect).

    Values compare if both normalise to one base unit. They agree if their difference, as a share of the
    larger, is within the tolerance before rounding; a ratio of 100 or more looks like a lost scale.
    """
    x, y = (F.col(c) if isinstance(c, str) else c for c in (va, vb))
    return compare_normalized(normalize_unit(x, ua), normalize_unit(y, ub), x, y, tolerance_pct)


def short_number(x: Column) -> Column:
    """A number with up to six significant digits and no trailing zeros."""
    return let(x, _short)


def _short(x: Column) -> Column:
    whole = (F.abs(x) >= 1e-4) & (F.abs(x) < 1e6)
    fixed = F.regexp_replace(F.format_string("%.6g", x), r"(\.\d*?)0+$", "$1")
    wide = F.regexp_replace(F.format_string("%.5e", x), r"\.?0*e", "e")
    return first_of([(x == 0, F.lit("0")), (whole, F.regexp_replace(fixed, r"\.$", ""))], wide)


def describe_comparison(c: Column) -> Column:
    """a sentence for a prompt."""
    same = F.concat(F.lit("values match within tolerance: "), short_number(c["value_a"]), F.lit(" and "), short_number(c["value_b"]), F.lit(" "), c["common_unit"], F.lit(" ("), short_number(c["diff_pct"]), F.lit("% apart)"))
    apart = F.concat(F.lit("values differ: "), short_number(c["value_a"]), F.lit(" and "), short_number(c["value_b"]), F.lit(" "), c["common_unit"], F.lit(" ("), short_number(c["diff_pct"]), F.lit("% apart)"))
    return first_of([(~c["comparable"], F.concat(F.lit("values cannot be compared: "), c["reason"])), (c["agree"], same)], apart)


def numeric_fallback(value: Column | str) -> Column:
    """F8: the first number of a value, unless the value is only a period's label."""
    s = F.lower(strip(_s(value)))
    return F.when(~s.rlike(r"^(fy|q[1-4]|h[1-2]|fiscal(\s+year)?|quarter)\s*[\d\s/-]*$"), F.get(number_tokens(value), F.lit(0)))


def power_of_ten(ratio: Column, tolerance: float = 0.005) -> Column:
    """the power of ten, 10^±1 to 10^±9, that the ratio is within the tolerance of, else null."""
    exponents = F.array(*[F.lit(float(s * e)) for e in range(1, 10) for s in (1, -1)])
    near = F.filter(exponents, lambda e: F.abs(ratio / F.pow(F.lit(10.0), e) - 1) <= tolerance)
    return F.when(F.size(near) > 0, F.pow(F.lit(10.0), F.get(near, F.lit(0))))
