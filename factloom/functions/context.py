"""Reporting periods and scopes: parsing and comparing, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.numbers import blank, first_of, let, strip

SAME, DIFFERENT, OVERLAPPING, UNKNOWN = "same", "different", "overlapping", "unknown"

# Fixed values.
RELATIVE = ("current period", "current year", "current quarter", "this year", "previous year", "prior year", "last year", "preceding year", "previous period", "prior period", "year ago", "corresponding period", "to date", "ytd", "year to date")
MONTHS = (
    ("january", 1), ("february", 2), ("march", 3), ("april", 4), ("may", 5), ("june", 6), ("july", 7), ("august", 8), ("september", 9), ("october", 10), ("november", 11), ("december", 12),
    ("jan", 1), ("feb", 2), ("mar", 3), ("apr", 4), ("jun", 6), ("jul", 7), ("aug", 8), ("sep", 9), ("sept", 9), ("oct", 10), ("nov", 11), ("dec", 12),
)
SCOPE_STOP = ("the", "a", "an", "of", "for", "in", "on", "at", "to", "and", "or", "is", "as", "by", "with", "from", "basis", "level")
AXES = (
    ("scope", ("consolidated", "group"), ("standalone", "separate", "company", "entity")),
    ("scope", ("gross",), ("net",)),
    ("scope", ("continuing",), ("discontinued",)),
    ("scope", ("annual", "yearly"), ("quarterly", "interim")),
    ("basis", ("current",), ("historical", "prior", "restated")),
    ("basis", ("actual", "reported"), ("estimated", "forecast", "projected", "budgeted")),
)
PERIOD = "struct<label:string,kind:string,year:int,quarter:int,half:int,month:int,day:int,span_start:int,span_end:int>"


def _year(digits: Column) -> Column:
    """years below 70 are in the 2000s, others of two digits in the 1900s."""
    return let(F.when(digits != "", digits).cast("int"), lambda n: first_of([(n >= 100, n), (n < 70, n + 2000)], n + 1900))


def _period(label: Column, kind: str, **parts: Column) -> Column:
    names = ("year", "quarter", "half", "month", "day", "span_start", "span_end")
    return F.struct(label.alias("label"), F.lit(kind).alias("kind"), *[parts.get(n, F.lit(None)).cast("int").alias(n) for n in names])


def _month(tail: Column) -> Column:
    found = F.regexp_extract(tail, rf"(?U)\b({'|'.join(m for m, _ in MONTHS)})\b", 1)
    return F.get(F.array(*[F.lit(n) for _, n in MONTHS]), F.array_position(F.array(*[F.lit(m) for m, _ in MONTHS]), found).cast("int") - 1)


def _dated(label: Column, s: Column, kind: str, marker: str) -> tuple[Column, Column]:
    """Condition and period of a date after ``marker``; the month must be named."""
    tail = F.regexp_extract(s, marker + "(.*)$", 1)
    month, year = _month(tail), F.regexp_extract(tail, r"(?U)\b(\d{4})\b", 1)
    day = F.regexp_extract(tail, r"(?U)\b(\d{1,2})\b", 1).try_cast("int")
    return s.rlike(marker) & month.isNotNull() & (year != ""), _period(label, kind, year=year.try_cast("int"), month=month, day=F.when(day <= 31, day))


def parse_period(text: Column | str, compat: bool = False) -> Column:
    """struct (label, kind, year, quarter, half, month, day, span_start, span_end), or null if there
    is none. Rules are tried in order. Without ``compat``, a date in digits is a day and no span of years.
    """
    told = strip((F.col(text) if isinstance(text, str) else text).cast("string"))
    return let(told, lambda raw: let(F.translate(F.lower(raw), "–—", "--"), lambda s: _parsed(raw, s, compat)))


def _parsed(raw: Column, s: Column, compat: bool) -> Column:
    relative = s.contains(RELATIVE[0])
    for term in RELATIVE[1:]:
        relative = relative | s.contains(term)

    quarter = F.regexp_extract(s, r"(?U)\bq([1-4])\b", 1)
    rest = F.regexp_extract(s, r"(?U)^.*?\bq[1-4]\b(.*)$", 1)
    quarter_year = F.regexp_extract(F.when(rest == "", s).otherwise(rest), r"(?U)\b(?:fy\s*)?(\d{2,4})\b", 1)
    half_before, half_after = r"(?U)\bhy?([12])\s*(?:fy)?\s*(\d{2,4})\b", r"(?U)\b([12])h\s*(?:fy)?\s*(\d{2,4})\b"
    full_year = F.regexp_extract(s, r"(?U)\b((?:19|20)\d{2})\b", 1)
    words = F.when(s.contains("first half"), 1).when(s.contains("second half"), 2).when(s.contains("1st half"), 1).when(s.contains("2nd half"), 2)
    span = r"(?U)\b(?:fy|fiscal(?:\s+year)?)?\s*(\d{4}|\d{2})\s*-\s*(\d{4}|\d{2})\b"
    start, end = _year(F.regexp_extract(s, span, 1)), _year(F.regexp_extract(s, span, 2))
    end = F.when(end < start, start + 1).otherwise(end)
    fiscal = r"(?U)\b(?:fy|fiscal(?:\s+year)?)\s*(\d{2,4})\b"
    fiscal_year = _year(F.regexp_extract(s, fiscal, 1))
    iso, dmy = r"(?U)\b(\d{4})-(\d{1,2})-(\d{1,2})\b", r"(?U)\b(\d{1,2})-(\d{1,2})-(\d{4})\b"

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(s, pattern, i).try_cast("int")

    dates = [] if compat else [
        (s.rlike(iso), _period(raw, "as_of", year=part(iso, 1), month=part(iso, 2), day=part(iso, 3))),
        (s.rlike(dmy), _period(raw, "as_of", year=part(dmy, 3), month=part(dmy, 2), day=part(dmy, 1))),
    ]
    rules = [
        (blank(raw), F.lit(None).cast(PERIOD)),
        (relative, _period(raw, "relative")),
        (quarter != "", _period(raw, "quarter", quarter=quarter.try_cast("int"), year=_year(quarter_year))),
        (s.rlike(half_before), _period(raw, "half_year", half=part(half_before, 1), year=_year(F.regexp_extract(s, half_before, 2)))),
        (s.rlike(half_after), _period(raw, "half_year", half=part(half_after, 1), year=_year(F.regexp_extract(s, half_after, 2)))),
        (words.isNotNull(), _period(raw, "half_year", half=words, year=full_year.try_cast("int"))),
        _dated(raw, s, "as_of", r"(?U)\bas\s+(?:of|at|on)\b"),
        _dated(raw, s, "period_end", r"(?U)\b(?:year\s+)?end(?:ed|ing)\b"),
        *dates,
        (s.rlike(span), _period(raw, "fiscal_year", year=end, span_start=start, span_end=end)),
        (s.rlike(fiscal), _period(raw, "fiscal_year", year=fiscal_year, span_start=fiscal_year - 1, span_end=fiscal_year)),
        (full_year != "", _period(raw, "calendar_year", year=full_year.try_cast("int"))),
    ]
    return first_of(rules, F.lit(None).cast(PERIOD))


def describe_period(p: Column) -> Column:
    """a short name."""
    year = F.coalesce(p["year"].cast("string"), F.lit("?"))
    date = F.concat_ws("-", year, F.lpad(p["month"].cast("string"), 2, "0"), F.lpad(p["day"].cast("string"), 2, "0"))
    return first_of(
        [
            (p["kind"] == "quarter", F.concat(F.lit("Q"), p["quarter"].cast("string"), F.lit(" "), year)),
            (p["kind"] == "half_year", F.concat(F.lit("H"), p["half"].cast("string"), F.lit(" "), year)),
            (p["kind"] == "as_of", F.concat(F.lit("as of "), date)),
            (p["kind"] == "period_end", F.concat(F.lit("period ended "), date)),
            (p["kind"] == "fiscal_year", F.concat(F.lit("FY"), year)),
            (p["kind"] == "relative", p["label"]),
        ],
        year,
    )


def compare_parsed_periods(a: Column, b: Column) -> Column:
    """F13 over parsed periods."""
    return let(a, lambda x: let(b, lambda y: related(x, y, describe_period(x), describe_period(y))))


def related(a: Column, b: Column, name_a: Column, name_b: Column) -> Column:
    """F13 over parsed periods and their names, all columns that are there already."""

    def says(relation: str, *detail: Column | str) -> Column:
        return F.struct(F.lit(relation).alias("relation"), F.coalesce(F.concat(*[F.lit(d) if isinstance(d, str) else d for d in detail]), F.lit("")).alias("detail"))

    both = (name_a, F.lit(" and "), name_b)

    def within(p: Column) -> Column:
        return F.coalesce(((p["kind"] == "quarter") & p["quarter"].isNotNull()) | ((p["kind"] == "half_year") & p["half"].isNotNull()), F.lit(False))

    sub_a, sub_b = within(a), within(b)
    fiscal_a, fiscal_b = a["kind"].isin("fiscal_year", "period_end"), b["kind"].isin("fiscal_year", "period_end")
    dated = a["kind"].isin("as_of", "period_end") & b["kind"].isin("as_of", "period_end")
    one_kind = a["kind"] == b["kind"]
    part = F.coalesce(a["quarter"], a["half"]).eqNullSafe(F.coalesce(b["quarter"], b["half"]))
    return first_of(
        [
            (a.isNull() | b.isNull(), says(UNKNOWN, "a reporting period is missing or cannot be read")),
            ((a["kind"] == "relative") | (b["kind"] == "relative"), says(UNKNOWN, "a period depends on an unstated date: ", *both)),
            (a["year"].isNull() | b["year"].isNull(), says(UNKNOWN, "a period has no year")),
            (a["year"] != b["year"], says(DIFFERENT, "periods differ: ", *both)),
            (sub_a & sub_b & one_kind & part, says(SAME, "both cover ", name_a)),
            (sub_a & sub_b & one_kind, says(DIFFERENT, "parts of the year differ: ", *both)),
            (sub_a | sub_b, says(OVERLAPPING, "one is a part of the other: ", *both)),
            ((fiscal_a & (b["kind"] == "calendar_year")) | (fiscal_b & (a["kind"] == "calendar_year")), says(OVERLAPPING, "a fiscal and a calendar year share a number: ", *both)),
            (dated & ~(a["month"].eqNullSafe(b["month"]) & a["day"].eqNullSafe(b["day"])), says(DIFFERENT, "dates differ: ", *both)),
            (dated & one_kind, says(SAME, "both are dated ", name_a)),
            (dated, says(OVERLAPPING, "a balance on a date and a period that ends on it: ", *both)),
        ],
        says(SAME, "both cover ", name_a),
    )


def compare_periods(a: Column | str, b: Column | str, compat: bool = False) -> Column:
    """struct (relation, detail)."""
    return compare_parsed_periods(parse_period(a, compat), parse_period(b, compat))


def scope_tokens(text: Column | str) -> Column:
    """different words of over two characters that are no stop words."""
    s = F.lower(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")))
    return F.array_distinct(F.filter(F.split(s, r"(?U)\W+"), lambda w: (F.length(w) > 2) & ~w.isin(*SCOPE_STOP)))


def scope_sides(tokens: Column) -> Column:
    """The sides of the axes that the words name, as bits: two for each axis."""
    words = [side for _, *sides in AXES for side in sides]
    return sum((F.when(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in side])), 1 << i).otherwise(0) for i, side in enumerate(words)), F.lit(0))


def compare_scopes(a: Column | str, b: Column | str) -> Column:
    """struct (relation, detail, dimension). All axes are tried for contrast before any for synonyms."""
    ra, rb = ((F.col(c) if isinstance(c, str) else c).cast("string") for c in (a, b))
    return let(scope_tokens(a), lambda x: let(scope_tokens(b), lambda y: let(scope_sides(x), lambda sx: let(scope_sides(y), lambda sy: scoped(x, y, sx, sy, ra, rb)))))


def scoped(x: Column, y: Column, sx: Column, sy: Column, ra: Column, rb: Column) -> Column:
    """F15 over the words and sides of both scopes, all columns that are there already."""

    def says(relation: str, dimension: str, detail: str) -> Column:
        told = F.concat(F.lit(detail + ": "), F.coalesce(ra, F.lit("none")), F.lit(" and "), F.coalesce(rb, F.lit("none")))
        return F.struct(F.lit(relation).alias("relation"), told.alias("detail"), F.lit(dimension).alias("dimension"))

    def has(s: Column, bit: int) -> Column:
        return s.bitwiseAND(F.lit(1 << bit)) != 0

    contrast = [((has(sx, 2 * i) & has(sy, 2 * i + 1)) | (has(sx, 2 * i + 1) & has(sy, 2 * i)), says(DIFFERENT, dim, f"opposite {dim}")) for i, (dim, *_) in enumerate(AXES)]
    synonyms = [(has(sx, 2 * i + k) & has(sy, 2 * i + k), says(SAME, dim, f"two names of one {dim}")) for i, (dim, *_) in enumerate(AXES) for k in (0, 1)]
    return first_of(
        [
            ((F.size(x) == 0) | (F.size(y) == 0), says(UNKNOWN, "scope", "a scope is missing")),
            (F.array_sort(x) == F.array_sort(y), says(SAME, "scope", "one scope")),
            *contrast,
            *synonyms,
            (F.arrays_overlap(x, y), says(OVERLAPPING, "scope", "scopes agree in part")),
        ],
        says(DIFFERENT, "scope", "scopes differ"),
    )


def describe_context(period: Column, scope: Column) -> Column:
    """F16: a line for each dimension, for a prompt."""
    return F.concat_ws("\n", F.concat(F.lit("period: "), period["relation"], F.lit(" - "), period["detail"]), F.concat(F.lit("scope: "), scope["relation"], F.lit(" - "), scope["detail"]))
