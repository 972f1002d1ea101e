"""Strings, hashes and similarity, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.numbers import first_of, let, strip

# Fixed values.
STOPWORDS = ("the", "a", "an", "of", "for", "in", "on", "at", "to", "and", "or", "is", "was", "were", "as", "by", "with", "from", "its", "their", "this", "that", "total")
PAIR_FIELDS = ("subject", "attribute", "value", "unit", "time_period", "scope", "statement", "quote")


def _c(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def hash_text(*parts: Column | str) -> Column:
    """sha256 over the parts, each with a zero byte behind it; null counts as empty."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(_c(p), F.lit("")), F.lit("\x00"))]), 256)


def hash_bytes(content: Column | str) -> Column:
    """sha256 of a file's bytes."""
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def pair_signature(fact: Column) -> Column:
    """the fact's content in one string, by which pairs are put in order."""
    return F.array_join(F.array(*[F.coalesce(fact[f].cast("string"), F.lit("")) for f in PAIR_FIELDS]), "|")


def pair_hash(a: Column, b: Column) -> Column:
    """one hash for both orders of a pair."""
    x, y = pair_signature(a), pair_signature(b)
    return hash_text(F.least(x, y), F.greatest(x, y))


def tokens(text: Column | str) -> Column:
    """different lower-case words of letters and digits, without stop words and single characters."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS)))


def jaccard_of(a: Column, b: Column) -> Column:
    """F20 over token arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    return let(tokens(a), lambda x: let(tokens(b), lambda y: jaccard_of(x, y)))


def entity_similarity(a: Column | str, b: Column | str) -> Column:
    """1 for equal names, 0.85 if one holds the other, else the words' Jaccard index; 0 without a name."""
    x, y = F.lower(strip(F.coalesce(_c(a), F.lit("")))), F.lower(strip(F.coalesce(_c(b), F.lit(""))))
    return let(x, lambda x: let(y, lambda y: first_of([((x == "") | (y == ""), F.lit(0.0)), (x == y, F.lit(1.0)), (x.contains(y) | y.contains(x), F.lit(0.85))], jaccard(x, y))))


def _collapsed(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def quote_position(text: Column | str, quote: Column | str) -> Column:
    """where the quote stands in the text, as it is or with white space collapsed, from 0; else -1.
    A null or blank quote is nowhere."""
    t, q = F.coalesce(_c(text), F.lit("")), F.coalesce(_c(quote), F.lit(""))
    exact = F.position(q, t)
    return first_of([(strip(q) == "", F.lit(-1)), (exact > 0, exact - 1)], F.position(_collapsed(q), _collapsed(t)) - 1).cast("int")


def fingerprint(*parts: str) -> Column:
    """the first 16 digits of the settings' hash."""
    return F.substring(hash_text(*[F.lit(p) for p in parts]), 1, 16)


def display_name(name: Column | str) -> Column:
    """a file's name without upload prefixes and without ``.pdf``."""
    return F.regexp_replace(F.regexp_replace(_c(name), r"^([0-9a-f]{32}_)+", ""), r"(?i)\.pdf$", "")


def truncate(text: Column | str, length: int) -> Column:
    """a label of at most ``length`` characters, the last a dot row if cut."""
    t = _c(text)
    return F.when(F.length(t) > length, F.concat(F.substring(t, 1, length - 1), F.lit("…"))).otherwise(t)


def search(q: str, *columns: str) -> Column:
    """Whether any column holds the text, regardless of case; no wildcards."""
    needle = F.lit(q[:200].lower())
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), needle)
    return found
