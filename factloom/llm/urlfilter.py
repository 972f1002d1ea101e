"""URL verdicts from a Bloom filter cascade; DataFrame functions only.

A cascade is exact on a known key universe. Its first level encodes the listed keys; the second encodes
those unlisted keys of the universe that the first lets through; the third those listed keys that the
second lets through; and so on, until a level lets nothing wrong through. A key is listed if the first
level that does not hold it has an even number (or, if all hold it, if the number of levels is odd). A
level's bits are a staged table of one row that Spark reads once as a scalar subquery, so a url is judged
inside the scan, without a join, and the plan holds no filter. Lists whose filter would pass a size are split by a
hash of the key into parts with a cascade each, and the pages are read once for each part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table
from factloom.scratch import stage, unstage

#: Verdict, host and path of the prefix rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Hosts with such a word between dots or hyphens are listed in the registered query, and, in the stead of a published list
#: of hosts, those whose MD5 begins with such a digit.
LISTED_DIGITS = ("0", "1")
LISTED_WORDS = ("pills", "casino", "poker", "porn", "xxx", "viagra", "malware", "phishing", "warez")
#: Bits of a level, at most, about (4 MB, which each task gets for each of a level's hashes); keys that need more are split.
MOST_BITS = 1 << 25
#: Words of 64 bits that are gathered in one row before all are.
_CHUNK = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """A filter; ``words`` is a table of one row, the array of its words of 64 bits."""

    bits: int
    hashes: int
    words: DataFrame | None


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null. A rule fits its host and all subdomains
    where the path starts with the rule's; of rules of one length, the one that comes first in the list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, at, prefix in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(prefix))
        name, verdict = F.when(fits, at + prefix).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _bit(key: Column, level: int, i: int, bits: int) -> Column:
    """The place of the key's i-th bit, by two hashes of the key."""
    a, b = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1)).bitwiseOR(F.lit(1).cast("long"))
    return F.pmod(F.shiftrightunsigned(a, 2) + F.lit(i).cast("long") * F.shiftrightunsigned(b, 8), F.lit(bits).cast("long"))


def _holds(key: Column, number: int, level: Level) -> Column:
    if level.words is None:
        return F.lit(False)
    each = None
    for i in range(level.hashes):
        at = _bit(key, number, i, level.bits)
        bit = F.getbit(F.get(level.words.scalar(), F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
        each = bit if each is None else each & bit
    return each


def _size(n: int, rate: float) -> int:
    return max(64, 64 * math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))


def _level(keys: DataFrame, number: int, n: int, rate: float) -> Level:
    """A filter of the n keys with about that rate of false positives. Bits are combined to words of 64, and words to
    chunks, before one task gets them."""
    if not n:
        return Level(0, 0, None)
    bits = _size(n, rate)
    hashes = max(1, round(bits / n * math.log(2)))
    at = F.explode(F.array(*[_bit(F.col("key"), number, i, bits) for i in range(hashes)]))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    found = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), one.alias("bit"))
    none = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
    words = found.unionByName(none).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    chunks = words.groupBy(F.floor(F.col("word") / _CHUNK).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bit"))), lambda x: x["bit"]).alias("bits"))
    whole = chunks.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "bits"))), lambda x: x["bits"])).alias("words"))
    return Level(bits, hashes, stage(whole, "filter"))


def _first_rate(inside: int, outside: int) -> float:
    return min(0.5, max(1e-6, inside * math.sqrt(2) / max(outside, 1)))


def build(universe: DataFrame, rate: float = 1 / 16) -> list[Level]:
    """The cascade for ``universe(key, listed)``, whose keys are distinct and not null.

    The first level's rate is set by the sizes of both sides, later ones have ``rate``. Only counts reach
    the driver; a filter has about 6 bits for each encoded key. Levels end when no key is judged wrongly.
    """
    now = stage(universe.select("key", "listed"), "universe")
    sizes = {r.listed: r.n for r in now.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    n, first = sizes.get(True, 0), _first_rate(sizes.get(True, 0), sizes.get(False, 0))
    levels, side = [], True
    while n:
        level = _level(now.where(F.col("listed") == side), len(levels), n, rate if levels else first)
        # The other side's keys that this level lets through go on; this side's stay, for the level after.
        old, now = now, stage(now.where((F.col("listed") == side) | _holds(F.col("key"), len(levels), level)), "universe")
        unstage(old)
        levels.append(level)
        side = not side
        n = now.where(F.col("listed") == side).count()
    unstage(now)
    return levels


def listed(key: Column, levels: Sequence[Level]) -> Column:
    """Whether the cascade's list has the key; exact for keys of its universe, false for null."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(_holds(key, i, levels[i]), out).otherwise(F.lit(i % 2 == 1))
    return F.coalesce(out, F.lit(False))


def judge(pages: DataFrame, keys: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, most_bits: int = MOST_BITS) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url)``.

    ``keys(key)`` lists hosts to block; null, empty and repeated keys and hosts that no page has are
    ignored. The universe is every distinct host of ``pages``. A url that no rule fits is blocked if its
    host is listed, else allowed; a null url or one without ``://`` has empty parts and is allowed. Rows
    are returned as often as they come; other columns are ignored; an empty table gives an empty result.
    """
    host, path = parts(F.col("url").cast("string"))
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    hosts = cut.where("host <> ''").groupBy(F.col("host").alias("key")).agg(F.lit(1).alias("here"))
    wanted = keys.where("key is not null and key <> ''").groupBy("key").agg(F.lit(True).alias("listed"))
    universe = stage(hosts.join(wanted, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "hosts")
    inside, total = universe.agg(F.count_if("listed"), F.count("*")).first()
    split = -(-_size(inside, _first_rate(inside, total - inside)) // most_bits) if inside else 1
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    out = None
    for i in range(split):
        mine = (lambda c: F.pmod(F.xxhash64(c, F.lit(-1)), F.lit(split)) == i) if split > 1 else (lambda c: F.lit(True))  # noqa: B023 - used in this round
        levels = build(universe.where(mine("key")))
        method = F.when((F.col("host") != "") & listed(F.col("host"), levels), "block").otherwise("allow")
        part = cut.where(mine("host")).select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"))
        out = part if out is None else out.unionByName(part)
    return out


def listed_hosts(pages: DataFrame, words: Sequence[str] = LISTED_WORDS, digits: Sequence[str] = LISTED_DIGITS) -> DataFrame:
    """``(key)``: the hosts of ``pages`` with one of the words between dots or hyphens, or whose MD5 begins with one of
    the digits."""
    host, _ = parts(F.col("url").cast("string"))
    return pages.select(host.alias("key")).where(F.col("key").rlike(rf"(^|[.-])({'|'.join(words)})([.-]|$)") | ((F.col("key") != "") & F.substring(F.md5("key"), 1, 1).isin(*digits))).distinct()


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, listed_hosts(pages))


def _fits(at: str, prefix: str) -> str:
    return f"(host = '{at}' or ends_with(host, '.{at}')) and starts_with(path, '{prefix}')"


_ORDERED = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
OP7_SQL = f"""
with a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') h from a),
c as (select page_id, translate(h, '{_UPPER}', '{_LOWER}') host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') path from b)
select page_id, host, path,
    case {' '.join(f"when {_fits(h, p)} then '{h}{p}'" for _, h, p in _ORDERED)} end as rule,
    case {' '.join(f"when {_fits(h, p)} then '{v}'" for v, h, p in _ORDERED)}
        when regexp_matches(host, '(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)') or (host <> '' and substr(md5(host), 1, 1) in ({', '.join(f"'{d}'" for d in LISTED_DIGITS)})) then 'block' else 'allow' end as verdict
from c
"""
