"""Secret scanning with corpus-wide ownership frequency; DataFrame functions only.

Every text is searched for candidates: the base kinds (assigned values, access keys, long hexadecimal
runs) and wider kinds that are too common in harmless text to report by themselves. Each candidate's value
is hashed, and over the whole corpus the distinct repositories (``doc_id``) and owners (``source``) that
hold the hash are counted. A value held by many owners is a widely copied example; one held by a single
owner that also looks random is live. Base spans are always reported; spans of the wider kinds are added
where they are live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import fresh, running, table
from factloom.scratch import BROADCAST_ROWS, small, stage

#: From so many distinct owners a value counts as a widely copied example.
EXAMPLE_OWNERS = 3
#: Kinds as (name, pattern, group of the value, least length of the value); the first three are the base.
BASE = (
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: The web token is looked for where a run of its characters begins, and without going back, so in linear time.
ADDED = (
    ("prefixed", r"(?:gh[pousr]_|sk_live_|sk-|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}", 0, 20),
    ("webtoken", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 29),
    ("mixed", r"[A-Za-z0-9+/_]{32,}", 0, 32),
)
KINDS = (*BASE, *ADDED)


def _located(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``spans``, an array of (start, ord, stop, kind, value) of all kinds' leftmost non-overlapping matches,
    instead of ``text``.

    A match's place is the sum of what stands before it: the parts between matches, from a split by the same pattern, and
    the earlier matches. Each step is a column of its own, so that none is worked out for each element of another.
    Matches whose value is too short are dropped after they have used up their text.
    """
    kinds = range(len(KINDS))
    kept = [c for c in rows.columns if c != text]
    found = rows.select("*", *[F.regexp_extract_all(text, F.lit(KINDS[i][1]), F.lit(0)).alias(f"_whole{i}") for i in kinds])

    def lengths(i: int) -> Column:
        whole = F.col(f"_whole{i}")
        parts = F.zip_with(F.slice(F.split(text, KINDS[i][1]), 1, F.size(whole)), whole, lambda gap, w: F.array(F.length(gap), F.length(w)))
        return F.when(F.size(whole) > 0, F.flatten(parts)).otherwise(F.array().cast("array<int>"))

    def spans(i: int) -> Column:
        name, pattern, group, least = KINDS[i]
        ends, whole = F.col(f"_ends{i}"), F.col(f"_whole{i}")

        def span(w: Column, k: Column) -> Column:
            value = F.regexp_extract(w, pattern, group) if group else w
            return F.struct(F.get(ends, 2 * k).alias("start"), F.lit(i).alias("ord"), F.get(ends, 2 * k + 1).alias("stop"), F.lit(name).alias("kind"), value.alias("value"))

        return F.filter(F.transform(whole, span), lambda s: F.length(s["value"]) >= least)

    sized = found.select(*kept, *[F.col(f"_whole{i}") for i in kinds], *[lengths(i).alias(f"_size{i}") for i in kinds])
    ended = sized.select(*kept, *[F.col(f"_whole{i}") for i in kinds], *[running(F.col(f"_size{i}")).alias(f"_ends{i}") for i in kinds])
    return ended.select(*kept, F.concat(*[spans(i) for i in kinds]).alias("spans"))


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, digest, spans)``: a row for each row of ``docs``, with the candidates of its
    whole text; ``digest`` tells rows with one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    owner = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.alias("source"), text.alias("text"))
    return _located(base.select("doc_id", "source", F.xxhash64("text").alias("digest"), "text"))


def _random(value: Column) -> Column:
    """Looks like a key and not like a word, a path or a filler: digits and letters of both cases or hex,
    at least ten different characters."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return (value.rlike("[0-9]")) & (value.rlike("[A-Za-z]")) & (different >= 10)


def ownership(found: DataFrame, owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``(hash, n_repositories, n_owners, class, random)`` of each value in ``found(doc_id, source, digest, s)``; the class
    is ``example``, ``live`` or ``shared``. A text that several owners hold alike counts for the first of them, so copies
    of one document make no example; a null owner counts as one owner. Counts are combined before each shuffle."""
    each = found.select("doc_id", "digest", F.coalesce("source", F.lit("")).alias("source"), F.sha2("s.value", 256).alias("hash"), _random(F.col("s.value")).alias("random"))
    texts = each.groupBy("hash", "digest").agg(F.min("source").alias("source"), F.first("random").alias("random"))
    by = texts.groupBy("hash", "source").agg(F.first("random").alias("random"))
    total = by.groupBy("hash").agg(F.count("*").alias("n_owners"), F.first("random").alias("random"))
    held = each.groupBy("hash", "doc_id").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_repositories"))
    kind = F.when(F.col("n_owners") >= owners, "example").when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("shared")
    return total.join(held, "hash").select("hash", "n_repositories", "n_owners", kind.alias("class"), "random")


def _digest() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def found_secrets(docs: DataFrame, owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``(doc_id, digest, secrets)``, as ``scan``, of the documents that have any; each text is searched once."""
    some = stage(candidates(docs).select("doc_id", "source", "digest", F.explode_outer("spans").alias("s")).where("s is not null"), "candidates")
    known = ownership(some, owners)
    each = some.select("doc_id", "digest", "s").distinct().withColumn("hash", F.sha2("s.value", 256))
    joined = each.join(known, "hash").withColumn("base", F.col("s.ord") < len(BASE)).where(F.col("base") | (F.col("class") == "live"))
    # A span meets a base span that starts no later and ends behind its start, or the next base span if that starts inside.
    text = Window.partitionBy("doc_id", "digest")
    before = F.max(F.when(F.col("base"), F.col("s.stop"))).over(text.orderBy("s.start").rangeBetween(Window.unboundedPreceding, 0))
    behind = F.min(F.when(F.col("base"), F.col("s.start"))).over(text.orderBy(F.desc("s.start")).rangeBetween(Window.unboundedPreceding, 0))
    apart = ~F.coalesce(before > F.col("s.start"), F.lit(False)) & ~F.coalesce(behind < F.col("s.stop"), F.lit(False))
    kept = joined.withColumn("apart", apart).where("base or apart")
    return kept.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.ord", "s.stop", "s.kind", "s.value", "class", "n_repositories", "n_owners", "random"))).alias("secrets"))


def scan(docs: DataFrame, owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Secrets of every row of ``docs(doc_id, text, source)``:
    ``(doc_id, digest, secrets)`` with ``secrets`` an array of (start, ord, stop, kind, value, class,
    n_repositories, n_owners, random), in order; wider kinds only where they are live and overlap no base span.

    Null text is empty and has no secrets; rows with the same doc_id and text share one result and are
    returned as often as they come; a null doc_id or source, or no source column, is allowed. Other
    columns are ignored; an empty table gives an empty result. Offsets are in code points, the end
    exclusive. The work follows the length of the texts, also of those that are full of secrets.
    """
    secrets = found_secrets(docs, owners).select(F.col("doc_id").alias("id"), F.col("digest").alias("d"), "secrets")
    here = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"))
    return here.join(secrets, here.doc_id.eqNullSafe(secrets.id) & (here.digest == secrets.d), "left").select("doc_id", "digest", F.coalesce("secrets", F.filter(F.array().cast(secrets.schema["secrets"].dataType), lambda _: F.lit(True))).alias("secrets"))


#: Characters of a block of a text that is cut, so that a place in it is found without reading all before it.
_PIECE = 1024


def _between(blocks: Column, start: Column, stop: Column) -> Column:
    """The characters from ``start`` up to ``stop`` of a text in blocks."""
    i, j = F.floor(start / _PIECE).cast("int"), F.floor((stop - 1) / _PIECE).cast("int")
    near = F.substring(F.get(blocks, i), start % _PIECE + 1, stop - start)
    far = F.concat(F.substring(F.get(blocks, i), start % _PIECE + 1, F.lit(_PIECE)), F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), F.substring(F.get(blocks, j), F.lit(1), stop - j * _PIECE))
    return F.when(stop <= start, "").when(i == j, near).otherwise(far)


def redact(docs: DataFrame, owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``docs`` with the value of every secret replaced by ``[SECRET]``, but for widely copied examples that do not look
    random; ``n_chars``, if there, is set to the new length of a changed text. No row is dropped, rows without secrets
    keep their text as it is, and columns may have any names."""
    hits = found_secrets(docs, owners).select("doc_id", "digest", F.transform(F.filter("secrets", lambda s: (s["class"] != "example") | s["random"]), lambda s: F.struct((s["stop"] - F.length(s["value"])).alias("start"), s["stop"].alias("stop"))).alias("cut")).where(F.size("cut") > 0)
    # Where the text up to a cut ends: behind the last of the cuts before it. Cuts that start inside an earlier one only move it.
    last = hits.withColumn("stops", F.transform("cut", lambda s: s["stop"])).withColumn("last", running(F.col("stops"), most=True))
    pairs = F.transform("cut", lambda s, k: F.struct(F.when(k > 0, F.get("last", k - 1)).otherwise(0).alias("from"), s["start"].alias("to")))
    own = {c: fresh(f"_{c}", docs.columns) for c in ("id", "digest", "gaps", "rest", "blocks", "new")}
    hits = stage(last.select(F.col("doc_id").alias(own["id"]), F.col("digest").alias(own["digest"]), F.filter(pairs, lambda p: p["to"] >= p["from"]).alias(own["gaps"]), F.element_at("last", -1).alias(own["rest"])), "redactions")
    # Documents with secrets are few; beyond a bound both sides are shuffled by id.
    side = F.broadcast(hits) if small(hits, BROADCAST_ROWS // 10) else hits
    joined = docs.join(side, docs.doc_id.cast("long").eqNullSafe(F.col(own["id"])) & (_digest() == F.col(own["digest"])), "left")
    cut = joined.withColumn(own["blocks"], F.when(F.col(own["gaps"]).isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))))
    blocks = F.col(own["blocks"])
    new = F.concat(F.array_join(F.transform(own["gaps"], lambda p: F.concat(_between(blocks, p["from"], p["to"]), F.lit("[SECRET]"))), ""), _between(blocks, F.col(own["rest"]), F.length("text")))
    out = cut.withColumn(own["new"], F.when(F.col(own["gaps"]).isNull(), F.col("text")).otherwise(new))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(own["gaps"]).isNull(), F.col("n_chars")).otherwise(F.length(own["new"]).cast(docs.schema["n_chars"].dataType)))
    return out.withColumn("text", F.col(own["new"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def count(name: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    counts = [count(name) for name, *_ in BASE]
    base = F.filter("secrets", lambda s: s["ord"] < len(BASE))
    live = F.size(F.filter("secrets", lambda s: s["class"] == "live")).cast("long")
    example = F.size(F.filter("secrets", lambda s: s["class"] == "example")).cast("long")
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"), live.alias("n_live"), example.alias("n_example"))


def _sql_spans(name: str, order: int, pattern: str, group: int, least: int) -> str:
    # DuckDB's patterns have no look-behind and need none of the possessive marks: what stands before is matched and taken off.
    p = pattern.replace("'", "''").replace("}+", "}")
    before, p = ("(^|[^A-Za-z0-9_-])", p[len("(?<![A-Za-z0-9_-])"):]) if p.startswith("(?<!") else ("()", p)
    return f"""
    select rid, doc_id, source, dg, unnest(list_transform(list_filter(range(1, len(whole) + 1), lambda k: length(vals[k]) >= {least}), lambda k: struct_pack(
        start := cast(list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:k - 1], lambda m: length(m))), 0) + length(pre[k]) as bigint),
        size := length(whole[k]) - length(pre[k]), val := vals[k]))) s, {order} ord, '{name}' kind
    from (select rid, doc_id, source, md5(text) dg, string_split_regex(text, '{before}{p}') gaps, regexp_extract_all(text, '{before}{p}') whole, regexp_extract_all(text, '{before}{p}', 1) pre,
            {"regexp_extract_all(text, '" + before + p + "', 2)" if group else "list_transform(regexp_extract_all(text, '" + before + "(" + p + ")', 2), lambda x: x)"} vals
          from docs where regexp_matches(text, '{before}{p}'))"""


OP1_SQL = f"""
with docs as (select row_number() over () rid, doc_id, source, coalesce(text, '') as text from documents),
cand as ({' union all '.join(_sql_spans(n, i, p, g, k) for i, (n, p, g, k) in enumerate(KINDS))}),
flat as (select rid, doc_id, coalesce(source, '') source, dg, s.start a, s.start + s.size b, s.val val, ord, kind, sha256(s.val) h from cand),
held as (select h, dg, min(source) source, any_value(val) val from flat group by h, dg),
own as (select h, count(distinct source) n_owners, bool_and(regexp_matches(val, '[0-9]') and regexp_matches(val, '[A-Za-z]') and len(list_distinct(string_split(val, ''))) >= 10) rnd from held group by h),
cls as (select flat.*, case when n_owners >= {EXAMPLE_OWNERS} then 'example' when n_owners = 1 and rnd then 'live' else 'shared' end cl from flat join own using (h)),
kept as (select * from cls x where ord < {len(BASE)} or (cl = 'live' and not exists (select 1 from cls y where y.rid = x.rid and y.ord < {len(BASE)} and y.a < x.b and x.a < y.b))),
agg as (select rid, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
    coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, ord) filter (ord < {len(BASE)}), '') base,
    string_agg(kind || ':' || a || ':' || b, ',' order by a, ord) spans, count(*) filter (cl = 'live') n_live, count(*) filter (cl = 'example') n_example from kept group by rid)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256,
    coalesce(spans, '') spans, coalesce(n_live, 0) n_live, coalesce(n_example, 0) n_example
from docs left join agg using (rid)
"""
