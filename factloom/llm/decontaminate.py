"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Texts become templates: numbers, units behind numbers and names (capitalised words inside a sentence) are
replaced by typed placeholders, other words are lower-cased. Windows of five template words of documents
and benchmark items meet in a hash join. Matching windows with the same distance between their places
belong to one occurrence of the item, and its slots must be consistent: equal item values have equal
document values. An item is in a document if consistent occurrences hold 0.8 of its windows or more; so
an item whose numbers or names were exchanged throughout is found, and a text that shares only the shape
of a few phrases is not. Names are known by their capitals, so a second, case-folded template that keeps
them as plain words finds copies in another case; either hit counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import fresh, table
from factloom.scratch import BROADCAST_ROWS, small, stage

WINDOW, SHARE = 5, 0.8
#: A window counts if it has so many plain words.
PLAIN = 3
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "inch", "inches", "feet", "miles", "pounds", "dollars", "euros", "cents", "percent", "degrees", "meters", "metres", "liters", "litres", "grams", "kilograms", "tons", "watts", "volts")
_NUM, _UNIT, _NAME = "\x03", "\x02", "\x01"
_WORD = r"[\p{L}\p{M}]+"
#: Letters of scripts that put no spaces between words; each is a word of its own.
_UNSPACED = r"[\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}&&\p{L}]"
_NUMBER = r"[0-9]+(?:[.,][0-9]+)*"


def _digest(text: Column | str) -> Column:
    return F.xxhash64((F.col(text) if isinstance(text, str) else text).cast("string")).alias("digest")


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``marked`` instead of ``text``: the lower-cased text with a mark before each name and before each
    unit behind a number. A name is a capitalised word behind another word or a comma; the first word of a
    sentence is none. (Each step is a column of its own, so none is worked out twice.)"""
    named = F.regexp_replace("text", r"([\p{L}\p{M}\p{N},;)])\x20(?=\p{Lu}[\p{Ll}\p{M}]+(?!\p{L}))", "$1 " + _NAME)
    units = F.regexp_replace("text", rf"([0-9])\x20?(?=(?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{M}}]))", "$1 " + _UNIT)
    return (
        rows.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
        .withColumn("text", F.when(F.col("text").rlike("[\x01-\x03]"), F.translate("text", _NAME + _UNIT + _NUM, "   ")).otherwise(F.col("text")))
        .withColumn("text", F.when(F.col("text").rlike(_UNSPACED), F.regexp_replace("text", rf"({_UNSPACED}\p{{M}}*)", " $1 ")).otherwise(F.col("text")))
        .withColumn("text", named)
        .withColumn("text", F.when(F.col("text").rlike("[0-9]"), units).otherwise(F.col("text")))
        .withColumn("marked", F.replace(F.lower("text"), F.lit("ß"), F.lit("ss")))
        .drop("text")
    )


def _tokens(marked: Column) -> Column:
    """The words and numbers of a marked text."""
    return F.regexp_extract_all(F.translate(marked, _NAME + _UNIT, ""), F.lit(f"{_WORD}|{_NUMBER}"), F.lit(0))


def _words(raw: Column) -> Column:
    return F.transform(raw, lambda x: F.translate(x, _NAME + _UNIT, ""))


def _templates(rows: DataFrame) -> DataFrame:
    """``rows`` with ``raw`` (words and numbers, with their marks), ``template`` (placeholders for names, units and
    numbers) and ``folded`` (the same without those for names) instead of ``text``."""

    def typed(x: Column) -> Column:  # marks are less than digits, and those less than letters
        return F.when(x >= ":", x).when(x < _UNIT, F.lit(_NAME)).when(x < _NUM, F.lit(_UNIT)).otherwise(F.lit(_NUM))

    steps = _marked(rows).withColumn("raw", F.regexp_extract_all("marked", F.lit(f"[{_NAME}{_UNIT}]?{_WORD}|{_NUMBER}"), F.lit(0)))
    steps = steps.withColumn("template", F.when(F.col("marked").rlike("[\x01\x020-9]"), F.transform("raw", typed)).otherwise(F.col("raw")))
    return steps.withColumn("folded", F.when(F.col("marked").contains(_NAME), F.transform("template", _unnamed)).otherwise(F.col("template"))).drop("marked")


def _unnamed(x: Column, i: Column) -> Column:
    """A place of the template with its own word for a name. (A capitalised unit behind a number is marked as a name.)"""
    word = F.translate(F.get("raw", i), _NAME, "")
    unit = (F.get("template", i - 1) == _NUM) & word.isin(*UNITS)
    return F.when(x != _NAME, x).when((i > 0) & unit, F.lit(_UNIT)).otherwise(word)


def _hash(words: str, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(width)])


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """``_templates`` of ``rows`` and a row for each window of the template with ``pos`` and ``h``, and for each window
    of the folded one that differs. The last rows of a text hold fewer words."""
    names = F.filter(F.transform("template", lambda w, i: F.when(w == _NAME, i)), lambda i: i.isNotNull())
    near = F.array_distinct(F.flatten(F.transform(names, lambda i: F.sequence(F.greatest(i - (width - 1), F.lit(0)), i))))
    steps = _templates(rows).withColumn("near", F.when(F.array_contains("template", _NAME), near).otherwise(F.array().cast("array<int>")))
    hashes = F.concat(F.transform("template", lambda w, i: _hash("template", i, width)), F.transform("near", lambda i: _hash("folded", i, width)))
    # The hashes are a column of their own, so that the generator and the join behind it work on plain values; the
    # outer form keeps the optimizer from working them out once more in a filter on their number.
    each = steps.withColumn("hashes", hashes).select(*steps.columns, F.posexplode_outer("hashes").alias("at", "h")).where("h is not null")
    own = F.size("template")
    return each.withColumn("pos", F.when(F.col("at") < own, F.col("at")).otherwise(F.get("near", F.col("at") - own))).drop("at", "near")


def _items(benchmark: DataFrame) -> DataFrame:
    """``(item, text)`` of ``benchmark(item_id, text)``; an item is an id and the hash of its text."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return rows.select(F.struct("item_id", F.xxhash64("text").alias("digest")).alias("item"), "text")


def item_templates(benchmark: DataFrame) -> DataFrame:
    """``(item, inside, raw, template, folded)`` of ``benchmark(item_id, text)``, staged: each item as it is and, marked as
    ``inside``, as if it stood behind other words, where its first word may be a name."""
    rows = _items(benchmark)
    both = rows.select("item", F.lit(False).alias("inside"), "text").unionByName(rows.select("item", F.lit(True).alias("inside"), F.concat(F.lit(", "), "text").alias("text")))
    return stage(_templates(both), "item-templates")


def item_windows(templates: DataFrame, width: int = WINDOW, plain: int = PLAIN) -> DataFrame:
    """``(item, folded_item, h, ipos, window, words, slots, n)`` for each window of ``item_templates``
    with enough plain words, of the template and of the folded one; ``n`` is at how many places the item has
    one. The template's first window comes in two forms if its first word would be a name inside a sentence."""
    forms = F.array(F.struct(F.lit(False).alias("folded_item"), F.col("template").alias("t")), F.struct(F.lit(True).alias("folded_item"), F.col("folded").alias("t")))
    each = templates.select("item", "inside", "raw", F.explode(forms).alias("f")).where("not inside or not f.folded_item").select("item", "inside", "raw", "f.*")
    placed = each.select("*", F.posexplode(F.transform("t", lambda w, i: _hash("t", i, width))).alias("ipos", "h")).where("not inside or ipos = 0")
    cut = placed.select("item", "folded_item", "h", "ipos", F.slice("t", F.col("ipos") + 1, width).alias("window"), _words(F.slice("raw", F.col("ipos") + 1, width)).alias("words"))
    w = cut.withColumn("slots", F.transform("window", lambda x: x.isin(_NUM, _UNIT, _NAME)))
    w = w.where((F.size("window") == width) & (F.size(F.filter("slots", lambda x: ~x)) >= plain)).dropDuplicates(["item", "folded_item", "ipos", "h"])
    n = w.groupBy(F.col("item").alias("item_n"), F.col("folded_item").alias("folded_n")).agg(F.countDistinct("ipos").alias("n"))
    return w.join(n, (w.item == n.item_n) & (w.folded_item == n.folded_n)).drop("item_n", "folded_n")


def plain_items(templates: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``(item, head, h, words)`` for each item of ``item_templates`` that has no window in ``items``: all its
    words and numbers, and the hash of the first ``head`` of them, ``width`` at most."""
    rows = templates.where("not inside").join(items.select("item").distinct(), "item", "left_anti").select("item", _words(F.col("raw")).alias("words"))
    head = F.least(F.size("words"), F.lit(width))
    return rows.where(F.size("words") > 0).select("item", head.alias("head"), F.xxhash64(F.slice("words", F.lit(1), head)).alias("h"), "words")


def _head(k: int):
    return lambda w, i: F.xxhash64(F.slice("mine", i + 1, k))


def verbatim_matches(docs: DataFrame, plain: DataFrame) -> DataFrame:
    """``matches`` of ``plain_items``: texts of ``docs(doc_id, digest, text)`` that hold all words and numbers of the
    item in their order, in any case."""
    heads = sorted(r["head"] for r in plain.select("head").distinct().collect())  # at most a window's width
    rows = _marked(docs).select("doc_id", "digest", _tokens(F.col("marked")).alias("mine"))
    hashes = F.concat(*[F.transform("mine", _head(k)) for k in heads])
    each = rows.withColumn("hashes", hashes).select("doc_id", "digest", "mine", F.posexplode_outer("hashes").alias("at", "h")).where("h is not null")
    side = F.broadcast(plain) if small(plain, BROADCAST_ROWS // 4) else plain
    hit = each.join(side, "h").where(F.slice("mine", F.col("at") % F.size("mine") + 1, F.size("words")) == F.col("words"))
    return hit.select("doc_id", "digest", F.col("item.item_id").alias("item_id")).distinct().select("*", F.lit(1.0).alias("coverage"), F.lit(True).alias("verbatim"))


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: float = SHARE, plain: int = PLAIN) -> DataFrame:
    """``(doc_id, digest, item_id, coverage, verbatim)`` of the benchmark items found in ``docs(doc_id, text)``.

    ``coverage`` is the share of the item's windows in consistent occurrences, ``verbatim`` whether all
    slots hold the item's own values. Of an item with no window of enough plain words all words and
    numbers are compared; one without a word or number is found nowhere. Null and empty texts hold no item. Texts are judged one by one, also where they share a
    doc_id or have none: ``digest`` is the text's hash. Other columns are ignored; empty tables give an empty result. The benchmark's windows are broadcast while
    they are counted to be few; beyond that both sides are shuffled on the window's hash.
    """
    templates = item_templates(benchmark)
    items = stage(item_windows(templates, width, plain), "items")
    side = F.broadcast(items) if small(items, BROADCAST_ROWS // 4) else items
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest("text"), "text")
    mine = _windows(rows, width)
    template = F.when(F.col("folded_item"), F.col("folded")).otherwise(F.col("template"))
    hit = mine.join(side, "h").where(F.slice(template, F.col("pos") + 1, width) == F.col("window"))
    mine_words = _words(F.slice("raw", F.col("pos") + 1, width))
    pairs = F.filter(F.zip_with(F.arrays_zip("words", "slots"), mine_words, lambda a, t: F.struct(a["words"].alias("item"), t.alias("doc"), a["slots"].alias("slot"))), lambda x: x["slot"])
    none = F.array().cast("array<struct<item:string,doc:string,slot:boolean>>")
    found = hit.select("doc_id", "digest", "item", "folded_item", "n", "ipos", (F.col("pos") - F.col("ipos")).alias("shift"), F.when(F.exists("slots", lambda x: x), pairs).otherwise(none).alias("pairs"))
    occurrence = found.groupBy("doc_id", "digest", "item", "folded_item", "n", "shift").agg(F.collect_set("ipos").alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    steady = occurrence.where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"]))))
    whole = steady.groupBy("doc_id", "digest", "item", "folded_item", "n").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"), F.bool_and(F.forall("pairs", lambda p: p["item"] == p["doc"])).alias("verbatim"))
    found = whole.where(F.col("held") >= share * F.col("n")).groupBy("doc_id", "digest", F.col("item.item_id").alias("item_id")).agg(F.max(F.col("held") / F.col("n")).alias("coverage"), F.bool_or("verbatim").alias("verbatim"))
    plain_ones = stage(plain_items(templates, items, width), "plain-items")
    return found if plain_ones.isEmpty() else found.unionByName(verbatim_matches(rows, plain_ones))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: float = SHARE, by: tuple[str, ...] = ("doc_id", "digest")) -> DataFrame:
    """A row for each contaminated text of a doc_id, or for each doc_id that has one: the item with the
    largest coverage (ties: the smallest id), its coverage, and how many items there are."""
    best = F.max_by(F.struct("item_id", "coverage", "verbatim"), F.struct("coverage", -F.col("item_id")))
    items = matches(docs, benchmark, width, share).groupBy(*by, "item_id").agg(F.max("coverage").alias("coverage"), F.bool_or("verbatim").alias("verbatim"))
    each = items.groupBy(*by).agg(best.alias("best"), F.count("*").alias("n_items"))
    return each.select(*by, "best.item_id", F.round("best.coverage", 6).alias("coverage"), "best.verbatim", "n_items")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose own text is contaminated. The keys to remove are broadcast while they
    are counted to be few; columns may have any names."""
    own, digest = fresh("_id", docs.columns), fresh("_digest", docs.columns)
    keys = stage(contaminated(docs, benchmark).select(F.col("doc_id").alias(own), F.col("digest").alias(digest)), "contaminated")
    side = F.broadcast(keys) if small(keys) else keys
    same = docs.doc_id.cast("long").eqNullSafe(F.col(own)) & (_digest(docs.text) == F.col(digest))
    return docs.join(side, same, "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), by=("doc_id",))
