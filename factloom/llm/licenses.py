"""Licence scanning by the Dice coefficient over word bigrams; DataFrame functions only.

Every line, every paragraph and the whole of a text is a unit. A unit with u different bigrams can reach a
Dice coefficient of s with a template of m bigrams only if s / (2 - s) <= u / m <= (2 - s) / s, so units
whose size suits no template are dropped before any bigram is formed, and bigrams only meet templates of
suitable size. By the same bound such a unit holds at least one of a few telling words of the templates, so
texts and units without any of them are dropped first.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table

SIMILARITY = 0.8
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_UNLICENSE = "This is free and unencumbered software released into the public domain."
#: Licence and text of each template: one-line notices, parts of licences, and short licences as a whole.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", _APACHE),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", _GPL),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", _MIT),
    ("mit", _MIT_NOTICE),
    ("mit", _MIT_AS_IS),
    ("mit", f"MIT License\n{_MIT}\n{_MIT_NOTICE}\n{_MIT_AS_IS}"),
    ("isc", _ISC),
    ("isc", f"{_ISC}\n{_ISC_AS_IS}"),
    ("bsd", "Released under the BSD License."),
    ("bsd", _BSD),
    ("bsd", _BSD_AS_IS),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", _UNLICENSE),
)


def template_words(text: str) -> list[str]:
    """The words of a template, normalised as texts are."""
    return re.sub(r"[^\w]+|_", " ", text.lower()).split()


def _bounds(m: int, least: float) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach ``least``; rounding never narrows them."""
    return math.ceil(m * least / (2 - least) - 1e-9), math.floor(m * (2 - least) / least + 1e-9)


def templates(spark: SparkSession, least: float = SIMILARITY, texts: tuple = TEMPLATES) -> DataFrame:
    """``(template, license, bigram, m, lo, hi)`` for each different bigram of each template."""
    rows = []
    for i, (name, text) in enumerate(texts):
        words = template_words(text)
        pairs = sorted(set(zip(words, words[1:])))
        rows += [(i, name, f"{a} {b}", len(pairs), *_bounds(len(pairs), least)) for a, b in pairs]
    return spark.createDataFrame(rows, "template int, license string, bigram string, m int, lo int, hi int")


def telling_words(least: float = SIMILARITY, texts: tuple = TEMPLATES) -> list[str]:
    """Words of which every unit that reaches ``least`` with a template holds one.

    The shared bigrams must be at least s / (2 - s) of the template's m, as a unit has no fewer than it shares. So
    words suffice whose bigrams are more than the rest of the m, in each template. Long words are rarer in other
    texts, so words under six letters are only taken where no others are left; of the rest the one that brings
    all templates furthest comes first.
    """
    open_: list[tuple[set, int]] = []
    for _, text in texts:
        words = template_words(text)
        pairs = set(zip(words, words[1:]))
        open_.append((pairs, len(pairs) - _bounds(len(pairs), least)[0] + 1))
    found: list[str] = []
    while open_:
        gain: dict[str, float] = {}
        for pairs, need in open_:
            for word in {w for p in pairs for w in p}:
                gain[word] = gain.get(word, 0) + min(need, sum(word in p for p in pairs)) / need
        best = max(gain, key=lambda w: (len(w) >= 6, gain[w], w))
        found.append(best)
        left = [({p for p in pairs if best not in p}, need - sum(best in p for p in pairs)) for pairs, need in open_]
        open_ = [x for x in left if x[1] > 0]
    return [w for w in found if not any(v != w and v in w for v in found)]


def _holds(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _units(text: Column) -> Column:
    """Normalised lines, paragraphs and the whole of a lower-cased text; lines of copyright are left out."""
    plain = F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")
    bare = F.when(plain.contains("copyright"), F.regexp_replace(plain, r"(^|\n) ?copyright (c )?[0-9][^\n]*", "$1")).otherwise(plain)
    whole = F.when(bare.contains("\n"), F.concat(F.split(bare, r"\n *\n"), F.array(bare))).otherwise(F.array(bare))
    return F.concat(F.split(bare, "\n"), whole)


def matches(docs: DataFrame, least: float = SIMILARITY, texts: tuple = TEMPLATES) -> DataFrame:
    """``(doc_id, unit, license, template, dice)``: of each unit of ``docs(doc_id, text)`` the templates
    with a Dice coefficient of ``least`` or more. ``unit`` numbers the text's lines, then its paragraphs,
    then the whole. Rows with one doc_id and different texts are told apart by ``digest``. Null and empty
    texts match nothing; other columns are ignored; an empty table gives an empty result.
    """
    side = templates(docs.sparkSession, least, texts)
    sizes = [_bounds(len(set(zip(w, w[1:]))), least) for w in (template_words(t) for _, t in texts)]
    telling = telling_words(least, texts)
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("low"))
    lines = low.where(_holds(F.col("low"), telling)).select("doc_id", "digest", F.posexplode(_units(F.col("low"))).alias("unit", "line")).where(_holds(F.col("line"), telling))
    words = lines.select("doc_id", "digest", "unit", F.split(F.trim(F.translate("line", "\n", " ")), " +").alias("words")).where(F.size("words") > min(lo for lo, _ in sizes))
    pairs = F.array_distinct(F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    sized = words.select("doc_id", "digest", "unit", pairs.alias("pairs")).withColumn("u", F.size("pairs")).where(F.col("u").between(min(lo for lo, _ in sizes), max(hi for _, hi in sizes)))
    each = sized.select("doc_id", "digest", "unit", "u", F.explode("pairs").alias("bigram"))
    met = each.join(F.broadcast(side), "bigram").where("u >= lo and u <= hi")  # as many rows as the templates have bigrams
    both = met.groupBy("doc_id", "digest", "unit", "u", "template", "license", "m").agg(F.count("*").alias("both"))
    return both.withColumn("dice", 2 * F.col("both") / (F.col("u") + F.col("m"))).where(F.col("dice") >= least).select("doc_id", "digest", "unit", "license", "template", "dice")


def licenses(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``(doc_id, licenses, best_license, dice, n_units)`` for each doc_id with a licence: all different
    licences by name, the one with the largest coefficient (ties: the first name), and the number of units
    with any. Rows with one doc_id, null included, are judged together."""
    found = matches(docs, least)
    unit = found.groupBy("doc_id", "digest", "unit").agg(F.max(F.struct("dice", F.col("license"))).alias("top"), F.max("dice").alias("dice"), F.collect_set(F.struct("dice", "license")).alias("all"))
    best = F.array_min(F.transform(F.filter("all", lambda x: x["dice"] == F.col("dice")), lambda x: x["license"]))
    named = unit.select("doc_id", "dice", best.alias("license"))
    return named.groupBy("doc_id").agg(F.sort_array(F.collect_set("license")).alias("names"), F.min(F.struct((-F.col("dice")).alias("below"), "license")).alias("first"), F.count("*").alias("n_units")).select(
        "doc_id", F.array_join("names", ",").alias("licenses"), F.col("first.license").alias("best_license"), F.round(-F.col("first.below"), 6).alias("dice"), "n_units"
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def _values() -> str:
    rows = []
    for i, (name, text) in enumerate(TEMPLATES):
        words = template_words(text)
        pairs = sorted(set(zip(words, words[1:])))
        lo, hi = _bounds(len(pairs), SIMILARITY)
        rows += [f"({i},'{name}','{a} {b}',{len(pairs)},{lo},{hi})" for a, b in pairs]
    return ",".join(rows)


OP2_SQL = rf"""
with side(template, license, bigram, m, lo, hi) as (values {_values()}),
plain as (select row_number() over () rid, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') p from documents),
bare as (select rid, doc_id, regexp_replace(p, '(^|\n) ?copyright (c )?[0-9][^\n]*', '\1', 'g') p from plain),
lines as (select rid, doc_id, unnest(range(1, len(u) + 1)) unit, unnest(u) line from (
    select rid, doc_id, list_concat(string_split(p, chr(10)), case when contains(p, chr(10)) then list_concat(string_split_regex(p, '\n *\n'), [p]) else [p] end) u from bare)),
words as (select rid, doc_id, unit, string_split_regex(trim(translate(line, chr(10), ' ')), ' +') w from lines),
sized as (select rid, doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) pairs from words where len(w) > 1),
each as (select rid, doc_id, unit, len(pairs) u, unnest(pairs) bigram from sized),
dice as (select doc_id, rid, unit, template, license, 2.0 * count(*) / (u + m) dice from each join side using (bigram) where u between lo and hi group by doc_id, rid, unit, u, template, license, m having 2.0 * count(*) / (u + m) >= {SIMILARITY}),
best as (select doc_id, rid, unit, max(dice) dice, arg_min(license, (-dice, license)) license from dice group by doc_id, rid, unit)
select doc_id, string_agg(distinct license, ',' order by license) licenses, arg_min(license, (-dice, license)) best_license, round(max(dice), 6) dice, count(*) n_units from best group by doc_id
"""
