"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. A letter trigram is bound as the product of its
letters' vectors, the first permuted (rotated) twice and the second once; a document is the bundle (sum)
of its trigrams' vectors, and a language is the bundle of its documents' unit vectors. A document gets
the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import fold, small_batches, table
from factloom.scratch import stage

DIMENSIONS = 1024
#: Distinct labelled texts of each language that prototypes are bundled from, at most, and languages that are learned.
SAMPLE_PER_LANGUAGE, LANGUAGES = 2000, 1000
UNDETERMINED = "und"
#: Code points below have letter vectors of their own; the rest share as many by hash.
_OWN = 4096
_LETTERS = 2 * _OWN
_PIECE = 400_000


@lru_cache(1)
def _letter_ids() -> np.ndarray:
    """Of each code point: 0 if it is no letter, else a number from 1."""
    points = np.arange(0x110000)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    ids = np.where(points < _OWN, points, _OWN + points * 2654435761 % _OWN)
    return np.where(letter, np.maximum(ids, 1), 0).astype(np.uint16)


@lru_cache(2)
def _letter_vectors(dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter vectors for the first, second and third place of a trigram; id 0 stands for a word's edge."""
    one = np.random.Generator(np.random.PCG64(20_240)).integers(0, 2, (_LETTERS, dimensions), np.int8) * 2 - 1
    return np.roll(one, 2, axis=1), np.roll(one, 1, axis=1), one


def _letters(piece: str) -> np.ndarray:
    """Letter ids of the lower-cased text, each run of other characters one 0, and a 0 at both ends."""
    ids = _letter_ids()[np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    ids = np.concatenate(([0], ids, [0]))
    return ids[np.concatenate(([True], (ids[1:] != 0) | (ids[:-1] != 0)))]


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct trigrams, as numbers, and their counts. Texts are read in long pieces."""
    found = []
    for at in range(0, len(text), _PIECE):
        x = _letters(text[at : at + _PIECE]).astype(np.int64)
        if len(x) > 2:
            found.append(np.unique((x[:-2] * _LETTERS + x[1:-1]) * _LETTERS + x[2:], return_counts=True))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0]
    keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([c for _, c in found])).astype(np.int64)


def vectors(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row per text: its bundle, of length 1; zero if the text is null or has no letter."""
    first, second, third = _letter_vectors(dimensions)
    out = np.zeros((len(texts), dimensions), np.float32)
    for at in range(0, len(texts), 32):
        each = [_trigrams(t or "") for t in texts[at : at + 32]]
        keys, where = np.unique(np.concatenate([k for k, _ in each]), return_inverse=True)
        if not len(keys):
            continue
        counts = np.zeros((len(each), len(keys)), np.float32)
        counts[np.repeat(np.arange(len(each)), [len(k) for k, _ in each]), where] = np.concatenate([c for _, c in each])
        for i in range(0, len(keys), 1024):  # few trigrams' vectors at a time, as each takes 4 KB
            k = keys[i : i + 1024]
            bound = (first[k // _LETTERS**2] * second[k // _LETTERS % _LETTERS] * third[k % _LETTERS]).astype(np.float32)
            out[at : at + 32] += counts[:, i : i + 1024] @ bound
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length == 0, 1, length)


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's sum of unit vectors for each language."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        v = vectors(batch.column(1).to_pylist())
        for lang, x in zip(batch.column(0).to_pylist(), v):
            sums[lang] = sums.get(lang, 0) + x.astype(np.float64)
    for lang, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x)), pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x)], ["lang", "place", "value"])


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Language names and their unit prototypes, from ``labelled(text, lang)``.

    Prototypes come from at most ``per_language`` distinct texts of each language, those with the smallest hashes, and
    at most ``LANGUAGES`` languages, the most frequent ones (then by name), are learned; so the sample and what the
    driver receives, a vector for each language, do not grow with the input. Rows whose text or lang is null are
    left out.
    """
    small_batches(labelled.sparkSession)
    known = labelled.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("texts")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    share = stage(counts.select("lang", (1.3 * (per_language + 20) / F.greatest("texts", F.lit(1))).alias("share")), "languages")
    # Only hashes below a share of their range are ranked, so a frequent language is not gathered.
    drawn = known.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    sample = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language).select("lang", "text")
    rows = sample.mapInArrow(_bundles, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value")).collect()
    names = sorted({r.lang for r in rows})
    found = np.zeros((len(names), DIMENSIONS))
    for r in rows:
        found[names.index(r.lang), r.place] = r.value
    return names, (found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the largest cosine (0 if it is negative).

    A row whose text is null or has no letter, and every row if no language was learned, gets ``und`` and
    score 0. Equal cosines: the name that comes first. All columns of ``docs`` are kept; columns named
    like the two results, whose names are ``out``, are replaced.
    """
    kept = [c for c in docs.columns if c not in out]
    fields = [docs.schema[c] for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vectors(batch.column(kept.index(text)).to_pylist())
            if names:
                cosine = v @ prototypes.T
                best, score = cosine.argmax(axis=1), np.clip(cosine.max(axis=1).astype(np.float64), 0, 1)
            none = ~v.any(axis=1) | (not names)
            lang = [UNDETERMINED if none[i] else names[best[i]] for i in range(len(v))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(np.where(none, 0.0, score) if names else np.zeros(len(v)))], [*kept, *out])

    small_batches(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, T.StructType([*fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())]))


def identify(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``; learned from the rows of ``docs`` that are
    not held out and have a language."""
    names, prototypes = fit(docs.where(fold() != 1).select("text", "lang"), per_language)
    return predict(docs, names, prototypes).withColumn("held_out", fold() == 1)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, prototypes = fit(docs.where(fold() != 1).select("text", "lang"))
    return predict(docs.select("doc_id", "text"), names, prototypes).select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", "score")
