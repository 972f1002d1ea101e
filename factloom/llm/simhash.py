"""SimHash near-duplicates with covering locality-sensitive hashing.

Covering construction: each of the 64 bits gets a non-zero vector of ``radius + 1`` bits, and for each
non-zero vector v of that length there is a table whose mask keeps the bits whose vector has an odd
inner product with v. At most ``radius`` differing bits span a space of at most ``radius`` dimensions,
so some v is orthogonal to all their vectors; that table's mask keeps none of the differing bits and the
pair agrees on its key. So 2^(radius+1) - 1 tables (15 for radius 3) miss no pair, and each key keeps 32
to 36 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import small_batches, table
from factloom.operators.graph import components
from factloom.scratch import stage

RADIUS, WORDS, SEED = 3, 3, 42
#: Fingerprints that one task compares with each other; larger buckets are split into pairs of blocks.
BLOCK = 2048
_PIECE = 65_536


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The tables' masks, as unsigned integers."""
    n = (1 << (radius + 1)) - 1
    vector = [i % n + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, n + 1)]


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of the XXH64 hashes of all word shingles, repeats included.

    A bit is set if more than half of the hashes have it. Null, empty and blank texts give 0; a text of
    fewer than ``words`` words is one shingle.
    """
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII alone
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    whole = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.concatenate(([0], np.cumsum(size[:-1] + 1)))
    end = (start + size)[min(words, len(parts)) - 1 :]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        to = min(n, at + _PIECE)
        raw = b"".join([digest(whole[s:e], seed) for s, e in zip(start[at:to].tolist(), end[at:to].tolist())])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["key", "fp"])


def _forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of at most ``radius`` differing bits that connect whatever such edges connect."""
    left, found = prints[1:], []
    queue = [prints[0]]
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
            continue
        at = queue.pop()
        if not len(left):
            break
        near = np.bitwise_count(left ^ at) <= radius
        if near.any():
            queue += (new := list(left[near]))
            found += [(int(at), int(x)) for x in new]
            left = left[~near]
    return found


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in batch.column(0):
                found += _forest(row.values.to_numpy(zero_copy_only=False).astype(np.int64), radius)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return run


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``(a, b)`` of distinct fingerprints ``fp`` at most ``radius`` bits apart: not all pairs, but enough
    of them to connect everything that all pairs would.

    A bucket of at most ``block`` fingerprints is one row for one task. A larger bucket is dealt into
    blocks by hash, and each pair of its blocks becomes such a row, so no task holds more than two
    blocks and no pair of fingerprints is left out.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)])
    keyed = prints.select("fp", F.inline(tables))
    counts = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), blocks.cast("long")).cast("int")
    dealt = keyed.join(counts, ["t", "key"]).select("t", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = dealt.groupBy("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("prints"))
    return rows.where(F.size("prints") > 1).select("prints").mapInArrow(_links(radius), "a long, b long")


def grouped(rows: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``(key, fp, least)`` for every row of ``rows(key, text)``, whose keys may be of any type with an
    order; ``least`` is the smallest key reachable, null only if all are."""
    small_batches(rows.sparkSession)
    kind = rows.schema["key"].dataType.simpleString()
    each = stage(rows.select("key", F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, f"key {kind}, fp long"), "fingerprints")
    distinct = stage(each.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    group = components(links(distinct, radius, block))
    rooted = distinct.join(group.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    keys = rooted.groupBy("root").agg(F.min("least").alias("least"))
    named = rooted.select("fp", "root").join(keys, "root").select("fp", "least")
    return each.join(named, "fp").select("key", "fp", "least")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest doc_id
    reachable. Rows with null, empty or blank text have fingerprint zero and link like any other; rows
    with a null doc_id are returned, and a component has a null id only if all its ids are null.
    Repeated rows are returned as often as they come. Other columns are ignored; an empty table gives an
    empty result.
    """
    found = grouped(docs.select(F.col("doc_id").cast("long").alias("key"), "text"), radius, block)
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
