"""Candidate pairs and their classification.

Language-model answers come from a table of judgments, keyed by the pair's content hash. A live model is
any function that fills that table; everything else is one plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.evidence import evidence_caveat, relation
from factloom.functions.text import PAIR_FIELDS, hash_text, pair_signature
from factloom.operators.adjudicate import OVERRIDE, STORED, score_pair
from factloom.operators.compare import adjudicate_pairs, compare_pairs
from factloom.scratch import checked_broadcast, stage
from factloom.session import reach

TOP_K = 4
#: Numbers in a block of the similarity join: of probes, and of pool rows, which come as wide as they are stored.
BLOCK, POOL_BLOCK = 1 << 22, 1 << 23
#: Probes and pool rows that are multiplied at a time; the first pool rows are fewer, as all that are near the best of them are scored.
ROWS, FIRST, STEP = 512, 256, 2048
#: Pairs that are scored exactly at a time.
SCORED = 1 << 14
JUDGMENTS = "pair_hash string, same_metric boolean, slice_a string, slice_b string, reason string, relation_type string, explanation string, reconciliation_context string, confidence double"


def _matrix(vec: pa.ChunkedArray, n: int) -> np.ndarray:
    return vec.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _finite(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors by id; a vector with a number that is null or not finite has no finite product."""
    ids, x = table.column("id").to_numpy(), _matrix(table.column("vec"), table.num_rows)
    order = np.argsort(ids, kind="stable")
    order = order[np.isfinite(x[order]).all(axis=1)]
    return ids[order], x[order]


def _without_copies(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors those of the k + 1 smallest ids: k others have the same score and a smaller id than any further one."""
    if not x.size:
        return ids, x
    same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(same, kind="stable")
    new = np.concatenate(([True], np.diff(same[order]) != 0))
    nth = np.cumsum(new | np.concatenate(([True], np.diff(ids[order]) != 0)))
    keep = np.sort(order[nth - nth[new][np.cumsum(new) - 1] <= k])
    return ids[keep], x[keep]


def _score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, in double precision and added in order, so that equal pairs have equal scores wherever they stand."""
    parts = [np.cumsum(x[i : i + SCORED].astype(np.float64) * y[i : i + SCORED], axis=1)[:, -1] for i in range(0, len(x), SCORED)]
    return np.concatenate(parts) if parts else np.empty(0)


def _best(k: int):
    kind = pa.list_(pa.struct([("below", pa.float64()), ("other_id", pa.int64())]))

    def run(probe: pa.Table, pool: pa.Table) -> pa.Table:
        none = pa.table({"id": pa.array([], pa.int64()), "found": pa.array([], kind)})
        if not probe.num_rows or not pool.num_rows:
            return none
        (a, x), (b, y) = _finite(probe), _without_copies(*_finite(pool), k)
        if not len(a) or not x.shape[1] or not len(b):
            return none
        width = x.shape[1]
        long_x, long_y = (np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64)) for v in (x, y))
        # Small multiples of 1/1024 have exact products; else single precision sifts where it neither overflows nor vanishes.
        # Vectors of doubles keep the product's sum, which fuses multiplying and adding as the SQL's does; for single ones the two are alike.
        wide = x.dtype == np.float64 or y.dtype == np.float64
        exact = wide or width <= 1 << 12 and all(np.abs(v).max() <= 1024 and (v * 1024 == np.rint(v * 1024)).all() for v in (x, y))
        narrow = not exact and x.dtype == y.dtype == np.float32 and 1e-25 < long_x.max() * long_y.max() < 1e37
        kinds = (np.float32, np.float64) if narrow else (np.float64,)
        ids, scores, sizes = [], [], []
        for at in range(0, len(a), ROWS):
            own, part = a[at : at + ROWS], x[at : at + ROWS]
            # The best so far, by score and then id; what follows has larger ids, so it must have more than the last of them.
            score, other = np.full((len(own), k), -np.inf), np.zeros((len(own), k), np.int64)
            to = 0
            while to < len(b):
                end = to + (STEP if to else FIRST)
                some, tile = b[to:end], y[to:end]
                for t in kinds:
                    now = part.astype(t, copy=False) @ tile.astype(t, copy=False).T
                    # No product is further than this from its exact score.
                    off = 0.0 if exact else 2 * (width + 2) * (np.finfo(t).eps * long_x[at : at + ROWS] * long_y[to:end].max() + np.finfo(t).tiny)
                    least = score[:, -1]
                    if np.isneginf(least).any():
                        now[own[:, None] == some[None, :]] = -np.inf
                        if now.shape[1] > k:
                            least = np.maximum(least, np.nextafter(np.partition(now, -k, axis=1)[:, -k].astype(np.float64) - off, -np.inf))
                    near = np.flatnonzero(now > (least - off).astype(t)[:, None])
                    if len(near) <= now.size >> 5:
                        break
                i, j = np.divmod(near, now.shape[1])
                i, j = (v[own[i] != some[j]] for v in (i, j))
                for lo in range(0, len(i), SCORED):
                    _merge(score, other, i[lo : lo + SCORED], now[i[lo : lo + SCORED], j[lo : lo + SCORED]] if wide else _score(part[i[lo : lo + SCORED]], tile[j[lo : lo + SCORED]]), some[j[lo : lo + SCORED]])
                to = end
            there = np.isfinite(score)
            ids.append(other[there])
            scores.append(score[there])
            sizes.append(there.sum(axis=1))
        found = pa.StructArray.from_arrays([pa.array(-np.concatenate(scores)), pa.array(np.concatenate(ids))], fields=list(kind.value_type))
        edge = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), pa.int32())
        return pa.table({"id": pa.array(a, pa.int64()), "found": pa.ListArray.from_arrays(edge, found)})

    return run


def _merge(score: np.ndarray, other: np.ndarray, row: np.ndarray, more: np.ndarray, ids: np.ndarray) -> None:
    """Put scored pairs, by row and then id, among the best of their rows; at equal scores those that are there stay first."""
    use = np.isfinite(more)
    use[use] = more[use] > score[row[use], -1]
    row, more, ids = row[use], more[use], ids[use]
    if not len(row):
        return
    rows, first, size = np.unique(row, return_index=True, return_counts=True)
    k, place = score.shape[1], np.arange(len(row)) - np.repeat(first, size)
    both, who = np.full((len(rows), k + size.max()), -np.inf), np.zeros((len(rows), k + size.max()), np.int64)
    both[:, :k], who[:, :k] = score[rows], other[rows]
    at = np.repeat(np.arange(len(rows)), size)
    both[at, k + place], who[at, k + place] = more, ids
    best = np.argsort(-both, axis=1, kind="stable")[:, :k]
    score[rows], other[rows] = np.take_along_axis(both, best, axis=1), np.take_along_axis(who, best, axis=1)


def deal(probes: int, pool: int, tasks: int, block: int, pool_block: int) -> tuple[int, int]:
    """How many blocks of probes and of pool rows: of at most so many rows, and about ``tasks`` pairs of blocks, so what is copied
    follows the input until ``tasks`` full blocks of probes are not enough."""
    m = max(1, -(-pool // pool_block))
    return max(1, -(-probes // block), min(-(-tasks // m), -(-probes // 256))), m


def top_k_similar(probe: DataFrame, pool: DataFrame, k: int = TOP_K, block: int = BLOCK, pool_block: int = POOL_BLOCK) -> DataFrame:
    """``(id, other_id, score, rank)``: for each probe the k pool rows with the largest inner
    product, never itself, ties to the smaller id. Both sides are (id, embedding).

    Both sides are dealt into blocks of bounded size by hash; each pair of blocks is one task's work, which multiplies
    them a part at a time and passes on k rows for each probe; a second step merges these. A probe is copied for each
    block of the pool and a pool row for each block of probes, at its stored width. Rows without a vector take no part.
    """
    spark = probe.sparkSession
    reach(spark)

    def side(df: DataFrame, blocks: int, name: str) -> DataFrame:
        narrow = df.schema["embedding"].dataType == T.ArrayType(T.FloatType())
        vec = F.col("embedding").cast("array<float>" if narrow else "array<double>")
        return df.where("id is not null and embedding is not null").select(F.col("id").cast("long").alias("id"), vec.alias("vec"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias(name))

    size = pool.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    wide = max(1, size.d or 1)
    n, m = deal(probe.count(), size.n, 2 * spark.sparkContext.defaultParallelism, max(1, block // wide), max(1, pool_block // wide))
    left = side(probe, n, "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = side(pool, m, "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_best(k), "id long, found array<struct<below:double,other_id:long>>")
    merged = found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("best"))
    each = merged.select("id", F.posexplode("best").alias("at", "b"))
    return each.select("id", "b.other_id", (-F.col("b.below")).alias("score"), (F.col("at") + 1).alias("rank"))


def unordered_pairs(pairs: DataFrame) -> DataFrame:
    """One row for each unordered pair: the one with the best score, then the smaller id."""
    lo, hi = F.least("id", "other_id"), F.greatest("id", "other_id")
    order = Window.partitionBy("lo", "hi").orderBy(F.desc("score"), "id")
    return pairs.withColumn("lo", lo).withColumn("hi", hi).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def new_pairs(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs (lo, hi) that are not stored as (fact_low_id, fact_high_id)."""
    known = stored.select(F.col("fact_low_id").alias("lo"), F.col("fact_high_id").alias("hi")).distinct()
    return pairs.join(known, ["lo", "hi"], "left_anti")


def with_facts(pairs: DataFrame, facts: DataFrame, a: str = "id", b: str = "other_id") -> DataFrame:
    """``pairs`` with the facts of both ends as structs ``a`` and ``b``."""
    x = facts.select(F.col("id").alias("_a"), F.struct(*facts.columns).alias("a"))
    y = facts.select(F.col("id").alias("_b"), F.struct(*facts.columns).alias("b"))
    return pairs.join(x, pairs[a] == x["_a"]).join(y, pairs[b] == y["_b"]).drop("_a", "_b")


def candidates(new: DataFrame, pool: DataFrame, facts: DataFrame, stored: DataFrame | None = None, k: int = TOP_K) -> DataFrame:
    """Scored candidate pairs of new facts against a pool: ``(lo, hi, a, b, cand)``. ``new`` and
    ``pool`` are (id, embedding)."""
    pairs = unordered_pairs(top_k_similar(new, pool, k))
    if stored is not None:
        pairs = new_pairs(pairs, stored)
    scored = with_facts(pairs, facts).withColumn("cand", score_pair(F.col("a"), F.col("b"), F.col("score")))
    return scored.where(F.size("cand.triggers") > 0)


def in_order(pairs: DataFrame) -> DataFrame:
    """``a`` and ``b`` in the order of their content, and ``pair_hash``."""
    x, y = pair_signature(F.col("a")), pair_signature(F.col("b"))
    swap = x > y
    named = pairs.withColumn("_x", x).withColumn("_y", y)
    out = named.select(*[c for c in pairs.columns if c not in ("a", "b")], F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), hash_text(F.least("_x", "_y"), F.greatest("_x", "_y")).alias("pair_hash"))
    return out


def classify(pairs: DataFrame, judgments: DataFrame) -> DataFrame:
    """``pairs`` with facts ``a`` and ``b``, judged: adds ``same_metric``, ``comparison``, ``period``,
    ``scope`` and ``adj``.

    A pair without a judgment, or one that says that the metrics differ, is unrelated; comparing and
    adjudicating only decide for the rest. A proposal that is missing is uncertain.
    """
    ordered = in_order(pairs)
    told = judgments.groupBy("pair_hash").agg(F.min(F.struct(*[c for c in judgments.columns if c != "pair_hash"])).alias("j")).select("pair_hash", "j.*")
    known = ordered.join(told, "pair_hash", "left").withColumn("same_metric", F.coalesce("same_metric", F.lit(False)))
    a, b = F.col("a"), F.col("b")
    sides = [{"value": x["value_numeric"], "unit": x["unit"], "time_period": x["time_period"], "scope": x["scope"]} for x in (a, b)]
    compared = compare_pairs(stage(known, "judged"), *sides)
    llm = F.struct(relation("relation_type").alias("relation_type"), F.col("explanation"), F.col("reconciliation_context"), F.col("confidence"))
    both = a["value_numeric"].isNotNull() & b["value_numeric"].isNotNull()
    judged = adjudicate_pairs(compared, llm, evidence_caveat(a["evidence_status"], b["evidence_status"]), both, F.col("slice_a"), F.col("slice_b")).withColumn("adj", F.when(F.col("same_metric"), F.col("adj")))
    final = F.coalesce(F.col("adj.relation_type"), F.lit("unrelated"))
    return judged.withColumn("final_relation", final).drop("reason", "relation_type", "explanation", "reconciliation_context", "confidence", "slice_a", "slice_b")


def relationships(classified: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Rows to store, one for each unordered pair that is not stored yet; unrelated pairs are not
    kept. The first writer wins: the smallest ids."""
    a, b = F.col("a.id"), F.col("b.id")
    rows = classified.where(F.col("final_relation").isin(*STORED)).select(
        a.alias("fact_id_a"), b.alias("fact_id_b"), F.least(a, b).alias("fact_low_id"), F.greatest(a, b).alias("fact_high_id"), F.col("final_relation").alias("relation_type"),
        "adj.explanation", "adj.reconciliation_context", "adj.confidence", F.col("cand.embedding_score").alias("similarity_score"), F.col("cand.detail").alias("candidate_reason"),
        "adj.decision_source", "adj.llm_proposal", "adj.disagreement", "adj.disagreement_reason", F.col("adj.checks").alias("adjudication"),
    )
    first = Window.partitionBy("fact_low_id", "fact_high_id").orderBy("fact_id_a", "fact_id_b")
    once = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    if stored is None:
        return once
    return once.join(stored.select("fact_low_id", "fact_high_id").distinct(), ["fact_low_id", "fact_high_id"], "left_anti")


def build_summary(classified: DataFrame) -> DataFrame:
    """Counts over all judged pairs."""
    r = F.col("final_relation")
    is_ = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    triggers = F.col("cand.triggers")
    return classified.agg(
        F.count("*").alias("candidate_pairs"),
        is_(~F.col("same_metric")).alias("metric_mismatches"),
        *[is_(r == name).alias(name) for name in STORED],
        is_(r.isin(*STORED)).alias("stored"),
        is_(F.col("adj.decision_source") == OVERRIDE).alias("llm_overridden"),
        is_(F.col("adj.disagreement")).alias("disagreements"),
        is_(~F.array_contains(triggers, "embedding")).alias("hybrid_promotions"),
        is_(F.array_contains(triggers, "numeric")).alias("numeric_matches"),
    )


def judge(pairs: DataFrame, judgments: DataFrame, ask) -> DataFrame:
    """New judgments for the pairs whose hash is not in ``judgments``. ``ask`` maps a batch of
    (pair_hash, a, b) as dicts to judgment dicts, in any order. If it fails on a batch, each pair of it gets a row without
    ``same_metric``, whose ``reason`` is the error."""
    fields = [f.split(" ")[0] for f in JUDGMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"same_metric": pa.bool_(), "confidence": pa.float64()}
        for batch in batches:
            asked = batch.to_pylist()
            try:
                rows = ask(asked)
            except Exception as e:  # noqa: BLE001 - whatever the model's client raises
                rows = [{"pair_hash": r["pair_hash"], "reason": str(e)} for r in asked]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], kinds.get(f, pa.string())) for f in fields], fields)

    reach(pairs.sparkSession)
    asked = in_order(pairs).select("pair_hash", F.struct(*[F.col("a")[f].alias(f) for f in PAIR_FIELDS]).alias("a"), F.struct(*[F.col("b")[f].alias(f) for f in PAIR_FIELDS]).alias("b")).dropDuplicates(["pair_hash"])
    return asked.join(judgments.select("pair_hash"), "pair_hash", "left_anti").mapInArrow(run, JUDGMENTS)


def recall_at_k(pairs: DataFrame, embeddings: DataFrame, ks: tuple[int, ...] = (4, 8, 16, 32)) -> DataFrame:
    """``(k, pairs, hits, recall)``: how many stored pairs (fact_id_a, fact_id_b) have b among the
    k nearest of a."""
    pairs = stage(pairs, "pairs")  # it is read three times
    probes = embeddings.join(checked_broadcast(pairs.select(F.col("fact_id_a").alias("id")).distinct()), "id", "left_semi")
    near = top_k_similar(probes, embeddings, max(ks)).select(F.col("id").alias("fact_id_a"), F.col("other_id").alias("fact_id_b"), "rank")
    found = pairs.join(near, ["fact_id_a", "fact_id_b"], "left")
    counted = found.agg(F.count("*").alias("pairs"), *[F.count_if(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"h{k}") for k in ks])
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks]))
    recall: Column = F.when(F.col("pairs") > 0, F.col("hits") / F.col("pairs")).otherwise(0.0)
    return counted.select("pairs", rows).select("k", "pairs", "hits", recall.alias("recall"))
