"""Approximate nearest neighbours by largest inner product: inverted lists of coarse centroids,
product-quantised residuals, asymmetric distance tables, and exact reranking.

Coarse centroids and the quantiser's codebooks are fitted on a bounded sample; every vector is indexed.
There are about as many lists as the square root of the number of vectors. How many of them a query probes, and how many
vectors of a list are reranked, is set by brute force: a bounded number of the queries themselves is compared with every
vector, and the search must find most of what that finds. So few lists are probed for clustered vectors, many for vectors
without structure or for queries that are unlike the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import small_batches, table
from factloom.scratch import stage

#: Vectors that the index is fitted on, at most, and of them for each list, at least.
SAMPLE, PER_LIST = 65_536, 16
#: Queries that are compared with every vector, at most.
CHECKED = 256
#: Share of their true neighbours that the probed lists must hold, and that the whole search must find.
REACH, RECALL = 0.975, 0.965
#: Parts of a vector that are quantised by themselves, and code words for each.
PARTS, WORDS = 16, 256
#: Vectors of a list that one task searches; longer lists are dealt into several.
BLOCK = 4096
#: Vectors of each block that are reranked by their exact inner product, for each neighbour wanted: at least, and how
#: many times more where that finds too little.
DEPTH, DEEPER = 3, 4
#: Rows in the lists that a query probes, for each neighbour wanted, at least.
ENOUGH = 10
_FOUND = "array<struct<below:double,none:boolean,vec_id:long,rid:long>>"
_ENTRY = pa.struct([("below", pa.float64()), ("none", pa.bool_()), ("vec_id", pa.int64()), ("rid", pa.int64())])


@dataclass
class Index:
    """What was fitted, the table ``(list, rid, vec_id, vec, code)`` of all vectors, and the recall against brute force that was
    measured (null without queries)."""

    coarse: np.ndarray
    books: list[np.ndarray]
    probes: int
    sizes: dict[int, int]
    rows: DataFrame
    depth: int = DEPTH
    recall: float | None = None


def valid(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``(rid, vec_id, vec)``, staged: the rows whose vector is not null or zero and has only finite components, each with a
    number of its own."""
    vec = F.col(vector).cast("array<double>")
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    return stage(kept.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "vec"), "vectors")


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centre)
        n = np.bincount(own, minlength=len(centre))
        total = np.stack([np.bincount(own, x[:, j], len(centre)) for j in range(x.shape[1])], axis=1)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(centre))])
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    out, half = np.empty(len(x), np.int64), (centre**2).sum(axis=1) / 2
    for at in range(0, len(x), 8192):
        out[at : at + 8192] = (x[at : at + 8192] @ centre.T - half).argmax(axis=1)
    return out


def _spans(d: int) -> list[slice]:
    edge = [round(i * d / min(PARTS, d)) for i in range(min(PARTS, d) + 1)]
    return [slice(a, b) for a, b in zip(edge, edge[1:])]


def _matrix(vec: pa.ListArray) -> np.ndarray:
    return np.asarray(vec.flatten()).reshape(len(vec), -1)


def _encode(coarse: np.ndarray, books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2))
            own = _nearest(x, coarse)
            rest = x - coarse[own]
            code = np.stack([_nearest(rest[:, s], b) for s, b in zip(_spans(x.shape[1]), books)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *batch.columns, pa.array([c.tobytes() for c in code], pa.binary())], ["list", "rid", "vec_id", "vec", "code"])

    return run


def _brute_force(query: np.ndarray, rid: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The best of this task so far: (score, list) for each query.
        score, where = np.full((len(query), 0), -np.inf), np.zeros((len(query), 0), np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            now = query @ _matrix(batch.column("vec")).T
            now[rid[:, None] == batch.column("rid").to_numpy()[None, :]] = -np.inf
            own = np.broadcast_to(batch.column("list").to_numpy(), now.shape)
            score, where = np.concatenate((score, now), axis=1), np.concatenate((where, own), axis=1)
            if score.shape[1] > k:
                best = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, where = np.take_along_axis(score, best, axis=1), np.take_along_axis(where, best, axis=1)
        i, j = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(-score[i, j]), pa.array(where[i, j])], ["query", "below", "list"])

    return run


def _calibrate(index: Index, queries: DataFrame, k: int, reach: float) -> Index:
    """``index`` with as many probes and as much depth as ``queries(rid, vec)`` need, of which at most ``CHECKED`` are compared
    with every vector. The driver gets these and their k true neighbours."""
    drawn = queries.select("rid", "vec", F.col("rid").alias("query_id")).orderBy(F.xxhash64("rid")).limit(CHECKED)
    asked = drawn.toArrow()
    if not asked.num_rows:
        return index
    q, rid = _matrix(asked.column("vec").combine_chunks()), asked.column("rid").to_numpy()
    every = index.rows.select("list", "rid", "vec").mapInArrow(_brute_force(q, rid, k), "query int, below double, list int")
    true = every.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("below", "list"))), 1, k).alias("best")).collect()
    if not true:
        return index
    # How far down a query's ranking of the lists the lists of its true neighbours are.
    place = np.argsort(np.argsort(-(q @ index.coarse.T), axis=1, kind="stable"), axis=1)
    deep = np.sort(np.concatenate([place[r.query, [b.list for b in r.best]] for r in true]))
    index.probes = int(deep[math.ceil(reach * len(deep)) - 1]) + 1
    last = {int(rid[r.query]): -r.best[-1].below for r in true}
    while True:
        found = search(index, drawn, k).select("query_id", "score").collect()
        hits = sum(r.score >= last[r.query_id] - 1e-9 * abs(last[r.query_id]) for r in found)
        index.recall = hits / len(deep)
        if index.recall >= min(RECALL, reach) or index.depth * k >= 2 * BLOCK:
            return index
        index.depth *= DEEPER


def build(rows: DataFrame, k: int = 20, sample: int = SAMPLE, reach: float = REACH, queries: DataFrame | None = None) -> Index | None:
    """An index of ``rows(rid, vec_id, vec)``, a staged table of vectors of one length, for ``queries(rid, vec)`` out of it (any
    row, if None); None if there is no row.

    The driver gets at most ``sample`` vectors, those with the smallest hashes of their numbers, ``CHECKED`` queries with
    their true neighbours, and a count for each list.
    """
    small_batches(rows.sparkSession, 4096)
    total = rows.count()
    if not total:
        return None
    drawn = rows.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < min(1.0, 1.2 * sample / total) * (1 << 30)).orderBy(F.xxhash64("rid")).limit(sample)
    x = _matrix(drawn.select("vec").toArrow().column("vec").combine_chunks())
    coarse = _kmeans(x, max(1, min(math.ceil(math.sqrt(total)), len(x) // PER_LIST)), 10, 1)
    rest = x - coarse[_nearest(x, coarse)]
    books = [_kmeans(rest[:, s], WORDS, 8, 2 + i) for i, s in enumerate(_spans(x.shape[1]))]
    indexed = stage(rows.mapInArrow(_encode(coarse, books), "list int, rid long, vec_id long, vec array<double>, code binary"), "index")
    sizes = {r.list: r.n for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    return _calibrate(Index(coarse, books, len(coarse), sizes, indexed), rows if queries is None else queries, k, reach)


def _parts(n: int) -> int:
    return -(-n // BLOCK)


def _probe(coarse: np.ndarray, probes: int, sizes: dict[int, int], k: int):
    size = np.array([sizes.get(i, 0) for i in range(len(coarse))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cut = batch.slice(at, 256)
                best = np.argsort(-(_matrix(cut.column(1)) @ coarse.T), axis=1, kind="stable")
                # Short lists: further ones, until there are enough rows to choose from.
                before = np.cumsum(size[best], axis=1) - size[best]
                row, at_list = np.nonzero((np.arange(len(coarse)) < probes) | (before < ENOUGH * k + 1))
                where = [(int(i), int(c), p) for i, c in zip(row, best[row, at_list]) for p in range(_parts(size[c]))]
                take = pa.array([w[0] for w in where], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([w[1] for w in where], pa.int32()), pa.array([w[2] for w in where], pa.int32()), cut.column(0).take(take), cut.column(1).take(take)], ["list", "part", "query", "vec"])

    return run


def _search(books: list[np.ndarray], k: int, depth: int):
    empty = pa.table({"query": pa.array([], pa.int64()), "found": pa.array([], pa.list_(_ENTRY))})

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return empty
        # In the order of their ids, those without one last, so that equal products come in that order.
        index = index.sort_by([("vec_id", "ascending"), ("rid", "ascending")])
        ids, rid = index.column("vec_id").combine_chunks(), index.column("rid").to_numpy()
        x = _matrix(index.column("vec").combine_chunks())
        code = np.frombuffer(b"".join(index.column("code").to_pylist()), np.uint8).reshape(len(rid), -1)
        query = queries.column("query").to_numpy()
        q = _matrix(queries.column("vec").combine_chunks())
        spans, deep = _spans(x.shape[1]), min(len(rid), depth * k)
        picks, scores = [], []
        for at in range(0, len(q), 128):
            part = q[at : at + 128]
            # Asymmetric distance: a table of each query's products with all code words, summed by code. The list's
            # centroid adds the same to all of them, so it is left out.
            rough = np.zeros((len(part), len(rid)), np.float32)
            for j, (s, b) in enumerate(zip(spans, books)):
                rough += (part[:, s] @ b.T).astype(np.float32)[:, code[:, j]]
            own = rid[None, :] == query[at : at + 128, None]
            rough[own] = -np.inf
            pick = np.sort(np.argsort(-rough, axis=1, kind="stable")[:, :deep], axis=1)
            exact = np.stack([(x[p] * v).sum(axis=1) for p, v in zip(pick, part)])
            exact[np.take_along_axis(own, pick, axis=1)] = -np.inf
            best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
            picks.append(np.take_along_axis(pick, best, axis=1))
            scores.append(np.take_along_axis(exact, best, axis=1))
        pick, score = np.concatenate(picks), np.concatenate(scores)
        there = np.isfinite(score)
        flat = pa.array(pick[there], pa.int64())
        found = pa.StructArray.from_arrays([pa.array(-score[there]), ids.is_null().take(flat), ids.take(flat), pa.array(rid[pick[there]], pa.int64())], fields=list(_ENTRY))
        edge = pa.array(np.concatenate(([0], np.cumsum(there.sum(axis=1)))), pa.int32())
        return pa.table({"query": pa.array(query, pa.int64()), "found": pa.ListArray.from_arrays(edge, found)})

    return run


def search(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries(rid, query_id, vec)`` the k rows with
    the largest inner products found, ties to the smaller vec_id, null behind all; never the row of the query itself.
    Scores are exact, in double precision. Each pair of a list's block and the queries that probe it is one
    task's work; k results of each go on."""
    parts = F.create_map(*[F.lit(x) for at, n in index.sizes.items() for x in (at, _parts(n))])
    dealt = index.rows.withColumn("part", F.pmod(F.xxhash64("rid", F.lit(3)), F.get(F.array(parts[F.col("list")]), F.lit(0)).cast("long")).cast("int"))
    asked = queries.select("rid", "vec").mapInArrow(_probe(index.coarse, index.probes, index.sizes, k), "list int, part int, query long, vec array<double>")
    found = dealt.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInArrow(_search(index.books, k, index.depth), f"query long, found {_FOUND}")
    best = found.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("best"))
    each = best.select("query", F.posexplode("best").alias("at", "b"))
    named = each.join(queries.select(F.col("rid").alias("query"), "query_id"), "query")
    return named.select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", (-F.col("b.below")).alias("score"))


def neighbours(rows: DataFrame, every: int = 20, k: int = 20, vector: str = "embedding") -> DataFrame:
    """The k nearest neighbours of each row whose vec_id is divisible by ``every``, among all other rows.

    Vectors that are null or zero or hold null or non-finite components take no part, on either side. Rows are told apart
    by themselves: rows that share a vec_id are candidates, and queries, each for itself, and rows without one are
    candidates. Vectors of different lengths have no inner product, so each length has an index of its own. Other
    columns are ignored; an empty table gives an empty result.
    """
    all_rows, out = valid(rows, vector), None
    lengths = sorted(r.d for r in all_rows.select(F.size("vec").alias("d")).distinct().collect())
    for d in lengths:
        mine = all_rows.where(F.size("vec") == d)
        asked = mine.where(F.col("vec_id") % every == 0).select("rid", F.col("vec_id").alias("query_id"), "vec")
        found = search(build(mine, k, queries=asked), asked, k)
        out = found if out is None else out.unionByName(found)
    return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
