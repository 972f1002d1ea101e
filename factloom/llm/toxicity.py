"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over block-max inverted lists.

A bounded sample of labelled documents is the example set. Every word of a text is a term, and of longer words
also their beginning, so that inflected words are known by their stem; no term is left out. A term's weight is
(1 + ln tf) x idf x relevance: document frequencies are counted over the whole corpus, and the relevance
(x + 0.25) / (x + 5.25), x being the term's chi-square with the label by Yates, keeps the many words that say
nothing about it from outweighing the few that do. (Without it, ``relevance=0``, the neighbours of a text are those
that share its topic and not its toxicity: on ``check_l`` no cut would find any toxic text and leave 99.7 % of the
others alone, and with it every cut in a wide range finds all.)

Examples stand in blocks. A term's inverted list that is long is held block by block with the largest weight in each
block; a short one is read as a whole. A text's cosines with a block's examples are at most its sum over short lists
plus the sum of the block's largest weights; blocks whose bound is below the k-th best cosine found so far hold no
nearer example and are skipped, so the k nearest are exact (weights of examples have single precision). Votes are weighted by cosine and class, and a
logistic curve fitted on the examples (their own near copies left out of the vote) makes them probabilities. The
neighbours are the evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import fold, no_collection, small_batches, table
from factloom.scratch import stage

#: Labelled examples of each class, at most, and their characters; those with the smallest hashes come first.
EXAMPLES_PER_CLASS, CHARACTERS_PER_CLASS = 4096, 32_000_000
#: Length of the beginning that is a term of longer words.
STEM = 6
#: Chi-square at which a term keeps half of its weight, about, and what is added to each, so that every term has some.
RELEVANCE, LEAST = 5.0, 0.25
#: Neighbours, examples of a block, lists that are held in blocks, and blocks that are opened first.
NEIGHBOURS, BLOCK, LONG_LISTS, FIRST = 15, 64, 1024, 4
#: Texts, and entries of their lists, that are scored at a time.
_TEXTS, _ENTRIES = 128, 2_000_000
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> Counter[str]:
    return Counter(_WORD.findall((text or "").lower()))


def terms_of(word: str) -> tuple[str, ...]:
    """The word, and its beginning with a star behind it if it is longer."""
    return (word, word[:STEM] + "*") if len(word) > STEM else (word,)


class Vocabulary:
    """Numbers of the examples' terms in a text."""

    def __init__(self, terms: list[str]):
        self.words = {t: i for i, t in enumerate(terms) if not t.endswith("*")}
        self.stems = {t[:-1]: i for i, t in enumerate(terms) if t.endswith("*")}
        self.last = np.zeros(len(terms), np.int32)

    def find(self, words: Counter[str]) -> tuple[np.ndarray, np.ndarray]:
        """Terms, each once, and how often the text has each."""
        word, stem = self.words.get, self.stems.get
        at = np.array([word(w, -1) for w in words] + [stem(w[:STEM], -1) if len(w) > STEM else -1 for w in words], np.int32)
        n = np.tile(np.fromiter(words.values(), np.int64, len(words)), 2)
        at, n = at[at >= 0], n[at >= 0]
        # Stems that several words share are added up at the place of the last of them.
        place = np.arange(len(at), dtype=np.int32)
        self.last[at] = place
        own = self.last[at]
        return at[own == place], np.bincount(own, n, len(at))[own == place]


@dataclass
class Model:
    """Examples in blocks; ``lists`` is the inverted index: term ``t`` stands at ``place[ptr[t]:ptr[t + 1]]``, with ``weight``."""

    terms: list[str]
    factor: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    vote_weight: np.ndarray
    family: np.ndarray
    ptr: np.ndarray
    place: np.ndarray
    weight: np.ndarray
    none: float
    curve: tuple[float, float] = (0.0, 0.0)
    #: What ``terms_of_texts`` gives for the documents that the model was fitted with.
    found: DataFrame | None = None

    def __post_init__(self) -> None:
        self.index()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("found", "row", "blocks", "most", "both")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.index()

    def index(self) -> None:
        """The parts of the index that follow from the lists."""
        size = np.diff(self.ptr)
        long = np.argsort(-size, kind="stable")[:LONG_LISTS]
        self.row = np.full(len(size), -1, np.int64)
        self.row[long] = np.arange(len(long))
        n = -(-len(self.ids) // BLOCK)
        self.blocks = np.zeros((n, len(long), BLOCK), np.float32)
        for r, t in enumerate(long):
            at = self.place[self.ptr[t] : self.ptr[t + 1]]
            self.blocks[at // BLOCK, r, at % BLOCK] = self.weight[self.ptr[t] : self.ptr[t + 1]]
        # Place and weight of an entry side by side, so that one look finds both.
        both = np.empty((len(self.place), 2), np.int32)
        both[:, 0], both[:, 1] = self.place, self.weight.view(np.int32)
        self.both = both.view(np.int64).ravel()
        self.most = self.blocks.max(axis=2, initial=0.0).T.copy() * np.float32(1 + 1e-6)

    def vectors(self, edge: np.ndarray, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts whose terms and occurrences stand between the edges: the edges, terms and weights of their vectors of
        length 1. (Words that no example has have no relevance, so no weight.)"""
        doc = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        w = (1 + np.log(n)) * self.factor[term]
        length = np.sqrt(np.bincount(doc, w * w, len(edge) - 1))
        kept = w > 0
        doc, term, w = doc[kept], term[kept], w[kept]
        return np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(edge) - 1)))), term, w / length[doc]

    def nearest(self, edge: np.ndarray, term: np.ndarray, q: np.ndarray, family: np.ndarray | None = None, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place and cosine of each vector's k nearest examples with a cosine over 0, the nearest first, ties to the
        earlier place. ``family`` names for each text the examples that are not asked."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        entries = np.concatenate(([0], np.cumsum(np.where(self.row[term] < 0, self.ptr[term + 1] - self.ptr[term], 0))))[edge]
        at = 0
        while at < len(edge) - 1:
            to = max(at + 1, min(at + _TEXTS, int(np.searchsorted(entries, entries[at] + _ENTRIES, "right")) - 1, len(edge) - 1))
            cut = slice(edge[at], edge[to])
            doc, place, score = self._some(edge[at : to + 1] - edge[at], term[cut], q[cut], None if family is None else family[at:to], k)
            found.append((doc + at, place, score))
            at = to
        return tuple(np.concatenate(x) for x in zip(*found))

    def _some(self, edge: np.ndarray, term: np.ndarray, q: np.ndarray, family: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, blocks = len(edge) - 1, len(self.blocks)
        if not blocks:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        doc = np.repeat(np.arange(n), np.diff(edge))
        row = self.row[term]
        short = row < 0
        size = (self.ptr[term + 1] - self.ptr[term])[short]
        entry = np.arange(size.sum())
        entry += np.repeat(self.ptr[term[short]] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        both = self.both.take(entry).view(np.int32).reshape(-1, 2)
        where = both[:, 0] + np.repeat(doc[short] * (blocks * BLOCK), size)
        value = both[:, 1].view(np.float32) * np.repeat(q[short], size)
        sums = np.bincount(where, value, n * blocks * BLOCK).astype(float, copy=False).reshape(n, blocks, BLOCK)
        if family is not None:
            own = np.full(blocks * BLOCK, -1, np.int64)
            own[: len(self.family)] = self.family
            sums[own.reshape(blocks, BLOCK)[None] == family[:, None, None]] = -np.inf
        rest = np.zeros((n, len(self.most)), np.float32)
        rest[doc[~short], row[~short]] = q[~short]
        partly = sums.max(axis=2)
        bound = partly + rest @ self.most
        opened = np.zeros((n, blocks), bool)

        def open_(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                who = np.flatnonzero(wanted[:, b])
                sums[who, b] += rest[who] @ self.blocks[b]
            opened[:] |= wanted

        first = np.zeros((n, blocks), bool)
        m = min(FIRST, blocks)
        np.put_along_axis(first, np.argpartition(-bound, m - 1, axis=1)[:, :m], True, axis=1)
        open_(first & (bound > 0))
        # k examples reach what the k-th best of an opened block, or of the blocks' best sums so far, has.
        least = np.zeros(n)
        if m * BLOCK >= k:
            least = np.maximum(least, np.partition(sums[first].reshape(n, -1), m * BLOCK - k, axis=1)[:, m * BLOCK - k])
        if blocks >= k:
            least = np.maximum(least, np.partition(partly, blocks - k, axis=1)[:, blocks - k])
        open_(~opened & (bound >= least[:, None] - 1e-5) & (bound > 0))
        who, block = np.nonzero(opened & (sums.max(axis=2) >= least[:, None]))
        near = sums[who, block]
        row, at = np.nonzero((near >= least[who, None]) & (near > 0))
        who, score, place = who[row], near[row, at], block[row] * BLOCK + at
        order = np.lexsort((place, -score, who))
        who, place, score = who[order], place[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        return who[rank < k], place[rank < k], score[rank < k]

    def probabilities(self, n: int, doc: np.ndarray, place: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Of each of n texts, from its neighbours; ``none`` for a text without any."""
        w = score * self.vote_weight[place]
        total, bad = np.bincount(doc, w, n), np.bincount(doc, w * self.label[place], n)
        vote = bad / np.where(total > 0, total, 1)
        return np.where(total > 0, 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * vote, -30, 30))), self.none)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one number, with a little ridge, by Newton's method."""
    a, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2), a.T @ (w * (y - p)) - 0.01 * beta)
        beta += step
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _family(words: Counter[str]) -> int:
    """One number for texts that have nearly all words in common: their least hashes under four seeds."""
    import xxhash

    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    least = [min((xxhash.xxh64_intdigest(w, seed) for w in raw), default=0) for seed in (1, 2, 3, 4)]
    return xxhash.xxh64_intdigest(repr(least)) >> 1


_EXAMPLE = "doc_id long, toxic int, family long, words array<string>, counts array<int>"


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [words_of(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([_family(w) for w in found], pa.int64()), pa.array([list(w) for w in found], pa.list_(pa.string())), pa.array([list(w.values()) for w in found], pa.list_(pa.int32()))],
            ["doc_id", "toxic", "family", "words", "counts"],
        )


def _found(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms.value)
        for batch in batches:
            with no_collection():
                each = [vocabulary.find(words_of(t)) for t in batch.column(1).to_pylist()]
            edge = pa.array(np.concatenate(([0], np.cumsum([len(t) for t, _ in each]))), pa.int32())
            flat = [np.concatenate(x).astype(np.int32) if each else np.zeros(0, np.int32) for x in (list(zip(*each)) or [(), ()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.ListArray.from_arrays(edge, pa.array(x, pa.int32())) for x in flat]], ["doc_id", "terms", "counts"])

    return run


def terms_of_texts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``(doc_id, terms, counts)`` of every row of ``docs(doc_id, text)``: the numbers of those terms that it has."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(terms)  # bounded by the examples
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_found(held), "doc_id long, terms array<int>, counts array<int>")


def _chosen(text: DataFrame, own: DataFrame, per_class: int, characters: int) -> DataFrame:
    """Labelled texts ``(doc_id, toxic, text)``, by the hashes of their ids, within the two bounds of a class."""
    spark = text.sparkSession
    ids = own.where("toxic = 1").orderBy(F.xxhash64("doc_id")).limit(per_class).unionByName(own.where("toxic = 0").orderBy(F.xxhash64("doc_id")).limit(per_class))
    side = spark.createDataFrame([(r.doc_id, r.toxic) for r in ids.collect()], "doc_id long, toxic int")
    mine = stage(text.join(F.broadcast(side), "doc_id").select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "toxic", "text").dropDuplicates(["doc_id", "key"]), "labelled")
    kept = []
    for toxic in (0, 1):
        used = 0
        for r in mine.where(F.col("toxic") == toxic).select("doc_id", "key", F.length(F.coalesce("text", F.lit(""))).alias("n")).orderBy(F.xxhash64("doc_id"), "key").limit(per_class).collect():
            if used + r.n <= characters:
                kept.append((r.doc_id, r.key))
                used += r.n
    wanted = spark.createDataFrame(kept, "doc_id long, key long")
    return mine.join(F.broadcast(wanted), ["doc_id", "key"], "left_semi").select("doc_id", "toxic", "text")


def _lists(words: pa.ChunkedArray, counts: pa.ChunkedArray, part: int = 512) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The examples' terms, and for each term of each example (example, term, occurrences)."""
    flat = pc.list_flatten(words).combine_chunks().dictionary_encode()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    number: dict[str, int] = {}
    pairs = np.full((len(flat.dictionary), 2), -1, np.int32)
    for i, w in enumerate(flat.dictionary):
        for j, t in enumerate(terms_of(w.as_py())):
            pairs[i, j] = number.setdefault(t, len(number))
    code, n = flat.indices.to_numpy(zero_copy_only=False), pc.list_flatten(counts).to_numpy()
    size = pc.list_value_length(words).to_numpy()
    edge = np.concatenate(([0], np.cumsum(size)))
    found = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))]
    for at in range(0, len(size), part):  # a part at a time, as its terms come several times over
        to = min(at + part, len(size))
        cut = slice(edge[at], edge[to])
        term = pairs[code[cut]]
        keys = (np.repeat(np.arange(at, to), size[at:to])[:, None] * len(number) + term)[term >= 0]
        key, where = np.unique(keys, return_inverse=True)
        found.append(((key // len(number)).astype(np.int32), (key % len(number)).astype(np.int32), np.bincount(where, np.repeat(n[cut], 2).reshape(-1, 2)[term >= 0], len(key)).astype(np.float32)))
    return list(number), *(np.concatenate(x) for x in zip(*found))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = EXAMPLES_PER_CLASS, relevance: float = RELEVANCE, characters: int = CHARACTERS_PER_CLASS) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, whose labels are all taken as
    training labels. Null labels and ids, and ids with both labels, are left out; near copies count once where terms
    are compared with the label.

    The driver gets the words of the examples: ``per_class`` of each class and ``characters`` of text, at most.
    Document frequencies are counted over all of ``docs``. With ``relevance`` 0 terms have their plain TF-IDF weight.
    """
    small_batches(docs.sparkSession)
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("y"), F.max("toxic").alias("z")).where("y = z").select("doc_id", F.least(F.greatest("y", F.lit(0)), F.lit(1)).cast("int").alias("toxic"))
    size = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = _chosen(text, own, per_class, characters).mapInArrow(_examples, _EXAMPLE).toArrow().sort_by([("doc_id", "ascending"), ("family", "ascending")])
    label, family = got.column("toxic").to_numpy().astype(float), got.column("family").to_numpy()
    ids = got.column("doc_id").to_numpy()
    terms, example, term, n = _lists(got.column("words"), got.column("counts"))
    del got
    found = stage(terms_of_texts(docs, terms), "terms")
    counted = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()
    df = np.zeros(len(terms))
    df[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    total = found.count()
    del counted
    factor = np.log((1 + total) / (1 + df))
    if relevance:
        names, group = np.unique(family, return_inverse=True)
        bad = np.zeros(len(names))
        np.maximum.at(bad, group, label)
        pair = np.unique(term.astype(np.int64) * max(len(names), 1) + group[example])
        m = np.bincount(pair // max(len(names), 1), minlength=len(terms)).astype(float)
        a = np.bincount(pair // max(len(names), 1), bad[pair % max(len(names), 1)], len(terms))
        f, f1 = float(len(names)), bad.sum()
        del pair
        gap = np.maximum(np.abs(a * (f - f1) - (m - a) * f1) - f / 2, 0)
        chi2 = f * gap * gap / (max(f1, 1.0) * max(f - f1, 1.0) * m * np.maximum(f - m, 0.5))
        factor = factor * (chi2 + LEAST) / (chi2 + LEAST + relevance)
    weight = (1 + np.log(n.astype(float))) * factor[term]
    del n
    length = np.sqrt(np.bincount(example, weight**2, len(label)))
    kept = weight > 0
    example, term, weight = example[kept], term[kept], weight[kept] / length[example[kept]]
    # Examples whose heaviest term is the same stand together, so that blocks differ in their terms; silent ones go.
    top = np.zeros(len(label))
    np.maximum.at(top, example, weight)
    heaviest = np.full(len(label), len(terms))
    np.minimum.at(heaviest, example[weight == top[example]], term[weight == top[example]])
    speaks = np.flatnonzero(heaviest < len(terms))
    order = speaks[np.argsort(heaviest[speaks], kind="stable")]
    place = np.zeros(len(label), np.int32)
    place[order] = np.arange(len(order))
    at = place[example]
    by = np.lexsort((at, term))
    ptr = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(terms)))))
    n1, n0 = label.sum(), len(label) - label.sum()
    share = np.where(label == 1, size.get(1, 0) / max(n1, 1), size.get(0, 0) / max(n0, 1))
    silent = np.setdiff1d(np.arange(len(label)), order)
    rate = (size.get(1, 0) + 0.5) / (sum(size.values()) + 1)
    none = (share[silent] @ label[silent] + rate) / (share[silent].sum() + 1)
    model = Model(terms, factor, ids[order], label[order], share[order], family[order], ptr, at[by], weight[by].astype(np.float32), float(none), found=found)
    if len(order):
        own_terms = np.argsort(at, kind="stable")
        edge = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(order)))))
        doc, at, cosine = model.nearest(edge, term[own_terms], weight[own_terms], model.family)
        w = cosine * model.vote_weight[at]
        total_w = np.bincount(doc, w, len(order))
        has = total_w > 0
        vote = np.bincount(doc, w * model.label[at], len(order))[has] / total_w[has]
        model.curve = _logistic(vote, model.label[has], model.vote_weight[has] / max(model.vote_weight[has].mean(), 1e-12)) if has.any() else (0.0, 0.0)
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, predicted, evidence)`` for every row of ``docs(doc_id, text)``; the evidence is
    an array of (doc_id, cosine, toxic), nearest first.

    A text that is null, empty or without any term that an example has has no neighbour and gets the rate of
    toxic examples among those without terms. Repeated rows are returned as often as they come, a null
    doc_id is kept, other columns are ignored; an empty table gives an empty result.
    """
    return score_terms(terms_of_texts(docs, model.terms), model, threshold)


def score_terms(found: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``score`` of texts whose terms are found already: ``found(doc_id, terms, counts)``."""
    held = found.sparkSession.sparkContext.broadcast(model)  # bounded by the examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            edge = np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column(1)).to_numpy())))
            doc, place, cosine = model.nearest(*model.vectors(edge, pc.list_flatten(batch.column(1)).to_numpy(), pc.list_flatten(batch.column(2)).to_numpy()))
            scores = model.probabilities(batch.num_rows, doc, place, cosine)
            evidence = pa.StructArray.from_arrays([pa.array(model.ids[place], pa.int64()), pa.array(cosine, pa.float64()), pa.array(model.label[place].astype(np.int32))], ["doc_id", "cosine", "toxic"])
            first = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32)), pa.ListArray.from_arrays(first, evidence)], ["doc_id", "score", "predicted", "evidence"])

    small_batches(found.sparkSession)
    return found.mapInArrow(run, "doc_id long, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(fold() != 1).select("doc_id", "toxic"))
    nearest = F.get("evidence", F.lit(0))
    return score_terms(model.found, model).select("doc_id", (fold() == 1).alias("held_out"), "score", "predicted", F.size("evidence").alias("n_neighbours"), nearest["doc_id"].alias("nearest_doc_id"), nearest["cosine"].alias("nearest_cosine"))
