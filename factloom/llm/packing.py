"""Best-fit packing of tokenised documents, planned over a histogram of lengths.

Documents are tokenised once into pieces of at most a sequence's length. The driver plans best-fit
decreasing over how many pieces there are of each length: bins that are filled alike are one group with
a multiplicity, so the plan's size depends on the number of lengths and not of documents. Each piece then
takes the planned slot of its rank within its length.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import no_collection, small_batches, table
from factloom.scratch import checked_broadcast, stage

CAPACITY = 2048
END = 0
TOKENIZER = "word_bpe_49k.json"
#: Pieces of one length that are ranked in one task, about; more are dealt into several.
RANKED = 1000
#: Distinct words that a Python worker keeps the ids of, as written, and as many plain ones: about 400 bytes each. They
#: are in two generations: when one is full it becomes the old one, whose words are taken over when they come again,
#: and the one before is dropped.
KEPT = 800_000
_MARKS = ".,;:!?&$#*%|()[]{}-"
#: Characters that are tokenised at a time, about, and words in a call of the tokenizer.
_AT_ONCE, _LOT = 1_000_000, 2000


class _Encoder:
    """Ids of words, each worked out once.

    The tokenizer never joins characters across white space: its normaliser acts on a character and the
    marks after it, and its pre-tokenizer drops white space. It also parts letters from punctuation and
    lower-cases, so a word of Latin letters with punctuation behind it is the lower-cased word and the
    punctuation. Such words are tokenised many in one call; each ends with the only token that is marked as
    a word's end. All other words are tokenised one by one.
    """

    def __init__(self, path: str, kept: int):
        self.kept = kept // 2
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {"": b""}
        self.plain: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_plain: dict[str, bytes] = {}

    def _singly(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> None:
        lots = [words[i : i + _LOT] for i in range(0, len(words), _LOT)]
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast([" ".join(x) for x in lots], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cut = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cut) != len(lot):
                self.plain.update(zip(lot, self._singly(lot)))
                continue
            raw = ids.tobytes()
            for w, a, b in zip(lot, [0, *cut[:-1].tolist()], cut.tolist()):
                self.plain[w] = raw[a:b]

    def learn(self, texts: list[list[str]]) -> None:
        """Work out the words that are not known yet."""
        new = set().union(*texts)
        if len(self.words) > self.kept:
            self.old_words, self.words = self.words, {"": b""}
        if len(self.plain) > self.kept:
            self.old_plain, self.plain = self.plain, {}
        new = new.difference(self.words)
        again = [w for w in new if w in self.old_words]
        self.words.update((w, self.old_words[w]) for w in again)
        new.difference_update(again)
        if not new:
            return
        # Latin words with punctuation behind them, by their lower-cased core and what stands behind it.
        cores, tails, whole, odd = [], [], [], []
        for w in new:
            core = w.rstrip(_MARKS)
            if core.isalpha() and (core.isascii() or (max(core) < "\u0250" and "\u0130" not in core)):
                whole.append(w)
                cores.append(core.lower())
                tails.append(w[len(core) :])
            else:
                odd.append(w)
        wanted = set(cores).difference(self.plain)
        again = [w for w in wanted if w in self.old_plain]
        self.plain.update((w, self.old_plain[w]) for w in again)
        self._together(sorted(wanted.difference(again)))
        alone = sorted(set(tails).union(odd))
        found = dict(zip(alone, self._singly(alone)))
        self.words.update(zip(odd, map(found.__getitem__, odd)))
        self.words.update(zip(whole, map(add, map(self.plain.__getitem__, cores), map(found.__getitem__, tails))))


@lru_cache(2)
def _encoder(path: str, kept: int) -> _Encoder:
    return _Encoder(path, kept)


def encode(texts: list[str | None], path: str, kept: int = KEPT) -> Iterator[bytes]:
    """Of each text its ids, then the end id, as little-endian unsigned 32-bit numbers."""
    encoder, end = _encoder(path, kept), END.to_bytes(4, "little")
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and size < _AT_ONCE:
            size += len(texts[to] or "")
            to += 1
        with no_collection():
            cut = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts[at:to]]
            encoder.learn(cut)
            found = [b"".join(map(encoder.words.__getitem__, words)) + end for words in cut]
        yield from found
        at = to


def _pieces(path: str, capacity: int, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist(), path, kept)):
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``{length: count}``: slots ``(length, rank, count, sequence, offset, each)``.

    The pieces of ``length`` with ranks ``rank`` to ``rank + count - 1`` go, ``each`` at a time, into
    consecutive sequences from ``sequence``, the first of each lot at ``offset`` and the others behind it.
    Lengths are placed from the longest; each goes to the fullest group of bins that has room for it, as
    often as it fits, and new bins are opened when none has.
    """
    slots, opened = [], 0
    rooms: list[int] = []  # sorted
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, number of sequences)

    def put(room: int, first: int, n: int) -> None:
        if room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                n = left // each or 1
                each = min(each, left)
                room, first = capacity, opened
                opened += n
            else:
                room = rooms[at]
                first, held = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
                each = min(room // length, left)
                n = min(held, left // each)
                if n < held:
                    put(room, first + n, held - n)
            slots.append((length, rank, n * each, first, capacity - room, each))
            put(room - each * length, first, n)
            rank, left = rank + n * each, left - n * each
    return slots


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, kept: int = KEPT) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of each document's pieces."""
    import public_tokenizers

    small_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(path, capacity, kept), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ranked: int = RANKED, kept: int = KEPT) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` and their place: ``sequence_id`` and ``offset``.

    Null and empty texts are the end id alone. Documents longer than ``capacity`` are cut into pieces of
    that length, the last maybe shorter; shorter documents are never cut. Repeated rows are packed as
    often as they come; a null doc_id is kept. Other columns are ignored; an empty table gives an empty
    result.

    What the driver gathers is a count for each length, so it is bounded by ``capacity``. A length that many
    pieces share is ranked in several deals, each in one task; pieces are dealt by the row that they stand in, so
    copies are dealt out as evenly as others. A deal's first rank is the sum of the counts of the deals before it.
    A piece's slot is found by halving in its length's sorted slots.
    """
    spark = docs.sparkSession
    cut = stage(pieces(docs, capacity, tokenizer, kept), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in counts}
    for length, rank, _, sequence, place, each in plan(counts, capacity):
        slots[length].append((rank, sequence, place, each))
    rows = [(k, -(-n // ranked), sorted(slots[k])) for k, n in counts.items()]
    side = F.broadcast(spark.createDataFrame(rows, "length long, deals long, slots array<struct<first:long,sequence:long,place:long,each:long>>"))
    named = cut.select("*", F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("row"))
    dealt = named.join(side.select("length", "deals"), "length").withColumn("deal", F.pmod("row", F.col("deals"))).drop("deals")
    ahead = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    size = dealt.groupBy("length", "deal").agg(F.count("*").alias("n"))
    first = stage(size.select("length", "deal", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")), "deals")
    own = F.row_number().over(Window.partitionBy("length", "deal").orderBy("row"))
    rank = dealt.withColumn("own", own).join(checked_broadcast(first), ["length", "deal"]).withColumn("rank", F.col("own") - 1 + F.col("before"))
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(max([len(x) for x in slots.values()], default=1).bit_length()))])
    at = F.aggregate(halves, F.lit(0), lambda acc, step: acc + F.when(F.get("slots", acc + step)["first"] <= F.col("rank"), step).otherwise(0))
    found = rank.join(side.select("length", "slots"), "length").withColumn("slot", F.get("slots", at)).withColumn("step", F.col("rank") - F.col("slot.first"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("slot.sequence + step div slot.each").alias("sequence_id"), F.expr("slot.place + step % slot.each * length").alias("offset"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
