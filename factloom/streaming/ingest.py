"""Incremental ingestion with Structured Streaming (I1-I8), and windowed statistics of event streams.

New facts arrive as files; each micro-batch is compared with everything stored and with itself, and its
relationships are appended. A batch that is run again after a failure adds nothing twice: facts are taken
up by id and pairs by their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from factloom.functions.evidence import check_evidence
from factloom.operators.relate import TOP_K, candidates, classify, relationships
from factloom.scratch import stage
from factloom.sources.store import SCHEMAS, Store


def ingest_batch(store: Store, batch: DataFrame, judgments: DataFrame, k: int = TOP_K) -> None:
    """Take up one batch of facts: verify their evidence (V4, V6), store those with new ids, find and judge
    candidate pairs of new facts against all facts, and store new relationships."""
    known = store.read("facts")
    fresh = batch.dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti")
    check = check_evidence(F.col("quote_grounded"))
    fresh = stage(fresh.withColumn("evidence_status", check["status"]), "fresh")
    store.append("facts", fresh)
    facts = store.read("facts")
    # A batch that failed after its facts were stored finds them here again.
    probes = facts.join(batch.select("id").distinct(), "id", "left_semi").select("id", "embedding")
    stored = store.read("relationships")
    pairs = candidates(probes, facts.select("id", "embedding"), facts.drop("embedding"), stored, k)
    rows = stage(relationships(classify(pairs, judgments), stored), "relationships")
    store.append("relationships", rows.withColumn("id", F.xxhash64("fact_low_id", "fact_high_id")).withColumn("created_at", F.current_timestamp()))


def ingest_stream(spark: SparkSession, source: str, store: Store, judgments: DataFrame, checkpoint: str) -> StreamingQuery:
    """All files under ``source`` that were not taken up yet, batch by batch; then the query ends.
    Stopping it keeps what finished batches have stored (I6)."""
    facts = spark.readStream.schema(SCHEMAS["facts"]).option("maxFilesPerTrigger", 100).parquet(source)
    return facts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: ingest_batch(store, batch, judgments)).start()


def windowed_events(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of an event stream (ts, event_type, value) by window and type; events later than ``late``
    behind the newest are dropped. Works on batches too, where nothing is late."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


STALE_AFTER = 20 * 60


def stale_stream(activity: DataFrame, seconds: int = STALE_AFTER) -> DataFrame:
    """``(document_id, status, error_message)``, a row for each document that stays unfinished and silent for so long.

    ``activity`` is a stream of (document_id, status): each row restarts its document's timer, which runs by processing
    time; a finished status ends it. State is one timer for each unfinished document.
    """

    def watch(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"document_id": [key[0]], "status": ["failed"], "error_message": ["no activity"]})
            return
        seen = [s for batch in rows for s in batch["status"]]
        if any(s in ("done", "failed", "cancelled") for s in seen):
            if state.exists:
                state.remove()
        else:
            state.update((True,))
            state.setTimeoutDuration(seconds * 1000)

    known = activity.select(F.col("document_id").cast("long").alias("document_id"), "status").where("document_id is not null")
    return known.groupBy("document_id").applyInPandasWithState(watch, "document_id long, status string, error_message string", "open boolean", "append", "ProcessingTimeTimeout")


def next_status(status: str, event: str) -> str:
    """I8: a document's state after an event; ValueError if the event does not fit."""
    moves = {("pending", "start"): "processing", ("pending", "cancel"): "cancelled", ("processing", "finish"): "done", ("processing", "fail"): "failed", ("processing", "cancel"): "cancelled", ("pending", "fail"): "failed"}
    if (status, event) not in moves:
        raise ValueError(f"a {status} document cannot {event}")
    return moves[status, event]
