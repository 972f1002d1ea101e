"""One document from pages to relationships.

Chunks are taken up in lots: each lot's answers, facts and issues are stored before the next one begins, so a run that is
stopped or fails keeps what was done, and finds it in the cache when it is started again.
"""

from __future__ import annotations

import json
import time
import traceback
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from factloom.functions.answers import Ask
from factloom.operators.arithmetic import check_arithmetic
from factloom.operators.coherence import check_coherence
from factloom.operators.extract import ANSWER, PROMPT, ask_chunks, chunk_hash, facts_of_answers
from factloom.operators.relate import JUDGMENTS, build_summary, candidates, classify, in_order, judge, relationships
from factloom.scratch import stage
from factloom.sources.pages import chunks as cut
from factloom.sources.pages import select_pages
from factloom.sources.store import Store, cache_lookup, reusable_document, vectors
from factloom.streaming.ingest import next_status

LOT, MOST_VIOLATIONS = 64, 50


class Stopwatch:
    """Seconds by stage; a stage that is entered again adds up."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def track(self, stage_name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[stage_name] = self.seconds.get(stage_name, 0.0) + time.perf_counter() - began


def report(name: str, stats: dict) -> str:
    """A run's counts and times as text."""
    counts = [f"{k}: {v}" for k, v in stats.items() if k != "timing"]
    return "\n".join([name, *counts, *[f"{k}: {v:.2f} s" for k, v in stats.get("timing", {}).items()]])


def add_issues(store: Store, rows: DataFrame) -> int:
    """``rows(document_id, page_number, issue_type, detail, raw_excerpt)`` with ids and the time."""
    kept = stage(rows.withColumn("id", F.xxhash64(F.expr("uuid()"))).withColumn("created_at", F.current_timestamp()), "issues")
    store.append("extraction_issues", kept)
    return kept.count()


def request_cancel(store: Store, document_id: int) -> None:
    """Asks a run to stop; it does so before its next lot or stage."""
    status = store.get("documents", document_id).select("status").first()
    if status is None:
        raise KeyError(f"no document {document_id}")
    if status[0] not in ("pending", "processing"):
        raise ValueError(f"a {status[0]} document cannot be stopped")
    store.update_document(document_id, cancel_requested=True)


def cancelled(store: Store, document_id: int) -> bool:
    return bool(store.get("documents", document_id).select(F.coalesce("cancel_requested", F.lit(False))).first()[0])


def reuse(store: Store, document_id: int) -> int | None:
    """If another finished document has the same bytes, selection and settings, this one points to it and is done."""
    own = store.get("documents", document_id).select("content_hash", "page_selector", "pipeline_fingerprint").first()
    others = store.latest("documents").where(F.col("id") != document_id)
    found = reusable_document(others, store.read("facts"), own.content_hash, own.page_selector, own.pipeline_fingerprint).select("id").first()
    if found is None:
        return None
    store.update_document(document_id, status="done", reused_from_document_id=found.id)
    return found.id


def ingest_document(store: Store, document_id: int, pages: DataFrame, ask: Ask, judge_pairs: Callable[[list[dict]], list[dict]], embed: Callable[[DataFrame], DataFrame], model: str = "model", prompt: str = PROMPT, selector: str | None = None, max_pages: int | None = None, lot: int = LOT, at_once: int | None = None) -> dict | None:
    """The whole run of a document that is stored as pending; its statistics, or None if it was reused or stopped before
    it began. ``pages`` has (page_number, text[, table_context]), ``ask`` and ``judge_pairs`` are the model's callables (see
    ``functions.answers`` and ``relate.judge``), and ``embed`` adds ``embedding`` to rows with a statement (L7).
    """
    watch, began = Stopwatch(), time.perf_counter()
    counts = dict.fromkeys(("pages", "chunks", "facts", "embeddings", "candidate_pairs", "relationships_stored", "extraction_calls", "extraction_cache_hits", "reasoning_calls", "reasoning_cache_hits", "relationship_errors", "arithmetic_identities", "arithmetic_anomalies", "coherence_triangles", "coherence_violations", "coherence_inferences"), 0)
    try:
        if cancelled(store, document_id):
            store.update_document(document_id, status=next_status("pending", "cancel"), error_message="stopped before it began")
            return None
        if reuse(store, document_id) is not None:
            return None
        store.update_document(document_id, status=next_status("pending", "start"))
        with watch.track("pages"):
            own = select_pages(pages, selector, max_pages).withColumn("document_id", F.lit(document_id).cast("long"))
            own = own if "table_context" in own.columns else own.withColumn("table_context", F.lit("plain_not_tabular"))
            parts = cut(own.select("document_id", "page_number", "text", "table_context")).withColumn("chunk_hash", chunk_hash(model, prompt))
            parts = stage(parts.withColumn("lot", F.floor((F.row_number().over(_order()) - 1) / lot).cast("int")), "chunks")
            counts["chunks"], counts["pages"], lots = parts.agg(F.count("*"), F.countDistinct("page_number"), F.coalesce(F.max("lot"), F.lit(-1))).first()
            store.update_document(document_id, num_pages=pages.agg(F.max("page_number")).first()[0])
        stopped = ""
        for i in range(lots + 1):
            _take_lot(store, document_id, parts.where(F.col("lot") == i), ask, embed, model, prompt, at_once, watch, counts)
            store.update_document(document_id, progress=json.dumps({"stage": "extracting", "current": i + 1, "total": lots + 1, "at": time.time()}))
            if cancelled(store, document_id):
                stopped = "extraction"
                break
        if not stopped:
            mine = stage(store.read("facts").where(F.col("document_id") == document_id), "own-facts")
            with watch.track("arithmetic"):
                sums = check_arithmetic(mine)
                counts["arithmetic_identities"] = sums.identities.count()
                odd = sums.anomalies.select(F.lit(document_id).cast("long").alias("document_id"), F.lit(None).cast("int").alias("page_number"), F.lit("arithmetic_scale_anomaly").alias("issue_type"), F.concat_ws(" ", F.lit("a sum holds only by a factor of"), F.col("factor")).alias("detail"), F.concat(F.lit("suspect fact: "), F.col("suspect_id").cast("string")).alias("raw_excerpt"))
                counts["arithmetic_anomalies"] = add_issues(store, odd)
            if counts["facts"]:
                stopped = _relate(store, document_id, mine, judge_pairs, model, watch, counts)
        if not stopped:
            with watch.track("coherence"):
                graph = check_coherence(store.read("relationships"), store.read("facts"))
                row = graph.summary.first()
                counts["coherence_triangles"], counts["coherence_violations"], counts["coherence_inferences"] = row.triangles_checked, row.violations, row.inferences
                bad = graph.violations.orderBy("a", "b", "c").limit(MOST_VIOLATIONS)
                add_issues(store, bad.select(F.lit(document_id).cast("long").alias("document_id"), F.lit(None).cast("int").alias("page_number"), F.lit("graph_incoherence").alias("issue_type"), F.concat_ws(" ", F.lit("facts that cannot all be right:"), "a", "b", "c").alias("detail"), F.col("basis").alias("raw_excerpt")))
        stats = counts | {"timing": watch.seconds | {"total": time.perf_counter() - began}}
        status = next_status("processing", "cancel" if stopped else "finish")
        told = f"stopped during {stopped}" if stopped else f"{counts['facts']} facts, {counts['relationships_stored']} relationships"
        store.update_document(document_id, status=status, error_message=told, stats=json.dumps(stats), progress=None)
        return stats
    except Exception as e:  # noqa: BLE001 - a run that fails is recorded, then raised
        store.update_document(document_id, status="failed", error_message=str(e)[:1500], progress=None)
        row = [(document_id, None, "pipeline_crashed", str(e)[:500], traceback.format_exc()[-1500:])]
        add_issues(store, store.spark.createDataFrame(row, "document_id long, page_number int, issue_type string, detail string, raw_excerpt string"))
        raise


def _order() -> WindowSpec:
    return Window.partitionBy("document_id").orderBy("page_number", "chunk")  # one document's chunks


def _take_lot(store: Store, document_id: int, parts: DataFrame, ask: Ask, embed, model: str, prompt: str, at_once: int | None, watch: Stopwatch, counts: dict) -> None:
    """One lot's answers from the cache or the model, its facts and issues stored."""
    kinds = {f.split(" ", 1)[0]: f.split(" ", 1)[1] for f in ANSWER.split(", ")}
    with watch.track("fact_extraction"):
        keys = stage(parts, "lot")
        held, missing = cache_lookup(keys, store, "extraction_cache", model)
        fresh = stage(ask_chunks(missing, ask, prompt, at_once), "answers")
        good = fresh.where("not failed")
        store.append("extraction_cache", good.select("chunk_hash", F.lit(model).alias("model"), F.to_json("facts").alias("facts_json"), F.to_json("issues").alias("issues_json"), F.current_timestamp().alias("created_at")))
        cached = held.select("chunk_hash", F.from_json("facts_json", kinds["facts"]).alias("facts"), F.from_json("issues_json", kinds["issues"]).alias("issues")).dropDuplicates(["chunk_hash"])
        counts["extraction_calls"] += fresh.count()
        counts["extraction_cache_hits"] += held.count()
        facts, issues = facts_of_answers(keys, cached.unionByName(fresh.select("chunk_hash", "facts", "issues")))
    with watch.track("embeddings"):
        rows = stage(embed(facts).withColumn("created_at", F.current_timestamp()), "facts")
    with watch.track("store"):
        known = store.read("facts").where(F.col("document_id") == document_id).select("id")
        new = stage(rows.join(known, "id", "left_anti"), "new-facts")
        store.append("facts", new)
        add_issues(store, issues)
        n = new.count()
        counts["facts"] += n
        counts["embeddings"] += n


def _relate(store: Store, document_id: int, mine: DataFrame, judge_pairs, model: str, watch: Stopwatch, counts: dict) -> str:
    """This document's facts against all, judgments from the cache or the model, new relationships stored."""
    with watch.track("candidate_retrieval"):
        everything = store.read("facts")
        pairs = stage(candidates(vectors(mine), vectors(everything), everything.drop("embedding"), store.read("relationships")), "pairs")
        counts["candidate_pairs"] = pairs.count()
    if cancelled(store, document_id):
        return "relationship comparison"
    with watch.track("relationship_reasoning"):
        keys = stage(in_order(pairs).select("pair_hash").distinct(), "pair-hashes")
        held, missing = cache_lookup(keys, store, "relationship_cache", model)
        known = held.select("pair_hash", F.from_json("result_json", JUDGMENTS.split(", ", 1)[1]).alias("j")).select("pair_hash", "j.*")
        fresh = stage(judge(pairs, known, judge_pairs), "judgments")
        answered = fresh.where("same_metric is not null")
        store.append("relationship_cache", answered.select("pair_hash", F.lit(model).alias("model"), F.to_json(F.struct(*[c for c in fresh.columns if c != "pair_hash"])).alias("result_json"), F.current_timestamp().alias("created_at")))
        counts["reasoning_cache_hits"], asked, failed = known.count(), fresh.count(), fresh.where("same_metric is null").count()
        counts["reasoning_calls"], counts["relationship_errors"] = asked, failed
        judged = stage(classify(pairs, known.unionByName(answered)), "classified")
        add_issues(store, fresh.where("same_metric is null").select(F.lit(document_id).cast("long").alias("document_id"), F.lit(None).cast("int").alias("page_number"), F.lit("relationship_classification_failed").alias("issue_type"), F.coalesce("reason", F.lit("no judgment")).alias("detail"), F.col("pair_hash").alias("raw_excerpt")))
        rows = stage(relationships(judged, store.read("relationships")), "relationships")
        store.append("relationships", rows.withColumn("id", F.xxhash64("fact_low_id", "fact_high_id")).withColumn("created_at", F.current_timestamp()))
        counts["relationships_stored"] = rows.count()
        counts |= {k: v for k, v in build_summary(judged).first().asDict().items() if k in ("metric_mismatches", "llm_overridden", "disagreements")}
    return ""
