"""Reads with checked parameters, one function for each read of a service (S17, P10, P12). HTTP is left to the caller.

A ``LookupError`` means that there is no such row, a ``ValueError`` that a parameter is not allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import display_name
from factloom.operators.adjudicate import STORED
from factloom.operators.coherence import Coherence, check_coherence, enrich, touching
from factloom.operators.priority import LEVELS, level_counts, priority, ranked
from factloom.operators.timeline import points, timelines
from factloom.scratch import stage
from factloom.sources import store as reads
from factloom.sources.store import Store

#: What a service returns of a row of each kind.
RESPONSES = {
    "document": "id long, original_name string, display_name string, status string, num_pages int, error_message string, uploaded_at timestamp, page_selector string, reused_from_document_id long, fact_count long, stats string, progress string",
    "fact": "id long, document_id long, document_name string, page_number int, subject string, attribute string, value string, value_numeric double, unit string, time_period string, scope string, statement string, quote string, quote_grounded boolean, confidence double, evidence_status string, evidence_detail string, table_context string",
    "relationship": "id long, fact_id_a long, fact_id_b long, relation_type string, explanation string, reconciliation_context string, confidence double, similarity_score double, candidate_reason string, decision_source string, llm_proposal string, disagreement boolean, disagreement_reason string",
    "issue": "id long, document_id long, page_number int, issue_type string, detail string, raw_excerpt string, created_at timestamp",
}
MOST_TEXT, MOST_FINDINGS, MOST_RANKED = 200, 200, 500


def _id(value: int, what: str) -> int:
    if value < 1:
        raise ValueError(f"{what} must be at least 1")
    return value


def _limit(value: int, most: int) -> int:
    if not 1 <= value <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    return value


def _found(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise LookupError(f"no such {what}")
    return rows


def shaped(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` as a service returns them: these columns and types, null where a row lacks one."""
    wanted = rows.sparkSession.createDataFrame([], RESPONSES[kind]).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def _source(store: Store, document_id: int) -> int:
    """The document that holds the facts: itself, or the one that it reuses."""
    row = _found(store.get("documents", _id(document_id, "document_id")), "document").select(F.coalesce("reused_from_document_id", "id")).first()
    return row[0]


def get_documents(store: Store) -> DataFrame:
    return reads.list_documents(store.latest("documents"), store.read("facts")).withColumn("display_name", display_name("original_name"))


def get_document(store: Store, document_id: int) -> DataFrame:
    return _found(reads.document_detail(store.latest("documents"), store.read("facts"), store.read("extraction_issues"), _id(document_id, "document_id")), "document")


def get_facts(store: Store, document_id: int | None = None, q: str | None = None) -> DataFrame:
    if q is not None and len(q) > MOST_TEXT:
        raise ValueError(f"q has at most {MOST_TEXT} characters")
    rows = reads.list_facts(store.read("facts"), None if document_id is None else _source(store, document_id), q)
    names = store.latest("documents").select(F.col("id").alias("document_id"), F.col("original_name").alias("_n"))
    return rows.join(names, "document_id", "left").withColumn("document_name", F.coalesce("_n", F.concat(F.lit("document "), F.col("document_id").cast("string")))).drop("_n")


def get_fact(store: Store, fact_id: int) -> tuple[DataFrame, DataFrame]:
    """A fact and its relationships."""
    fact = _found(store.get("facts", _id(fact_id, "fact_id")), "fact").drop("embedding")
    return fact, reads.related_facts(store.read("facts"), store.read("relationships"), fact_id)


def get_relationships(store: Store, relation_type: str | None = None) -> DataFrame:
    if relation_type is not None and relation_type not in STORED:
        raise ValueError(f"relation_type must be one of {', '.join(STORED)}")
    rels = reads.list_relationships(store.read("relationships"), relation_type)
    return reads.relationships_with_facts(rels, store.read("facts"), store.latest("documents")).orderBy(F.desc("id"))


def get_issues(store: Store, document_id: int | None = None) -> DataFrame:
    return reads.list_issues(store.read("extraction_issues"), None if document_id is None else _source(store, document_id))


def get_stats(store: Store) -> tuple[DataFrame, DataFrame]:
    """One row of counts, and relationships by type."""
    rels = store.read("relationships")
    return reads.corpus_stats(store.latest("documents"), store.read("facts"), rels, store.read("extraction_issues")), reads.count_by(rels, "relation_type")


def get_coherence(store: Store, document_id: int | None = None, limit: int = 25) -> Coherence:
    """Violations and inferences, the first ``limit`` of each with their facts, and the summary. Triangles are closed over
    the whole corpus; for a document those that touch it are shown."""
    _limit(limit, MOST_FINDINGS)
    facts, documents = store.read("facts"), store.latest("documents")
    whole = check_coherence(store.read("relationships"), facts)
    bad, guessed = whole.violations, whole.inferences
    if document_id is not None:
        own = _source(store, document_id)
        bad, guessed = touching(bad, facts, own), touching(guessed, facts, own, ("b", "c"))
    return Coherence(enrich(bad.orderBy("a", "b", "c").limit(limit), facts, documents), enrich(guessed.orderBy("b", "c").limit(limit), facts, documents, ("b", "c")), whole.summary)


def get_priority(store: Store, document_id: int | None = None, limit: int = 50, level: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The most urgent facts and relationships, of one level if asked for, and how many facts each level has."""
    _limit(limit, MOST_RANKED)
    names = (*(n for n, _ in LEVELS), "low")
    if level is not None and level not in names:
        raise ValueError(f"level must be one of {', '.join(names)}")
    facts, rels = priority(store.read("facts").drop("embedding"), store.read("relationships"), None if document_id is None else _source(store, document_id))
    facts, rels = stage(facts, "scored-facts"), stage(rels, "scored-relationships")
    kept = (lambda d: d) if level is None else (lambda d: d.where(F.col("level") == level))
    return ranked(kept(facts), limit=limit), ranked(kept(rels), newest_first=True, limit=limit), level_counts(facts)


def get_timelines(store: Store, document_id: int | None = None) -> DataFrame:
    facts, rels = store.read("facts").drop("embedding"), store.read("relationships")
    found = stage(points(facts, rels), "points")
    whole = timelines(found, facts, rels)
    if document_id is None:
        return whole
    own = found.where(F.col("document_id") == _source(store, document_id)).select("timeline").distinct()
    return whole.join(own, "timeline", "left_semi").orderBy(F.desc("n_points"), "first_fact_id")
