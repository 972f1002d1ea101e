"""Stored tables, reads over them and corpus statistics (S8-S20, P, A1-A8, J5-J8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.numbers import compare_values, strip
from factloom.functions.text import search
from factloom.operators.adjudicate import STORED
from factloom.scratch import stage

SCHEMAS = {
    "documents": "id long, original_name string, stored_path string, num_pages int, status string, error_message string, uploaded_at timestamp, content_hash string, page_selector string, pipeline_fingerprint string, reused_from_document_id long, cancel_requested boolean, stats string, progress string, changed_at timestamp",
    "facts": "id long, document_id long, page_number int, subject string, attribute string, value string, value_numeric double, unit string, time_period string, scope string, statement string, quote string, quote_grounded boolean, confidence double, evidence_status string, evidence_detail string, table_context string, embedding array<float>, created_at timestamp",
    "relationships": "id long, fact_id_a long, fact_id_b long, fact_low_id long, fact_high_id long, relation_type string, explanation string, reconciliation_context string, confidence double, similarity_score double, candidate_reason string, decision_source string, llm_proposal string, disagreement boolean, disagreement_reason string, created_at timestamp",
    "extraction_issues": "id long, document_id long, page_number int, issue_type string, detail string, raw_excerpt string, created_at timestamp",
    "extraction_cache": "chunk_hash string, model string, facts_json string, issues_json string, created_at timestamp",
    "relationship_cache": "pair_hash string, model string, result_json string, created_at timestamp",
}
KEYS = {"documents": ["id"], "facts": ["id"], "relationships": ["fact_low_id", "fact_high_id"], "extraction_issues": ["id"], "extraction_cache": ["chunk_hash", "model"], "relationship_cache": ["pair_hash", "model"]}
EXCERPT = 2000


class Store:
    """Tables as Parquet folders under one path. Appends only add files; upserts keep the newest row of a key
    when they are read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        """The table under today's schema; columns that older files lack are null, as is a missing table."""
        schema = SCHEMAS[name]
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
            found.schema  # noqa: B018 - resolves the path
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)
        if name == "relationships":  # older rows lack the ordered ends
            a, b = F.col("fact_id_a"), F.col("fact_id_b")
            found = found.withColumns({"fact_low_id": F.coalesce("fact_low_id", F.least(a, b)), "fact_high_id": F.coalesce("fact_high_id", F.greatest(a, b))})
        return found

    def get(self, name: str, row_id: int) -> DataFrame:
        """The newest row with this id; empty if there is none."""
        rows = self.latest(name) if name == "documents" else self.read(name)
        return rows.where(F.col("id") == row_id)

    def update_document(self, document_id: int, **changes: object) -> None:
        """A new version of a document's row with these columns changed; reads take the newest version."""
        row = self.get("documents", document_id)
        now = {k: (v if isinstance(v, Column) else F.lit(v)).cast(row.schema[k].dataType) for k, v in changes.items()}
        self.append("documents", stage(row.withColumns(now | {"changed_at": F.current_timestamp()}), "document"))

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows; columns that they lack are null, and excerpts are cut."""
        wanted = self.spark.createDataFrame([], SCHEMAS[name]).schema
        cols = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
        out = rows.select(*cols)
        if name == "extraction_issues":
            out = out.withColumn("raw_excerpt", F.substring("raw_excerpt", 1, EXCERPT))
        out.write.mode("append").parquet(f"{self.path}/{name}")

    def latest(self, name: str) -> DataFrame:
        """One row for each key, the newest by ``created_at`` (documents: the last change); of equally new
        ones that with the smallest hash."""
        rows = self.read(name)
        at = F.coalesce("changed_at", "uploaded_at") if name == "documents" else F.col("created_at")
        w = Window.partitionBy(*KEYS[name]).orderBy(F.desc_nulls_last(at), F.xxhash64(*rows.columns), *[F.col(c).cast("string") for c in rows.columns])
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cache_lookup(keys: DataFrame, store: Store, name: str, model: str) -> tuple[DataFrame, DataFrame]:
    """``keys`` with the model's newest cached row, and the keys that have none. A key that comes several
    times keeps its rows."""
    key = KEYS[name][0]
    cache = store.latest(name).where(F.col("model") == model).drop("model", "created_at")
    return keys.join(cache, key), keys.join(cache.select(key), key, "left_anti")


def vectors(facts: DataFrame, exclude_document_id: int | None = None) -> DataFrame:
    """``(id, embedding)`` of the facts that have a vector, without those of one document."""
    rows = facts.where("embedding is not null")
    if exclude_document_id is not None:
        rows = rows.where(~F.col("document_id").eqNullSafe(F.lit(exclude_document_id)))
    return rows.select("id", "embedding")


def list_issues(issues: DataFrame, document_id: int | None = None) -> DataFrame:
    """Issues, the newest first, of one document if asked for."""
    return (issues if document_id is None else issues.where(F.col("document_id") == document_id)).orderBy(F.desc("id"))


def run_totals(documents: DataFrame) -> DataFrame:
    """Pages, chunks and candidate pairs over all runs' statistics."""
    s = F.from_json("stats", "pages long, chunks long, candidate_pairs long")
    return documents.select(s.alias("s")).agg(*[F.coalesce(F.sum(f"s.{c}"), F.lit(0)).alias(c) for c in ("pages", "chunks", "candidate_pairs")])


def list_facts(facts: DataFrame, document_id: int | None = None, q: str | None = None) -> DataFrame:
    """Facts without their vectors, of one document by page and id, else by id."""
    out = facts.drop("embedding") if "embedding" in facts.columns else facts
    if q is not None:
        out = out.where(search(q, "statement", "subject", "attribute"))
    return out.where(F.col("document_id") == document_id).orderBy("page_number", "id") if document_id is not None else out.orderBy("id")


def list_relationships(rels: DataFrame, relation_type: str | None = None) -> DataFrame:
    """Newest first; the type must be one that is stored."""
    if relation_type is not None:
        if relation_type not in STORED:
            raise ValueError(f"relation_type must be one of {', '.join(STORED)}")
        rels = rels.where(F.col("relation_type") == relation_type)
    return rels.orderBy(F.desc("id"))


def resolved(documents: DataFrame) -> DataFrame:
    """``documents`` with ``source_id``, the document that a reused one points to."""
    return documents.withColumn("source_id", F.coalesce("reused_from_document_id", "id"))


def list_documents(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents with their number of facts, through the reuse pointer, newest first."""
    counts = facts.groupBy(F.col("document_id").alias("source_id")).agg(F.count("*").alias("fact_count"))
    return resolved(documents).join(counts, "source_id", "left").withColumn("fact_count", F.coalesce("fact_count", F.lit(0))).drop("source_id").orderBy(F.desc("id"))


def document_detail(documents: DataFrame, facts: DataFrame, issues: DataFrame, document_id: int) -> DataFrame:
    """One document with its facts and issues nested, both through the reuse pointer."""
    doc = resolved(documents.where(F.col("id") == document_id))
    f = facts.drop("embedding") if "embedding" in facts.columns else facts
    # One document's rows; the lists are part of the answer.
    mine = f.join(doc.select(F.col("source_id").alias("document_id")), "document_id", "left_semi").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "id", "statement", "value", "unit", "time_period", "scope", "evidence_status"))).alias("facts"))
    bad = issues.join(doc.select(F.col("source_id").alias("document_id")), "document_id", "left_semi").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("id", "issue_type", "detail"))).alias("issues"))
    return doc.join(mine, doc.source_id == mine.document_id, "left").drop("document_id").join(bad, F.col("source_id") == bad.document_id, "left").drop("document_id", "source_id")


def reusable_document(documents: DataFrame, facts: DataFrame, content_hash: str, page_selector: str | None, fingerprint: str) -> DataFrame:
    """The newest finished document of the same bytes, selection and settings that has facts."""
    same = documents.where((F.col("content_hash") == content_hash) & (F.col("status") == "done") & F.col("page_selector").eqNullSafe(F.lit(page_selector)) & (F.col("pipeline_fingerprint") == fingerprint))
    return same.join(facts.select(F.col("document_id").alias("id")), "id", "left_semi").orderBy(F.desc("id")).limit(1)


def relationships_with_facts(rels: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Relationships with both facts (null if missing) and the comparison of their values."""
    name = documents.select(F.col("id").alias("document_id"), F.col("original_name").alias("_name"))
    own = [c for c in facts.columns if c != "embedding"]
    f = facts.select(*own).join(name, "document_id", "left").withColumn("document_name", F.coalesce("_name", F.concat(F.lit("document "), F.col("document_id").cast("string")))).drop("_name")
    a = f.select(F.col("id").alias("fact_id_a"), F.struct(*[f[c] for c in f.columns]).alias("fact_a"))
    b = f.select(F.col("id").alias("fact_id_b"), F.struct(*[f[c] for c in f.columns]).alias("fact_b"))
    return rels.join(a, "fact_id_a", "left").join(b, "fact_id_b", "left").withColumn("comparison", compare_values(F.col("fact_a.value_numeric"), F.col("fact_a.unit"), F.col("fact_b.value_numeric"), F.col("fact_b.unit")))


def related_facts(facts: DataFrame, rels: DataFrame, fact_id: int) -> DataFrame:
    """The relationships of a fact, each with the fact at its other end."""
    mine = rels.where((F.col("fact_id_a") == fact_id) | (F.col("fact_id_b") == fact_id)).withColumn("other_id", F.when(F.col("fact_id_a") == fact_id, F.col("fact_id_b")).otherwise(F.col("fact_id_a")))
    other = facts.select(F.col("id").alias("other_id"), F.struct("statement", "value", "unit", "document_id", "page_number").alias("other"))
    return mine.join(other, "other_id", "left")


def edges_of_document(rels: DataFrame, facts: DataFrame, document_id: int) -> DataFrame:
    """Edges with either end in the document."""
    own = facts.where(F.col("document_id") == document_id).select(F.col("id").alias("_f"))
    hit = rels.select("id", F.explode(F.array("fact_id_a", "fact_id_b")).alias("_f")).join(own, "_f", "left_semi").select("id").distinct()
    return rels.join(hit, "id", "left_semi")


def graph_view(rels: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their degree, and links whose both ends exist."""
    ids = facts.select("id")
    links = rels.join(ids.withColumnRenamed("id", "fact_id_a"), "fact_id_a", "left_semi").join(ids.withColumnRenamed("id", "fact_id_b"), "fact_id_b", "left_semi")
    degree = links.select(F.explode(F.array("fact_id_a", "fact_id_b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return facts.select("id", "document_id", "statement").join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), links


def corpus_stats(documents: DataFrame, facts: DataFrame, rels: DataFrame, issues: DataFrame) -> DataFrame:
    """One row of counts; each table is aggregated once."""
    e = F.coalesce("evidence_status", F.lit(""))
    parts = [
        documents.agg(F.count("*").alias("documents"), F.count_if(F.coalesce(F.col("status") == "done", F.lit(False))).alias("documents_done")),
        facts.agg(F.count("*").alias("facts"), F.count_if(~F.coalesce("quote_grounded", F.lit(False))).alias("ungrounded_facts"), F.count_if(e == "fact_validated").alias("fact_validated"), F.count_if(e == "quote_grounded").alias("quote_grounded_only"), F.coalesce(F.round(100 * F.avg(F.coalesce("quote_grounded", F.lit(False)).cast("int"))), F.lit(0)).cast("int").alias("grounded_pct")),
        rels.agg(F.count("*").alias("relationships")),
        issues.agg(F.count("*").alias("issues")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def count_by(rows: DataFrame, *columns: str) -> DataFrame:
    """A2-A5: counts by columns."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def top_values(facts: DataFrame, column: str, n: int = 7) -> DataFrame:
    """A4: the most frequent values that are not blank, ties by name."""
    v = strip(F.coalesce(F.col(column), F.lit("")))
    return facts.where(v != "").groupBy(v.alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def cross_document_edges(rels: DataFrame, facts: DataFrame) -> DataFrame:
    """How many edges join facts of two documents."""
    d = facts.select("id", "document_id")
    both = rels.join(d.select(F.col("id").alias("fact_id_a"), F.col("document_id").alias("da")), "fact_id_a").join(d.select(F.col("id").alias("fact_id_b"), F.col("document_id").alias("db")), "fact_id_b")
    return both.agg(F.count_if(F.col("da") != F.col("db")).alias("cross_document"))


def shares(counts: DataFrame, n: str = "n") -> DataFrame:
    """``counts`` with each row's share in percent, rounded."""
    total = counts.agg(F.sum(n).alias("_t"))
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100 * F.col(n) / F.col("_t")).cast("int")).drop("_t")  # the total is one row


def stale_documents(documents: DataFrame, now: Column, minutes: int = 20, active: str | None = None) -> DataFrame:
    """Unfinished documents without activity for so long, as failed."""
    last = F.greatest("uploaded_at", active) if active else F.col("uploaded_at")
    return documents.where(F.col("status").isin("pending", "processing") & (last < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0)))).withColumn("status", F.lit("failed")).withColumn("error_message", F.lit("no activity"))
