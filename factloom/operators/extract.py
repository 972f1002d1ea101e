"""Facts out of chunks, by a callable that asks a language model.

The model is asked once for each different chunk that no cache holds, in a ``mapInArrow`` stage whose failures become
issue rows. Everything behind it, validation, numbers, evidence, is one plan of column functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.answers import Ask, CallFailed, Unparseable, as_facts, call
from factloom.functions.evidence import check_evidence, evidence_detail, validate_facts
from factloom.functions.numbers import numeric_fallback
from factloom.functions.text import hash_text
from factloom.scratch import stage
from factloom.session import reach

FIELDS = ("subject", "attribute", "value", "value_numeric", "unit", "time_period", "scope", "statement", "quote", "confidence")
PROMPT = "List the facts of the page text as a JSON array of objects with the keys " + ", ".join(FIELDS) + ". Copy each quote from the page text."
REGROUND = 'Copy from the page text the passage that supports the fact, word for word, as {"found": true, "quote": "..."}; {"found": false} if there is none.'
ANSWER = "chunk_hash string, facts array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ",quote_grounded:boolean,regrounded:boolean>>, issues array<struct<issue_type:string,detail:string,raw_excerpt:string>>, failed boolean"
_FACT = pa.struct([*((f, pa.string()) for f in FIELDS), ("quote_grounded", pa.bool_()), ("regrounded", pa.bool_())])
_ISSUE = pa.struct([(f, pa.string()) for f in ("issue_type", "detail", "raw_excerpt")])


def chunk_hash(model: str, prompt: str = PROMPT):
    """The cache key of a chunk: the model, the prompt, the text and the page's head; not where it stands."""
    return hash_text(F.lit(model), F.lit(prompt), "text", "page_context")


def _stands(text: str, quote: str) -> bool:
    flat = " ".join(quote.split())
    return bool(flat) and (quote in text or flat in " ".join(text.split()))


def _text(value: object) -> str | None:
    return None if value is None else str(value)


def reground(ask: Ask, statement: str, text: str) -> str | None:
    """L3: a quote that stands in the text, or None; asked for once."""
    try:
        said = call(ask, REGROUND, f"FACT: {statement}\n\nPAGE TEXT:\n{text}")
    except (CallFailed, Unparseable):
        return None
    quote = said.get("quote") if isinstance(said, dict) and said.get("found") else None
    return quote.strip() if isinstance(quote, str) and _stands(text, quote.strip()) else None


def read_chunk(ask: Ask, text: str, page_context: str, prompt: str = PROMPT) -> tuple[list[dict], list[dict], bool]:
    """L2: facts as the model gave them, issues, and whether the call failed (and so must not be cached)."""
    head = f"TOP OF THE PAGE, only to understand units and periods:\n{page_context}\n\n" if page_context else ""

    def issue(kind: str, detail: str, raw: str = "") -> dict:
        return {"issue_type": kind, "detail": detail, "raw_excerpt": raw}

    try:
        value = call(ask, prompt, f"{head}PAGE TEXT:\n{text}")
    except CallFailed as e:
        return [], [issue("llm_call_failed", str(e))], True
    except Unparseable as e:
        return [], [issue("unparseable_response", str(e), e.raw)], True
    found, how = as_facts(value)
    if found is None:
        return [], [issue("unexpected_shape", f"not a list of facts but {type(value).__name__}", str(value)[:1000])], True
    issues = [issue("unexpected_shape_recovered", how)] if how else []
    facts = []
    for x in found:
        fact = {f: _text(x.get(f)) for f in FIELDS}
        quote, statement = (fact["quote"] or "").strip(), (fact["statement"] or "").strip()
        fact |= {"quote": quote or None, "quote_grounded": _stands(text, quote), "regrounded": False}
        if quote and statement and not fact["quote_grounded"] and (better := reground(ask, statement, text)):
            fact |= {"quote": better, "quote_grounded": True, "regrounded": True}
        facts.append(fact)
    return facts, issues, False


def ask_chunks(chunks: DataFrame, ask: Ask, prompt: str = PROMPT, at_once: int | None = None) -> DataFrame:
    """An answer for each different ``chunk_hash`` of ``chunks(chunk_hash, text, page_context)``. ``at_once``
    bounds how many chunks are asked at a time, by the number of tasks."""
    reach(chunks.sparkSession)
    one = chunks.groupBy("chunk_hash").agg(F.min(F.struct("text", "page_context")).alias("c")).select("chunk_hash", "c.text", "c.page_context")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read_chunk(ask, text or "", head or "", prompt) for text, head in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.list_(_FACT)), pa.array([r[1] for r in rows], pa.list_(_ISSUE)), pa.array([r[2] for r in rows], pa.bool_())], ["chunk_hash", "facts", "issues", "failed"])

    return (one.repartition(at_once, "chunk_hash") if at_once else one).mapInArrow(run, ANSWER)


def facts_of_answers(chunks: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and issues of ``chunks(document_id, page_number, chunk, chunk_hash, table_context)`` by
    ``answers(chunk_hash, facts, issues)``. Evidence is judged here, for cached answers as for fresh ones."""
    where = ["document_id", "page_number", "chunk", "table_context"]
    told = stage(chunks.select(*where, "chunk_hash").join(answers, "chunk_hash"), "told")
    each = told.select(*where, F.posexplode("facts").alias("at", "f")).select(*where, "at", "f.*")
    good, malformed = validate_facts(each)
    numbered = good.withColumn("value_numeric", F.coalesce("value_numeric", numeric_fallback("value")))
    check = check_evidence("quote_grounded")
    checked = stage(numbered.withColumn("check", check).withColumn("evidence_status", F.col("check.status")).withColumn("evidence_detail", evidence_detail(F.col("check"), "table_context")), "checked")
    facts = checked.withColumn("id", F.xxhash64("document_id", "page_number", "chunk", "at").bitwiseAND(F.lit(2**63 - 1).cast("long"))).drop("check", "at", "regrounded", "chunk")

    def issue(rows: DataFrame, kind: str, detail, raw) -> DataFrame:
        return rows.select("document_id", "page_number", F.lit(kind).alias("issue_type"), detail.alias("detail"), raw.cast("string").alias("raw_excerpt"))

    fact = F.substring("statement", 1, 120)
    parts = [
        told.select("document_id", "page_number", F.explode("issues").alias("i")).select("document_id", "page_number", "i.*"),
        issue(told.where("table_context = 'plain_reconstruction_rejected'"), "table_alignment_uncertain", F.lit("the page looks like a table but its cells could not be aligned"), F.lit("")),
        malformed.select("document_id", "page_number", "issue_type", "detail", "raw_excerpt"),
        issue(checked.where("regrounded"), "quote_regrounded", F.concat(F.lit("a second question found the quote of: "), fact), F.substring("quote", 1, 300)),
        issue(checked.where("not quote_grounded"), "quote_not_grounded", F.concat(F.lit("the page does not hold the quote of: "), fact), F.col("quote")),
        issue(checked.where("quote_grounded and evidence_status <> 'fact_validated'"), "value_not_evidenced", F.concat(F.lit("the quote does not support: "), fact, F.lit("; "), F.col("evidence_detail")), F.substring("quote", 1, 300)),
    ]
    issues = parts[0]
    for p in parts[1:]:
        issues = issues.unionByName(p)
    return facts, issues


def embed_with(rows: DataFrame, encode: Callable[[list[str]], list[list[float]]], column: str = "statement") -> DataFrame:
    """``rows`` with ``embedding``, the unit vector that ``encode`` gives for the column's text; null for null text. A
    model is loaded by ``encode`` itself, once in each worker."""
    reach(rows.sparkSession)
    kept = [c for c in rows.columns if c != "embedding"]
    plain = rows.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(kept.index(column)).to_pylist()
            found = iter(encode([t for t in texts if t is not None]))
            vectors = [None if t is None else list(next(found)) for t in texts]
            lengths = [sum(x * x for x in v) ** 0.5 or 1.0 if v is not None else 1.0 for v in vectors]
            unit = [None if v is None else [x / n for x in v] for v, n in zip(vectors, lengths)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(unit, pa.list_(pa.float32()))], [*kept, "embedding"])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))
