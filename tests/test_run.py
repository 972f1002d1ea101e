"""Answers of a model, extraction, whole runs, reads and evaluation cases, with recorded callables."""

import json
import os
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from factloom.functions.answers import CallFailed, Unparseable, as_facts, call, parse_answer
from factloom.operators import evaluate
from factloom.operators.extract import ask_chunks, chunk_hash, embed_with, facts_of_answers, read_chunk
from factloom.sources import api
from factloom.sources.pages import file_issues, pages_from_html, read_files
from factloom.sources.store import Store
from factloom.streaming.ingest import stale_stream
from factloom.streaming.run import Stopwatch, ingest_document, report, request_cancel


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test


def test_answers_are_found():
    assert parse_answer('```json\n[{"a": 1}]\n```') == [{"a": 1}]
    assert parse_answer('Here it is: {"a": "x}]\\" y"} and more') == {"a": 'x}]" y'}
    assert parse_answer('{"a": "two\nlines"}') == {"a": "two\nlines"} and parse_answer(" 5 ") == 5
    for bad in ("", "nothing here", '{"a": '):
        with pytest.raises(Unparseable):
            parse_answer(bad)


def test_shapes_are_recovered():
    fact = {"quote": "q", "statement": "s"}
    assert as_facts([fact, 3]) == ([fact], None) and as_facts(fact)[0] == [fact]
    assert as_facts({"n": 1, "facts": [fact]}) == ([fact], "the list stood under 'facts'") and as_facts({"facts": []}) == (None, None) and as_facts("x") == (None, None)


def test_calls_are_tried_again_but_not_after_a_timeout():
    tried, pauses = [], []

    def ask(system, user):
        tried.append(user)
        if user == "slow":
            raise TimeoutError
        if len(tried) == 1 or user == "bad":
            raise OSError("gone")
        return "[]"

    assert call(ask, "", "x", sleep=pauses.append) == [] and pauses == [1.5]
    tried.clear()
    with pytest.raises(CallFailed):
        call(ask, "", "slow", sleep=pauses.append)
    assert tried == ["slow"]
    with pytest.raises(CallFailed):
        call(ask, "", "bad", sleep=pauses.append)
    assert tried == ["slow", "bad", "bad"]


def test_a_quote_is_asked_for_again():
    def ask(system, user):
        if "FACT:" in user:
            return '{"found": true, "quote": "Revenue  was 5"}'
        return json.dumps([{"statement": "revenue", "quote": "about five"}, {"statement": "x", "quote": "was 5"}, {"statement": None, "quote": "?"}])

    facts, issues, failed = read_chunk(ask, "Revenue was 5 that year", "")
    assert [(f["quote"], f["quote_grounded"], f["regrounded"]) for f in facts] == [("Revenue  was 5", True, True), ("was 5", True, False), ("?", False, False)] and not issues and not failed
    assert read_chunk(lambda s, u: "no", "t", "")[1][0]["issue_type"] == "unparseable_response" and read_chunk(lambda s, u: '"x"', "t", "")[2]


def ask_by_page(system, user):
    """Facts written on the page as `subject|number|unit|period`."""
    if "FACT:" in user:
        return '{"found": false}'
    if "boom" in user:
        raise ValueError("boom")
    rows = [line.split("|") for line in user.split("PAGE TEXT:\n")[1].splitlines() if line.count("|") == 3]
    return json.dumps([{"subject": s, "attribute": "revenue", "value": v, "value_numeric": v, "unit": u, "time_period": p, "scope": "group", "statement": f"{s} {v}", "quote": f"{s}|{v}|{u}|{p}" if s != "Lost" else "never said", "confidence": "0.9"} for s, v, u, p in rows])


def judge_same(asked):
    return [{"pair_hash": r["pair_hash"], "same_metric": r["a"]["subject"] == r["b"]["subject"], "reason": "", "relation_type": "agree", "explanation": "told", "confidence": 0.5} for r in asked]


def embed(rows):
    return rows.withColumn("embedding", F.array(F.lit(1.0), F.length("subject") / 100).cast("array<float>"))


def pending(spark, store, ident, content):
    store.append("documents", spark.createDataFrame([(ident, f"{'0' * 32}_doc{ident}.pdf", "pending", content, "f")], "id long, original_name string, status string, content_hash string, pipeline_fingerprint string").withColumn("uploaded_at", F.current_timestamp()))


def test_a_whole_run(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    filler = "Nothing else is told here, only words without any meaning.\n"
    first = spark.createDataFrame([(1, filler + "Acme|100|USD|FY24\nAcme|150|USD|FY23\nAcme|50|USD|FY22"), (2, filler + "Lost|7|USD|FY24"), (3, filler + "boom")], "page_number int, text string")
    pending(spark, store, 1, "aa")
    stats = ingest_document(store, 1, first, ask_by_page, judge_same, embed, lot=2)
    assert (stats["pages"], stats["chunks"], stats["facts"], stats["extraction_calls"]) == (3, 3, 4, 3) and "total" in stats["timing"] and "facts: 4" in report("doc", stats)
    kinds = {r.issue_type for r in store.read("extraction_issues").collect()}
    assert {"llm_call_failed", "quote_not_grounded"} <= kinds
    rels = {(r.relation_type, r.decision_source) for r in store.read("relationships").collect()}
    assert rels == {("reconciled", "deterministic_override")} and stats["relationships_stored"] == 3
    # Another file whose page is the same: the chunk comes from the cache, and its facts meet those of the first.
    pending(spark, store, 2, "bb")
    again = ingest_document(store, 2, first.where("page_number = 1"), ask_by_page, judge_same, embed)
    assert (again["extraction_calls"], again["extraction_cache_hits"], again["facts"]) == (0, 1, 3) and again["relationships_stored"] > 0
    alike = store.read("relationships").where("relation_type = 'corroborates'").count()
    assert 1 <= alike <= 3  # of equally near facts the four with the smallest ids are compared
    # The same bytes once more are not read at all.
    pending(spark, store, 3, "aa")
    assert ingest_document(store, 3, first, None, None, None) is None
    # A run that is asked to stop before it begins, and one whose callable fails.
    pending(spark, store, 4, "cc")
    request_cancel(store, 4)
    assert ingest_document(store, 4, first, ask_by_page, judge_same, embed) is None
    pending(spark, store, 5, "dd")
    with pytest.raises(TypeError):
        ingest_document(store, 5, first.where("page_number = 1"), ask_by_page, judge_same, lambda rows: None + rows)
    states = {r.id: (r.status, r.reused_from_document_id) for r in store.latest("documents").collect()}
    assert states == {1: ("done", None), 2: ("done", None), 3: ("done", 1), 4: ("cancelled", None), 5: ("failed", None)}
    assert "pipeline_crashed" in {r.issue_type for r in store.read("extraction_issues").collect()}
    with pytest.raises(ValueError):
        request_cancel(store, 1)
    # Reads over what is stored.
    listed = {r.id: (r.fact_count, r.display_name) for r in api.get_documents(store).collect()}
    assert listed[3] == (4, "doc3") and listed[4][0] == 0
    assert api.get_facts(store, 3, "acme").count() == 3 and api.get_document(store, 3).first().facts[0].page_number == 1
    fact = store.read("facts").where("document_id = 1 and time_period = 'FY24' and subject = 'Acme'").first().id
    one, related = api.get_fact(store, fact)
    assert api.shaped(one, "fact").columns[:3] == ["id", "document_id", "document_name"] and all(api.shaped(api.get_documents(store), "document").schema.names == [c.split(" ")[0] for c in api.RESPONSES["document"].split(", ")] for _ in (0,))
    assert one.first().statement == "Acme 100" and related.count() >= 1
    assert api.get_relationships(store, "corroborates").count() == alike and api.get_stats(store)[0].first().documents == 5 and api.get_issues(store, 3).count() > 0
    facts, edges, levels = api.get_priority(store, limit=5)
    assert facts.count() == 5 and edges.count() == 5 and levels.agg(F.sum("n")).first()[0] == 7
    assert api.get_timelines(store, 1).first().n_points == 3 and api.get_coherence(store, 1, 5).summary.first().violations == 0
    for bad in (lambda: api.get_facts(store, 0), lambda: api.get_facts(store, q="x" * 201), lambda: api.get_priority(store, limit=501), lambda: api.get_priority(store, level="urgent"), lambda: api.get_coherence(store, limit=0), lambda: api.get_relationships(store, "unrelated")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(LookupError):
        api.get_fact(store, 12345)


def test_cached_answers_are_judged_anew(spark):
    chunk = spark.createDataFrame([(1, 1, 0, "Acme|100|USD|FY24", "", "plain_reconstruction_rejected"), (1, 2, 0, "Acme|100|USD|FY24", "", "plain_not_tabular")], "document_id long, page_number int, chunk int, text string, page_context string, table_context string").withColumn("chunk_hash", chunk_hash("m"))
    answers = ask_chunks(chunk, ask_by_page, at_once=2)
    assert answers.count() == 1  # the same text is asked about once
    facts, issues = facts_of_answers(chunk, answers.select("chunk_hash", "facts", "issues"))
    assert [(r.evidence_status, r.value_numeric) for r in facts.collect()] == [("fact_validated", 100.0)] * 2
    assert [r.issue_type for r in issues.collect()] == ["table_alignment_uncertain"]


def test_files_that_cannot_be_read_leave_a_problem(spark, tmp_path):
    for name, content in (("a", b"good"), ("b", b"bad"), ("c", b"%PDF-1.7 trailer << /Encrypt 5 0 R >>")):
        (tmp_path / name).write_bytes(content)

    def parse(content):
        if content == b"bad":
            raise ValueError("broken")
        return [(1, content.decode()), (2, None)]

    files = read_files(spark, f"file://{tmp_path}", parse)
    assert sorted(((os.path.basename(r.path), r.page_number, r.text, r.problem) for r in files.collect()), key=str) == [("a", 1, "good", None), ("a", 2, None, "the page cannot be read"), ("b", None, None, "ValueError: broken"), ("c", None, None, "the file is encrypted")]
    assert file_issues(files).count() == 3
    html = spark.createDataFrame([(1, "<p>One &amp; two</p><script>x<y</script><div>three</div>"), (2, None)], "id int, html string")
    assert [r.text for r in pages_from_html(html).orderBy("id").collect()] == ["One & two\nthree", ""]


def test_embedding_hook(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id long, statement string")
    got = {r.id: r.embedding for r in embed_with(rows, lambda texts: [[len(t), 4.0] for t in texts]).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] is None and got[3] == [0.0, 1.0]


def test_evaluation_cases(spark, tmp_path):
    fact = {"subject": "Acme", "attribute": "revenue", "value": "5", "value_numeric": 5.0, "unit": "USD", "time_period": "FY24", "scope": "group"}
    cases = [
        {"id": "a", "category": "EXACT_CORROBORATION", "fact_a": fact, "fact_b": fact, "llm": {"relation_type": "contradicts", "explanation": "x", "confidence": 0.4}},
        {"id": "b", "category": "CONTRADICTION", "fact_a": fact, "fact_b": fact | {"value_numeric": 9.0}, "llm": {"relation_type": "contradicts"}},
        {"id": "c", "category": "UNRELATED", "fact_a": fact, "fact_b": fact, "llm": {"relation_type": "corroborates"}, "same_metric": False},
        {"id": "d", "category": "CONTRADICTION", "fact_a": fact, "fact_b": fact | {"value_numeric": 9.0, "time_period": None}, "llm": {"relation_type": "contradicts"}},
    ]
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    loaded = evaluate.load_cases(spark, f"file://{tmp_path}/cases.json")
    assert all(r.fact_a.id < 0 and r.fact_a.statement == "Acme revenue is 5 USD FY24" for r in loaded.collect())
    results = evaluate.run_cases(loaded)
    assert {r.id: r.predicted for r in results.collect()} == {"a": "EXACT_CORROBORATION", "b": "CONTRADICTION", "c": "UNRELATED", "d": "INSUFFICIENT_CONTEXT"}
    assert evaluate.write_report(results, f"file://{tmp_path}/out").startswith("3 of 4 right")
    assert all(r.rejected for r in evaluate.evidence_probes(spark).collect())


def test_silent_documents_fail(spark, tmp_path):
    rows = [(1, "pending"), (2, "processing"), (2, "done"), (3, "processing")]
    spark.createDataFrame(rows, "document_id long, status string").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("document_id long, status string").parquet(f"file://{tmp_path}/in")
    query = stale_stream(stream, seconds=1).writeStream.format("memory").queryName("stale").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/check").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if spark.table("stale").count() >= 2:
                break
        assert sorted((r.document_id, r.status) for r in spark.table("stale").collect()) == [(1, "failed"), (3, "failed")]
    finally:
        query.stop()


def test_stopwatch_adds_up():
    watch = Stopwatch()
    for _ in range(2):
        with watch.track("x"):
            time.sleep(0.01)
    assert watch.seconds["x"] >= 0.02
