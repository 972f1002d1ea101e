"""Graph, arithmetic, timeline and streaming operators against small models."""

import random

from pyspark.sql import functions as F

from factloom.operators.arithmetic import check_arithmetic
from factloom.operators.coherence import check_coherence
from factloom.operators.graph import components
from factloom.operators.relate import candidates, classify, in_order, relationships
from factloom.operators.timeline import points, timelines
from factloom.sources.store import Store
from factloom.streaming.ingest import ingest_stream, next_status

FACTS = "id long, document_id long, subject string, attribute string, value string, value_numeric double, unit string, time_period string, scope string, statement string, quote string, quote_grounded boolean, evidence_status string, page_number int, embedding array<float>"


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(None, 1), (5, 5)]
    root = {i: i for i in range(60)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    touched = {i for a, b in edges if a is not None and a != b for i in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blame_by_values(spark):
    rels = spark.createDataFrame([(1, 10, 30, "corroborates", 1.0), (2, 10, 20, "corroborates", 0.9), (3, 20, 30, "reconciled", 0.8)], "id long, fact_id_a long, fact_id_b long, relation_type string, confidence double")
    facts = spark.createDataFrame([(10, 81415.38, "INR million", None), (20, 81415.38, "INR million", None), (30, 72253.01, "INR million", None)], "id long, value_numeric double, unit string, evidence_status string")
    v = check_coherence(rels, facts).violations.collect()
    assert len(v) == 1 and v[0].suspect_edge_id == 1 and v[0].basis == "refuted_by_values"
    assert check_coherence(rels).violations.first().suspect_edge_id == 3


def test_balance_sheet(spark):
    rows = [(1, "Total assets", 114530.20), (2, "Total liabilities", 23083.74), (3, "Total equity", 91446.46), (4, "Equity share capital", 736.79), (5, "Other equity", 90709.67)]
    facts = spark.createDataFrame([(i, s, v, "INR million", "FY24", "consolidated", "fact_validated") for i, s, v in rows], "id long, statement string, value_numeric double, unit string, time_period string, scope string, evidence_status string")
    r = check_arithmetic(facts)
    assert sorted((x.a_id, x.b_id, x.c_id) for x in r.identities.collect()) == [(2, 3, 1), (4, 5, 3)]
    assert r.anomalies.count() == 0
    lost = facts.withColumn("unit", F.when(F.col("id") == 3, "INR").otherwise(F.col("unit")))
    a = check_arithmetic(lost).anomalies.collect()
    assert a and all(x.suspect_id == 3 for x in a) and {x.factor for x in a} <= {1e6, 1e-6}


def _fact(i, doc, value, period="FY24", scope="consolidated", vec=(1.0, 0.0), unit="INR Crore", status="fact_validated"):
    return (i, doc, "Company", "revenue", str(value), float(value), unit, period, scope, f"revenue was {value}", f"revenue of {value} in the year", True, status, 1, list(vec))


def test_timelines(spark):
    facts = spark.createDataFrame([_fact(1, 1, 100, "FY22"), _fact(2, 1, 150, "FY23"), _fact(3, 2, 120, "FY24"), _fact(4, 2, 30, "Q1 FY24")], FACTS)
    rels = spark.createDataFrame([(1, 2, "reconciled"), (2, 3, "reconciled"), (3, 4, "reconciled"), (1, 4, "contradicts")], "fact_id_a long, fact_id_b long, relation_type string")
    p = points(facts, rels)
    assert [(r.fact_id, r.pct_change) for r in p.orderBy("year").collect()] == [(1, None), (2, 50.0), (3, -20.0)]
    t = timelines(p, facts, rels).collect()
    assert len(t) == 1 and t[0].n_points == 3 and t[0].label == "Company - revenue"


def test_classify_and_store(spark):
    facts = spark.createDataFrame([_fact(1, 1, 100), _fact(2, 2, 100.5), _fact(3, 3, 150), _fact(4, 4, 1, vec=(0.0, 1.0))], FACTS)
    v = facts.select("id", "embedding")
    pairs = candidates(v, v, facts.drop("embedding"))
    hashes = in_order(pairs).select("pair_hash")
    judged = hashes.select("pair_hash", F.lit(True).alias("same_metric"), F.lit(None).cast("string").alias("slice_a"), F.lit(None).cast("string").alias("slice_b"), F.lit("").alias("reason"), F.lit("agree").alias("relation_type"), F.lit("same").alias("explanation"), F.lit(None).cast("string").alias("reconciliation_context"), F.lit(0.7).alias("confidence"))
    stored = {(r.fact_low_id, r.fact_high_id): r.relation_type for r in relationships(classify(pairs, judged)).collect()}
    assert stored[1, 2] == "corroborates" and stored[1, 3] == "contradicts"
    assert relationships(classify(pairs, judged.limit(0))).count() == 0  # without a judgment nothing is related


def test_ingest_is_idempotent(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    facts = spark.createDataFrame([_fact(1, 1, 100), _fact(2, 2, 100.5)], FACTS)
    facts.write.parquet(f"file://{tmp_path}/in")
    v = facts.select("id", "embedding")
    judged = in_order(candidates(v, v, facts.drop("embedding"))).select("pair_hash", F.lit(True).alias("same_metric"), *[F.lit(None).cast("string").alias(c) for c in ("slice_a", "slice_b", "reason", "relation_type", "explanation", "reconciliation_context")], F.lit(None).cast("double").alias("confidence"))
    for n in range(2):
        ingest_stream(spark, f"file://{tmp_path}/in", store, judged, f"file://{tmp_path}/check{n}").awaitTermination()
    assert store.read("facts").count() == 2 and store.read("relationships").count() == 1
    assert next_status("processing", "finish") == "done"
