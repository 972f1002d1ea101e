"""More queries over the driver's tables, each beside the SQL that it must equal: stored tables and reads, whole-pair
classification, blame by values, contested timelines, layouts of two columns, texts for prompts, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import context, evidence, numbers, text
from factloom.operators import coherence, evaluate, priority, relate, timeline
from factloom.operators.arithmetic import check_arithmetic
from factloom.plans.oracle import _GRAPH, _NEAR, ORACLES
from factloom.plans.registry import QUERIES, Query, _graph, _order_pairs, _vectors, pick, t
from factloom.scratch import folder, stage
from factloom.sources import layout, pages, store


def query(name: str, sql: str):
    def add(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def new_store(spark: SparkSession) -> store.Store:
    return store.Store(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}")


def hit(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# Stored tables and reads


def _customer_facts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return t(spark, sf, "customer").select(k.alias("id"), F.col("c_nationkey").cast("long").alias("document_id"), (k % 5 + 1).cast("int").alias("page_number"), F.col("c_name").alias("statement"), F.col("c_mktsegment").alias("subject"), F.lit("balance").alias("attribute"), F.col("c_acctbal").alias("value_numeric"), F.lit("USD").alias("unit"), pick(k, "fact_validated", "ungrounded", "quote_grounded", None).alias("evidence_status"), (k % 4 != 1).alias("quote_grounded"))


@query("s8_document_facts", "select c_custkey as id, cast(c_custkey % 5 + 1 as integer) as page_number, c_name as statement from customer where c_nationkey = 3 order by page_number, id limit 50")
def _(spark, sf):
    s = new_store(spark)
    s.append("facts", _customer_facts(spark, sf))
    return store.list_facts(s.read("facts"), document_id=3).select("id", "page_number", "statement").limit(50)


@query("p1_p5_fact_search", "select c_custkey as id, c_name as statement, 'document ' || c_nationkey as document_name from customer where contains(lower(c_name), '7') or contains(lower(c_mktsegment), '7')")
def _(spark, sf):
    found = store.list_facts(_customer_facts(spark, sf).withColumn("embedding", F.array(F.lit(1.0))), q="7")
    assert "embedding" not in found.columns
    return found.select("id", "statement", F.concat(F.lit("document "), F.col("document_id").cast("string")).alias("document_name"))


@query("s9_latest_documents", "select c_custkey as id, case when c_custkey % 3 = 0 then 'failed' when c_custkey % 3 = 1 then 'done' else 'pending' end as status from customer")
def _(spark, sf):
    s, k = new_store(spark), F.col("c_custkey")
    docs = t(spark, sf, "customer").select(k.alias("id"), F.lit("pending").alias("status"), F.timestamp_seconds(k).alias("uploaded_at"))
    s.append("documents", docs)
    s.append("documents", docs.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, "failed").otherwise("done").alias("status"), "uploaded_at", F.timestamp_seconds(F.col("id") + 60).alias("changed_at")))
    return s.latest("documents").select("id", "status")


@query("s14_cache", "select c_custkey as k, case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then 'new' else 'old' end as answer from customer")
def _(spark, sf):
    s, k = new_store(spark), F.col("c_custkey")
    rows = t(spark, sf, "customer").select(k.cast("string").alias("chunk_hash"), k)
    for i, (answer, kept) in enumerate((("old", k % 3 > 0), ("new", k % 3 == 1))):
        s.append("extraction_cache", rows.where(kept).select("chunk_hash", F.lit("m").alias("model"), F.lit(answer).alias("facts_json"), F.timestamp_seconds(F.lit(i)).alias("created_at")))
    s.append("extraction_cache", rows.select("chunk_hash", F.lit("another model").alias("model"), F.lit("wrong").alias("facts_json"), F.timestamp_seconds(F.lit(9)).alias("created_at")))
    found, missing = store.cache_lookup(rows, s, "extraction_cache", "m")
    return found.select(F.col("c_custkey").alias("k"), F.col("facts_json").alias("answer")).unionByName(missing.select(F.col("c_custkey").alias("k"), F.lit(None).cast("string").alias("answer")))


@query("s12_issues", "select o_orderkey as id, repeat('x', cast(least(2000, o_orderkey) as int)) as raw_excerpt, o_custkey as document_id from orders where o_custkey % 10 = 0")
def _(spark, sf):
    s = new_store(spark)
    # Excerpts of up to twice the length that is stored: as long as the key, they would grow with the square of the rows.
    s.append("extraction_issues", t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.repeat(F.lit("x"), F.least("o_orderkey", F.lit(2 * store.EXCERPT)).cast("int")).alias("raw_excerpt"), F.lit("malformed_fact").alias("issue_type")).where("document_id % 10 = 0"))
    return store.list_issues(s.read("extraction_issues")).select("id", "raw_excerpt", "document_id")


@query("s13_vectors_of_others", "select vec_id as id from embeddings where vec_id % 4 <> 1")
def _(spark, sf):
    facts = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 4).alias("document_id"), "embedding")
    return store.vectors(facts, exclude_document_id=1).select("id")


@query("s16_backfilled_ends", "select o_orderkey as id, least(o_orderkey, o_custkey) as fact_low_id, greatest(o_orderkey, o_custkey) as fact_high_id from orders")
def _(spark, sf):
    s, k = new_store(spark), F.col("o_orderkey")
    s.append("relationships", t(spark, sf, "orders").select(k.alias("id"), k.alias("fact_id_a"), F.col("o_custkey").alias("fact_id_b"), F.when(k % 2 == 0, F.least(k, "o_custkey")).alias("fact_low_id"), F.when(k % 2 == 0, F.greatest(k, "o_custkey")).alias("fact_high_id")))
    return s.read("relationships").select("id", "fact_low_id", "fact_high_id")


@query("s2_page_counts", "select l_orderkey, cast(max(l_linenumber) as integer) as num_pages, max(l_quantity) >= 40 as has_text from lineitem group by 1")
def _(spark, sf):
    return pages.page_counts(t(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page_number"), F.expr("repeat('w', cast(l_quantity as int))").alias("text")), "l_orderkey")


@query("s5_clean_prefix", "select l_linenumber as page_number, count(*) as n from lineitem where l_linenumber <= 3 and l_quantity >= 40 group by 1")
def _(spark, sf):
    rows = t(spark, sf, "lineitem").select(F.col("l_linenumber").alias("page_number"), F.expr("repeat('w', cast(l_quantity as int))").alias("text"))
    return pages.clean_pages(pages.select_pages(rows, max_pages=3)).groupBy("page_number").agg(F.count("*").alias("n"))


_RELS = "rel as (select id, i as a, j as b, relation_type, conf from e)"


@query("s11_newest_relationships", f"{_GRAPH} select id, relation_type from e where relation_type = 'contradicts' order by id desc limit 100")
def _(spark, sf):
    return store.list_relationships(_graph(spark, sf), "contradicts").select("id", "relation_type").limit(100)


@query("s20_document_detail", """select c_custkey as id, (select count(*) from orders where o_custkey = 7) as facts, (select count(*) from orders where o_custkey = 7 and o_orderkey % 2 = 0) as issues,
    (select min(o_orderkey) from orders where o_custkey = 7 and o_orderkey % 3 = (select min(o_orderkey % 3) from orders where o_custkey = 7)) as first from customer where c_custkey = 8""")
def _(spark, sf):
    docs = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") == 8, F.lit(7).cast("long")).alias("reused_from_document_id"))
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 3).alias("page_number"), *[F.lit("x").alias(c) for c in ("statement", "value", "unit", "time_period", "scope", "evidence_status", "issue_type", "detail")])
    d = store.document_detail(docs, o, o.where("id % 2 = 0"), 8)
    return d.select("id", F.coalesce(F.size("facts"), F.lit(0)).cast("long").alias("facts"), F.coalesce(F.size("issues"), F.lit(0)).cast("long").alias("issues"), F.col("facts")[0]["id"].alias("first"))


@query("p3_edges_of_document", f"{_GRAPH} select id from e where i % 7 = 2 or j % 7 = 2")
def _(spark, sf):
    facts = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7).alias("document_id"))
    return store.edges_of_document(_graph(spark, sf), facts, 2).select("id")


@query("j5_relationship_view", f"""{_GRAPH}
select id, x.c_name as statement_a, case when j % 10 > 0 then y.c_name end as statement_b, 'document ' || x.c_nationkey as document_a,
    case when j % 10 > 0 then case when x.c_acctbal = y.c_acctbal then true else abs(x.c_acctbal - y.c_acctbal) / greatest(abs(x.c_acctbal), abs(y.c_acctbal)) * 100 <= 2 end end as agree
from e join customer x on x.c_custkey = i join customer y on y.c_custkey = j""")
def _(spark, sf):
    facts = _customer_facts(spark, sf)
    missing = facts.where("id % 10 > 0")
    rels = _graph(spark, sf)
    docs = spark.createDataFrame([], "id long, original_name string")
    both = store.relationships_with_facts(rels.select("id", "fact_id_a", "fact_id_b"), missing, docs)
    # The first end of an edge may be missing too; the query looks at it through all facts.
    a = facts.select(F.col("id").alias("fact_id_a"), F.col("statement").alias("statement_a"), F.concat(F.lit("document "), F.col("document_id").cast("string")).alias("document_a"), "value_numeric")
    b = missing.select(F.col("id").alias("fact_id_b"), F.col("value_numeric").alias("vb"))
    told = both.join(a, "fact_id_a").join(b, "fact_id_b", "left")
    agree = F.when(F.col("fact_a").isNull() & F.col("vb").isNotNull(), numbers.compare_values("value_numeric", F.lit("USD"), "vb", F.lit("USD"))["agree"]).otherwise(F.col("comparison.agree"))
    return told.select("id", "statement_a", F.col("fact_b.statement").alias("statement_b"), "document_a", agree.alias("agree"))


@query("j6_related_facts", f"{_GRAPH} select id, case when i = 5 then j else i end as other_id, c_name as statement from e join customer on c_custkey = case when i = 5 then j else i end where i = 5 or j = 5")
def _(spark, sf):
    facts = _customer_facts(spark, sf).withColumn("value", F.lit("v"))
    return store.related_facts(facts, _graph(spark, sf), 5).select("id", "other_id", F.col("other.statement").alias("statement"))


@query("j8_reusable_document", "select max(o_orderkey) as id from orders where o_custkey % 50 = 7 and o_orderstatus = 'F' and o_orderkey % 3 <> 1 having count(*) > 0")
def _(spark, sf):
    o, k = t(spark, sf, "orders"), F.col("o_orderkey")
    docs = o.select(k.alias("id"), (F.col("o_custkey") % 50).cast("string").alias("content_hash"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("status"), F.lit(None).cast("string").alias("page_selector"), F.lit("f").alias("pipeline_fingerprint"))
    facts = o.where("o_orderkey % 3 <> 1").select(k.alias("document_id"))
    return store.reusable_document(docs, facts, "7", None, "f").select("id")


@query("a8_run_totals", "select cast(sum(p_size) as bigint) as pages, cast(sum(p_size * 2) as bigint) as chunks, cast(sum(p_partkey) as bigint) as candidate_pairs from part")
def _(spark, sf):
    p = F.col("p_size").cast("long")
    docs = t(spark, sf, "part").select(F.struct(p.alias("pages"), (2 * p).alias("chunks"), F.col("p_partkey").alias("candidate_pairs")).alias("stats"))
    return store.run_totals(docs.withColumn("stats", F.to_json("stats"))).select("pages", "chunks", "candidate_pairs")


@query("i7_stale_documents", "select o_orderkey as id, 'failed' as status from orders where o_orderstatus <> 'F' and o_orderdate < timestamp '1997-01-01' - interval 20 minute")
def _(spark, sf):
    docs = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing").alias("status"), F.col("o_orderdate").alias("uploaded_at"))
    return store.stale_documents(docs, F.lit("1997-01-01").cast("timestamp")).select("id", "status")


# Candidates and classification


def _vector_facts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("vec_id")
    return t(spark, sf, "embeddings").select(k.alias("id"), pick(k, "Acme", "Acme Limited", "Other").alias("subject"), pick(F.floor(k / 3), "revenue", "staff").alias("attribute"), (F.col("label") + 1).cast("double").alias("value_numeric"), F.lit("USD").alias("unit"))


@query("j4_candidates", f"""{_NEAR},
p as (select id, other_id, score, least(id, other_id) as lo, greatest(id, other_id) as hi, row_number() over (partition by least(id, other_id), greatest(id, other_id) order by score desc, id) as k from n where rank <= 4 and id % 5 = 0),
f as (select vec_id as id, vec_id % 3 as s, (vec_id // 3) % 2 as a, label + 1.0 as v from embeddings),
q as (select lo, hi, score, case when x.s = y.s then 1.0 when x.s + y.s = 1 then 0.85 else 0.0 end as entity, case when x.a = y.a then 1.0 else 0.0 end as lexical, abs(x.v - y.v) / greatest(x.v, y.v) * 100 <= 2 as near from p join f x on x.id = p.id join f y on y.id = p.other_id where k = 1 and (lo + hi) % 4 <> 0),
r as (select lo, hi, array_to_string(list_filter([case when score >= 0.4 then 'embedding' end, case when entity >= 0.5 and lexical >= 0.3 then 'entity+lexical' end, case when near and entity >= 0.5 then 'numeric' end], lambda x: x is not null), '+') as triggers, entity, lexical from q)
select lo, hi, triggers, round(entity, 2) as entity, round(lexical, 2) as lexical from r where triggers <> ''""")
def _(spark, sf):
    v = _vectors(spark, sf)
    # Stored pairs are those whose ids add up to a multiple of four; only pairs near each other matter.
    near = relate.unordered_pairs(relate.top_k_similar(v.where("id % 5 = 0"), v))
    stored = near.where("(lo + hi) % 4 = 0").select(F.col("lo").alias("fact_low_id"), F.col("hi").alias("fact_high_id"))
    c = relate.candidates(v.where("id % 5 = 0"), v, _vector_facts(spark, sf), stored)
    return c.select("lo", "hi", F.array_join("cand.triggers", "+").alias("triggers"), F.round("cand.entity_score", 2).alias("entity"), F.round("cand.lexical_score", 2).alias("lexical"))


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's stated and recomputed totals as two facts, with recorded judgments for two of three."""
    p = stage(_order_pairs(spark, sf).where("recomputed is not null"), "order-facts")
    k = F.col("o_orderkey")

    def fact(side: str, value: str, period: Column, unit: Column, scope: Column, status: Column) -> Column:
        own = {"id": 2 * k + int(side == "b"), "subject": F.lit("order"), "attribute": F.lit("total"), "value": F.col(value).cast("string"), "value_numeric": F.col(value), "unit": unit, "time_period": period, "scope": scope, "statement": F.concat(F.lit(side), k.cast("string")), "quote": F.lit("q"), "evidence_status": status}
        return F.struct(*[c.alias(n) for n, c in own.items()])

    pairs = p.select(k, F.struct(F.lit(0.5).alias("embedding_score"), F.lit("d").alias("detail"), F.array(F.lit("embedding")).alias("triggers")).alias("cand"), fact("a", "o_totalprice", F.col("period_a"), F.lit("USD"), F.lit("gross"), F.lit("fact_validated")).alias("a"), fact("b", "recomputed", F.col("period_b"), F.col("unit_b"), F.col("scope_b"), F.when(k % 11 == 0, "ungrounded").otherwise("fact_validated")).alias("b"))
    hashes = relate.in_order(pairs).where("o_orderkey % 3 > 0").select("pair_hash", "o_orderkey")
    j = hashes.select("pair_hash", (k % 6 != 4).alias("same_metric"), F.lit(None).cast("string").alias("slice_a"), F.lit(None).cast("string").alias("slice_b"), F.lit("").alias("reason"), pick(k, "agree", "conflicts", "whatever", None).alias("relation_type"), F.lit("told").alias("explanation"), F.lit(None).cast("string").alias("reconciliation_context"), F.lit(0.6).alias("confidence"))
    return relate.classify(pairs, j)


_CLASSIFIED = """
with l as (select l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as b from lineitem group by 1),
p as (select o_orderkey as k, o_totalprice as a, b, case o_orderkey % 4 when 0 then 'corroborates' when 1 then 'contradicts' else 'uncertain' end as said from orders join l on l_orderkey = o_orderkey),
c as (select *, k % 13 <> 0 as comparable, case when a = b then 0 else abs(a - b) / greatest(abs(a), abs(b)) * 100 end as diff,
    case when k % 5 = 0 then 'overlapping' when k % 7 = 0 then 'unknown' else 'same' end as per, case when k % 17 = 0 then 'different' else 'same' end as sc, k % 11 = 0 as caveat from p),
f as (select *, comparable and least(abs(a), abs(b)) > 0 and greatest(abs(a), abs(b)) / least(abs(a), abs(b)) >= 100 as suspect from c),
g as (select *, comparable and not suspect and not caveat and diff <= 2 as agree, comparable and not suspect and not caveat and diff > 2 as differ from f),
r as (select *, case when not comparable then 1 when suspect then 2 when caveat and said in ('corroborates', 'contradicts') then 3
    when agree and per <> 'overlapping' and sc <> 'different' then 4 when differ and per = 'same' and sc = 'same' then 5
    when differ and (per = 'overlapping' or sc = 'different') then 6 when differ and per = 'unknown' then 7 else 8 end as rule from g),
z as (select *, k % 3 > 0 and k % 6 <> 4 as judged, case rule when 1 then 'related_but_not_comparable' when 2 then 'uncertain' when 3 then 'uncertain' when 4 then 'corroborates' when 5 then 'contradicts' when 6 then 'reconciled' when 7 then 'insufficient_context' else said end as fin from r),
y as (select *, case when judged then fin else 'unrelated' end as final_relation,
    case when not judged then null when rule = 8 then 'llm_unchecked' when rule <> 3 and (said = fin or rule = 7 and said = 'uncertain') then 'deterministic_confirmed' else 'deterministic_override' end as source, judged and rule <> 8 and said <> fin as disagreement from z)"""


@query("l6_classified_pairs", f"{_CLASSIFIED} select k as o_orderkey, judged as same_metric, final_relation, source as decision_source, disagreement, not judged or not disagreement and ends_with('told', 'told') as told_alone from y")
def _(spark, sf):
    c = _classified(spark, sf)
    return c.select("o_orderkey", "same_metric", "final_relation", "adj.decision_source", hit(F.col("adj.disagreement")).alias("disagreement"), (~F.col("same_metric") | (F.col("adj.explanation") == "told")).alias("told_alone"))


@query("a15_build_summary", f"""{_CLASSIFIED}
select count(*) as candidate_pairs, count(*) filter (not judged) as metric_mismatches, count(*) filter (final_relation <> 'unrelated') as stored, count(*) filter (source = 'deterministic_override') as llm_overridden,
    count(*) filter (disagreement) as disagreements, count(*) filter (final_relation = 'contradicts') as contradicts, cast(0 as bigint) as hybrid_promotions from y""")
def _(spark, sf):
    return relate.build_summary(_classified(spark, sf)).select("candidate_pairs", "metric_mismatches", "stored", "llm_overridden", "disagreements", "contradicts", "hybrid_promotions")


@query("s10_stored_relationships", f"{_CLASSIFIED} select 2 * k as fact_low_id, 2 * k + 1 as fact_high_id, final_relation as relation_type, case when source = 'llm_unchecked' then 0.6 else 1.0 end as confidence from y where final_relation <> 'unrelated' and k % 10 <> 0")
def _(spark, sf):
    c = stage(_classified(spark, sf).drop("cand").withColumn("cand", F.struct(F.lit(0.5).alias("embedding_score"), F.lit("d").alias("detail"))), "classified")
    turned = c.withColumn("_a", F.col("a")).withColumn("a", F.col("b")).withColumn("b", F.col("_a")).drop("_a")
    stored = c.where("o_orderkey % 10 = 0").select((2 * F.col("o_orderkey")).alias("fact_low_id"), (2 * F.col("o_orderkey") + 1).alias("fact_high_id"))
    return relate.relationships(c.unionByName(turned), stored).select("fact_low_id", "fact_high_id", "relation_type", "confidence")


@query("x11_explanations", """
select c_custkey, case when k = 0 then 'told' when k = 1 then 'the values agree, 0% apart' when k = 2 then 'the values agree, 0% apart (proposed: contradicts; told)' else 'no check applies to the pair' end as explanation,
    case when k = 2 then 'the values agree, 0% apart' end as disagreement_reason, case when k = 3 then 0.3 else 1.0 end as confidence from (select c_custkey, c_custkey % 4 as k from customer)""")
def _(spark, sf):
    from factloom.operators.compare import adjudicate_pairs, compare_pairs

    k = F.col("c_custkey") % 4
    value = F.when(k < 3, 5.0)
    side = {"value": value, "unit": F.lit("USD"), "time_period": F.lit("FY24"), "scope": F.lit("group")}
    llm = F.struct(F.when(k == 2, "contradicts").when(k < 2, "corroborates").alias("relation_type"), F.when(k % 2 == 0, "told").alias("explanation"), F.lit(None).cast("string").alias("reconciliation_context"), F.lit(0.3).alias("confidence"))
    judged = adjudicate_pairs(compare_pairs(t(spark, sf, "customer"), side, side), llm, F.lit(None).cast("string"), value.isNotNull())
    return judged.select("c_custkey", "adj.explanation", "adj.disagreement_reason", "adj.confidence")


# Graph


@query("g6_blame_by_values", f"""{_GRAPH},
w as (select q.*, x.c_acctbal as va, y.c_acctbal as vb, x.c_custkey % 4 in (1, 2) or y.c_custkey % 4 in (1, 2) as weak from q join customer x on x.c_custkey = q.i join customer y on y.c_custkey = q.j),
d as (select *, case when va = vb then 0 else abs(va - vb) / greatest(abs(va), abs(vb)) * 100 end as diff, least(abs(va), abs(vb)) > 0 and greatest(abs(va), abs(vb)) / least(abs(va), abs(vb)) >= 100 as suspect from w),
m as (select *, not weak and not suspect and (kind = 'E') <> (diff <= 2) as refuted from d),
tr as (select x.i as a, x.j as b, y.j as c, [x, y, z] as es from m x join m y on y.i = x.j join m z on z.i = x.i and z.j = y.j),
vi as (select *, list_filter(es, lambda x: x.refuted) as bad, list_min(list_transform(es, lambda x: x.conf)) as lo, list_max(list_transform(es, lambda x: x.conf)) as hi from tr where len(list_filter(es, lambda x: x.kind = 'E')) = 2),
vj as (select *, case when len(bad) > 0 then bad when lo = hi then es else es end as pool, case when len(bad) > 0 then list_min(list_transform(bad, lambda x: x.conf)) when lo = hi then null else lo end as least from vi)
select a, b, c, case when len(bad) = 1 then 'refuted_by_values' when len(bad) > 1 then 'least_confident_refuted' when lo = hi then 'undetermined' else 'least_confident' end as basis,
    list_min(list_transform(list_filter(pool, lambda x: least is null or x.conf = least), lambda x: x.id)) as suspect_edge_id from vj""")
def _(spark, sf):
    return coherence.check_coherence(_graph(spark, sf), _customer_facts(spark, sf), infer=False).violations.select("a", "b", "c", "basis", "suspect_edge_id")


@query("j12b_enriched_violations", f"{_GRAPH} select a, x.c_name as statement_a, b, case when b % 10 > 0 then y.c_name end as statement_b, case when a % 10 > 0 then 'n' || x.c_nationkey end as document_a from vio join customer x on x.c_custkey = a join customer y on y.c_custkey = b")
def _(spark, sf):
    facts = _customer_facts(spark, sf).withColumn("value", F.lit("v"))
    docs = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("original_name"))
    bad = coherence.check_coherence(_graph(spark, sf), infer=False).violations
    told = coherence.enrich(bad, facts.where("id % 10 > 0"), docs)
    names = facts.select(F.col("id").alias("_i"), F.col("statement").alias("_s"))
    return told.join(names, F.col("a.id") == F.col("_i")).select(F.col("a.id").alias("a"), F.col("_s").alias("statement_a"), F.col("b.id").alias("b"), F.col("b.statement").alias("statement_b"), F.col("a.document_name").alias("document_a"))


@query("p3_coherence_of_document", f"{_GRAPH} select a, b, c from vio where a % 7 = 2 or b % 7 = 2 or c % 7 = 2")
def _(spark, sf):
    facts = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7).alias("document_id"))
    return coherence.touching(coherence.check_coherence(_graph(spark, sf), infer=False).violations, facts, 2).select("a", "b", "c")


@query("g3_support", f"""{_GRAPH},
bb as (select i as x, j as via, id, kind, relation_type, conf from q union all select j, i, id, kind, relation_type, conf from q),
w as (select least(l.x, r.x) as b, greatest(l.x, r.x) as c, l.via, case when r.kind = 'E' then 'corroborates' else r.relation_type end as relation_type, round(least(l.conf, r.conf), 3) as confidence, list_sort([l.id, r.id]) as s
    from bb l join bb r on l.via = r.via and l.kind = 'E' and l.x <> r.x and (r.kind = 'N' or l.x < r.x)),
o as (select *, row_number() over (partition by b, c order by via, relation_type, confidence, s) as n from w where not exists (select 1 from q where q.i = w.b and q.j = w.c))
select b, c, s[1] as first, s[2] as second from o where n = 1 and s[1] not in (select edge_id from imp) and s[2] not in (select edge_id from imp)""")
def _(spark, sf):
    return coherence.check_coherence(_graph(spark, sf)).inferences.select("b", "c", F.col("support")[0].alias("first"), F.col("support")[1].alias("second"))


def _ranked_sql(order: str) -> str:
    from factloom.plans.oracle import _LEVEL, _R3

    return f"{_R3}, z as (select id, score, {_LEVEL} as level from sc) select id, score, level from z order by {order} limit 50"


@query("o3_ranked_facts", _ranked_sql("case level when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end, score desc, id"))
def _(spark, sf):
    g = _graph(spark, sf)
    facts = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), pick(F.col("c_custkey"), "fact_validated", "ungrounded", "quote_grounded", None).alias("evidence_status"))
    scored = priority.score_facts(facts, g, coherence.implicated_edges(coherence.check_coherence(g, infer=False).violations), facts.where("id % 11 = 0").select(F.col("id").alias("suspect_id")))
    return priority.ranked(scored, limit=50).select("id", "score", "level")


@query("r4_reasons", f"""{_GRAPH} select id, case when id in (select edge_id from imp) then 'in a triangle that cannot be true; ' else '' end || case when relation_type = 'contradicts' then case when conf >= 0.85 then 'a confident contradiction without explanation; ' else 'a contradiction without explanation; ' end else '' end
    || case when relation_type = 'uncertain' then 'the relation is not settled; ' else '' end || case when s = 3 then 'a check overrode the proposal uncertain; ' else '' end as told from e""")
def _(spark, sf):
    g = _graph(spark, sf)
    scored = priority.score_relationships(g, coherence.implicated_edges(coherence.check_coherence(g, infer=False).violations))
    told = F.array_join(F.transform(F.filter("reasons", lambda r: r != "nothing stands out"), lambda r: F.concat(r, F.lit("; "))), "")
    return scored.select("id", told.alias("told"))


@query("r5_priority_of_document", f"""{_GRAPH}, own as (select * from e where i % 7 = 2 or j % 7 = 2)
select (select count(*) from customer where c_custkey % 7 = 2) as facts, count(*) as relationships, count(*) filter (relation_type = 'contradicts') as contradicts from own""")
def _(spark, sf):
    facts = _customer_facts(spark, sf).withColumn("document_id", F.col("id") % 7).withColumns({"time_period": F.lit("FY24"), "scope": F.lit("all")})
    f, r = priority.priority(facts, _graph(spark, sf), 2)
    return f.agg(F.count("*").alias("facts")).crossJoin(r.agg(F.count("*").alias("relationships"), F.count_if(F.col("relation_type") == "contradicts").alias("contradicts")))  # one row each


# Arithmetic and timelines


@query("w6_first_of_groups", """
with f as (select c_nationkey as g, c_custkey as id, cast(c_custkey as double) as v, row_number() over (partition by c_nationkey order by c_custkey) as i from customer where c_custkey <> 0),
k as (select * from f where i <= 60), tr as (select a.id as a_id, b.id as b_id, c.id as c_id from k a join k b on a.g = b.g and a.i < b.i join k c on c.g = a.g and c.i not in (a.i, b.i) where abs(a.v + b.v - c.v) / c.v * 100 <= 0.5 and abs(a.v + b.v - c.v) / least(a.v, b.v) * 100 <= 5)
select a_id, b_id, c_id from tr""")
def _(spark, sf):
    k = F.col("c_custkey")
    facts = t(spark, sf, "customer").select(k.alias("id"), F.concat(F.lit("s"), k.cast("string")).alias("statement"), k.cast("double").alias("value_numeric"), F.lit("items").alias("unit"), F.lit("FY24").alias("time_period"), F.col("c_nationkey").cast("string").alias("scope"), F.lit(None).cast("string").alias("evidence_status"))
    return check_arithmetic(facts).identities.select("a_id", "b_id", "c_id")


def _contested(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Four facts of each supplier and year: two scopes, two units, and a quarter that must not be chained."""
    x = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(y).alias("y")) for y in range(2020, 2025) for i in range(4)]))
    f = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"), x.alias("x")).select("s", "x.i", "x.y")
    facts = f.select((F.col("s") * 100 + (F.col("y") - 2020) * 10 + F.col("i")).alias("id"), F.col("s").alias("document_id"), (F.col("s") + F.col("y") - 2000 + F.col("i")).cast("double").alias("value_numeric"), F.when((F.col("i") == 2) & (F.col("y") % 2 == 0), "kg").otherwise("items").alias("unit"), F.when(F.col("i") == 3, F.concat(F.lit("Q1 FY"), F.col("y").cast("string"))).otherwise(F.concat(F.lit("FY"), F.col("y").cast("string"))).alias("time_period"), F.when(F.col("i") == 0, "standalone").when(F.col("i") == 1, "consolidated").otherwise("").alias("scope"), F.concat(F.lit("subject "), F.repeat(F.lit("x"), F.col("i"))).alias("subject"), F.lit("count").alias("attribute"))
    base = facts.select("id", "document_id", (F.col("id") % 10).alias("i"), (F.floor(F.col("id") / 10) % 10).alias("y"))
    within = base.where("i in (1, 2, 3)").select((F.col("id") - F.col("i")).alias("fact_id_a"), F.col("id").alias("fact_id_b"))
    across = base.where("i = 0 and y < 4").select(F.col("id").alias("fact_id_a"), (F.col("id") + 10).alias("fact_id_b"))
    extra = base.where("i = 1 and y < 2").select(F.col("id").alias("fact_id_a"), (F.col("id") + 10).alias("fact_id_b"))
    return facts, within.unionByName(across).unionByName(extra).withColumn("relation_type", F.lit("reconciled"))


# Facts 0, 1 and 2 of a year are one component over all years; the quarter (3) overlaps its year and is left out. Scope "consolidated" and
# "standalone" are named five times each, so the smaller name wins and fact 1 stands for each year.
@query("g9_contested_timelines", """
with y as (select s_suppkey as s, unnest(range(2020, 2025)) as y from supplier), p as (select s, y, cast(s + y - 2000 + 1 as double) as v from y)
select s * 100 as timeline, s * 100 + (y - 2020) * 10 + 1 as fact_id, 'consolidated' as scope_used, 'items' as base_unit, v as value, case when lag(v) over w <> 0 then round((v - lag(v) over w) / abs(lag(v) over w) * 100, 2) end as pct_change from p window w as (partition by s order by y)""")
def _(spark, sf):
    return timeline.points(*_contested(spark, sf)).select("timeline", "fact_id", "scope_used", "base_unit", "value", "pct_change")


@query("a14_timeline_labels", "select s_suppkey * 100 as timeline, 'subject xx - count' as label, cast(5 as bigint) as n_points from supplier order by n_points desc, timeline limit 100")
def _(spark, sf):
    facts, rels = _contested(spark, sf)
    return timeline.timelines(timeline.points(facts, rels), facts, rels).select("timeline", "label", "n_points").limit(100)


# Layout


@query("t1_two_columns", """
with r as (select r.range as r from range(0, 10) r), side as (select c.range as c from range(0, 2) c)
select cast(n_nationkey as bigint) as document_id, (select string_agg('a' || r || c || ' b' || r || c || ' | d' || r || c || ' | f' || r || c, chr(10) order by c, r) from r, side) as text, 'reconstructed' as table_context from nation""")
def _(spark, sf):
    cell = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("document_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("k", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(x).alias("x")) for n, x in (("a", 30.0), ("b", 44.0), ("d", 110.0), ("f", 180.0))])))
    x0, y0 = F.col("k.x") + 300 * F.col("c"), 60.0 + 20 * F.col("r")
    words = cell.select("document_id", F.lit(1).alias("page_number"), x0.alias("x0"), y0.alias("y0"), (x0 + 12).alias("x1"), (y0 + 10).alias("y1"), F.concat("k.n", F.col("r").cast("string"), F.col("c").cast("string")).alias("word"))
    # Words over the gap between the sides' own columns keep those gaps from being gutters.
    bridge = cell.where("r = 0").select("document_id", F.lit(1).alias("page_number"), (F.col("c") * 300 + 30).cast("double").alias("x0"), F.lit(300.0).alias("y0"), (F.col("c") * 300 + 192).cast("double").alias("x1"), F.lit(310.0).alias("y1"), F.lit("-").alias("word")).distinct()
    pages_ = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("document_id"), F.lit(1).alias("page_number"), F.lit(612.0).alias("width"), F.lit("plain").alias("text"))
    found = layout.page_texts(words.unionByName(bridge), pages_)
    return found.select("document_id", F.regexp_replace("text", "\n-(?=\n|$)", "").alias("text"), "table_context")


@query("t7_rejected_table", "select cast(n_nationkey as bigint) as document_id, repeat('long text ', 60) as text_start, 'plain_reconstruction_rejected' as table_context from nation")
def _(spark, sf):
    cell = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("document_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2))))
    x0, y0 = 50.0 + 120 * F.col("c"), 60.0 + 20 * F.col("r")
    words = cell.select("document_id", F.lit(1).alias("page_number"), x0.alias("x0"), y0.alias("y0"), (x0 + 12).alias("x1"), (y0 + 10).alias("y1"), F.lit("ab").alias("word"))
    pages_ = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("document_id"), F.lit(1).alias("page_number"), F.lit(612.0).alias("width"), F.repeat(F.lit("long text "), F.lit(60)).alias("text"))
    return layout.page_texts(words, pages_).select("document_id", F.concat("text", F.lit(" ")).alias("text_start"), "table_context")


# Texts


@query("f7_prompt_lines", """
select o_orderkey, case o_orderkey % 3 when 0 then 'values match within tolerance: 12 and 12 usd (0% apart)' when 1 then 'values differ: 12 and 24 usd (50% apart)' else 'values cannot be compared: units do not convert: usd and eur' end as told from orders""")
def _(spark, sf):
    k = F.col("o_orderkey") % 3
    c = numbers.compare_values(F.lit(12.0), F.lit("USD"), F.when(k == 1, 24.0).otherwise(12.0), F.when(k == 2, "EUR").otherwise("USD"))
    return t(spark, sf, "orders").select("o_orderkey", numbers.describe_comparison(c).alias("told"))


@query("f16_prompt_context", "select n_nationkey, case when n_nationkey % 2 = 0 then 'period: same - both cover FY2024' else 'period: different - periods differ: FY2024 and FY2023' end || chr(10) || 'scope: same - two names of one scope: group and consolidated' as told from nation")
def _(spark, sf):
    b = F.when(F.col("n_nationkey") % 2 == 0, "FY2023-24").otherwise("FY23")
    told = context.describe_context(context.compare_periods(F.lit("FY24"), b), context.compare_scopes(F.lit("group"), F.lit("consolidated")))
    return t(spark, sf, "nation").select("n_nationkey", told.alias("told"))


@query("f18_hash_bytes", "select p_partkey, sha256(encode(p_name)) as hash from part")
def _(spark, sf):
    return t(spark, sf, "part").select("p_partkey", text.hash_bytes(F.encode("p_name", "utf-8")).alias("hash"))


@query("f19_pair_hash", """
with p as (select p_partkey, 'x|a|||||' || p_name || '|q' as x, 'y|a|||||' || p_brand || '|q' as y from part)
select p_partkey, sha256(encode(least(x, y)) || '\\x00'::blob || encode(greatest(x, y)) || '\\x00'::blob) as hash, true as either from p""")
def _(spark, sf):
    def fact(subject: str, statement: str) -> Column:
        own = {"subject": F.lit(subject), "attribute": F.lit("a"), "statement": F.col(statement), "quote": F.lit("q")}
        return F.struct(*[own.get(n, F.lit(None).cast("string")).alias(n) for n in text.PAIR_FIELDS])

    a, b = fact("x", "p_name"), fact("y", "p_brand")
    return t(spark, sf, "part").select("p_partkey", text.pair_hash(a, b).alias("hash"), (text.pair_hash(a, b) == text.pair_hash(b, a)).alias("either"))


@query("f24_fingerprint", "select r_regionkey, substr(sha256(encode('3') || '\\x00'::blob || encode('model') || '\\x00'::blob || encode('1200') || '\\x00'::blob), 1, 16) as fingerprint from region")
def _(spark, sf):
    return t(spark, sf, "region").select("r_regionkey", text.fingerprint("3", "model", "1200").alias("fingerprint"))


@query("f25_labels", "select p_partkey, p_name as shown, case when length(p_name) > 10 then substr(p_name, 1, 9) || chr(8230) else p_name end as short from part")
def _(spark, sf):
    upload = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("0123456789abcdef" * 2 + "_")).otherwise(""), "p_name", F.lit(".PDF"))
    return t(spark, sf, "part").select("p_partkey", text.display_name(upload).alias("shown"), text.truncate("p_name", 10).alias("short"))


# Evidence


@query("v2_units_in_quotes", "select o_orderkey, case o_orderkey % 5 when 0 then true when 1 then false when 2 then true when 3 then null else true end as seen, case o_orderkey % 3 when 0 then true when 1 then false end as words from orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    unit, quote = pick(k, "INR Crore", "USD", "%", None, "US dollars"), pick(k, "in inr only", "no currency", "5 % more", "anything", "many dollars")
    return t(spark, sf, "orders").select("o_orderkey", evidence.unit_in_quote(unit, quote).alias("seen"), evidence.text_overlap(pick(k, "total revenue", "staff", "the of"), F.lit("revenue in the year")).alias("words"))


@query("v5_evidence_detail", """select o_orderkey, 'value: ' || case when o_orderkey % 2 = 0 then 'yes' else 'no' end || '; unit: no; subject: yes' || case when o_orderkey % 2 = 0 then '' else '; no number of the fact is in the quote' end
    || case when o_orderkey % 3 = 0 then '; the page''s table could not be aligned' else '' end as detail from orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    # Another number is twice the key: numbers within a millionth count as the same.
    e = evidence.check_evidence(F.lit(True), k.cast("double"), F.lit(None).cast("string"), F.lit("USD"), F.concat(F.lit("the total came to "), (k * (1 + k % 2)).cast("string")), F.lit("total"), F.lit(None).cast("string"))
    return t(spark, sf, "orders").select("o_orderkey", evidence.evidence_detail(e, F.when(k % 3 == 0, "plain_reconstruction_rejected")).alias("detail"))


@query("v10_validated_facts", """
select c_custkey, case when k = 0 then null else c_name end as statement, case when k in (0, 1) then null when k = 2 then 1234.5 when k = 3 then c_custkey end as value_numeric, case when k = 0 then 'statement is missing' when k = 1 then 'quote is missing' end as issue from (select *, c_custkey % 4 as k from customer)""")
def _(spark, sf):
    k = F.col("c_custkey")
    raw = t(spark, sf, "customer").select(k, pick(k, "n/a", F.col("c_name"), F.col("c_name"), F.col("c_name")).alias("statement"), pick(k, "q", "  ", "q", "q").alias("quote"), pick(k, "1", "2", "1.234,5", k.cast("string")).alias("value_numeric"))
    good, bad = evidence.validate_facts(raw)
    names = t(spark, sf, "customer").select("c_custkey", "c_name")
    return good.select("c_custkey", "statement", "value_numeric", F.lit(None).cast("string").alias("issue")).unionByName(bad.join(names, "c_custkey").select("c_custkey", F.when(F.col("detail") == "quote is missing", F.col("c_name")).alias("statement"), F.lit(None).cast("double").alias("value_numeric"), F.col("detail").alias("issue")))


# Evaluation


@query("j14_audit_of_document", f"""{_GRAPH}, st as (select id, relation_type, case id % 4 when 1 then 'unrelated' when 2 then 'contradicts' when 3 then relation_type end as fresh from e where relation_type <> 'unrelated' and (i % 7 = 2 or j % 7 = 2))
select count(*) as audited, count(*) filter (fresh = relation_type) as kept, count(*) filter (fresh is null or fresh = 'unrelated') as dropped from st""")
def _(spark, sf):
    g = _graph(spark, sf).where("relation_type <> 'unrelated'").select(F.col("fact_id_a").alias("lo"), F.col("fact_id_b").alias("hi"), "relation_type", "id")
    fresh = g.where("id % 4 > 0").select("lo", "hi", F.when(F.col("id") % 4 == 1, F.lit("unrelated")).when(F.col("id") % 4 == 2, F.lit("contradicts")).otherwise(F.col("relation_type")).alias("relation_type"))
    facts = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7).alias("document_id"))
    return evaluate.audit(g, fresh, relate.STORED, facts, 2).select("audited", "kept", "dropped")


@query("c4_candidate_detail", """select p_partkey, case when p_partkey % 2 = 0 then 'embedding+entity+lexical+numeric [embedding=0.50, entity=1.00, lexical=1.00, numeric_match(1% apart)]' else 'embedding [embedding=0.50, entity=0.00, lexical=1.00]' end as detail from part""")
def _(spark, sf):
    from factloom.operators.adjudicate import score_pair

    k = F.col("p_partkey")

    def fact(subject: Column, value: float) -> Column:
        return F.struct(subject.alias("subject"), F.lit("revenue").alias("attribute"), F.lit(value).alias("value_numeric"), F.lit("USD").alias("unit"))

    s = score_pair(fact(F.lit("Acme"), 99.0), fact(F.when(k % 2 == 0, "acme").otherwise("Other"), 100.0), F.lit(0.5))
    return t(spark, sf, "part").select("p_partkey", s["detail"].alias("detail"))


@query("a19_recall", "select round(avg(case when quality = toxic then 1.0 else 0.0 end), 6) as recall from labels")
def _(spark, sf):
    return evaluate.mean_hit(t(spark, sf, "labels").select((F.col("quality") == F.col("toxic")).alias("hit"))).select(F.round("recall", 6).alias("recall"))


@query("a23_override_accounting", """
with r as (select c_custkey % 2 as x, c_custkey % 3 as l, c_custkey % 5 as p, c_custkey % 7 = 0 as d from customer), s as (select case when x = 0 then 'A' else 'B' end as e, case l when 0 then 'A' when 1 then 'B' end as m, case when p < 3 then 'A' else 'B' end as f, d from r)
select count(*) filter (d) as disagreements, count(*) filter (m <> e) as llm_wrong, count(*) filter (m <> e and f = e) as corrected, count(*) filter (m <> e and f <> e) as still_wrong, count(*) filter (m = e and f <> e) as introduced from s""")
def _(spark, sf):
    k = F.col("c_custkey")
    rows = t(spark, sf, "customer").select(pick(k, "A", "B").alias("expected"), pick(k, "A", "B", None).alias("llm_category"), pick(k, "A", "A", "A", "B", "B").alias("predicted"), (k % 7 == 0).alias("disagreement"))
    return evaluate.override_accounting(rows)


@query("e2_override_cases", """
select c_custkey as id, case c_custkey % 4 when 0 then 'corroborates' when 1 then 'contradicts' when 2 then 'reconciled' else 'related_but_not_comparable' end as relation_type, case when c_custkey % 4 = 0 then 'deterministic_confirmed' else 'deterministic_override' end as decision_source from customer""")
def _(spark, sf):
    k = F.col("c_custkey")

    def fact(value: Column, unit: Column, period: Column) -> Column:
        return F.struct(value.alias("value_numeric"), unit.alias("unit"), period.alias("time_period"), F.lit("group").alias("scope"), F.lit("fact_validated").alias("evidence_status"))

    llm = F.struct(F.lit("corroborates").alias("relation_type"), F.lit("e").alias("explanation"), F.lit(None).cast("string").alias("reconciliation_context"), F.lit(0.5).alias("confidence"))
    cases = t(spark, sf, "customer").select(k.alias("id"), fact(F.lit(10.0), F.lit("USD"), F.lit("FY24")).alias("fact_a"), fact(F.when(k % 4 == 0, 10.0).otherwise(15.0), F.when(k % 4 == 3, "EUR").otherwise("USD"), F.when(k % 4 == 2, "FY23").otherwise("FY24")).alias("fact_b"), llm.alias("llm"))
    return evaluate.run_override_cases(cases).select("id", "adj.relation_type", "adj.decision_source")


@query("e5_evidence_scores", """
with s as (select o_orderkey % 3 > 0 as e, o_orderkey % 2 = 0 as p from orders), c as (select count(*) filter (e and p) as tp, count(*) filter (not e and p) as fp, count(*) filter (e and not p) as fn, count(*) filter (not e and not p) as tn from s)
select tp, fp, fn, tn from c""")
def _(spark, sf):
    k = F.col("o_orderkey")
    # Another number is twice the key: the check takes numbers within a millionth for the same, as from a million on a key and the next.
    facts = t(spark, sf, "orders").select(k.alias("id"), k.cast("double").alias("value_numeric"), F.lit(None).cast("string").alias("value"), F.lit("USD").alias("unit"), F.concat(F.lit("the total came to "), (k * (1 + k % 2)).cast("string")).alias("quote"), F.lit("total").alias("subject"), F.lit(None).cast("string").alias("time_period"), F.lit("fact_validated").alias("evidence_status"))
    labels = facts.select(F.col("id").alias("fact_id"), (F.col("id") % 3 > 0).alias("should_validate"))
    return evaluate.evidence_scores(facts, labels).select("tp", "fp", "fn", "tn")
