"""Consistency of the relationship graph: impossible triangles and inferable edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbers import first_of
from factloom.operators.compare import compare_pairs
from factloom.scratch import checked_broadcast, stage

EQUAL, NOT = "E", "N"
UNVERIFIED = ("ungrounded", "quote_grounded")


@dataclass
class Coherence:
    """``violations``, ``inferences`` (None if not asked for) and a one-row ``summary``."""

    violations: DataFrame
    inferences: DataFrame | None
    summary: DataFrame


def claim(relation: Column) -> Column:
    """E for edges that say equal, N for those that say not equal, null for others."""
    return F.when(relation == "corroborates", EQUAL).when(relation.isin("contradicts", "reconciled"), NOT)


def claim_edges(rels: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One edge for each unordered pair of different facts: ``(lo, hi, id, relation_type,
    kind, conf, source, refuted)``.

    The surest edge stands for its pair (no confidence counts as 0.5), then the smallest id. An edge is
    refuted if both its facts are evidenced and their values say the opposite.
    """
    e = rels.select("id", "fact_id_a", "fact_id_b", "relation_type", F.coalesce(F.col("confidence"), F.lit(0.5)).alias("conf"), F.col("decision_source") if "decision_source" in rels.columns else F.lit(None).cast("string").alias("decision_source"))
    e = e.where(F.col("fact_id_a").isNotNull() & F.col("fact_id_b").isNotNull() & (F.col("fact_id_a") != F.col("fact_id_b"))).withColumn("kind", claim(F.col("relation_type"))).where("kind is not null")
    best = e.withColumn("lo", F.least("fact_id_a", "fact_id_b")).withColumn("hi", F.greatest("fact_id_a", "fact_id_b"))
    one = best.groupBy("lo", "hi").agg(F.min(F.struct((-F.col("conf")).alias("c"), "id", "relation_type", "kind", "conf", F.col("decision_source").alias("source"))).alias("e")).select("lo", "hi", "e.id", "e.relation_type", "e.kind", "e.conf", "e.source")
    if facts is None:
        return one.withColumn("refuted", F.lit(False))
    keep = facts.select("id", "value_numeric", "unit", "evidence_status")
    x = keep.select(F.col("id").alias("lo"), F.struct("value_numeric", "unit", "evidence_status").alias("x"))
    y = keep.select(F.col("id").alias("hi"), F.struct("value_numeric", "unit", "evidence_status").alias("y"))
    weak = F.coalesce(F.col("x.evidence_status").isin(*UNVERIFIED), F.lit(False)) | F.coalesce(F.col("y.evidence_status").isin(*UNVERIFIED), F.lit(False))
    joined = one.join(x, "lo", "left").join(y, "hi", "left")
    both = compare_pairs(stage(joined, "claims"), *[{"value": F.col(f"{s}.value_numeric"), "unit": F.col(f"{s}.unit")} for s in "xy"]).withColumnRenamed("comparison", "cmp")
    refuted = F.col("x").isNotNull() & F.col("y").isNotNull() & ~weak & F.col("cmp.comparable") & ~F.col("cmp.magnitude_suspect") & ((F.col("kind") == EQUAL) != F.col("cmp.agree"))
    return both.withColumn("refuted", F.coalesce(refuted, F.lit(False))).select("lo", "hi", "id", "relation_type", "kind", "conf", "source", "refuted")


def triangles(edges: DataFrame) -> DataFrame:
    """``(a, b, c, ab, bc, ac)`` with a < b < c, each triangle once.

    Edges are directed from the end with fewer neighbours, so no node starts more than sqrt(2 x edges) of
    them and a hub's pairs of neighbours are never formed.
    """
    ends = edges.select(F.explode(F.array("lo", "hi")).alias("node"))
    degree = ends.groupBy("node").agg(F.count("*").alias("d"))
    packed = F.struct("lo", "hi", "id", "relation_type", "kind", "conf", "source", "refuted").alias("e")
    flat = edges.select("lo", "hi", packed)
    ranked = flat.join(degree.select(F.col("node").alias("lo"), F.col("d").alias("dl")), "lo").join(degree.select(F.col("node").alias("hi"), F.col("d").alias("dh")), "hi")
    up = (F.col("dl") < F.col("dh")) | ((F.col("dl") == F.col("dh")) & (F.col("lo") < F.col("hi")))
    directed = ranked.select(F.when(up, F.col("lo")).otherwise(F.col("hi")).alias("u"), F.when(up, F.col("hi")).otherwise(F.col("lo")).alias("v"), F.when(up, F.col("dh")).otherwise(F.col("dl")).alias("dv"), "e")
    first = directed.select("u", F.col("v").alias("v1"), F.col("dv").alias("d1"), F.col("e").alias("e1"))
    second = directed.select("u", F.col("v").alias("v2"), F.col("dv").alias("d2"), F.col("e").alias("e2"))
    wedge = first.join(second, "u").where((F.col("d1") < F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("v1") < F.col("v2"))))
    closed = wedge.join(directed.select(F.col("u").alias("v1"), F.col("v").alias("v2"), F.col("e").alias("e3")), ["v1", "v2"])
    sides = F.array_sort(F.array("e1", "e2", "e3"))  # by (lo, hi): ab, ac, bc
    return closed.select(sides.alias("s")).select(F.col("s")[0]["lo"].alias("a"), F.col("s")[0]["hi"].alias("b"), F.col("s")[1]["hi"].alias("c"), F.col("s")[0].alias("ab"), F.col("s")[2].alias("bc"), F.col("s")[1].alias("ac"))


def violations(found: DataFrame) -> DataFrame:
    """Triangles with two E edges and one N edge, the edge to blame and why, and whether every
    corroborating edge was decided by a check."""
    sides = F.array("ab", "bc", "ac")
    bad = F.size(F.filter(sides, lambda s: s["kind"] == EQUAL)) == 2
    key = lambda s: F.struct(s["conf"].alias("conf"), s["id"].alias("id"))
    refuted = F.filter("sides", lambda s: s["refuted"])
    least = F.array_min(F.transform("sides", key))
    least_refuted = F.array_min(F.transform(refuted, key))
    alike = F.array_max(F.transform("sides", lambda s: s["conf"])) == F.array_min(F.transform("sides", lambda s: s["conf"]))
    suspect = first_of([(F.size(refuted) > 0, least_refuted["id"]), (alike, F.array_min(F.transform("sides", lambda s: s["id"])))], least["id"])
    basis = first_of([(F.size(refuted) == 1, F.lit("refuted_by_values")), (F.size(refuted) > 1, F.lit("least_confident_refuted")), (alike, F.lit("undetermined"))], F.lit("least_confident"))
    strict = F.forall("sides", lambda s: (s["relation_type"] != "corroborates") | F.coalesce(s["source"].isin("deterministic_confirmed", "deterministic_override"), F.lit(False)))
    return (
        found.withColumn("sides", sides)
        .where(bad)
        .select("a", "b", "c", F.transform("sides", lambda s: s["id"]).alias("edge_ids"), F.transform("sides", lambda s: s["relation_type"]).alias("relations"), suspect.alias("suspect_edge_id"), basis.alias("basis"), strict.alias("is_strict_proof"))
    )


def inferences(edges: DataFrame, implicated: DataFrame | None = None) -> DataFrame:
    """``(b, c, relation_type, via, confidence, support)`` for pairs that two edges settle
    and no edge joins: E with E corroborates, E with N takes the N edge's relation. The smallest node in
    between that settles a pair counts. Pairs that rest on an ``implicated(edge_id)`` are left out.
    """
    e = F.struct("id", "relation_type", "kind", "conf")
    both = edges.select(F.col("lo").alias("x"), F.col("hi").alias("via"), e.alias("e")).unionByName(edges.select(F.col("hi").alias("x"), F.col("lo").alias("via"), e.alias("e")))
    left = both.where(F.col("e.kind") == EQUAL).select("via", F.col("x").alias("p"), F.col("e").alias("e1"))
    right = both.select("via", F.col("x").alias("q"), F.col("e").alias("e2"))
    # One side at least says equal, so wedges of two N edges are never formed; E-E pairs come once.
    wedge = left.join(right, "via").where((F.col("p") != F.col("q")) & ((F.col("e2.kind") == NOT) | (F.col("p") < F.col("q"))))
    told = wedge.select(F.least("p", "q").alias("b"), F.greatest("p", "q").alias("c"), F.struct("via", F.when(F.col("e2.kind") == EQUAL, F.lit("corroborates")).otherwise(F.col("e2.relation_type")).alias("relation_type"), F.round(F.least("e1.conf", "e2.conf"), 3).alias("confidence"), F.array_sort(F.array("e1.id", "e2.id")).alias("support")).alias("w"))
    one = told.groupBy("b", "c").agg(F.min("w").alias("w"))
    open_ = one.join(edges.select(F.col("lo").alias("b"), F.col("hi").alias("c")), ["b", "c"], "left_anti").select("b", "c", "w.relation_type", "w.via", "w.confidence", "w.support")
    if implicated is None:
        return open_
    tainted = open_.select("b", "c", F.explode("support").alias("edge_id")).join(implicated.select("edge_id").distinct(), "edge_id", "left_semi").select("b", "c").distinct()
    return open_.join(tainted, ["b", "c"], "left_anti")


def implicated_edges(bad: DataFrame) -> DataFrame:
    """``(edge_id)`` of all edges of violations."""
    return bad.select(F.explode("edge_ids").alias("edge_id")).distinct()


def check_coherence(rels: DataFrame, facts: DataFrame | None = None, infer: bool = True) -> Coherence:
    """G1: the whole check. ``rels`` has (id, fact_id_a, fact_id_b, relation_type, confidence[,
    decision_source]); without ``facts`` no edge is refuted by values."""
    edges = stage(claim_edges(rels, facts), "claim-edges")
    found = stage(triangles(edges), "triangles")
    bad = violations(found)
    hit = implicated_edges(bad)
    guessed = inferences(edges, hit) if infer else None
    counts = [
        edges.agg(F.count("*").alias("edges")),
        edges.select(F.explode(F.array("lo", "hi")).alias("n")).agg(F.countDistinct("n").alias("nodes")),
        found.agg(F.count("*").alias("triangles_checked")),
        bad.agg(F.count("*").alias("violations")),
        hit.agg(F.count("*").alias("implicated_edges")),
        *([guessed.agg(F.count("*").alias("inferences"))] if guessed is not None else []),
    ]
    summary = counts[0]
    for c in counts[1:]:
        summary = summary.crossJoin(c)  # one row each
    rate = F.when(F.col("triangles_checked") > 0, F.col("violations") / F.col("triangles_checked")).otherwise(0.0)
    return Coherence(bad, guessed, summary.withColumn("violation_rate", rate))


def touching(result: DataFrame, facts: DataFrame, document_id: int, nodes: tuple[str, ...] = ("a", "b", "c")) -> DataFrame:
    """Rows of a corpus-wide result with a node in the document."""
    own = facts.where(F.col("document_id") == document_id).select(F.col("id").alias("_n"))
    at = result.withColumn("_k", F.struct(*nodes)).select("_k", F.explode(F.array(*nodes)).alias("_n")).join(own, "_n", "left_semi").select("_k").distinct()
    return result.withColumn("_k", F.struct(*nodes)).join(at, "_k", "left_semi").drop("_k")


def enrich(result: DataFrame, facts: DataFrame, documents: DataFrame, nodes: tuple[str, ...] = ("a", "b", "c")) -> DataFrame:
    """Each node as a struct of (id, statement, value, unit, document_name, page_number); only the id if
    the fact is missing."""
    named = facts.join(checked_broadcast(documents.select(F.col("id").alias("document_id"), "original_name")), "document_id", "left")
    for n in nodes:
        told = named.select(F.col("id").alias("_id"), F.struct("statement", "value", "unit", F.col("original_name").alias("document_name"), "page_number").alias("_f"))
        result = result.join(told, result[n] == told["_id"], "left").withColumn(n, F.struct(F.col(n).alias("id"), F.col("_f.statement").alias("statement"), F.col("_f.value").alias("value"), F.col("_f.unit").alias("unit"), F.col("_f.document_name").alias("document_name"), F.col("_f.page_number").alias("page_number"))).drop("_id", "_f")
    return result


def best_edge_window() -> Window:
    """W4 as a window, for callers that keep whole rows."""
    return Window.partitionBy("lo", "hi").orderBy(F.desc(F.coalesce("confidence", F.lit(0.5))), "id")
