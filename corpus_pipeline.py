"""A training corpus from raw documents: five stages, each of one operator, over all that the stage before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import decontaminate, langid, packing, secrets, simhash
from factloom.llm.common import fold, fresh, table
from factloom.scratch import checked_broadcast, folder, remove, scope, stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected rows, whose language is undetermined (null texts and texts without a letter), go. A
    missing language is filled with the predicted one."""
    names, prototypes = langid.fit(docs.where(fold() != 1).select("text", "lang"))
    out = fresh("_language", docs.columns), fresh("_cosine", docs.columns)
    found = langid.predict(docs, names, prototypes, out=out).where(F.col(out[0]) != langid.UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", out[0])).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that with the smallest id, of several texts of that id
    the one with the smallest hash, and of several rows of that text the first by the other columns. Texts
    that are no near-duplicates stay even if they share an id. Rows without id come behind all ids."""
    key = [fresh(c, docs.columns) for c in ("_none", "_id", "_digest")]
    row = fresh("_row", docs.columns)
    marked = docs.withColumns(dict(zip(key, (F.col("doc_id").cast("long").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))))))
    groups = stage(simhash.grouped(marked.select(F.struct(*key).alias("key"), "text")).select("key", (F.col("key") != F.col("least")).alias("copy")), "groups")
    copies = stage(groups.where("copy").select("key.*").distinct(), "copies")
    kept = marked.join(checked_broadcast(copies), key, "left_anti")
    # Texts that come more than once and stay are few; only their rows are sorted.
    again = stage(groups.where("not copy").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key.*"), "again")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if again.isEmpty():
        return kept.select(*columns)
    side = checked_broadcast(again)
    order = Window.partitionBy(*key).orderBy("text", *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    first = kept.join(side, key, "left_semi").withColumn(row, F.row_number().over(order)).where(F.col(row) == 1)
    return kept.join(side, key, "left_anti").select(*columns).unionByName(first.select(*columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the values of secrets, but for widely copied examples, are replaced."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The workers still hold what earlier stages loaded, so they keep fewer words here.
    return packing.pack(docs, kept=200_000)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("without_secrets", without_secrets),
    ("packed", packed),
]

#: Hashes, trained profiles and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again, as its successor's input. What a
    stage has staged on the way goes when its result is written, and the result itself when the next one is."""
    base = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage_of) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        with scope(spark):
            stage_of(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
