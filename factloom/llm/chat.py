"""Chat formatting of reply trees.

Messages point to the message they answer. Root-to-leaf paths are enumerated by iterative self-joins that
double their reach: first each message's ancestor 1, 2, 4, ... steps up, then, from the leaves, all steps
in between. A tree of depth d takes about 2 log2(d) joins, and no more rows than its paths have messages.
Branches are ranked by score, and each chosen path becomes one conversation.

Template: ``<<SYS>>text<</SYS>>``, ``[INST]text[/INST]`` and ``<s>text</s>`` for the system, the user and
the assistant, and ``[ROLE]role[/ROLE]text</s>`` for any other role. A control string inside a text or a
role gets a backslash behind its first character, and one that has such backslashes gets one more, so
texts never hold control strings and are restored exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import small_batches, table
from factloom.scratch import stage

_REST = r"/?s>|/?INST\]|/?ROLE\]|</?SYS>>"
_ADD = re.compile(rf"([<\[])(\\*)(?={_REST})")
_CUT = re.compile(rf"([<\[])(\\*)\\(?={_REST})")
_MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_TURN = re.compile(r"(?:<<SYS>>(.*?)<</SYS>>|\[INST\](.*?)\[/INST\]|<s>(.*?)</s>|\[ROLE\](.*?)\[/ROLE\](.*?)</s>)", re.S)
EXTRA = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))


def escape(text: str) -> str:
    return _ADD.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _CUT.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask: the spans of the assistant's (escaped) texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, tail = _MARKS.get(role) or (f"[ROLE]{escape(role)}[/ROLE]", "</s>")
        body = escape(text)
        out += [head, body, tail]
        at += len(head)
        if role == "assistant":
            spans.append((at, at + len(body)))
        at += len(body) + len(tail)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; the inverse of ``render``."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        for role, body in zip(("system", "user", "assistant"), m.groups()):
            if body is not None:
                turns.append((role, unescape(body)))
        if m[4] is not None:
            turns.append((unescape(m[4]), unescape(m[5])))
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


_NO_NODE = -(2**63)


def _keyed(messages: DataFrame) -> DataFrame:
    """``messages`` with keys that are never null, for joins: ``none`` marks those of the null tree, and a null node has a
    number of its own. Of rows that share tree and node one stays, the first by their other columns."""
    own = [c for c in ("parent", "role", "text", "score") if c in messages.columns]
    named = messages.select(F.col("tree").isNull().alias("none"), F.coalesce("tree", F.lit(0).cast(messages.schema["tree"].dataType)).alias("tree"), F.coalesce(F.col("node").cast("long"), F.lit(_NO_NODE)).alias("node"), F.struct(*own).alias("m"))
    return named.groupBy("none", "tree", "node").agg(F.min("m").alias("m")).select("none", "tree", "node", "m.*")


def _tree() -> Column:
    return F.when(~F.col("none"), F.col("tree")).alias("tree")


def _node(name: str) -> Column:
    return F.when(F.col(name) != _NO_NODE, F.col(name)).alias(name)


def paths(messages: DataFrame) -> DataFrame:
    """``(tree, leaf, node, up)`` for every message on every root-to-leaf path of ``messages(tree, node,
    parent)``; ``up`` counts the steps from the leaf.

    A message whose parent is null or missing is a root. Messages that are their own ancestors, and those
    below them, have no root: they raise an error. Rows that share tree and node are one message, the first of them by
    parent, role, text and score; messages whose tree is null are one tree, and one without a node is never answered.
    """
    return _paths(_keyed(messages)).select(_tree(), _node("leaf"), _node("node"), "up")


def _paths(messages: DataFrame) -> DataFrame:
    """``paths`` of keyed messages, with ``none``."""
    nodes = stage(messages.select("none", "tree", "node", "parent"), "nodes")
    total = nodes.count()
    up = nodes.where("parent is not null").select("none", "tree", "node", F.col("parent").cast("long").alias("top"))
    nodes = nodes.drop("parent")
    jump = stage(up.join(nodes.withColumnRenamed("node", "top"), ["none", "tree", "top"], "left_semi").select("none", "tree", "node", "top"), "jump")
    leaves = nodes.join(jump.select("none", "tree", F.col("top").alias("node")).distinct(), ["none", "tree", "node"], "left_anti")
    jumps = []
    while not jump.isEmpty():
        if 2 ** len(jumps) > total:
            raise ValueError("messages answer each other in a circle")
        jumps.append(jump)
        over = jump.select("none", "tree", F.col("node").alias("top"), F.col("top").alias("next"))
        jump = stage(jump.join(over, ["none", "tree", "top"]).select("none", "tree", "node", F.col("next").alias("top")), "jump")
    found = leaves.select("none", "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for i in reversed(range(len(jumps))):
        more = found.join(jumps[i], ["none", "tree", "node"]).select("none", "tree", "leaf", F.col("top").alias("node"), (F.col("up") + 2**i).alias("up"))
        found = stage(found.unionByName(more), "paths")
    return found


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = [], []
        for turns in batch.column(3).to_pylist():
            text, own = render([(t["role"], t["text"]) for t in turns])
            texts.append(text)
            spans.append([{"start": a, "stop": b} for a, b in own])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["tree", "leaf", "rank", "formatted", "loss_spans"])


def conversations(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """``(tree, leaf, rank, formatted, loss_spans)`` of the best ``branches`` paths of each tree (None:
    all) of ``messages(tree, node, parent, role, text, score)``.

    A path's score is the mean of its messages' scores, nulls counting as 0; ties go to the smaller leaf.
    Null roles and texts are empty, and keys are read as ``paths`` reads them, so repeated rows count once. Other columns
    are ignored; an empty table gives an empty result. A path is gathered in one row, as its conversation is one text.
    """
    small_batches(messages.sparkSession, 500)
    keyed = stage(_keyed(messages), "messages")
    full = _paths(keyed).join(keyed.select("none", "tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")), ["none", "tree", "node"])
    each = full.groupBy("none", "tree", "leaf").agg(F.avg("score").alias("score"), F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text")).alias("turns"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("none", "tree").orderBy(F.desc("score"), "leaf")))
    kept = ranked if branches is None else ranked.where(F.col("rank") <= branches)
    return kept.select(_tree(), _node("leaf"), "rank", F.array_sort("turns").alias("turns")).mapInArrow(_render, "tree long, leaf long, rank int, formatted string, loss_spans array<struct<start:long,stop:long>>")


def from_turns(rows: DataFrame) -> DataFrame:
    """Messages of ``rows(conv_id, turn, role, text)``: each answers the one before it. Rows that share a
    turn stand in the order of role and text; repeated rows stay."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    named = rows.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    node = F.row_number().over(order).cast("long")
    return named.withColumn("node", node).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sha(x: str) -> str:
        return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

    for batch in batches:
        rows = []
        for tree, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            turns, loss = parse(text), "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
            rows.append((tree, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    messages = stage(from_turns(rows.unionByName(extra)), "messages")
    return conversations(messages).select("tree", "formatted", "loss_spans").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP10_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (select conv_id, turn, role, text from conversations
    union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))),
e as (select *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|</?SYS>>)', '\1\2\\\3', 'g'))
    + case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7
      else 17 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|</?SYS>>)', '\1\2\\\3', 'g')) end as n from t),
g as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '') as loss, cast(sum(n) as bigint) as formatted_chars from e group by conv_id)
select conv_id, n_turns, turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g
"""
