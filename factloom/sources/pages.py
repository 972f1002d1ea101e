"""Page sources and chunking."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.numbers import strip
from factloom.session import reach

# Fixed values.
MAX_CHUNK, OVERLAP, CONTEXT, LEAST_CONTEXT, LEAST_PAGE, LAST_PAGE = 1200, 150, 260, 40, 40, 10_000


FILES = "path string, content_hash string, page_number int, text string, problem string"


def read_files(spark: SparkSession, path: str, parse: Callable[[bytes], list[tuple[int, str]]]) -> DataFrame:
    """``(path, content_hash, page_number, text, problem)`` of binary files. ``parse`` turns a file's bytes
    into (page number, text) rows, the text None for a page that it cannot read. A file that it fails on, or that is an
    encrypted PDF, gives one row without a page, whose ``problem`` says why; so no file vanishes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, digest, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if is_encrypted(content):
                    rows.append((name, digest, None, None, "the file is encrypted"))
                    continue
                try:
                    rows += [(name, digest, n, text, None if text is not None else "the page cannot be read") for n, text in parse(content)]
                except Exception as e:  # noqa: BLE001 - a broken file must not end the scan
                    rows.append((name, digest, None, None, f"{type(e).__name__}: {e}"[:500]))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], [f.split(" ")[0] for f in FILES.split(", ")])

    reach(spark)
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("content_hash"), "content")
    return files.mapInArrow(run, FILES)


def is_encrypted(content: bytes) -> bool:
    """Whether a PDF's trailer names an encryption dictionary."""
    return content[:5] == b"%PDF-" and re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content) is not None


def file_issues(files: DataFrame) -> DataFrame:
    """An issue for each file or page that ``read_files`` could not read."""
    return files.where("problem is not null").select("path", "page_number", F.lit("unreadable_source").alias("issue_type"), F.col("problem").alias("detail"))


def pages_from_html(rows: DataFrame, html: str = "html") -> DataFrame:
    """S1 for web pages: ``rows`` with ``text`` instead of ``html``: scripts, styles and tags away, block ends as line ends."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    lines = F.regexp_replace(F.regexp_replace(bare, r"(?i)<(br|/p|/div|/tr|/li|/h[1-6])\b[^>]*>", "\n"), r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        lines = F.replace(lines, F.lit(name), F.lit(sign))
    return rows.withColumn("text", strip(F.regexp_replace(F.regexp_replace(lines, r"[ \t\r\f]+", " "), r" ?\n\s*", "\n"))).drop(html)


def clean_pages(pages: DataFrame, least: int = LEAST_PAGE) -> DataFrame:
    """Pages with at least ``least`` characters of text."""
    return pages.where(F.length(strip(F.coalesce("text", F.lit("")))) >= least)


def page_counts(pages: DataFrame, document: str = "document_id") -> DataFrame:
    """``(document, num_pages, has_text)``."""
    return pages.groupBy(document).agg(F.max("page_number").alias("num_pages"), (F.count_if(F.length(strip(F.coalesce("text", F.lit("")))) >= LEAST_PAGE) > 0).alias("has_text"))


def parse_page_spec(spec: str) -> list[tuple[int, int]]:
    """Closed ranges of a selector such as ``1,3,7-10``, sorted and joined; ValueError if it is malformed,
    runs backwards, leaves 1 to 10000 or selects nothing."""
    found = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not m:
            raise ValueError(f"not a page or a range of pages: {part!r}")
        first, last = int(m[1]), int(m[2] or m[1])
        if last < first:
            raise ValueError(f"the range runs backwards: {part!r}")
        if first < 1 or last > LAST_PAGE:
            raise ValueError(f"pages go from 1 to {LAST_PAGE}: {part!r}")
        found.append((first, last))
    if not found:
        raise ValueError("no page is selected")
    joined: list[tuple[int, int]] = []
    for first, last in sorted(found):
        if joined and first <= joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], max(last, joined[-1][1]))
        else:
            joined.append((first, last))
    return joined


def select_pages(pages: DataFrame, spec: str | None = None, max_pages: int | None = None) -> DataFrame:
    """Selected pages; ``max_pages`` counts only without a selector. The predicate is on
    ``page_number`` alone, so it reaches the scan."""
    if spec is not None:
        kept = F.lit(False)
        for first, last in parse_page_spec(spec):
            kept = kept | F.col("page_number").between(first, last)
        return pages.where(kept)
    if max_pages is not None:
        if max_pages < 1:
            raise ValueError("max_pages must be at least 1")
        return pages.where(F.col("page_number") <= max_pages)
    return pages


def page_context(text: Column | str) -> Column:
    """The page's head, of at most 260 characters; of a longer page up to its last line end, if that is not
    near the start."""
    t = F.col(text) if isinstance(text, str) else text
    head = F.substring(t, 1, CONTEXT)
    cut = F.length(F.regexp_extract(head, r"(?s)^(.*)\n", 1))
    return strip(F.when((F.length(t) > CONTEXT) & head.contains("\n") & (cut > LEAST_CONTEXT), F.substring(head, F.lit(1), cut)).otherwise(head))


def chunks(pages: DataFrame, size: int = MAX_CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Pages cut into windows: the columns of ``pages`` but ``text``, with ``chunk`` (from 0), ``start``, ``text``
    and ``page_context``, which is empty in a page's first chunk. Null text is empty: one empty chunk."""
    kept = [c for c in pages.columns if c != "text"]
    t = F.coalesce("text", F.lit(""))
    step = size - overlap
    n = F.when(F.length(t) <= size, 1).otherwise(1 + F.ceil((F.length(t) - size) / step).cast("int"))
    each = pages.select(*kept, t.alias("_t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).withColumn("start", F.col("chunk") * step)
    return each.select(*kept, "chunk", "start", F.substring(F.col("_t"), F.col("start") + 1, F.lit(size)).alias("text"), F.when(F.col("chunk") > 0, page_context("_t")).otherwise("").alias("page_context"))
