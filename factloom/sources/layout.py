"""Rows and cells from word boxes.

``words`` has (document_id, page_number, x0, y0, x1, y1, word); ``pages`` has (document_id, page_number, width,
text). Everything is grouped by page, which bounds every window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbers import strip

# Fixed values.
BAND, LEAST_WORDS, LEAST_SPAN, LEAST_GUTTER = 6.0, 30, 10, 3
ROW_HEIGHT, LEAST_GAP, GAP_RATIO, CHAR_WIDTH = 3.0, 8.0, 1.8, 5.0
LEAST_ROWS, LEAST_SHARE, LEAST_KEPT = 4, 0.22, 0.6
RECONSTRUCTED, PLAIN, REJECTED = "reconstructed", "plain_not_tabular", "plain_reconstruction_rejected"
PAGE = ["document_id", "page_number"]


def upper_median(values: Column, default: float) -> Column:
    """The middle of the sorted values, the upper one of two."""
    s = F.sort_array(values)
    return F.coalesce(F.get(s, F.floor(F.size(s) / 2).cast("int")), F.lit(default))


def gutters(words: DataFrame, pages: DataFrame) -> DataFrame:
    """``(document_id, page_number, gutters)``, an array of x positions for each page that has any.

    Bands of six points that no word touches, three or more in a row, inside the printed span and away from
    its ends.
    """
    bands = F.greatest(F.lit(1), F.floor(F.col("width") / BAND).cast("int"))
    full = words.where(strip("word") != "").join(pages.select(*PAGE, bands.alias("n")), PAGE)
    low, high = F.floor(F.col("x0") / BAND).cast("int"), F.least(F.floor(F.col("x1") / BAND).cast("int"), F.col("n") - 1)
    taken = full.where(low <= high).select(*PAGE, F.explode(F.sequence(low, high)).alias("band")).distinct()
    counted = full.groupBy(*PAGE).agg(F.count("*").alias("words"))
    per = taken.groupBy(*PAGE).agg(F.sort_array(F.collect_list("band")).alias("bands")).join(counted, PAGE)
    first, last = F.get("bands", F.lit(0)), F.get("bands", F.size("bands") - 1)
    # A run of empty bands lies between two neighbouring taken bands; it starts inside the margins.
    ends = F.zip_with(F.slice("bands", 1, F.size("bands") - 1), F.slice("bands", 2, F.size("bands") - 1), lambda a, b: F.struct(F.greatest(a + 1, first + 4).alias("a"), b.alias("b")))
    runs = F.filter(ends, lambda r: (r["b"] - r["a"] >= LEAST_GUTTER) & (r["b"] < last - 3))
    found = per.where((F.col("words") >= LEAST_WORDS) & (last - first >= LEAST_SPAN)).select(*PAGE, F.transform(runs, lambda r: (r["a"] + r["b"]) / 2 * BAND).alias("gutters"))
    return found.where(F.size("gutters") > 0)


def rows(words: DataFrame, pages: DataFrame) -> DataFrame:
    """``(document_id, page_number, zone, row, y, cells)``: zones from left to right, rows from top to
    bottom."""
    zoned = words.where(strip("word") != "").join(gutters(words, pages), PAGE, "left")
    middle = (F.col("x0") + F.col("x1")) / 2
    zone = F.size(F.filter(F.coalesce("gutters", F.array().cast("array<double>")), lambda g: g <= middle))
    y = (F.col("y0") + F.col("y1")) / 2
    placed = zoned.select(*PAGE, zone.alias("zone"), F.bround(y / ROW_HEIGHT).cast("int").alias("row"), y.alias("y"), "x0", "x1", "word")
    line = Window.partitionBy(*PAGE, "zone", "row")
    order = line.orderBy("x0", "x1", "word")
    width = F.when((F.length("word") > 0) & (F.col("x1") > F.col("x0")), (F.col("x1") - F.col("x0")) / F.length("word"))
    threshold = F.greatest(F.lit(LEAST_GAP), upper_median(F.collect_list(width).over(line), CHAR_WIDTH) * GAP_RATIO)
    gap = F.col("x0") - F.lag("x1").over(order)
    split = placed.withColumn("_break", F.when(F.coalesce(gap > threshold, F.lit(False)), 1).otherwise(0)).withColumn("_n", F.row_number().over(order)).withColumn("cell", F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cells = split.groupBy(*PAGE, "zone", "row", "cell").agg(strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "word"))), lambda w: w["word"]), " ")).alias("text"), F.sum("y").alias("y"), F.count("*").alias("n"))
    joined = cells.groupBy(*PAGE, "zone", "row").agg((F.sum("y") / F.sum("n")).alias("y"), F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("cell", "text")))), lambda c: c["text"]).alias("cells"))
    return joined.where(F.size("cells") > 0)


def page_texts(words: DataFrame, pages: DataFrame) -> DataFrame:
    """``(document_id, page_number, text, table_context)`` of every page: its rows with cells divided by
    bars where it looks like a table and loses little, else its plain text."""
    r = rows(words, pages)
    solid = F.exists("cells", lambda c: F.length(c) > 1)
    whole = r.groupBy(*PAGE).agg(F.count_if(solid).alias("solid"), F.count_if(solid & (F.size("cells") >= 3)).alias("wide"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("zone", "row", F.array_join("cells", " | ").alias("line")))), lambda x: x["line"]), "\n").alias("rendered"))
    plain = strip(F.coalesce("text", F.lit("")))
    both = pages.select(*PAGE, plain.alias("plain")).join(whole, PAGE, "left")
    tabular = F.coalesce((F.col("solid") >= LEAST_ROWS) & (F.col("wide") >= LEAST_SHARE * F.col("solid")), F.lit(False))
    context = F.when(~tabular, PLAIN).when(F.length(strip("rendered")) < F.length("plain") * LEAST_KEPT, REJECTED).otherwise(RECONSTRUCTED)
    return both.withColumn("table_context", context).select(*PAGE, F.when(F.col("table_context") == RECONSTRUCTED, strip("rendered")).otherwise(F.col("plain")).alias("text"), "table_context")
