"""Lines and columns of a page, from positioned spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def initial_lines(spans: DataFrame) -> DataFrame:
    """spans with the column `line`: spans in producer order continue a line if skew agrees, they overlap in y and the gap in x is small."""
    w = Window.partitionBy("doc_id", "page").orderBy("ix")
    last = lambda c: F.lag(c).over(w)
    width = (F.col("right") - F.col("left")) / F.greatest(F.length("text"), F.lit(1))
    gap = F.abs(F.col("left") - last("right"))
    goes_on = (last("skew") == F.col("skew")) & (F.least(last("top"), F.col("top")) > F.greatest(last("bottom"), F.col("bottom"))) & (gap <= F.least(F.lit(5.0), F.greatest(F.lit(0.1), width)))
    return spans.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("line", F.sum("_new").over(w)).drop("_new")


def line_boxes(lined: DataFrame) -> DataFrame:
    """A row for each line: box, text, size weighted by characters, share of bold characters."""
    n = F.length("text")
    out = lined.groupBy("doc_id", "page", "line").agg(F.min("left").alias("left"), F.max("right").alias("right"), F.max("top").alias("top"), F.min("bottom").alias("bottom"), F.array_sort(F.collect_list(F.struct("ix", "text"))).alias("_t"), (F.sum(F.col("size") * n) / F.sum(n)).alias("size"), (F.sum(F.when(F.col("bold"), n).otherwise(0)) / F.sum(n)).alias("bold_share"))
    return out.withColumn("text", F.array_join(F.transform("_t", lambda x: x["text"]), " ")).drop("_t")


def gutters(boxes: DataFrame, least: float) -> DataFrame:
    """doc_id, page, left, right: stretches of x, at least so wide, that no box of the page covers, between boxes."""
    w = Window.partitionBy("doc_id", "page").orderBy("left", "right")
    reach = F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return boxes.select("doc_id", "page", reach.alias("from"), F.col("left").alias("to")).where(F.col("to") - F.col("from") >= least).select("doc_id", "page", F.col("from").alias("left"), F.col("to").alias("right"))


def most_open(boxes: DataFrame) -> DataFrame:
    """doc_id, page, most: the largest number of boxes over one x, by a sweep over their edges (starts before ends)."""
    edges = boxes.select("doc_id", "page", F.explode(F.array(F.struct(F.col("left").alias("x"), F.lit(1).alias("d")), F.struct(F.col("right").alias("x"), F.lit(-1).alias("d")))).alias("e")).groupBy("doc_id", "page", "e.x").agg(F.sum(F.when(F.col("e.d") > 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("e.d") < 0, 1).otherwise(0)).alias("b"))
    w = Window.partitionBy("doc_id", "page").orderBy("x")
    return edges.withColumn("n", F.sum(F.col("a") - F.col("b")).over(w) + F.col("b")).groupBy("doc_id", "page").agg(F.max("n").alias("most"))


def line_number_runs(numbers: DataFrame, least: int = 5) -> DataFrame:
    """doc_id, first, last, n: runs of lines whose numbers grow by one (numbers: doc_id, ln, number), at least so long."""
    w = Window.partitionBy("doc_id").orderBy("ln")
    runs = numbers.withColumn("_i", F.col("number") - F.row_number().over(w)).withColumn("_new", F.when(F.lag("_i").over(w) == F.col("_i"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("doc_id", "_run").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("_run")


def nearest_neighbours(boxes: DataFrame) -> DataFrame:
    """boxes with the text above and below on the page, by top edge; ties by left edge and id."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("top"), "left", "ix")
    return boxes.select("doc_id", "page", "ix", F.lag("ix").over(w).alias("above"), F.lead("ix").over(w).alias("below"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks with `reading`: from 0 by column, top (down), bottom (down), left, right."""
    w = Window.partitionBy("doc_id", "page").orderBy("column", F.desc("top"), F.desc("bottom"), "left", "right", "ix")
    return blocks.withColumn("reading", F.row_number().over(w) - 1)


def overlap_gaps(lines: DataFrame, buckets: int = 20, width: float = 700.0) -> DataFrame:
    """doc_id, page, gap: the smallest vertical distance between lines that follow one another over one of the page's x buckets."""
    cell = lambda c: F.least(F.lit(buckets - 1), F.floor(F.col(c) * buckets / width)).cast("int")
    over = lines.withColumn("b", F.explode(F.sequence(cell("left"), cell("right"))))
    w = Window.partitionBy("doc_id", "page", "b").orderBy(F.desc("top"), "ix")
    return over.withColumn("gap", F.lag("bottom").over(w) - F.col("top")).where("gap > 0").groupBy("doc_id", "page").agg(F.min("gap").alias("gap"))
