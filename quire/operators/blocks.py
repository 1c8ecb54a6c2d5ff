"""Rows, columns and blocks of a page, and page headers and footers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rows(boxes: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """boxes with `row`: from the top down, a row ends where the centre falls by more than `tolerance` heights."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("cy"), "left", "ix")
    b = boxes.withColumn("cy", (F.col("top") + F.col("bottom")) / 2).withColumn("_h", F.col("top") - F.col("bottom"))
    new = F.when(F.lag("cy").over(w) - F.col("cy") <= tolerance * F.greatest(F.lag("_h").over(w), F.col("_h")), 0).otherwise(1)
    return b.withColumn("_new", new).withColumn("row", F.sum("_new").over(w)).drop("_new", "_h", "cy")


def merged_rows(rowed: DataFrame, gap: float = 2.0) -> DataFrame:
    """A row for each stretch of a page's row whose boxes are less than `gap` mean character widths apart: box, n, text in order of x."""
    w = Window.partitionBy("doc_id", "page", "row").orderBy("left", "ix")
    width = (F.col("right") - F.col("left")) / F.greatest(F.length("text"), F.lit(1))
    reach = F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = rowed.withColumn("_new", F.when(F.col("left") - reach < gap * width, 0).otherwise(1)).withColumn("part", F.sum("_new").over(w))
    return out.groupBy("doc_id", "page", "row", "part").agg(F.min("left").alias("left"), F.max("right").alias("right"), F.max("top").alias("top"), F.min("bottom").alias("bottom"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "ix", "text"))), lambda x: x["text"]), " ").alias("text"))


def columns(boxes: DataFrame, gap: float = 15.0) -> DataFrame:
    """doc_id, page, ix, column: a page is cut at its widest empty band, across x or y, again and again.

    A cut depends on the ones before, so a page is one group of a grouped function; columns count in reading order.
    """

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf.ix.tolist()
        box = list(zip(pdf.left, pdf.right, pdf.bottom, pdf.top))
        found: list[list[int]] = []
        todo = [(list(range(len(ids))), 0)]
        deepest = int(2 * math.log2(len(ids))) + 1
        while todo:
            part, depth = todo.pop()
            best = None
            for axis in (0, 2) if depth < deepest else ():
                order = sorted(part, key=lambda i: box[i][axis])
                reach = box[order[0]][axis + 1]
                for k, i in enumerate(order[1:], 1):
                    wide = box[i][axis] - reach
                    if wide >= gap * (1 if axis == 0 else 2) and (best is None or wide > best[0]):
                        best = (wide, axis, order[:k], order[k:])
                    reach = max(reach, box[i][axis + 1])
            if best is None:
                found.append(part)
            else:
                _, axis, low, high = best
                first, second = (low, high) if axis == 0 else (high, low)
                todo += [(second, depth + 1), (first, depth + 1)]
        column = {i: c for c, part in enumerate(found) for i in part}
        return pd.DataFrame({"doc_id": pdf.doc_id, "page": pdf.page, "ix": pdf.ix, "column": [column[i] for i in range(len(ids))]})

    return boxes.select("doc_id", "page", "ix", "left", "right", "bottom", "top").groupBy("doc_id", "page").applyInPandas(cut, "doc_id long, page int, ix long, column int")


def blocks(boxes: DataFrame, leading: float = 1.5, size: float = 0.5) -> DataFrame:
    """boxes (with `column`) with `block`: down a column, a block ends where the space above is over `leading` heights, the size changes by over `size`, or bold begins or ends."""
    w = Window.partitionBy("doc_id", "page", "column").orderBy(F.desc("top"), "left", "ix")
    last = lambda c: F.lag(c).over(w)
    same = (last("bottom") - F.col("top") <= leading * (F.col("top") - F.col("bottom"))) & (F.abs(last("size") - F.col("size")) <= size) & (last("bold") == F.col("bold"))
    return boxes.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("block", F.sum("_new").over(w)).drop("_new")


def block_stats(blocked: DataFrame) -> DataFrame:
    """A row for each block: box, boxes, characters, mean size, bold share, capitals-heavy, alignment and heading score (size, +2 capitals, +1 bold)."""
    n = F.length("text")
    out = blocked.groupBy("doc_id", "page", "column", "block").agg(F.min("left").alias("left"), F.max("right").alias("right"), F.max("top").alias("top"), F.min("bottom").alias("bottom"), F.count(F.lit(1)).alias("n_boxes"), F.sum(n).alias("n_chars"), (F.sum(F.col("size") * n) / F.sum(n)).alias("size"), (F.sum(F.when(F.col("bold"), n).otherwise(0)) / F.sum(n)).alias("bold_share"), F.sum(F.regexp_count("text", F.lit(r"\p{Lu}"))).alias("upper"), F.sum(F.regexp_count("text", F.lit(r"\p{Ll}"))).alias("lower"), (F.max("left") - F.min("left")).alias("_l"), (F.max("right") - F.min("right")).alias("_r"))
    slack = F.greatest(F.lit(1.0), (F.col("right") - F.col("left")) / 20)
    align = F.when((F.col("_l") <= slack) & (F.col("_r") <= slack), 1).when(F.col("_l") <= slack, 2).when(F.col("_r") <= slack, 4).otherwise(5)
    caps = F.col("upper") > 2 * F.col("lower")
    return out.withColumn("caps", caps).withColumn("alignment", align).withColumn("heading_score", F.col("size") + F.when(caps, 2).otherwise(0) + F.when(F.col("bold_share") > 0.5, 1).otherwise(0)).drop("_l", "_r", "upper", "lower")


def heads_and_feet(lines: DataFrame, edge: int = 2, apart: int = 3, share: float = 0.25) -> DataFrame:
    """doc_id, page, ln, kind (1 head, 2 foot): lines at a page's edge whose text, digits as #, stands at that edge of enough pages.

    Enough: max(3, a quarter of the pages), or two pages at most `apart` with the text itself the same. Aggregates by key, no self-join.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("ln")
    down = Window.partitionBy("doc_id", "page").orderBy(F.desc("ln"))
    near = lines.where("length(text) > 0").withColumn("_u", F.row_number().over(w)).withColumn("_d", F.row_number().over(down)).where((F.col("_u") <= edge) | (F.col("_d") <= edge))
    near = near.withColumn("kind", F.when(F.col("_u") <= edge, 1).otherwise(2)).withColumn("key", F.regexp_replace("text", "[0-9]+", "#"))
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    often = near.groupBy("doc_id", "kind", "key").agg(F.count_distinct("page").alias("on")).join(pages, "doc_id").where(F.col("on") >= F.greatest(F.lit(3), F.ceil(F.col("pages") * share))).select("doc_id", "kind", "key", F.lit(True).alias("often"))
    by_text = Window.partitionBy("doc_id", "kind", "text").orderBy("page", "ln")
    close = (F.col("page") - F.lag("page").over(by_text)).between(1, apart) | (F.lead("page").over(by_text) - F.col("page")).between(1, apart)
    out = near.withColumn("close", F.coalesce(close, F.lit(False))).join(often, ["doc_id", "kind", "key"], "left")
    return out.where("often or close").select("doc_id", "page", "ln", "kind")
