"""Outlines and bookmarks: validation, tiers, trees by level, page placement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


#: Words that number a content unit, so one counter after them is no sign of a generated list.
CONTENT_UNITS = ("chapter", "chap", "ch", "part", "pt", "section", "sec", "book", "appendix", "unit", "lesson", "章", "部", "节", "篇", "卷", "第章", "第部", "第节", "第篇", "第卷")


def valid_bookmarks(entries: DataFrame, pages: DataFrame, deepest: int = 15) -> DataFrame:
    """Entries in range whose page is not below the last kept one, with their level as the depth in the tree that the levels make.

    What is kept equals the running maximum of the pages in range. An entry of level k is open at a later one if no entry since has
    level k or less, that is, if its position is beyond the last positions of all smaller levels; the depth is one more than the
    levels open below the entry's own. Levels are 1 to `deepest`. pages: doc_id, n_pages.
    """
    inside = entries.join(pages, "doc_id").where("page between 1 and n_pages")
    w = Window.partitionBy("doc_id").orderBy("ord")
    kept = inside.withColumn("_max", F.max("page").over(w)).where("page = _max").drop("_max")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = [F.coalesce(F.max(F.when(F.col("level") == k, F.col("ord"))).over(before), F.lit(-1)) for k in range(1, deepest)]
    kept = kept.withColumn("_last", F.array(*last))
    opened = [F.when((F.col("level") > k + 1) & (F.col("_last")[k] > F.greatest(F.lit(-1), *[F.col("_last")[j] for j in range(k)], F.lit(-1))), 1).otherwise(0) for k in range(deepest - 1)]
    return kept.withColumn("level", (F.lit(1) + sum(opened)).cast("int")).drop("_last")


def bookmark_tiers(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, n, counting, tier of valid entries: ignore, full or skeleton.

    ignore: fewer than three; half of the titles generic; half of one template with a counter (the most frequent, the first of equally
    frequent ones), unless it is a content unit with a single counter; or four entries to a distinct title. full: two levels, and six
    entries or one to 20 pages. counting: entries of that template, 0 if it has no counter.
    """
    e = entries.withColumn("generic", T.is_generic_title(F.col("title"))).withColumn("template", T.title_template(F.col("title")))
    by = e.groupBy("doc_id", "template").agg(F.count(F.lit(1)).alias("c"), F.min("ord").alias("o"))
    top = by.groupBy("doc_id").agg(F.max_by(F.struct("template", "c"), F.struct("c", -F.col("o"))).alias("top"))
    sums = e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("generic").cast("int")).alias("generic"), F.count_distinct(T.title_key(F.col("title"))).alias("titles"), F.max("level").alias("depth"))
    out = sums.join(top, "doc_id").join(pages, "doc_id")
    marks, unit = F.regexp_count("top.template", F.lit("#")), F.replace(F.col("top.template"), F.lit("#"), F.lit(""))
    listed = (marks > 0) & (2 * F.col("top.c") >= F.col("n")) & ((marks >= 2) | ~unit.isin(*CONTENT_UNITS))
    tier = F.when((F.col("n") < 3) | (2 * F.col("generic") >= F.col("n")) | listed | (4 * F.col("titles") <= F.col("n")), "ignore").when((F.col("depth") >= 2) & (F.col("n") >= F.greatest(F.lit(6), F.floor(F.col("n_pages") / 20))), "full").otherwise("skeleton")
    return out.select("doc_id", "n", F.when(marks > 0, F.col("top.c")).otherwise(0).cast("long").alias("counting"), tier.alias("tier"))


def tree(entries: DataFrame, pages: DataFrame, deepest: int = 10) -> DataFrame:
    """doc_id, ord, parent_ord, depth, title, start_page, end_page, node_id: entries with levels as a tree in pre-order.

    The parent is the last entry before with a smaller level: the largest, over smaller levels, of their last positions, each a
    running maximum, so no self-join is needed. An entry ends where the next one of its level or above starts (shared), the last
    one with the document. Entries that have n_pages already, in order, are neither joined nor sorted again.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # A running frame over the order turned round: each row is added once.
    after = Window.partitionBy("doc_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    e = entries if "n_pages" in entries.columns else entries.join(pages, "doc_id")
    last = [F.max(F.when(F.col("level") == k, F.col("ord"))).over(before) for k in range(1, deepest)]
    nxt = [F.min(F.when(F.col("level") == k, F.struct("ord", "page"))).over(after) for k in range(1, deepest + 1)]
    parent = F.coalesce(*[F.when(F.col("level") == k, F.greatest(*last[: k - 1], F.lit(None).cast("int"))) for k in range(2, deepest + 1)])
    follow = F.coalesce(*[F.when(F.col("level") == k, F.least(*nxt[:k], F.lit(None).cast("struct<ord:int,page:int>"))) for k in range(1, deepest + 1)])
    # What is told in one order comes first: going back to it would sort the rows once more.
    out = e.withColumn("parent_ord", parent).withColumn("_n", F.row_number().over(w) - 1).withColumn("_f", follow)
    out = out.select("doc_id", "ord", "parent_ord", "level", "title", F.col("page").alias("start_page"), F.greatest(F.col("page"), F.coalesce(F.col("_f.page"), F.col("n_pages"))).alias("end_page"), F.format_string("%04d", "_n").alias("node_id"))
    return out


def placed_pages(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """As-of join: for each (doc_id, page) wanted, the last node that starts at or before it, by a union and a running last value."""
    both = nodes.select("doc_id", F.col("start_page").alias("page"), F.lit(0).alias("side"), "ord").unionByName(wanted.select("doc_id", "page", F.lit(1).alias("side"), F.lit(None).cast("int").alias("ord")))
    w = Window.partitionBy("doc_id").orderBy("page", "side", "ord")
    return both.withColumn("ord", F.last("ord", ignorenulls=True).over(w)).where("side = 1").select("doc_id", "page", "ord")


def smallest_containing(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (doc_id, page) wanted, the node that holds it with the fewest pages, then the deepest, then the first.

    The wanted pages of a document meet its nodes as one array, so both are dealt out by document, as the tree is already, and only
    pages inside a node become rows: a node of many pages is one row, whatever it spans.
    """
    pages = wanted.groupBy("doc_id").agg(F.collect_set("page").alias("_pages"))
    within = F.filter("_pages", lambda p: p.between(F.col("start_page"), F.col("end_page")))
    inside = nodes.join(pages, "doc_id").select("doc_id", "ord", "level", "start_page", "end_page", F.explode(within).alias("page"))
    key = F.struct((F.col("end_page") - F.col("start_page")).alias("a"), (-F.col("level")).alias("b"), F.col("ord").alias("c"))
    best = inside.groupBy("doc_id", "page").agg(F.min(key).alias("k"))
    return best.select("doc_id", "page", F.col("k.c").alias("ord"), (F.col("k.a") + 1).alias("n_pages"))


def outline_gate(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, tops, widest, valid: at least three top entries and no gap of over half of the pages (or five)."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    tops = nodes.where("parent_ord is null").withColumn("gap", F.col("start_page") - F.lag("start_page").over(w))
    out = tops.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tops"), F.coalesce(F.max("gap"), F.lit(0)).alias("widest")).join(pages, "doc_id")
    return out.select("doc_id", "tops", "widest", ((F.col("tops") >= 3) & (F.col("widest") <= F.greatest(F.lit(5), F.floor(F.col("n_pages") / 2)))).alias("valid"))
