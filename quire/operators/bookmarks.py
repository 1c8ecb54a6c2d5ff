"""Bookmarks merged into a detected tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def pruned(entries: DataFrame, repeats: int = 3, longest: int = 100) -> DataFrame:
    """Entries without those whose title the document repeats so often, or that are too long."""
    w = Window.partitionBy("doc_id", "title")
    return entries.withColumn("_n", F.count(F.lit(1)).over(w)).where((F.col("_n") < repeats) & (F.length("title") <= longest)).drop("_n")


def same_headings(nodes: DataFrame, entries: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, ord, b_ord: nodes and bookmarks that name the same heading: within a page, equal keys, or one the end of the other, or alike by `least`.

    Joined by document and page band. Likeness, the costly part, is only computed where the lengths allow it: it is at most twice the
    shorter of both lengths.
    """
    n = nodes.select("doc_id", "ord", T.title_key(F.col("title")).alias("k"), F.col("start_page").alias("p")).withColumn("_p", F.explode(F.array(F.col("p") - 1, "p", F.col("p") + 1)))
    b = entries.select("doc_id", F.col("ord").alias("b_ord"), T.title_key(F.col("title")).alias("bk"), F.col("page").alias("_p"))
    both = n.join(b, ["doc_id", "_p"]).where((F.col("k") != "") & (F.col("bk") != ""))
    both = both.withColumn("ends", F.endswith("k", "bk") | F.endswith("bk", "k"))
    can = 2 * F.least(F.length("k"), F.length("bk")) >= least * (F.length("k") + F.length("bk"))
    rest = both.where(~F.col("ends") & can).where(T.similarity("k", "bk") >= least)
    return both.where("ends").select("doc_id", "ord", "b_ord").union(rest.select("doc_id", "ord", "b_ord")).distinct()


def backfilled(entries: DataFrame, nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, ord, title, page: bookmarks that name no node but whose title stands in the text of their page or a neighbouring one."""
    known = same_headings(nodes, entries).select("doc_id", F.col("b_ord").alias("ord")).distinct()
    missing = entries.join(known, ["doc_id", "ord"], "left_anti").withColumn("_p", F.explode(F.array(F.col("page") - 1, "page", F.col("page") + 1)))
    text = pages.select("doc_id", F.col("page").alias("_p"), T.normalized("markdown").alias("m"))
    found = missing.join(text, ["doc_id", "_p"]).where((T.normalized("title") != "") & F.contains("m", T.normalized("title")))
    return found.select("doc_id", "ord", "title", "page").distinct()


def toc_source(tiers: DataFrame, detected: DataFrame) -> DataFrame:
    """doc_id, source: where a document's tree comes from (tiers: doc_id, tier; detected: doc_id, tops)."""
    both = tiers.select("doc_id", "tier").join(detected.select("doc_id", "tops"), "doc_id", "full")
    some = F.coalesce(F.col("tops"), F.lit(0)) > 0
    return both.select("doc_id", F.when(F.col("tier") == "full", "bookmarks").when((F.col("tier") == "skeleton") & some, "hybrid").when(F.col("tier") == "skeleton", "bookmarks").when(some, "detected").otherwise("pages").alias("source"))
