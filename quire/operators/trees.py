"""Section trees as rows: ancestors, uncovered pages, leaves over the same pages, fresh ids. Costs and rewriting are in optimizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources.scratch import kept


def ancestors(nodes: DataFrame, deepest: int = 10) -> DataFrame:
    """doc_id, ord, anc, dist: each node with itself and its ancestors, one join a level up to the deepest, by document and parent."""
    up = nodes.select("doc_id", F.col("ord").alias("anc"), F.col("parent_ord").alias("next"))
    out = found = nodes.select("doc_id", "ord", F.col("ord").alias("anc"), F.lit(0).alias("dist"))
    for d in range(1, deepest):
        found = found.join(up, ["doc_id", "anc"]).where("next is not null").select("doc_id", "ord", F.col("next").alias("anc"), F.lit(d).alias("dist"))
        out = out.unionByName(found)
    return out


def with_ancestors(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """nodes (doc_id, id, parent, ...) with `up`: the ancestors from the root to the parent, as structs of id and the carried columns. One join a level; all documents together."""
    mine = F.struct("id", *carried)
    level = nodes.where("parent is null").withColumn("up", F.array().cast(f"array<{_ddl(nodes, ['id', *carried])}>"))
    out = []
    while not level.isEmpty():
        out.append(level)
        above = level.select("doc_id", F.col("id").alias("parent"), F.concat("up", F.array(mine)).alias("up"))
        level = kept(nodes.join(above, ["doc_id", "parent"]).select(*nodes.columns, "up"))
    whole = out[0] if out else level
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def _ddl(df: DataFrame, names: list[str]) -> str:
    return f"struct<{','.join(f'{n}:{df.schema[n].dataType.simpleString()}' for n in names)}>"


def uncovered(lo, hi, ranges):
    """Pages of [lo, hi] in none of the ranges (arrays of structs start, end): the ranges in order, with the furthest page reached so far."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), (lo - 1).cast("long").alias("at"))
    step = lambda acc, r: F.struct((acc["n"] + F.greatest(F.least(r["start"], hi + 1) - acc["at"] - 1, F.lit(0))).alias("n"), F.greatest(acc["at"], F.least(r["end"], hi)).cast("long").alias("at"))
    cut = F.array_sort(F.filter(ranges, lambda r: (r["end"] >= lo) & (r["start"] <= hi) & (r["end"] >= r["start"])))
    return F.greatest(F.aggregate(cut, zero, step, lambda acc: acc["n"] + F.greatest(hi - acc["at"], F.lit(0))), F.lit(0).cast("long"))


def same_page_merged(nodes: DataFrame) -> DataFrame:
    """Leaf siblings over the same pages collapse into the first: doc_id, ord, title (joined, or the page label beyond 200 characters), items, start_page, end_page."""
    inner = nodes.where("parent_ord is not null").select("doc_id", F.col("parent_ord").alias("ord")).distinct()
    leaves = nodes.join(inner, ["doc_id", "ord"], "left_anti")
    out = leaves.groupBy("doc_id", "parent_ord", "start_page", "end_page").agg(F.array_sort(F.collect_list(F.struct("ord", "title"))).alias("t"))
    joined = F.array_join(F.filter(F.transform("t", lambda x: x["title"]), lambda x: x != ""), "; ")
    return out.select("doc_id", F.element_at("t", 1)["ord"].alias("ord"), F.when((F.length(joined) > 200) | (joined == ""), T.page_label(F.col("start_page"), F.col("end_page"))).otherwise(joined).alias("title"), F.size("t").alias("items"), "start_page", "end_page")


def relabelled(nodes: DataFrame) -> DataFrame:
    """nodes with fresh four-digit ids in pre-order."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    return nodes.withColumn("node_id", F.format_string("%04d", F.row_number().over(w) - 1))
