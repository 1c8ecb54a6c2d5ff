"""Queries of sources: stages compared field by field, and span dumps read by the Python data source."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.plans.inputs import order_lines, spans, sql
from quire.sources import datasource, nested
from quire.sources.scratch import fresh_folder


def stages(spark, d):
    """Two stages of every order as nested values: a page with a block for each line; the second one has other numbers, a moved word, no text, or no last block, by line."""
    o = order_lines(spark, d).withColumn("q", F.col("l_quantity").cast("double"))
    k = F.col("l_partkey") % 7

    def stage(b: bool):
        box = F.array(F.col("q"), F.when(F.lit(b) & (k == 1), F.col("q") + 0.5).when(F.lit(b) & (k == 2), F.col("q") + 1e-9).otherwise(F.col("q")))
        block = F.struct("n", F.struct(F.col("l_linenumber").alias("line"), box.alias("box"), F.when(F.lit(b) & (k == 3), "moved").otherwise(F.col("l_linestatus")).alias("mode"), F.when(~(F.lit(b) & (k == 4)), F.col("l_returnflag")).alias("flag")).alias("v"))
        all_ = o.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["v"]).alias("all"))
        less = F.when(F.lit(b) & (F.col("l_orderkey") % 5 == 0), 1).otherwise(0)
        return all_.select("l_orderkey", F.to_json(F.struct((F.col("l_orderkey") % 9).alias("page"), F.slice("all", 1, F.greatest(F.lit(1), F.size("all") - less)).alias("blocks"))).alias("value"))

    return stage(False), stage(True)


def stage_differences(spark, d):
    return nested.nested_difference(*stages(spark, d), ["l_orderkey"])


DIFFERENT = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey % 7 AS k, l_orderkey % 9 AS page FROM lineitem),
  kept AS (SELECT * FROM o WHERE NOT (l_orderkey % 5 = 0 AND n > 1 AND i = n - 1))
  SELECT l_orderkey, '$.blocks.len()' AS path, n::VARCHAR AS "left", (n - 1)::VARCHAR AS "right", page, NULL::INT AS block FROM o WHERE l_orderkey % 5 = 0 AND n > 1 AND i = 0
  UNION ALL SELECT l_orderkey, '$.blocks[' || i || '].box[1]', regexp_replace(l_quantity::DOUBLE::VARCHAR, '\\.0$', ''), regexp_replace((l_quantity + 0.5)::DOUBLE::VARCHAR, '\\.0$', ''), page, i::INT FROM kept WHERE k = 1
  UNION ALL SELECT l_orderkey, '$.blocks[' || i || '].mode', '"' || l_linestatus || '"', '"moved"', page, i::INT FROM kept WHERE k = 3
  UNION ALL SELECT l_orderkey, '$.blocks[' || i || '].flag', '"' || l_returnflag || '"', '<missing>', page, i::INT FROM kept WHERE k = 4"""

def dumped_spans(spark, d):
    """Spans of all pages dumped as JSON lines and read by the data source, from the second page on, in larger type."""
    s = spans(spark, d)
    span = F.struct("ix", F.struct(F.array("left", "right", "top", "bottom").alias("bbox"), "text", F.lit("f").alias("font_name"), F.col("size").alias("font_size"), "bold", F.lit(False).alias("italic"), "skew").alias("v"))
    at = fresh_folder(spark, "dumps")
    s.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(span)), lambda x: x["v"]).alias("spans")).select("page", "spans", "doc_id").write.json(at)
    datasource.register(spark)
    read = spark.read.format("span_dumps").load(at).where("page >= 2")
    return read.where("font_size > 9").groupBy("page", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("left").alias("left"), F.max("top").alias("top"))


DUMPED = sql("""SELECT page, text, count(*) AS n, sum("left") AS "left", max(top) AS top FROM spans WHERE page >= 2 AND size > 9 GROUP BY page, text""", "spans")

QUERIES = {"stage_differences": stage_differences, "dumped_spans": dumped_spans}
ORACLES = {"stage_differences": DIFFERENT, "dumped_spans": DUMPED}
