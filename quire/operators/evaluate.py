"""How well pages are located: shares and quantiles of the spans that hold them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def localizability(spans: DataFrame) -> DataFrame:
    """n, within_3, within_10, widest of columns n_pages (pages of the node that holds a wanted page)."""
    return spans.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("n_pages") <= 3).cast("double")).alias("within_3"), F.avg((F.col("n_pages") <= 10).cast("double")).alias("within_10"), F.max("n_pages").alias("widest"), F.percentile("n_pages", 0.5).alias("p50"), F.percentile("n_pages", 0.9).alias("p90"))


def evidence_hits(read, wanted) -> DataFrame:
    """doc_id, wanted, hit: wanted pages, and those among them that were read."""
    both = wanted.select("doc_id", "page").distinct().join(read.select("doc_id", "page").distinct().withColumn("r", F.lit(1)), ["doc_id", "page"], "left")
    return both.groupBy("doc_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("r").alias("hit"))
