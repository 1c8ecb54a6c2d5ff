"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import dropped, saved


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for each id in edges, whose two columns are ids of type long.

    Each round points every id at its smallest neighbour, shortens the pointers twice and contracts the links, so a path of n links
    takes about log4 n rounds. Aggregates combine before shuffling and joins have a unique side, so no id's links meet in one task.
    Null ids and links of an id to itself are left out. Rounds are written to the shared folder.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    edges = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null and b is not null and a <> b")
    edges, labels = saved(edges.distinct(), "links"), None
    while not edges.isEmpty():
        to = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("r"))
        for _ in range(2):
            to = saved(to, "pointers")
            to = to.join(to.select(F.col("v").alias("r"), F.col("r").alias("next")), "r", "left").select("v", F.coalesce("next", "r").alias("r"))
        to = saved(to, "pointers")
        if labels is None:
            labels = to.select(F.col("v").alias("id"), F.col("r").alias("component"))
        else:
            labels = saved(labels.join(to.withColumnRenamed("v", "component"), "component", "left").select("id", F.coalesce("r", "component").alias("component")), "labels")
        last = edges
        edges = edges.join(to.select(F.col("v").alias("a"), F.col("r").alias("ra")), "a").join(to.select(F.col("v").alias("b"), F.col("r").alias("rb")), "b")
        edges = saved(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct(), "links")
        dropped(spark, last)
    return labels if labels is not None else spark.createDataFrame([], "id long, component long")
