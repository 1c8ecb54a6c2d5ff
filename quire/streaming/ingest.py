"""New documents as they arrive: triage and append, once for each document id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import triage

SCHEMA = "doc_id LONG, page INT, markdown STRING, arrived TIMESTAMP"


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Page texts from JSON files as they appear."""
    return spark.readStream.schema(SCHEMA).json(path)


def labelled_stream(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Triage labels of pages, one for each document and page within the watermark."""
    return triage.labelled(triage.signals(pages.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["doc_id", "page"])))


def ingest(pages: DataFrame, to: str, checkpoint: str):
    """Appends labels of arriving pages to a table; a batch that runs again replaces its own rows, as each batch is a partition."""

    def put(batch: DataFrame, n: int) -> None:
        labels = triage.labelled(triage.signals(batch.dropDuplicates(["doc_id", "page"])))
        labels.withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(to)

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
