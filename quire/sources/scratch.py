"""Results that later steps read several times, kept in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or on a local master without it a new one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}/{name}"


def kept(df: DataFrame) -> DataFrame:
    """df computed once and read from the checkpoint folder from then on."""
    at, context = shared_dir(df.sparkSession), df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return df.checkpoint()
