"""The document store as tables: pages and nodes first, the document's record last, which commits it."""

from __future__ import annotations

import contextlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def problems(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """doc_id, ord of nodes whose pages are not within their document (records: doc_id, n_pages)."""
    n = nodes.join(records.select("doc_id", "n_pages"), "doc_id", "left")
    return n.where("n_pages is null or start_page is null or end_page is null or start_page < 1 or end_page < start_page or end_page > n_pages").select("doc_id", "ord")


def write(root: str, records: DataFrame, pages: DataFrame, nodes: DataFrame) -> str:
    """Adds documents, or new versions of them, and returns the run's name.

    Rows carry the run they were written by, and a document's record, written last, says which run is its own. So a run that stops
    before its records, or is run again, leaves nothing visible twice.
    """
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    for df, what in ((pages, "pages"), (nodes, "nodes"), (records, "records")):
        df.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{root}/{what}")
    return run


def committed(spark: SparkSession, root: str) -> DataFrame:
    """The newest record of each document."""
    records = spark.read.option("mergeSchema", True).parquet(f"{root}/records")
    newest = records.groupBy("doc_id").agg(F.max("run").alias("run"))
    return records.join(newest, ["doc_id", "run"], "left_semi")


def read(spark: SparkSession, root: str, what: str) -> DataFrame:
    """Rows of committed documents: the pages or nodes of the run that their record names, or the records."""
    records = committed(spark, root)
    rows = records if what == "records" else spark.read.option("mergeSchema", True).parquet(f"{root}/{what}").join(records.select("doc_id", "run"), ["doc_id", "run"], "left_semi")
    return rows.drop("run")


def drift(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, problem where tables disagree: rows that no record names, and records that have no pages or no nodes."""
    records = committed(spark, root).select("doc_id", "run")
    out = None
    for what in ("pages", "nodes"):
        rows = spark.read.option("mergeSchema", True).parquet(f"{root}/{what}").select("doc_id", "run").distinct()
        for left, right, problem in ((rows, records, f"{what} without a record"), (records, rows, f"a record without {what}")):
            found = left.join(right, ["doc_id", "run"], "left_anti").select("doc_id", F.lit(problem).alias("problem")).distinct()
            out = found if out is None else out.unionByName(found)
    return out


def repaired(spark: SparkSession, root: str, to: str) -> None:
    """Writes what is committed and whole to another folder: no leftovers, and no documents without pages or nodes."""
    broken = drift(spark, root).where("problem like 'a record%'").select("doc_id").distinct()
    for what in ("pages", "nodes", "records"):
        rows = committed(spark, root) if what == "records" else spark.read.option("mergeSchema", True).parquet(f"{root}/{what}").join(committed(spark, root).select("doc_id", "run"), ["doc_id", "run"], "left_semi")
        rows.join(broken, "doc_id", "left_anti").write.mode("overwrite").parquet(f"{to}/{what}")


def remove(spark: SparkSession, root: str, to: str, gone: DataFrame) -> None:
    """Writes the store without the documents of `gone` (doc_id) to another folder; the caller swaps the two."""
    for what in ("pages", "nodes", "records"):
        spark.read.option("mergeSchema", True).parquet(f"{root}/{what}").join(gone, "doc_id", "left_anti").write.mode("overwrite").parquet(f"{to}/{what}")


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put_text(spark: SparkSession, path: str, text: str, new: bool = False) -> bool:
    """Writes a small text whole: beside its place first, then renamed there. new: only if there is none yet; False if there is."""
    fs, p = _at(spark, path)
    if new:
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    return bool(fs.rename(beside, p))


@contextlib.contextmanager
def locked(spark: SparkSession, root: str, seconds: float = 60.0):
    """Holds the store's lock, a file that only one writer can create; waits for it at most so long."""
    path, until = f"{root}/lock", time.time() + seconds
    while not put_text(spark, path, str(time.time()), new=True):
        if time.time() > until:
            raise TimeoutError(f"{path} is held")
        time.sleep(0.1)
    try:
        yield
    finally:
        fs, p = _at(spark, path)
        fs.delete(p, False)


#: Attempts to publish a version, and the first wait between them in seconds, doubled up to six times.
ATTEMPTS, WAIT = 16, 0.01


def versions(spark: SparkSession, to: str) -> list[int]:
    fs, p = _at(spark, f"{to}/versions")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []


def push(spark: SparkSession, root: str, to: str) -> int:
    """Publishes the committed store as the next version of a mirror, and returns its number.

    The tables go to a folder of their own; then a file named by the version is created, which only one writer can do. Who comes second
    takes the next number, ATTEMPTS times at most.
    """
    folder = f"data-{uuid.uuid4().hex}"
    repaired(spark, root, f"{to}/{folder}")
    for n in range(ATTEMPTS):
        number = (versions(spark, to) or [0])[-1] + 1
        if put_text(spark, f"{to}/versions/{number}", folder, new=True):
            return number
        time.sleep(WAIT * 2 ** min(n, 6))
    raise TimeoutError(f"no version of {to} could be published")


def pulled(spark: SparkSession, to: str, what: str) -> DataFrame:
    """Rows of the mirror's newest version."""
    folder = spark.read.text(f"{to}/versions/{versions(spark, to)[-1]}").first()[0]
    return read(spark, f"{to}/{folder}", what)
