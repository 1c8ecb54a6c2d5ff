"""Files in and out: listings of PDF files, span dumps, reports, comparisons of stages."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = "page INT, viewbox ARRAY<DOUBLE>, rotation INT, spans ARRAY<STRUCT<bbox: ARRAY<DOUBLE>, text: STRING, font_name: STRING, font_size: DOUBLE, bold: BOOLEAN, italic: BOOLEAN, skew: DOUBLE>>"


def location(uri: str) -> str:
    """A place as Spark's file systems name it: s3: by its current driver, gs: as it is, and anything without a scheme as a local path."""
    scheme, _, rest = uri.partition("://")
    if not rest:
        return f"file://{os.path.abspath(uri)}"
    if scheme.lower() not in ("file", "s3", "s3a", "gs"):
        raise ValueError(f"{scheme}: is not a place to read from")
    bucket = rest.split("/")[0]
    if scheme.lower() != "file" and not bucket:
        raise ValueError(f"{uri} names no bucket")
    return f"{'s3a' if scheme.lower() == 's3' else scheme.lower()}://{rest}"


def tolerant_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that are not JSON, or not of the schema, are left out."""
    rows = spark.read.schema(f"{schema}, _bad STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.cache().where("_bad is null").drop("_bad")


def pdf_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, length (and content) of the PDF files below a folder of any file system Spark reads (file:, s3a:, gs:); only files that start as PDF when content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    if not content:
        return files.select("path", "length")
    return files.select("path", "length", "content").where(F.substring("content", 1, 5) == F.lit(b"%PDF-"))


def page_spans(spark: SparkSession, path: str) -> DataFrame:
    """path, page, ix, box and style of spans from JSON dumps: lines of pages, or one object with them in `data`."""
    raw = spark.read.schema(f"{SPANS}, data ARRAY<STRUCT<{SPANS.replace(' INT', ': INT', 2).replace('viewbox ', 'viewbox: ').replace('spans ', 'spans: ')}>>").option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    pages = raw.where("data is null").select("path", "page", "viewbox", "rotation", "spans").unionByName(raw.where("data is not null").select("path", F.inline("data")))
    s = pages.select("path", "page", F.posexplode("spans").alias("ix", "s"))
    return s.select("path", "page", "ix", *[F.col("s.bbox")[i].alias(n) for i, n in enumerate(("left", "right", "top", "bottom"))], *[F.col(f"s.{n}").alias(n) for n in ("text", "font_name", "font_size", "bold", "italic", "skew")])


def report(df: DataFrame, path: str) -> None:
    """One JSON line a row."""
    df.write.mode("overwrite").json(path)


def difference(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """keys, column, left, right where two tables of one schema differ: a full join by keys, numbers within a tolerance."""
    cols = [c for c in a.columns if c not in keys]
    x, y = a.select(*keys, F.struct(*cols).alias("x")), b.select(*keys, F.struct(*cols).alias("y"))

    def same(c):
        p, q = F.col(f"x.{c}"), F.col(f"y.{c}")
        kind = dict(a.dtypes)[c]
        return F.coalesce(F.abs(p - q) <= tolerance * F.greatest(F.lit(1.0), F.abs(p)), p.isNull() & q.isNull()) if kind in ("double", "float") else p.eqNullSafe(q)

    found = F.array(*[F.when(~same(c), F.struct(F.lit(c).alias("column"), F.col(f"x.{c}").cast("string").alias("left"), F.col(f"y.{c}").cast("string").alias("right"))) for c in cols])
    return x.join(y, keys, "full").select(*keys, F.inline(F.filter(found, lambda f: f.isNotNull())))
