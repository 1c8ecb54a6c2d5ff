"""Weighted statistics of pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weighted_percentile(df: DataFrame, keys: list[str], value: str, weight: str, share: float) -> DataFrame:
    """keys, value: the first value whose running weight passes `share` of the total; where a share is met exactly before a value, the mean of that value and the one before it; the last value where nothing passes it.

    Weights of 0 count as values. Equal values are added up first, so a key's window holds its distinct values only.
    """
    by = df.where(F.col(weight) >= 0).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys)
    up = w.orderBy(value)
    run = by.withColumn("_run", F.sum("_w").over(up)).withColumn("_target", F.sum("_w").over(w) * F.lit(share)).withColumn("_before", F.lag("_run", 1, 0).over(up)).withColumn("_last", F.lag(value).over(up))
    met = F.col("_before") == F.col("_target")
    hit = run.withColumn("_v", F.when(met & F.col("_last").isNotNull(), (F.col("_last") + F.col(value)) / 2).otherwise(F.col(value)).cast("double"))
    return hit.groupBy(*keys).agg(F.coalesce(F.min_by("_v", F.when(met | (F.col("_run") > F.col("_target")), F.col(value))), F.max(F.col(value).cast("double"))).alias(value))


def dominant(df: DataFrame, keys: list[str], value: str, weight) -> DataFrame:
    """keys, value: the value of largest total weight; of equal ones the smallest."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("_w")).alias("a"), F.col(value).alias("b"))).alias(value), F.max("_w").alias("weight"))


def page_stats(spans: DataFrame) -> DataFrame:
    """A row for each page of spans: lines, characters, mean size weighted by characters, dominant size; skewed spans are left out."""
    flat = spans.where("skew < 1").withColumn("chars", F.length("text"))
    sums = flat.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_spans"), F.sum("chars").alias("n_chars"), (F.sum(F.col("size") * F.col("chars")) / F.sum("chars")).alias("mean_size"), F.max("top").alias("top"), F.min("bottom").alias("bottom"))
    return sums.join(dominant(flat, ["doc_id", "page"], "size", F.col("chars")).select("doc_id", "page", F.col("size").alias("dominant_size")), ["doc_id", "page"])


def doc_stats(pages: DataFrame) -> DataFrame:
    """A row for each document of page statistics, pages weighted by min(100, characters)."""
    w = F.least(F.lit(100), F.col("n_chars"))
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_chars").alias("n_chars"), (F.sum(F.col("mean_size") * w) / F.sum(w)).alias("mean_size"))


def merged_char_stats(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Character statistics (a struct column `s`) added up by keys."""
    names = stats.schema["s"].dataType.names
    return stats.groupBy(*keys).agg(*[F.sum(f"s.{n}").alias(n) for n in names])


#: First code points of ranges and their scripts. Fixed values.
SCRIPTS = ((0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x750, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x4E00, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"))


def script_histogram(docs: DataFrame, text: str = "text") -> DataFrame:
    """script, n_letters over all texts; letters are counted in each text by range, so no row is made for a character."""
    bounds = [*SCRIPTS, (0x110000, "")]
    found: dict[str, list[str]] = {}
    for (a, name), (b, _) in zip(bounds, bounds[1:]):
        found.setdefault(name, []).append(f"\\x{{{a:x}}}-\\x{{{b - 1:x}}}")
    counts = F.array(*[F.struct(F.lit(k).alias("script"), F.regexp_count(text, F.lit(f"[\\p{{L}}&&[{''.join(v)}]]")).cast("long").alias("n")) for k, v in found.items()])
    return docs.select(F.explode(counts).alias("x")).groupBy("x.script").agg(F.sum("x.n").alias("n_letters")).where("n_letters > 0")
