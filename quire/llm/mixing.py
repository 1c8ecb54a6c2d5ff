"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, saved

#: Rows of one source that share a cell of the prefix sum: at this many on average, a cell is sorted in one task.
CELL_ROWS = 200_000
#: Times its size that a source's target is at most; no document is taken more often.
CAP = 2


def cell_of(salts: int):
    """Order of a source's documents by columns size and doc_id: by size class (four to an octave), then a slot dealt by id."""
    kind = "length(bin(size)) * 4 + CASE WHEN length(bin(size)) >= 3 THEN shiftright(size, length(bin(size)) - 3) & 3 ELSE size END"
    return F.expr(f"({kind}) * {salts} + pmod(coalesce(doc_id, 0) % 65536 * 40503 % 65536, {salts})")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = CAP, seed: str = "") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: a mix of share[0]/share[1] times all words.

    Sources in code-point order, null last, weigh `weights` in turn. A source's target stops at `cap` times its size; the excess goes
    to the others by weight. Systematic sampling: each document of a source expects target / source_size copies; these are summed
    along the source's documents from one random offset (a hash of the source and seed), and each integer crossed is a copy. Along a
    source, documents run by size class, then by a slot from the id, so the copies spread evenly over sizes and the words taken come
    near the target. No step sorts a source in one task: cells of (source, class, slot) are counted, the counts summed along the
    source, and documents numbered inside their cell.

    A null text or one without words has size 0 and takes nothing; a null source is a source; null and repeated ids are rows like
    others, told apart by their order within a size and id; texts of any length are counted whole; an empty table gives an empty result;
    other columns are not read.
    """
    sized = saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size")), "sized")
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # The windows below run over one row a source.
    totals = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights))) + 1))
    everything, before = Window.partitionBy(), Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("ratio", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    level = (share[0] * F.sum("source_size").over(everything) - cap * share[1] * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.lit(float(share[1])) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    totals = totals.withColumn("level", level).withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source"))).over(everything))
    totals = totals.withColumn("target", F.when(F.col("ratio") < F.col("level"), F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("level") * F.col("weight")))
    totals = totals.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"), (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("source"), F.lit("null")), F.lit(seed))), 1, 4), 16, 10).cast("double") / 65536).alias("start"))
    salts = sized.agg(F.greatest(F.lit(64), F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int"))).first()[0]
    celled = sized.withColumn("cell", cell_of(salts))
    cells = celled.groupBy("source", "cell").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("ahead", F.sum("n").over(Window.partitionBy("source").orderBy("cell")) - F.col("n"))
    cells = cells.join(totals, cells["source"].eqNullSafe(totals["source"])).select(cells["source"].alias("s"), F.col("cell").alias("c"), "ahead", "source_size", "target", "rate", "start")
    rows = celled.join(cells, celled["source"].eqNullSafe(cells["s"]) & (celled["cell"] == cells["c"]))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("source", "cell").orderBy("size", "doc_id")) - 1
    rows = rows.withColumn("place", place)
    copies = F.floor(F.col("start") + (F.col("place") + 1) * F.col("rate")) - F.floor(F.col("start") + F.col("place") * F.col("rate"))
    return rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long"))).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op6(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
t0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
t1 AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight FROM t0),
t2 AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM t1),
t3 AS (SELECT *, (3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER b, 0))::DOUBLE / 2.0::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM t2 WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pick AS (SELECT level AS lvl FROM t3 WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN ratio < lvl THEN 2.0::DOUBLE * source_size ELSE lvl * weight END AS target,
    ('0x' || substr(md5(coalesce(source, 'null')), 1, 4))::INT / 65536.0::DOUBLE AS start FROM t3, pick),
c AS (SELECT *, (SELECT greatest(64, ceil(count(*) / {CELL_ROWS}.0)::INT) FROM sized) AS salts FROM sized),
d AS (SELECT doc_id, source, size, (length(bin(size)) * 4
    + CASE WHEN length(bin(size)) >= 3 THEN (size >> greatest(length(bin(size)) - 3, 0)::INT) & 3 ELSE size END) * salts
    + (coalesce(doc_id, 0) % 65536 * 40503 % 65536) % salts AS cell FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cell, size, doc_id) - 1 AS place FROM d)
SELECT e.doc_id, e.size, t.source_size, t.target,
  CASE WHEN e.size > 0 THEN (floor(t.start + (e.place + 1)::DOUBLE * (t.target / t.source_size))
    - floor(t.start + e.place::DOUBLE * (t.target / t.source_size)))::BIGINT * e.size ELSE 0 END AS taken
FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source
"""
