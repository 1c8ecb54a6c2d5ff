"""Corpus pipeline: language ID, near copies, secrets, mixing and packing, in the order of STAGES.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import common, jaccard, language, mixing, packing, secrets

#: Words of a shingle and least similarity in percent, for near copies.
SHINGLE, PERCENT = 5, 80


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null or empty ones and ones without letters. Others stay as they are, also if no language can be learned; null and repeated ids are rows like others."""
    model = language.fitted(docs)
    if model is None:
        return docs.where(language.has_letters("text"))
    name = common.fresh(docs, "_p")
    return language.labelled(docs, model, name=name).where(F.col(name)["lang"] != "und").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the smallest id. Rows that repeat an id stay or go together; rows without an id stay."""
    classes = jaccard.near_classes(docs, k=SHINGLE, percent=PERCENT)
    copies = common.saved(classes.where("component_id <> doc_id").select("doc_id").distinct(), "copies")
    common.dropped(spark, classes)
    others, may = common.parted(docs, "doc_id", copies)
    return others.select(docs.columns).unionByName(may.join(copies, "doc_id", "anti").select(docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mark, and counts n_chars anew where a text changed. Null and empty texts, null and repeated ids and an empty table stay as they are."""
    model, before = secrets.train(secrets.labelled_samples(spark, docs)), common.fresh(docs, "_before")
    clean = secrets.redacted(docs.withColumn(before, F.col("text")), model)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text") != F.col(before), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mix takes it, which may be not at all; texts without words go.

    Rows that share an id, or have none, are told apart: in order of size, each takes the copies that the mix gave one of its id and
    size. An empty table stays empty. A bitmap tells most rows their copies; the others are joined by id, so few texts are shuffled.
    """
    names = [common.fresh(docs, c) for c in ("_copies", "_copy", "_size", "_nth", "_of")]
    copies, copy, size, nth, of = names
    took = common.saved(mixing.mix(docs).select(F.col("doc_id").alias(of), F.col("size").alias(size), F.col("copies").cast("int").alias(copies)), "copies")
    several = common.saved(took.groupBy(of).count().where("count > 1").select(of), "several")
    repeated = F.explode(F.sequence(F.lit(1), F.col(copies)))
    sure, docs = common.told_by_slot(docs, "doc_id", took.select(of, copies), copies, range(mixing.CAP + 1))
    sure = sure.where(F.col(copies) > 0).withColumn(copy, repeated).select(docs.columns)
    once = docs.join(took.where(F.col(copies) > 0), docs["doc_id"].eqNullSafe(F.col(of)))
    if several.isEmpty():
        return sure.unionByName(once.withColumn(copy, repeated).select(docs.columns))
    out = once.join(several.withColumnRenamed(of, nth), F.col(of).eqNullSafe(F.col(nth)), "left_anti").withColumn(copy, repeated).select(docs.columns)
    words = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0))
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy(words, F.xxhash64("text")))
    rows = docs.join(several, docs["doc_id"].eqNullSafe(several[of]), "left_semi").withColumn(nth, row)
    theirs = took.join(several.withColumnRenamed(of, "_id"), F.col(of).eqNullSafe(F.col("_id")), "left_semi").withColumn(copy, F.row_number().over(Window.partitionBy(of).orderBy(size, copies)))
    both = rows.join(theirs.where(F.col(copies) > 0), rows["doc_id"].eqNullSafe(F.col(of)) & (F.col(nth) == F.col(copy)))
    return sure.unionByName(out).unionByName(both.drop(copy).withColumn(copy, repeated).select(docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences, each row a document of its own; a null text is an empty one, and an empty table gives no row."""
    return packing.pack(docs)


STAGES = [("language ID", identified), ("near copies", one_of_each), ("secrets", without_secrets), ("mixing", mixed), ("packing", packed)]
#: Models and tokens are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
