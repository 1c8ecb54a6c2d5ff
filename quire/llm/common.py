"""What the operators share: reading tables, tables in the shared folder, labelled samples, state of Python workers."""

from __future__ import annotations

import gc
import pickle
import sys
import tempfile
import time
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master without it a new folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage, and later jobs read it instead of computing it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the tables made by saved() that df reads, if no later job reads them."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/quire-" in f}:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs, which it does once the driver has collected what refers to them."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.25)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(id_col, n: int):
    """crc32(id as text) mod n, the fold of a document."""
    return F.crc32(F.col(id_col).cast("string")) % n


def bounded_sample(df: DataFrame, id_col: str, rows: int, total: int | None = None) -> DataFrame:
    """About `rows` rows of df at most, the same ones on each run: those whose hash of id and text (if df has that column) is below a bound set from the count. All of df if it has fewer.

    The bound is a share of 2**63, so it holds for any count (`total`, counted where it is not given). Rows that repeat id and text
    fall in or out together; if none is in, the rows of the smallest hashes are taken.
    """
    n = df.count() if total is None else total
    if n <= rows:
        return df
    keys = [F.col(id_col).cast("string"), *([F.col("text")] if "text" in df.columns and id_col != "text" else [])]
    place = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(7)), 1)
    sample = df.where(place < F.lit(rows * (1 << 63) // n))
    return df.orderBy(place).limit(rows) if sample.isEmpty() else sample


def trimmed() -> None:
    """Gives what this process has freed back to the system: executors count the memory of idle workers too."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def worker_state(key, build):
    """build()'s value, kept in this Python worker from one task to the next. A worker keeps one value: another key drops the last one first, so what a finished stage held goes when the next begins."""
    state = sys.modules.setdefault("quire_worker_state", types.ModuleType("quire_worker_state")).__dict__
    if state.get("key") != key:
        state.pop("value", None)
        state["key"] = None
        gc.collect()
        trimmed()
        state["value"], state["key"] = build(), key
    return state["value"]


def shipped(spark: SparkSession, value, use=lambda x: x):
    """A function that gives use(value) on any worker: value (bounded) is broadcast with its classes, so executors need no copy of this package."""
    sent, key = spark.sparkContext.broadcast(cloudpickle.dumps((value, use))), uuid.uuid4().hex

    def build():
        held, made = pickle.loads(sent.value)
        return made(held)

    return lambda: worker_state(key, build)


#: Bytes of an Arrow batch, about, where the session has Spark's own default: texts are long, and a worker holds a batch as Arrow and as Python values.
BATCH_BYTES = 4 << 20


def arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow, with batches bounded by bytes and not by rows alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, "67108864b").rstrip("bB") == "67108864":
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


#: Slots of the bitmap that thins out rows before a join: 1 MB, whatever the data.
SLOTS = 1 << 23


def bit(at: str, held: str):
    """Whether the bitmap in column `held` has the bit of slot `at`, which is in its bucket."""
    return F.expr(f"(cast(conv(hex(substring({held}, cast(bitmap_bit_position({at}) div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(bitmap_bit_position({at}) % 8 as int))) != 0")


def bitmap_hit(df: DataFrame, id_col: str, ids: DataFrame, hit: str, how: str) -> DataFrame:
    """df with a column `hit`, whether its id may be among ids (one column): a bitmap of hashed ids, of fixed size, is broadcast. how: left keeps all rows; inner those alone whose part of the bitmap has ids."""
    slot = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(SLOTS))
    at, bucket, held = (fresh(df, c) for c in ("_slot", "_bucket", "_map"))
    maps = ids.select(slot(F.col(ids.columns[0])).alias(at)).groupBy(F.expr(f"bitmap_bucket_number({at})").alias(bucket)).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({at}))").alias(held))
    out = df.withColumn(at, slot(F.col(id_col)))
    out = out.join(F.broadcast(maps), F.expr(f"bitmap_bucket_number({at})") == F.col(bucket), how)
    return out.withColumn(hit, F.coalesce(bit(at, held), F.lit(False))).drop(at, bucket, held)


def only_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose id may be among ids (one column): most of the others are dropped before df is shuffled."""
    hit = fresh(df, "_hit")
    return bitmap_hit(df, id_col, ids, hit, "inner").where(F.col(hit)).drop(hit)


def parted(df: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose id is surely not among ids (one column), null ids included, and the others, which a join has to judge. Only the latter need be shuffled."""
    hit = fresh(df, "_hit")
    out = bitmap_hit(df, id_col, ids, hit, "left")
    return out.where(~F.col(hit)).drop(hit), out.where(F.col(hit)).drop(hit)


#: Slots that tell values of ids, a prime: 2 MB a value, whatever the data. Consecutive ids have slots of their own up to so many.
VALUE_SLOTS = 16_777_213


def told_by_slot(df: DataFrame, id_col: str, values: DataFrame, put: str, among) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose value (among the few in `among`) their slot tells, in a new column `put`, and the others, which a join has to judge.

    values: two columns, id and value, that hold each id of df. A bitmap for each value, of fixed size, is broadcast; a slot tells a
    value if all ids that fall on it have that one. Null ids are told nothing, and ids that fall on one slot with different values
    neither, so what is told is exact and df is not shuffled for it.
    """
    key, value = values.columns
    at, bucket = (fresh(df, c) for c in ("_slot", "_bucket"))
    held = [fresh(df, f"_map{v}") for v in among] + [fresh(df, "_map_of_others")]
    slot = lambda c: F.pmod(F.col(c).cast("long"), F.lit(VALUE_SLOTS)).alias(at)
    maps = values.where(F.col(key).isNotNull()).select(slot(key), F.coalesce(F.col(value).cast("int"), F.lit(-1)).alias("value"))
    has = [f"value = {v}" for v in among] + [f"value NOT IN ({', '.join(map(str, among))})"]
    maps = maps.groupBy(F.expr(f"bitmap_bucket_number({at})").alias(bucket)).agg(*[F.expr(f"bitmap_construct_agg(bitmap_bit_position({at})) FILTER (WHERE {x})").alias(m) for x, m in zip(has, held)])
    out = df.select("*", slot(id_col)).join(F.broadcast(maps), F.expr(f"bitmap_bucket_number({at})") == F.col(bucket), "left")
    bits = [F.coalesce(bit(at, m), F.lit(False)) for m in held]
    found = F.filter(F.array(*[F.when(b, F.lit(v)) for v, b in zip(among, bits)]), lambda x: x.isNotNull())
    out = out.withColumn(put, F.when((F.size(found) == 1) & ~bits[-1], F.element_at(found, 1))).drop(at, bucket, *held)
    return out.where(F.col(put).isNotNull()), out.where(F.col(put).isNull()).drop(put)
