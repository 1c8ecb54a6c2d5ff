"""Differences of nested values: two tables of JSON texts compared field by field, all documents and all places of one depth together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.scratch import kept

ROOT = "$"


def kind_of(c: str):
    """object, array, integer, number, or other: what a VARIANT column holds."""
    s = F.schema_of_variant(F.col(c))
    return F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "number").otherwise("other")


def nested_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value", tolerance: float = 1e-6) -> DataFrame:
    """keys, path, left, right, page, block where the JSON texts of two tables differ, as JSON; a side that lacks the place says <missing>.

    Objects are compared by field, arrays element by element as far as both reach, with a row for `path.len()` where lengths differ. Integers are
    compared exactly, other numbers within the tolerance, absolute or relative. page is that of the innermost object with a field page (of the left
    table) on the way, block the index in the innermost array called blocks. Documents of one table only are a row at the root; texts that are
    no JSON, and null ones, are null values. The documents of the tables meet in one join; from then on both sides of a place are in one row, which
    is opened where it is, level by level, and places whose sides are the same text are not opened at all.
    """
    x, y = (t.select(*keys, F.try_parse_json(value).alias(n), F.lit(True).alias(f"has_{n}")) for t, n in ((a, "x"), (b, "y")))
    both = x.join(y, keys, "full").withColumn("path", F.lit(ROOT)).withColumn("page", F.lit(None).cast("long")).withColumn("block", F.lit(None).cast("int"))
    text = lambda c: F.when(F.col(f"has_{c}"), F.coalesce(F.to_json(F.col(c)), F.lit("null"))).otherwise("<missing>")
    at = [*keys, "path", "page", "block"]
    told = []
    while True:
        both = both.withColumn("kx", F.coalesce(kind_of("x"), F.lit("other"))).withColumn("ky", F.coalesce(kind_of("y"), F.lit("other")))
        mine = F.expr("try_variant_get(x, '$.page', 'long')")
        known = F.coalesce("has_x", F.lit(False)) & F.coalesce("has_y", F.lit(False))
        both = both.withColumn("page", F.when(F.col("kx") == "object", F.coalesce(mine, "page")).otherwise(F.col("page")))
        both = kept(both.withColumn("left", text("x")).withColumn("right", text("y")).where(~(known & (F.col("left") == F.col("right")))))
        deeper = known & (F.col("kx") == F.col("ky")) & F.col("kx").isin("object", "array")
        number = lambda c: F.expr(f"try_variant_get({c}, '$', 'double')")
        apart = F.abs(number("x") - number("y"))
        close = (number("x") == number("y")) | (apart <= tolerance) | (apart <= tolerance * F.greatest(F.abs(number("x")), F.abs(number("y"))))
        numbers = F.col("kx").isin("integer", "number") & F.col("ky").isin("integer", "number") & ~((F.col("kx") == "integer") & (F.col("ky") == "integer"))
        told.append(both.where(~deeper & ~(known & F.when(numbers, close).otherwise(False))).select(*at, "left", "right"))
        inner = both.where(deeper)
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, told).select(*keys, "path", "left", "right", "page", "block")
        of = lambda c, kind: F.try_variant_get(c, "$", kind)
        opened = inner.withColumn("xs", of("x", "array<variant>")).withColumn("ys", of("y", "array<variant>"))
        told.append(opened.where("size(xs) <> size(ys) and kx = 'array'").select(*keys, F.concat("path", F.lit(".len()")).alias("path"), "page", "block", F.size("xs").cast("string").alias("left"), F.size("ys").cast("string").alias("right")))
        fields = F.map_zip_with(of("x", "map<string,variant>"), of("y", "map<string,variant>"), lambda _, x, y: F.struct(x.alias("x"), y.alias("y")))
        place = lambda key, pos, z: F.struct(key.cast("string").alias("key"), pos.cast("int").alias("pos"), z["x"].alias("x"), z["y"].alias("y"))
        reach = F.least(F.size("xs"), F.size("ys"))
        elements = F.transform(F.arrays_zip(F.slice("xs", 1, reach).alias("x"), F.slice("ys", 1, reach).alias("y")), lambda z, i: place(F.lit(None), i, z))
        parts = F.when(F.col("kx") == "object", F.transform(F.map_entries(fields), lambda z: place(z["key"], F.lit(None), z["value"]))).otherwise(elements)
        e = opened.select(*at, F.explode(parts).alias("e"))
        e = e.withColumn("block", F.when(F.col("path").endswith(".blocks") & F.col("e.key").isNull(), F.col("e.pos")).otherwise(F.col("block")))
        step = F.when(F.col("e.key").isNotNull(), F.concat(F.lit("."), "e.key")).otherwise(F.concat(F.lit("["), F.col("e.pos").cast("string"), F.lit("]")))
        both = e.withColumn("path", F.concat("path", step)).select(*at, "e.x", F.col("e.x").isNotNull().alias("has_x"), "e.y", F.col("e.y").isNotNull().alias("has_y"))
