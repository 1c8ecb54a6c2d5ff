"""Page specifications such as "1-3,7"."""

from pyspark.sql import functions as F

from quire.functions import text as T

PATTERN = r"^[0-9]+(-[0-9]+)?(, *[0-9]+(-[0-9]+)?)*$"
MOST = 10_000


def is_page_spec(c):
    return c.rlike(PATTERN)


def page_spec_problem(c):
    """Why a specification can't be expanded, or null: invalid, nonpositive, too_many (with all parts counted once). Parts are counted in order of their first page, each from where those before it end; nothing is expanded."""
    parts = F.transform(F.split(c, ", *"), lambda p: F.struct(F.split_part(p, F.lit("-"), F.lit(1)).cast("long").alias("a"), F.when(p.contains("-"), F.split_part(p, F.lit("-"), F.lit(2))).otherwise(p).cast("long").alias("b")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    more = lambda acc, p: F.struct((acc["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(p["a"] - 1, acc["end"]))).alias("n"), F.greatest(acc["end"], p["b"]).alias("end"))
    size = F.aggregate(F.array_sort(parts), zero, more, lambda acc: acc["n"])
    return F.when(~is_page_spec(c) | c.isNull(), "invalid").when(F.exists(parts, lambda p: p["a"] > p["b"]), "invalid").when(F.exists(parts, lambda p: p["a"] < 1), "nonpositive").when(size > MOST, "too_many")


def expanded(c):
    """Distinct pages in ascending order."""
    part = lambda p: F.sequence(F.split_part(p, F.lit("-"), F.lit(1)).cast("long"), F.when(p.contains("-"), F.split_part(p, F.lit("-"), F.lit(2))).otherwise(p).cast("long"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(c, ", *"), part))))


def formatted(pages):
    """Sorted distinct pages as a specification: runs become ranges."""
    pages = F.array_sort(F.array_distinct(pages))
    runs = T.let(pages, lambda ps: F.struct(F.filter(ps, lambda p, i: F.coalesce(F.get(ps, i - 1) != p - 1, F.lit(True))).alias("starts"), F.filter(ps, lambda p, i: F.coalesce(F.get(ps, i + 1) != p + 1, F.lit(True))).alias("ends")))
    return F.array_join(F.zip_with(runs["starts"], runs["ends"], lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string")))), ",")
