"""Style clusters: the headings set like a document's keyword headings, grown from one to the next.

Candidates: doc_id, ord (heading order), page, kind, numbering, title, keyword (whether the title is a section's usual one), font (of
its first characters), style (the dominant one), size, score, centred. What decides whether two are neighbours is a profile, of which a document
has few; so profiles are compared, never all pairs of headings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.sources.scratch import kept

#: How near in score keyword headings and those that join them must be; pages within which a repeated heading is a duplicate.
KEYWORDS_NEAR, OTHERS_NEAR, NEARBY = 2.0, 0.5, 20
PROFILE = ("kind", "numbers", "score", "centred", "style", "font", "size")


def neighbours(p: str, q: str, near: float):
    """Whether headings of two profiles (struct columns) are set alike: scores nearer than `near`; numbered ones of one kind and length; else not one of several numbers, and both centred, or of one style, or of one font and nearly one size."""
    a, b = (lambda c: F.col(f"{p}.{c}")), (lambda c: F.col(f"{q}.{c}"))
    numbered = (a("numbers") > 0) & (b("numbers") > 0)
    uneven = ((a("numbers") == 0) & (b("numbers") > 1)) | ((b("numbers") == 0) & (a("numbers") > 1))
    look = F.when(a("centred") | b("centred"), a("centred") == b("centred")).otherwise((a("style") == b("style")) | ((a("font") == b("font")) & (F.abs(a("size") - b("size")) < near)))
    return (F.abs(a("score") - b("score")) < near) & F.when(numbered, (a("kind") == b("kind")) & (a("numbers") == b("numbers"))).otherwise(~uneven & look)


def grown(found: DataFrame, keys: list[str], near: float) -> DataFrame:
    """The rows of found (keys, ord, p: profile, core) that a cluster holds in the end: core ones, and, in order of ord, each that has a neighbour in it by then.

    A profile is in the cluster from the first of its headings on that could join: the least ord after a neighbouring profile came in.
    These times are lowered in rounds until none changes; a round is one join of neighbouring profiles.
    """
    of = kept(found.groupBy(*keys, "p").agg(F.array_sort(F.collect_list("ord")).alias("ords"), F.max("core").alias("core")))
    near_by = (F.floor(F.col("p.score") / near)).cast("long")
    q = of.select(*keys, F.col("p").alias("q"), F.explode(F.array(near_by - 1, near_by, near_by + 1)).alias("cell"))
    edges = kept(of.select(*keys, "p", "ords", near_by.alias("cell")).join(q, [*keys, "cell"]).where(neighbours("p", "q", near)).select(*keys, "p", "q", "ords"))
    since = kept(of.where("core").select(*keys, "p", F.lit(-1).cast("long").alias("since")))
    while True:
        reach = edges.join(since.withColumnRenamed("p", "q"), [*keys, "q"]).withColumn("since", F.array_min(F.filter("ords", lambda o: o > F.col("since")))).where("since is not null").select(*keys, "p", F.col("since").cast("long").alias("since"))
        now = kept(since.unionByName(reach).groupBy(*keys, "p").agg(F.min("since").alias("since")))
        if now.join(since, [*keys, "p", "since"], "left_anti").isEmpty():
            break
        since = now
    first = edges.join(since.withColumnRenamed("p", "q"), [*keys, "q"]).groupBy(*keys, "p").agg(F.min("since").alias("since"))
    return found.join(first, [*keys, "p"], "left").where(F.col("core") | (F.col("since") < F.col("ord"))).drop("since")


def keyword_cliques(candidates: DataFrame) -> DataFrame:
    """doc_id, ord, core of the headings in a document's keyword clique; core: whether it is one of the keyword headings.

    Keyword headings of one font are a bucket, which takes those that are neighbours of what it holds. The largest bucket (of equal ones the first)
    of two or more is the clique, if no keyword heading repeats one of its bucket within NEARBY pages; then all candidates, in order, that are
    neighbours of what the clique holds join it. Null titles and an empty table give nothing.
    """
    c = candidates.withColumn("numbers", F.size("numbering")).withColumn("centred", F.coalesce("centred", F.lit(False)))
    c = kept(c.select("doc_id", F.col("ord").cast("long").alias("ord"), "page", "font", "keyword", F.struct(*PROFILE).alias("p"), S.heading_signature(F.col("kind"), F.col("numbering"), F.col("title")).alias("sig"), "title"))
    words = c.where("keyword and title is not null").withColumn("core", F.col("ord") == F.min("ord").over(Window.partitionBy("doc_id", "font")))
    buckets = kept(grown(words, ["doc_id", "font"], KEYWORDS_NEAR).select("doc_id", "font", "ord", "page", "sig"))
    # Of each keyword heading the last one before it in its bucket with the same signature.
    seen = words.select("doc_id", "font", "ord", "page", "sig").join(buckets.select("doc_id", "font", "ord", F.lit(True).alias("held")), ["doc_id", "font", "ord"], "left")
    w = Window.partitionBy("doc_id", "font", "sig").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    twice = seen.withColumn("last", F.last(F.when(F.col("held"), F.col("page")), ignorenulls=True).over(w)).where(F.abs(F.col("page") - F.col("last")) < NEARBY).select("doc_id").distinct()
    best = buckets.groupBy("doc_id", "font").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).where("n > 1").join(twice, "doc_id", "left_anti").groupBy("doc_id").agg(F.max_by("font", F.struct("n", -F.col("first"))).alias("font"))
    core = buckets.join(best, ["doc_id", "font"]).select("doc_id", "ord", F.lit(True).alias("core"))
    all_ = c.join(best.select("doc_id"), "doc_id", "left_semi").join(core, ["doc_id", "ord"], "left").withColumn("core", F.coalesce("core", F.lit(False)))
    return grown(all_, ["doc_id"], OTHERS_NEAR).select("doc_id", "ord", "core")
