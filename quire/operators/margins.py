"""Page headers and footers in three passes: candidates from the page's edge inwards, matches across pages, what lies beyond the marked ones and what repeats the most frequent texts.

kind 1 is headers, 2 footers. Nothing is compared within a whole document: texts meet by document, key and page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.classify import is_body
from quire.operators.stats import weighted_percentile
from quire.sources.scratch import kept

#: Words before a figure, table or chart's number, and those before a volume's.
CAPTION_WORDS = r"(?:figure|fig|table|chart)"
VOLUME_WORDS = r"(?:volume|vol|issue|no|number)"
#: Latin letters with marks and the letters they are read as.
MARKED, UNMARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
COPYRIGHT = r"(?:\bcopyright\b|©)"


def text_key(c):
    """Lower case without marks and white space."""
    return F.translate(F.regexp_replace(F.lower(c), r"\s+", ""), MARKED, UNMARKED)


def page_number(c):
    """The number of a text that is one: digits, between bars and blanks, not 0 at first; or a roman numeral up to XX."""
    digits = F.regexp_extract(c, r"^[ |]*([1-9][0-9]{0,5})[ |]*$", 1)
    return F.when(digits != "", digits.cast("int")).when(F.upper(c).rlike(r"^(?:XX|X?(?:IX|IV|V?I{1,3}|V)|X)$"), T.roman_value(c))


def blocks_of_parts(parts: DataFrame) -> DataFrame:
    """A row for each block of parts (doc_id, page, seq, part, text, left, right, top, bottom, size, bold, skew): its box, text, counts and heading score."""
    keys = ["doc_id", "page", "seq"]
    n = F.length("text")
    out = parts.groupBy(*keys).agg(*[F.min(c).alias(c) for c in ("left", "bottom")], *[F.max(c).alias(c) for c in ("right", "top", "skew")], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), " ").alias("text"), F.count_distinct("top").alias("n_lines"), F.max_by("size", F.struct(n, F.col("size"))).alias("size"), (F.sum(F.when(F.col("bold"), n).otherwise(0)) / F.greatest(F.lit(1), F.sum(n))).alias("bold"))
    count = lambda p: F.regexp_count("text", F.lit(p))
    out = out.withColumn("chars", F.length("text")).withColumn("letters", count(r"\p{L}")).withColumn("digits", count(r"\p{N}")).withColumn("key", text_key(F.col("text")))
    out = out.withColumn("info", F.col("letters") + count(r"\p{Lo}") + 0.5 * (F.col("chars") - F.col("letters")))
    caps = count(r"\p{Lu}") > 2 * count(r"\p{Ll}")
    return out.withColumn("score", F.col("size") + F.when(caps, 2).otherwise(0) + F.when(F.col("bold") > 0.5, 1).otherwise(0))


def candidates(blocks: DataFrame, pages: DataFrame, kind: int) -> DataFrame:
    """The blocks from a page's edge inwards up to the first that ends the margin, with `place` (from 1) and `beside` (one line with a number, level with the first text).

    The margin ends at the first block beyond a fifth of the page, or, unless it speaks of copyright, of three lines or more, with
    much text, or that begins like a caption. Skewed blocks and ones without area are passed over.
    """
    walk = Window.partitionBy("doc_id", "page").orderBy(F.col("seq") if kind == 1 else F.desc("seq"))
    b = blocks.where((F.col("skew") < 1) & (F.col("right") > F.col("left")) & (F.col("top") > F.col("bottom"))).join(pages, ["doc_id", "page"])
    far = F.col("top") < 0.8 * F.col("page_height") if kind == 1 else F.col("bottom") > 0.2 * F.col("page_height")
    full = (F.col("n_lines") >= 3) | (F.col("info") * (1 + F.col("bold")) >= 200) | F.col("text").rlike(rf"(?i)^{CAPTION_WORDS}\b")
    ends = far | (full & ~F.col("text").rlike(rf"(?i){COPYRIGHT}"))
    b = b.withColumn("ended", F.max(ends).over(walk)).where(~F.col("ended") & (F.col("chars") > 0))
    edge = F.first(F.when(F.col("letters") >= 5, F.col("bottom" if kind == 1 else "top")), ignorenulls=True).over(walk)
    level = F.col("top") > edge if kind == 1 else F.col("bottom") < edge
    beside = F.coalesce(level, F.lit(True)) & (F.col("n_lines") == 1) & (F.col("info") >= 8) & (F.col("letters") >= 5) & (F.col("digits") >= 1)
    return b.withColumn("beside", beside).withColumn("place", F.row_number().over(walk)).drop("ended")


def shifted(df: DataFrame, by: int) -> DataFrame:
    """df once for each page up to `by` pages away, in `near`: joins by document, key and page need no pairs of all pages."""
    return df.withColumn("near", F.explode(F.array(*[F.col("page") + d for d in range(-by, by + 1) if d])))


OTHER = ("page", "seq", "place", "left", "right", "top", "bottom", "score", "key")


def others(df: DataFrame, *also) -> DataFrame:
    return df.select("doc_id", *[F.col(c).alias(f"o_{c}") for c in OTHER], *also)


def title_like(page, score, size):
    """Whether a block of the first page stands out as a heading, so it is no running text."""
    return (page == 1) & (score >= size + 0.5)


def same_text(found: DataFrame, by: int = 3) -> DataFrame:
    """doc_id, page, seq, o_page, o_seq: the first block with the same key within `by` pages whose corners are near (squared distance below 100)."""
    texts = found.where("letters >= 5")
    both = shifted(texts, by).alias("b").join(others(texts).withColumnRenamed("o_key", "key"), ["doc_id", "key"]).where("near = o_page")
    apart = sum((F.col(c) - F.col(f"o_{c}")) ** 2 for c in ("left", "right", "top", "bottom"))
    near = (apart < 1) | ((apart < 100) & ~title_like(F.col("page"), F.col("score"), F.col("page_size")) & ~title_like(F.col("o_page"), F.col("o_score"), F.col("page_size")))
    return both.where(near).groupBy("doc_id", "page", "seq").agg(F.min(F.struct("o_page", "o_place", "o_seq")).alias("o")).select("doc_id", "page", "seq", "o.o_page", "o.o_seq")


def alike_text(found: DataFrame, pages: DataFrame, by: int = 2) -> DataFrame:
    """The like of same_text for texts within a bounded edit distance (below a fifth of the shorter): an edit-distance join.

    Only blocks beside the first text are compared, by document, their longest word or number, and page; a key counts if it is on
    four pages and on a quarter of all, and a page has one block for it. So a block meets four others at most for each of two keys.
    """
    longest = lambda p: F.element_at(F.array_sort(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))), 1)["w"]
    longer = F.expr("filter(array(struct(1 AS rank, word), struct(2 AS rank, number AS word)), x -> x.word IS NOT NULL)")
    keyed = found.where("beside").withColumn("word", longest(r"\p{L}+")).withColumn("word", F.when(F.length("word") > 3, text_key(F.col("word")))).withColumn("number", longest(r"\p{N}+"))
    keyed = keyed.withColumn("k", F.explode(longer)).withColumn("rank", F.col("k.rank")).withColumn("wkey", F.col("k.word")).drop("k", "word", "number")
    n_pages = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    often = keyed.groupBy("doc_id", "wkey").agg(F.count_distinct("page").alias("on")).join(n_pages, "doc_id").where(F.col("on") >= F.greatest(F.lit(4.0), F.col("n_pages") / 4)).select("doc_id", "wkey")
    keyed = keyed.join(often, ["doc_id", "wkey"])
    first = Window.partitionBy("doc_id", "wkey", "page").orderBy("place")
    ones = others(keyed.withColumn("nth", F.row_number().over(first)).where("nth = 1"), "wkey")
    both = shifted(keyed, by).join(ones, ["doc_id", "wkey"]).where("near = o_page")
    limit = F.least(F.length("key"), F.length("o_key")) / 5
    good = (F.abs(F.col("score") - F.col("o_score")) <= 1) & ~title_like(F.col("page"), F.col("score"), F.col("page_size")) & ~title_like(F.col("o_page"), F.col("o_score"), F.col("page_size"))
    both = both.where(good).where(T.bounded_edit_distance(F.col("key"), F.col("o_key"), limit) < limit)
    return both.groupBy("doc_id", "page", "seq").agg(F.min(F.struct("rank", "o_page", "o_seq")).alias("o")).select("doc_id", "page", "seq", "o.o_page", "o.o_seq")


def repeated_parts(parts: DataFrame, found: DataFrame, unmarked: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, seq of unmarked candidates all of whose characters are in parts that recur by style and text, or number the pages.

    A number counts if pages 1, 2 or 4 away bear the number that follows; after the first one found on a page with fewer signs.
    """
    n_pages = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    p = parts.join(found.select("doc_id", "page", "seq", "place", "chars"), ["doc_id", "page", "seq"]).where("length(text) > 0")
    p = p.withColumn("style", F.concat_ws(" ", "font", F.floor(F.col("top") - F.col("bottom") + 0.5).cast("string"), F.when(F.col("bold"), "B").otherwise("R"), F.lower("text"))).withColumn("number", page_number(F.col("text")))
    styles = p.where("chars >= 4").groupBy("doc_id", "style").agg(F.count_distinct("page").alias("on")).join(n_pages, "doc_id").where(F.col("on") >= F.greatest(F.lit(2.0), F.least(F.col("n_pages") / 3, F.lit(5.0)))).select("doc_id", "style", F.lit(True).alias("recurs"))
    numbers = p.where("number is not null").select("doc_id", "page", "number").distinct()
    near = numbers.select("doc_id", F.explode(F.array(*[F.struct((F.col("page") + s * d).alias("page"), (F.col("number") + s * d).alias("number"), F.lit(d).alias("d")) for d in (1, 2, 4) for s in (-1, 1)])).alias("x")).select("doc_id", "x.*").groupBy("doc_id", "page", "number").agg(F.collect_set("d").alias("away"))
    left = p.join(unmarked.select("doc_id", "page", "seq"), ["doc_id", "page", "seq"]).join(styles, ["doc_id", "style"], "left").join(near, ["doc_id", "page", "number"], "left")
    has = lambda d: F.coalesce(F.array_contains("away", d), F.lit(False))
    high = F.col("number") > F.col("page") / 2 - 30
    strict = (has(1) & has(2)) | (high & has(1)) | (has(2) & has(4))
    loose = ~F.coalesce(F.col("recurs"), F.lit(False)) & (strict | (high & has(2)))
    before = Window.partitionBy("doc_id", "page").orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.max(loose).over(before), F.lit(False))
    good = F.coalesce(F.col("recurs"), F.lit(False)) | strict | (loose & ~earlier)
    left = left.withColumn("good", good)
    return left.groupBy("doc_id", "page", "seq").agg(F.sum(F.when(F.col("good"), F.length("text")).otherwise(0)).alias("n"), F.max("chars").alias("chars"), F.count(F.lit(1)).alias("k")).where(F.col("n") + F.col("k") - 1 >= F.col("chars")).select("doc_id", "page", "seq")


def running_blocks(parts: DataFrame, pages: DataFrame, kind: int) -> DataFrame:
    """doc_id, page, seq, how of page headers (kind 1) or footers (2): copyright, same, alike, parts, outside or late.

    parts: what blocks_of_parts takes, with font. pages: doc_id, page, page_height, page_width, page_size (median), body_size (of the
    document) for each page. Blocks that another one matches are marked with it. Blocks nearer the edge than the first marked one are
    marked unless wide, body text or larger. Last, what lies beyond the pages' usual line (the 20th or 80th percentile of
    marked blocks, by their characters) is marked if it reads like one of the three texts marked most often, or is a volume's number.
    """
    id_ = ["doc_id", "page", "seq"]
    n_pages = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    found = kept(candidates(blocks_of_parts(parts), pages, kind))
    words = F.size(F.regexp_extract_all("text", F.lit(r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]"), F.lit(0)))
    stated = found.where(F.col("text").rlike(rf"(?i)^{COPYRIGHT}") & (words < 10)).select(*id_, F.lit("copyright").alias("how"), F.lit(0).alias("rank"))
    of = lambda m, how, rank: m.select(*id_, F.lit(how).alias("how"), F.lit(rank).alias("rank")).unionByName(m.select("doc_id", F.col("o_page").alias("page"), F.col("o_seq").alias("seq"), F.lit(how).alias("how"), F.lit(rank).alias("rank")))
    open_ = found.join(stated, id_, "left_anti")
    same = same_text(open_)
    matched = of(same, "same", 1).unionByName(of(alike_text(open_, pages), "alike", 2))
    marked = kept(stated.unionByName(matched).groupBy(*id_).agg(F.min_by("how", "rank").alias("how")))
    styled = repeated_parts(parts, found, found.join(marked, id_, "left_anti"), pages).select(*id_, F.lit("parts").alias("how"))
    marked = kept(marked.unionByName(styled))

    all_ = found.join(marked, id_, "left")
    page = Window.partitionBy("doc_id", "page")
    hit = F.col("how").isNotNull()
    all_ = all_.withColumn("first", F.min(F.when(hit, F.struct("place", "top", "bottom"))).over(page)).withColumn("most", F.max(F.when(hit, F.col("score"))).over(page)).withColumn("n", F.sum(F.when(hit, F.col("chars"))).over(page))
    outside = ~hit & (F.col("place") < F.col("first.place")) & (F.col("right") - F.col("left") < F.col("page_width") / 2) & ~((F.col("letters") > 0) & (F.col("score") >= F.col("most") + 1)) & ~is_body(F.col("text"))
    if kind == 1:
        outside = outside & (F.col("bottom") >= F.col("first.bottom"))
    all_ = kept(all_.withColumn("how", F.when(outside, "outside").otherwise(F.col("how"))))

    firsts = all_.where(F.col("place") == F.col("first.place")).select("doc_id", ((F.col("first.top") + F.col("first.bottom")) / 2).alias("line"), F.col("n").cast("double").alias("n"))
    enough = firsts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).join(n_pages, "doc_id").where(F.col("k") >= F.col("n_pages") / 20).select("doc_id", "n_pages")
    line = weighted_percentile(firsts, ["doc_id"], "line", "n", 0.2 if kind == 1 else 0.8).join(enough, "doc_id")
    counts = found.join(marked.where("how in ('same', 'alike', 'parts')"), id_).where("length(key) >= 5").groupBy("doc_id", "key").agg((F.max(F.when(F.col("how") != "parts", 2).otherwise(0)) + F.count(F.when(F.col("how") == "parts", 1))).alias("k"), F.min(F.struct("page", "place")).alias("first")).join(enough, "doc_id").where(F.col("k") >= F.col("n_pages") / 20)
    top = counts.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("k"), "first"))).where("nth <= 3").groupBy("doc_id").agg(F.collect_list("key").alias("tops"))
    late = all_.join(line, "doc_id").join(top, "doc_id")
    beyond = F.col("top") < F.col("line") if kind == 1 else F.col("bottom") > F.col("line")
    late = late.withColumn("over", F.max(beyond).over(page.orderBy("place"))).where(~F.col("over") & F.col("how").isNull())
    half = lambda h: F.least(F.length("key"), F.length(h)) / 2
    reads = F.exists("tops", lambda h: T.bounded_edit_distance(F.col("key"), h, half(h)) < half(h)) & (F.col("letters") >= 5) & ~((F.col("page") <= 1) & (F.col("score") > F.col("body_size") + 1))
    late = late.where(reads | F.col("text").rlike(rf"(?i)\b{VOLUME_WORDS}\W+\p{{N}}")).select(*id_, F.lit("late").alias("how"))
    return all_.where("how is not null").select(*id_, "how").unionByName(late)
