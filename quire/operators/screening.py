"""What a page's blocks are not: candidates that are no headings, pages that are covers or boilerplate, columns of page numbers, running matter by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.functions import text as T

#: Candidates from which on a page's are dropped, single numbers likewise; what characters of formulas weigh.
MOST_CANDIDATES, MOST_SINGLES = 20, 5
FORMULA = {"=": 10.0, "{": 5.0, "}": 5.0, "+": 5.0, "/": 3.0, "*": 3.0, "-": 1.0, "~": 1.0, "[": 1.0, "]": 1.0, "(": 1.0, ")": 1.0}
#: Own lists.
INSTITUTIONS = S.phrases("university", "institute of technology", "faculty of", "department of", "thesis", "dissertation", "universität", "fakultät", "institut für", "université", "faculté", "universidad", "facultad")
TITLES = S.phrases("prof.", "professor", "dr.", "professeur", "profesor")
VOLUMES = S.phrases("volume", "vol.", "issue", "no.", "band", "heft", "tome", "volumen")
BOXES = S.phrases("box", "kasten", "encadré", "recuadro")


def box_number(c):
    """Number of a heading such as "Box 3", or null."""
    number = F.regexp_extract(S.told(c), BOXES.replace("(?<![^ ])", "^", 1) + r" ([0-9]+)(?![^ ])", 1).try_cast("int")
    return F.when(number > 0, number)


def is_year(c):
    """Whether a text is a number between 1700 and 2100."""
    n = S.to_number(c)
    return ~F.isnan(n) & (n > 1700) & (n < 2100)


def too_wide(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """blocks (doc_id, page, width) with too_wide: over 0.7 of half of the page, of the document's median line, or of that of two of three pages around.

    pages: doc_id, page, page_width, line_width (median of the page), doc_line_width.
    """
    w = Window.partitionBy("doc_id").orderBy("page").rangeBetween(-1, 1)
    near = pages.withColumn("_widths", F.collect_list("line_width").over(w))
    wide = (F.col("width") > 0.35 * F.col("page_width")) | (F.col("width") > 0.7 * F.col("doc_line_width")) | (F.size(F.filter("_widths", lambda x: F.col("width") > 0.7 * x)) >= 2)
    return blocks.join(near, ["doc_id", "page"]).withColumn("too_wide", wide).select(*blocks.columns, "too_wide")


def formula_score(c):
    """How much a text looks like a formula: operators and numbers for it, words against it by their length."""
    tokens = S.tokens(c)
    signs = F.create_map(*[F.lit(x) for k, v in FORMULA.items() for x in (k, v)])
    worth = lambda t: F.when(t.rlike(r"^\p{N}+$"), 1.0).when(t.rlike(r"^\p{Sm}"), F.coalesce(F.element_at(signs, t), F.lit(5.0))).when(F.element_at(signs, t).isNotNull(), F.element_at(signs, t)).when((F.length(t) <= 3) | t.rlike(r"^\P{L}"), 0.0).when(t.rlike(r"^\p{Lo}"), -2.0 * F.length(t)).when(t.rlike(r"^\p{Lu}"), -0.5 * F.length(t)).otherwise(-1.0 * F.length(t))
    return F.aggregate(F.transform(tokens, worth), F.lit(0.0), lambda a, x: a + x)


def is_formula(c):
    return formula_score(c) >= 5


def is_reference_entry(c, n_numbered):
    """Whether a block's text reads as an entry, or entries, of a list of references: enough words, and years, small numbers or full stops behind single words.

    n_numbered: its lines that start with a number; less than two of them are believed only in a short block.
    """
    t, n = S.tokens(c), n_numbered.cast("double")
    words, years = F.size(F.filter(t, lambda x: x.rlike(r"^\p{L}"))), F.size(F.filter(t, lambda x: x.rlike("^[0-9]{4}$") & is_year(x)))
    small = F.size(F.filter(t, lambda x: x.rlike("^[0-9]{1,3}$") & (x.cast("int") > 0)))
    stops = F.regexp_count(c, F.lit(r"(?:^|[^\p{L} ]) *\p{L}+\."))
    short = (n_numbered >= 2) | (F.length(c) / F.greatest(F.lit(1), n_numbered) <= 300)
    return short & (words >= 0.1 * F.size(t)) & ((small >= 1.5 * n) | (years >= 0.5 * n) | (stops >= 0.5 * n))


def page_filter(candidates: DataFrame) -> DataFrame:
    """The candidates (doc_id, ord, page, kind, numbering, plain) that the filters of pages let through.

    A page with MOST_CANDIDATES or more has none. Roman numerals and letters count from the document's first that is a one. A page with
    MOST_SINGLES single numbers or more has no numbered ones. A number set plainly (`plain`) goes if nothing was numbered before it and
    its page does not start at one, or if it is over three times its page.
    """
    page, before = Window.partitionBy("doc_id", "page"), Window.partitionBy("doc_id").orderBy("ord")
    first = F.get("numbering", F.lit(0))
    c = candidates.withColumn("_n", F.count(F.lit(1)).over(page)).where(F.col("_n") < MOST_CANDIDATES)
    single = (F.col("kind") == 1) & (F.size("numbering") == 1)
    c = c.withColumn("_singles", F.count(F.when(single, 1)).over(page)).withColumn("_least", F.min(F.when(F.col("kind") == 1, first)).over(page))
    c = c.withColumn("_earlier", F.max(F.when(F.col("kind") == 1, F.col("page"))).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    c = c.withColumn("_known", F.min(F.when(F.col("kind") == 1, F.col("page"))).over(Window.partitionBy("doc_id")) < F.col("page"))
    started = [F.max(F.when((F.col("kind") == k) & (first == 1), 1).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, 0)) == 1 for k in (2, 4)]
    number = (F.col("_singles") < MOST_SINGLES) & ~(F.col("plain") & ((~F.coalesce("_known", F.lit(False)) & (F.col("_least") > 1) & (F.size("numbering") <= 1)) | (first > 3 * F.col("page"))))
    c = c.withColumn("_ok", F.when(F.col("kind") == 2, started[0]).when(F.col("kind") == 4, started[1]).when(F.col("kind") == 1, number).otherwise(True))
    return c.where("_ok").select(candidates.columns)


def cover_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page, cover of pages (doc_id, page, weight, captions): light for the document, without captions, and early in it.

    Light is less than half of the document's median page (of 5,000 at most), or four fifths of that on later early pages; early is page
    1, or up to a fifth of the pages and 15 at most beyond it.
    """
    sums = pages.groupBy("doc_id").agg(F.median("weight").alias("median"), F.count(F.lit(1)).alias("n"))
    p = pages.join(sums, "doc_id").withColumn("bound", 0.5 * F.least("median", F.lit(5000.0)))
    light = ((F.col("page") <= 1) & (F.col("weight") < F.col("bound"))) | ((F.col("page") < 1 + F.least(F.lit(15.0), F.col("n") / 5)) & (F.col("weight") < 0.8 * F.col("bound")))
    return p.select("doc_id", "page", (light & ~F.col("captions")).alias("cover"))


def is_boilerplate(c, weight):
    """Whether a light block names an institution or a thesis, or has a professor's title at the start of each of its lines."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    titled = F.forall(lines, lambda x: S.starts_with_phrase(x, TITLES))
    return (weight < 200) & (S.told(c).rlike(INSTITUTIONS) | ((F.size(lines) > 0) & titled))


def boilerplate_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page of light pages of a document's front, of which four fifths by weight, in three blocks or more, are boilerplate.

    blocks: doc_id, page, text, weight, heading_score. pages: doc_id, page, weight. Front: pages 2 to 49 in the first half.
    """
    sums = pages.groupBy("doc_id").agg(F.median("weight").alias("median"), F.count(F.lit(1)).alias("n"))
    light = pages.join(sums, "doc_id").where("page > 1 and page < 50 and page - 1 < n / 2").where(F.col("weight") < F.greatest(F.lit(200.0), F.least(0.75 * F.col("median"), F.lit(1000.0)))).select("doc_id", "page")
    b = blocks.join(light, ["doc_id", "page"], "left_semi").withColumn("w", F.col("weight") * F.col("heading_score")).withColumn("bp", is_boilerplate(F.col("text"), F.col("weight")))
    out = b.groupBy("doc_id", "page").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("bp"), F.col("w")).otherwise(0.0)).alias("w"), F.count(F.when(F.col("bp"), 1)).alias("n"))
    return out.where((F.col("w") >= 0.8 * F.col("all")) & (F.col("n") >= 3)).select("doc_id", "page")


def number_columns(lines: DataFrame) -> DataFrame:
    """doc_id, page, block, first, last, length, increasing of blocks all of whose lines (doc_id, page, block, ln, text) up to a break are numbers.

    The run ends at a number below 1 or beyond 9,999, a fraction, or one that falls; increasing tells that none did. A text that is no
    number before that means no column.
    """
    w = Window.partitionBy("doc_id", "page", "block").orderBy("ln")
    x = lines.withColumn("x", S.to_number(F.col("text")))
    bad = ~((F.col("x") > 0) & (F.col("x") == F.ceil("x")) & (F.col("x") < 10_000)) | (F.lag("x").over(w) > F.col("x"))
    x = x.withColumn("_stop", F.when(F.isnan("x"), 2).when(bad, 1).otherwise(0))
    x = x.withColumn("_before", F.coalesce(F.max("_stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    good = (F.col("_stop") == 0) & (F.col("_before") == 0)
    first_stop = F.min_by("_stop", F.when(F.col("_stop") > 0, F.col("ln")))
    out = x.groupBy("doc_id", "page", "block").agg(F.min(F.when(good, F.col("x"))).alias("first"), F.max(F.when(good, F.col("x"))).alias("last"), F.count(F.when(good, 1)).alias("length"), first_stop.alias("stop"))
    return out.where("stop is null or stop = 1").select("doc_id", "page", "block", F.coalesce("first", F.lit(0.0)).cast("int").alias("first"), F.coalesce("last", F.lit(0.0)).cast("int").alias("last"), "length", F.col("stop").isNull().alias("increasing"))


def running_matter(blocks: DataFrame, known: DataFrame, n_pages: DataFrame, top: bool = True) -> DataFrame:
    """doc_id, page, ix of blocks that are running matter by place and likeness, after others were found by their text.

    blocks: doc_id, page, ix, cy (centre), edge (the upper one for headers, the lower for footers), text. known: doc_id, page, ix, cy,
    weight, text of what is found already, from a twentieth of the pages at least (n_pages: doc_id, n_pages). A block beyond the 20th
    (headers) or 80th weighted percentile of the known centres goes with them if it is a volume and a number, or differs by less than
    half of the shorter from one of the three texts known most often (on a twentieth of the pages).
    """
    from quire.operators import stats

    cut = stats.weighted_percentile(known, ["doc_id"], "cy", "weight", 0.2 if top else 0.8).withColumnRenamed("cy", "cut")
    sure = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).join(n_pages, "doc_id").where(F.col("k") >= F.col("n_pages") / 20).select("doc_id")
    by = known.groupBy("doc_id", T.normalized(F.col("text")).alias("t")).agg(F.count(F.lit(1)).alias("c"), F.min("page").alias("p")).join(n_pages, "doc_id").where(F.col("c") >= F.col("n_pages") / 20)
    most = by.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("c"), "p", "t"))).where("r <= 3").groupBy("doc_id").agg(F.collect_list("t").alias("tops"))
    b = blocks.join(known.select("doc_id", "page", "ix"), ["doc_id", "page", "ix"], "left_anti").join(sure, "doc_id", "left_semi").join(cut, "doc_id").join(most, "doc_id")
    b = b.where(F.col("edge") >= F.col("cut") if top else F.col("edge") <= F.col("cut"))
    key = T.normalized(F.col("text"))
    half = lambda t: F.least(F.length(key), F.length(t)) / 2
    close = F.exists("tops", lambda t: (F.abs(F.length(key) - F.length(t)) < half(t)) & (T.bounded_edit_distance(key, t, half(t)) < half(t)))
    volume = S.told(F.col("text")).rlike(VOLUMES + r" [0-9]")
    return b.where(volume | ((F.regexp_count("text", F.lit(r"\p{L}")) >= 5) & close)).select("doc_id", "page", "ix")


def neighbours(blocks: DataFrame, page_width: float) -> DataFrame:
    """doc_id, page, ix, above, below, body_above, body_below of blocks (doc_id, page, ix, left, right, top, bottom, body): the nearest block above and below that shares an x bucket, and the nearest body block.

    Buckets are five points wide, or a 300th of the page. A block is told by bucket, and in each bucket its neighbours are those before
    and after it from the top down; so blocks are never paired. Where buckets differ, the nearest edge counts. Blocks are dealt out
    once, by page, before they are told by bucket.
    """
    step = max(5.0, page_width / 300)
    bucket = F.explode(F.sequence(F.floor(F.col("left") / step), F.floor(F.col("right") / step)))
    b = blocks.select("doc_id", "page", "ix", "left", "right", "top", "bottom", "body").repartition("doc_id", "page").select("doc_id", "page", "ix", "top", "bottom", "body", bucket.alias("x"))
    down = Window.partitionBy("doc_id", "page", "x").orderBy(F.desc("top"), F.desc("bottom"), "ix")
    here, mark = F.struct("ix", "top", "bottom"), F.when(F.col("body"), F.struct("ix", "top", "bottom"))
    b = b.withColumn("a", F.lag(here).over(down)).withColumn("z", F.lead(here).over(down)).withColumn("ba", F.last(mark, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)))
    up = Window.partitionBy("doc_id", "page", "x").orderBy("top", "bottom", F.desc("ix"))
    b = b.withColumn("bz", F.last(mark, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)))
    nearest = lambda c, edge: F.min_by(F.col(f"{c}.ix"), F.when(F.col(c).isNotNull(), F.struct(F.abs(edge), F.col(f"{c}.ix"))))
    return b.groupBy("doc_id", "page", "ix").agg(nearest("a", F.col("a.bottom") - F.col("top")).alias("above"), nearest("z", F.col("bottom") - F.col("z.top")).alias("below"), nearest("ba", F.col("ba.bottom") - F.col("top")).alias("body_above"), nearest("bz", F.col("bottom") - F.col("bz.top")).alias("body_below"))
