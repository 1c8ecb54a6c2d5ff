"""Classification of lines and blocks: headers and footers, recurring text, tables of contents, body text, captions, headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.functions import text as T
from quire.operators import figures

#: Keywords by kind. Own lists.
ABSTRACT, REFERENCES, INTRODUCTION = ("abstract", "summary"), ("references", "bibliography"), ("introduction",)
CONTENTS = ("contents", "table of contents", "inhalt", "sommaire", "índice")


def recurring(lines: DataFrame, least: int = 2) -> DataFrame:
    """text, n: exact texts that occur in so many lines."""
    return lines.groupBy("text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def running_heads(lines: DataFrame, pages_apart: int = 3) -> DataFrame:
    """doc_id, page, text: first lines of pages whose text heads another page of the document within so many pages.

    The self-join is by document and text with a band of pages, written as a window over the pages with one text.
    """
    first = lines.groupBy("doc_id", "page").agg(F.min_by("text", "ln").alias("text"))
    w = Window.partitionBy("doc_id", "text").orderBy("page")
    near = (F.col("page") - F.lag("page").over(w) <= pages_apart) | (F.lead("page").over(w) - F.col("page") <= pages_apart)
    return first.withColumn("near", F.coalesce(near, F.lit(False))).where("near").drop("near")


def adjacent_numbers(numbered: DataFrame) -> DataFrame:
    """doc_id, page, number of those that have number ± d on page ± d for d in 1, 2, 4: equi-joins on shifted keys."""
    shifted = numbered.select("doc_id", F.explode(F.array(*[F.struct((F.col("page") + d).alias("page"), (F.col("number") + d).alias("number")) for d in (-4, -2, -1, 1, 2, 4)])).alias("s")).select("doc_id", "s.page", "s.number").distinct()
    return numbered.join(shifted, ["doc_id", "page", "number"], "left_semi").distinct()


def watermarks(spans: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, text, n: skewed texts that a document repeats."""
    return spans.where("skew >= 1").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def contents_pages(lines: DataFrame, rows: int = 5) -> DataFrame:
    """doc_id, page, leaders, titled: pages with so many dot-leader rows, or with a contents title."""
    title = T.normalized(F.col("text")).isin(*CONTENTS)
    return lines.groupBy("doc_id", "page").agg(F.sum(F.when(T.is_dot_leader_row(F.col("text")), 1).otherwise(0)).alias("leaders"), F.max(title).alias("titled")).where((F.col("leaders") >= rows) | F.col("titled"))


def is_body(text, least_chars: int = 40, least_words: int = 6):
    """Whether a line reads as body text: long enough, mostly letters, not all capitals, no row of a table."""
    letters, upper = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Lu}"))
    return (F.length(text) >= least_chars) & (F.size(F.split(F.trim(text), r"\s+")) >= least_words) & (letters >= 0.6 * F.length(text)) & (upper < 0.5 * letters) & ~text.contains("|")


def title_scores(lines: DataFrame) -> DataFrame:
    """doc_id, ln, score of the first best title among a document's first page: a product of factors for length, place, case and stops."""
    n = F.length("text")
    score = F.when(n.between(8, 120), 1.0).otherwise(0.2) * (1.0 / (1 + F.col("ln"))) * F.when(F.col("text").rlike(r"[.;:]\s*$"), 0.5).otherwise(1.0) * F.when(F.col("text").rlike(r"^\p{Lu}"), 1.0).otherwise(0.6) * F.when(F.col("text").contains("|"), 0.1).otherwise(1.0)
    first = lines.where("page = 1 and length(text) > 0").select("doc_id", "ln", score.alias("score"))
    best = first.groupBy("doc_id").agg(F.min_by(F.struct("ln", "score"), F.struct((-F.col("score")).alias("a"), F.col("ln").alias("b"))).alias("b"))
    return best.select("doc_id", "b.ln", "b.score")


def title_echoes(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, ln of lines that repeat the document's title (doc_id, title): one starts with the other, over 20 characters, or nearly equal."""
    both = lines.join(titles, "doc_id").where("ln > title_ln")
    least = F.least(F.length("text"), F.length("title"))
    alike = (least > 20) & (F.col("text").startswith(F.col("title")) | F.col("title").startswith(F.col("text")))
    close = (F.abs(F.length("text") - F.length("title")) < 0.2 * least) & (T.bounded_edit_distance(F.col("text"), F.col("title"), 0.2 * least) < 0.2 * least)
    return both.where(alike | close).select("doc_id", "ln")


def captions(lines: DataFrame) -> DataFrame:
    """doc_id, ln, label, number: lines that start with a caption word and a number and are no reference, the first of each label (4 figure, 5 table, 11 chart) and number."""
    found = figures.captions(lines.select("doc_id", "page", F.col("ln").alias("reading"), "text", F.lit(0).alias("kind"))).where("length(label) > 1")
    return found.select("doc_id", F.col("reading").alias("ln"), F.col("kind").alias("label"), F.substring("label", F.lit(2), F.length("label")).alias("number")).groupBy("doc_id", "label", "number").agg(F.min("ln").alias("ln"))


#: Words before the number of a chapter, an appendix and a box. Own lists. Chinese numerals.
CHAPTERS, APPENDICES, BOXED = "chapter|kapitel|chapitre|capítulo", "appendix|anhang|annexe|anexo", "box|kasten|encadré|recuadro"
NUMERALS = "一二三四五六七八九十"


def chinese_number(c):
    """Value of a Chinese numeral up to 99, or null."""
    tens, ones = F.regexp_extract(c, "^([一二三四五六七八九]?)十[一二三四五六七八九]?$", 1), F.regexp_extract(c, "([一二三四五六七八九])$", 1)
    return F.when(c.rlike("^[一二三四五六七八九]$"), F.instr(F.lit(NUMERALS), c)).when(c.rlike("^[一二三四五六七八九]?十[一二三四五六七八九]?$"), 10 * digit_of(tens) + F.when(ones == "", 0).otherwise(F.instr(F.lit(NUMERALS), ones)))


def digit_of(c):
    return F.when(c == "", 1).otherwise(F.instr(F.lit(NUMERALS), c))


def heading_label(c):
    """struct(kind, numbers, title) of a heading with a label: 8 a chapter, 10 an appendix, 12 a box, 2 a roman numeral, 3 a Chinese one, 4 a letter, perhaps with a number below 20; null kind where there is none, or nothing but a label of the last three."""
    ends = r"(?:[.．｡。:：)）、]|\s|$)\s*"
    number = lambda x: F.coalesce(F.when(x.rlike("^[0-9]+$"), x.try_cast("int")), T.roman_value(x))
    get = lambda p, k: F.regexp_extract(c, p, k)
    chapter, han = rf"^\s*(?i:{CHAPTERS})\s+([0-9]+|(?i:[ivxlc]+)){ends}", r"^\s*第([0-9]+|[一二三四五六七八九十]+)[章节節篇]\s*"
    appendix, box = rf"^\s*(?i:{APPENDICES}|附录|附錄)\s*([0-9]+|[IVX]+|[A-H]){ends}", rf"^\s*(?i:{BOXED})\s+([1-9][0-9]*){ends}"
    roman, numeral, letter = r"^\s*([IVX]+)[.．｡。:)]\s*", rf"^\s*([{NUMERALS}])[、.．:：)）]\s*", r"^\s*([A-Ha-h])(?:\.([0-9]+)[.)]?(?=\s)|[.)])\s*"
    found = lambda kind, p, numbers, bare: F.when(c.rlike(p) & (F.lit(bare) | (F.regexp_replace(c, p, "") != "")), F.struct(F.lit(kind).alias("kind"), numbers.alias("numbers"), F.regexp_replace(c, p, "").alias("title")))
    one = lambda x: F.filter(F.array(x.cast("int")), lambda v: v.isNotNull())
    second = get(letter, 2).try_cast("int")
    letters = F.filter(F.array(S.letter_ordinal(get(letter, 1)).cast("int"), second), lambda v: v.isNotNull())
    good = second.isNull() | ((second > 0) & (second < 20))
    return F.coalesce(
        found(8, chapter, one(number(get(chapter, 1))), True), found(8, han, one(F.coalesce(number(get(han, 1)), chinese_number(get(han, 1)))), True), found(10, appendix, one(F.coalesce(number(get(appendix, 1)), S.letter_ordinal(get(appendix, 1)))), True), found(12, box, one(number(get(box, 1))), True),
        found(2, roman, one(T.roman_value(get(roman, 1))), False), found(3, numeral, one(chinese_number(get(numeral, 1))), False), F.when(good, found(4, letter, letters, False)),
    )


def headings(lines: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, page, ln, kind, numbering, and the columns `more` of lines: heading candidates in order of detectors: keyword, chapter, numbered, roman, letter.

    kind: 5 abstract, 7 references, 11 introduction, 8 chapter, 1 numbered, 2 roman, 4 letter, 3 Chinese numeral, 10 appendix, 12 box.
    """
    text = F.col("text")
    key = T.normalized(F.regexp_replace(text, r"^\s*[0-9.]+\s+", ""))
    chapter = text.rlike(r"^\s*(?i)(?:chapter|kapitel|chapitre|capítulo)\s+(?:[0-9]+|[ivxlc]+)\b")
    kind = F.when(key.isin(*ABSTRACT), 5).when(key.isin(*REFERENCES), 7).when(key.isin(*INTRODUCTION), 11).when(chapter, 8).when(T.numbering(text).isNotNull() & text.rlike(r"\p{L}"), 1).when(text.rlike(r"^\s*(?:[IVX]+)[.)]\s+\p{L}"), 2).when(text.rlike(r"^\s*[A-H][.)]\s+\p{L}"), 4).otherwise(heading_label(text)["kind"])
    short = (F.length(text) <= 120) & ~text.rlike(r"[.;,]\s*$") & ~text.contains("|")
    return lines.where(short).select("doc_id", "page", "ln", kind.alias("kind"), T.numbering(text).alias("numbering"), *more).where("kind is not null")


def section_openers(found: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """The first heading candidate of each page, those without ln last; of several with one ln the first by the columns `ties`."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.asc_nulls_last("ln"), *ties)
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sibling_counts(found: DataFrame) -> DataFrame:
    """doc_id, parent, siblings: distinct last numbers by numbering prefix."""
    parts = F.split("numbering", r"\.")
    return found.where("numbering is not null").select("doc_id", F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".").alias("parent"), F.element_at(parts, -1).alias("last")).groupBy("doc_id", "parent").agg(F.count_distinct("last").alias("siblings"))
