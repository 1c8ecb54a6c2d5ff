"""Run-in headings: a block that begins in another style than it goes on, cut where the style changes and judged by what stands before the cut.

Spans: doc_id, page, block, line (from 0 in the block), ix (order), text (with its blanks), font, bold, italic, size, left, right, top, bottom.
Blocks: doc_id, page, block, body (whether a paragraph of body text), body_size (of the document), above_bottom, above_right, above_word (the block
above, if any: its lower edge, its last line's right edge, and whether it ends in a word).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.classify import ABSTRACT, INTRODUCTION

#: Words that stand alone as section headings, those that begin a list of keywords, and those before a chapter's number. Own lists.
SECTIONS = ("methods", "materials and methods", "results", "discussion", "conclusion", "conclusions", "background", "acknowledgements", "acknowledgments", "references", "related work", "limitations")
KEYWORDS = r"(?i)^\s*(?:key\s?words|index terms|schlüsselwörter|mots[- ]clés|palabras clave)\W*$"
CHAPTER = r"(?i)^\s*(?:chapter|kapitel|chapitre|capítulo|appendix|part)\s+(?:[0-9]+|[ivxlc]+|[a-h])\b"
ENDS = r"[.:;,!?\-–—)\]]\s*$"
BLOCK = ["doc_id", "page", "block"]


def loud(c):
    """Whether capitals make up a text: three quarters of its letters or all but four, more than three and a third of all."""
    upper, letters = F.regexp_count(c, F.lit(r"[\p{Lu}\p{Lt}]")), F.regexp_count(c, F.lit(r"[\p{Lu}\p{Lt}\p{Ll}\p{Lo}]"))
    return (upper > F.greatest(0.75 * letters, letters - 4)) & (upper > F.greatest(F.lit(3.0), F.length(c) / 3))


def titled(c):
    """Whether words in capitals outnumber those in small letters (and are more than two), no small one being long."""
    words = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    n = lambda p: F.size(F.filter(words, lambda w: w.rlike(p)))
    return (n(r"^\p{Lu}") > F.greatest(F.lit(2), n(r"^\p{Ll}"))) & (n(r"^\p{Ll}\P{Lu}.{3,}") == 0)


def cut(spans: DataFrame) -> DataFrame:
    """A row for each block of two lines or more that begins in another style than it goes on: head and rest (texts), and what the rules ask of the block.

    Where the first line is bold in part, the head is its leading bold spans; else, where the last span's font is not the first one's, and no more than a
    quarter of the other lines begin with that, the leading spans in the first font on the first two lines. A word that the cut parts
    goes to the head. Gaps and islands over the spans of a block, by windows.
    """
    order = Window.partitionBy(*BLOCK).orderBy("line", "ix")
    whole = Window.partitionBy(*BLOCK)
    n = F.length("text")
    share = lambda c, of: F.sum(F.when(F.col(c) & of, n).otherwise(0)).over(whole) / F.sum(F.when(of, n).otherwise(0)).over(whole)
    first_line = F.col("line") == 0
    s = spans.withColumn("lines", F.max("line").over(whole) + 1).withColumn("bold_first", share("bold", first_line)).withColumn("italics", share("italic", F.lit(True)))
    s = s.withColumn("nth", F.row_number().over(order)).withColumn("nth_in_line", F.row_number().over(Window.partitionBy(*BLOCK, "line").orderBy("ix")))
    first, last = lambda c: F.first(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), lambda c: F.last(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("font0", first("font")).withColumn("font9", last("font"))
    others = F.sum(F.when((F.col("line") > 0) & (F.col("nth_in_line") == 1) & (F.col("font") == F.col("font0")), 1).otherwise(0)).over(whole)
    partly = (F.col("bold_first") > 0) & (F.col("bold_first") < 1)
    leads = F.when(partly, first_line & F.col("bold")).otherwise((F.col("font9") != F.col("font0")) & (others <= F.col("lines") / 4) & (F.col("font") == F.col("font0")) & (F.col("line") <= 1))
    s = s.where("lines >= 2").withColumn("leads", leads).withColumn("stopped", F.max((~F.col("leads")).cast("int")).over(order))
    head = F.col("stopped") == 0
    text = lambda of: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(of, F.struct("nth", "text")))), lambda x: x["text"]), "")
    at = lambda c, of, by: F.min_by(F.when(of, F.col(c)), F.when(of, by))
    out = s.groupBy(*BLOCK).agg(
        text(head).alias("head"), text(~head).alias("rest"), at("bold", F.col("nth") == 1, F.col("nth")).alias("bold"), at("italic", F.col("nth") == 1, F.col("nth")).alias("italic"), at("size", F.col("nth") == 1, F.col("nth")).alias("first_size"),
        at("italic", ~head, F.col("nth")).alias("next_italic"), at("line", ~head, F.col("nth")).alias("next_line"), F.max(F.when(head, F.col("line"))).alias("head_line"), F.max("italics").alias("italics"), (F.sum(F.col("size") * n) / F.sum(n)).alias("size"),
        (F.sum(F.when(first_line, F.col("size") * n)) / F.sum(F.when(first_line, n))).alias("line_size"), F.max(partly).alias("partly"),
        *[(F.min if c in ("left", "bottom") else F.max)(F.when(F.col("line") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("left", "right", "top", "bottom")], *[text(F.col("line") == k).alias(f"text{k}") for k in (0, 1)],
    ).where("head <> '' AND rest <> ''")
    word = F.when((F.col("next_line") == F.col("head_line")) & F.col("head").rlike(r"[\p{L}\p{N}]$"), F.regexp_extract("rest", r"^[\p{L}\p{M}\p{N}]+", 0)).otherwise("")
    out = out.withColumn("word", word).withColumn("head", F.concat("head", "word")).withColumn("rest", F.substring("rest", F.length("word") + 1, F.length("rest")))
    return out.where("trim(rest) <> ''").drop("word")


def run_in_headings(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page, block, kind, numbering, title, rest of the blocks that begin with a heading: kind 1 numbered, 8 a chapter, 5 abstract, 11 introduction, 6 a section's usual word, 0 by style.

    A number of several parts, a chapter, an abstract or an introduction is one as it is. Else the head must end in a mark, and be in capitals before a
    paragraph, or begin in italics, with a capital, where the rest is upright and begins a sentence, and stand off from what is above.
    """
    c = cut(spans).join(blocks, BLOCK)
    head = F.trim("head")
    words = F.regexp_extract_all("head", F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    letters = F.size(F.filter(words, lambda w: (F.length(w) > 1) | (~F.col("partly") & w.rlike(r"\p{Lo}"))))
    plain = (letters > 0) & ~(~F.col("bold") & ~F.col("italic") & (F.col("italics") > 0.5)) & ~(~F.col("bold") & (F.col("first_size") < F.col("size") + 1) & F.col("rest").rlike(r"^\s*\p{Ll}")) & ~F.col("head").rlike(KEYWORDS)
    c = c.where(plain).withColumn("numbering", T.numbering(head)).withColumn("title", F.trim(F.when(F.col("numbering").isNotNull(), F.regexp_replace(head, r"^\s*[0-9.]+[.)]?\s+", "")).otherwise(head))).withColumn("letters", letters)
    parts = F.size(F.split("numbering", r"\."))
    key, title_key = T.normalized(head), T.normalized(F.col("title"))
    both = F.concat("head", "rest")
    body = ~loud(both) & F.col("body") & (F.regexp_count(both, F.lit(r"\p{L}")) + 0.5 * F.regexp_count(both, F.lit(r"\P{L}")) >= 100)
    caps = body & loud(F.col("head")) & (F.regexp_count("head", F.lit(r"\p{Lu}")) <= F.regexp_count(both, F.lit(r"\p{Ll}")))
    width = (F.col("right0") - F.col("left0")) / F.greatest(F.lit(1), F.length("text0"))
    gap = F.coalesce(F.col("above_bottom") - F.col("top0"), F.lit(float("inf")))
    apart = (gap > 1.1 * (F.col("bottom0") - F.col("top1"))) | F.coalesce("above_word", F.lit(False)) | F.coalesce(F.col("above_right") < F.col("right0") - 8 * width, F.lit(False))
    full = (F.col("right0") > F.col("right1") - 4 * width) | ~F.col("text0").rlike(r"[.?!]\s*$") | F.col("text1").rlike(r"^\s*\p{Ll}")
    slanted = F.col("italic") & ~F.col("next_italic") & apart & full & F.col("head").rlike(r"^[^\p{L}]*\p{Lu}") & F.col("rest").rlike(r"^\s*\p{Lu}")
    marked = (F.col("line_size") >= F.col("body_size") - 2) & F.col("head").rlike(ENDS)
    section = key.isin(*SECTIONS)
    kind = (
        F.when(parts > 1, 1).when(F.col("numbering").isNotNull() & (title_key.isin(*INTRODUCTION) | titled(F.col("title"))), 1).when((F.size(words) > 2) & F.col("head").rlike(CHAPTER), 8)
        .when(key.isin(*ABSTRACT), 5).when(key.isin(*INTRODUCTION), 11).when(marked & caps, F.when(F.col("numbering").isNotNull(), 1).when(section, 6).otherwise(0)).when(marked & slanted & (section | (F.col("letters") > 1)), F.when(section, 6).otherwise(0))
    )
    out = c.withColumn("kind", kind).where("kind is not null")
    title = F.when(F.col("kind") == 8, F.regexp_replace("title", r"[.:;,\s]+$", "")).otherwise(F.col("title"))
    return out.select(*BLOCK, "kind", "numbering", title.alias("title"), F.trim("rest").alias("rest"))
