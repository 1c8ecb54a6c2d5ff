"""Inputs that the driver's tables stand in for: page texts and lines of documents, bookmarks, spans, document records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines on a page.
PAGE_LINES = 8


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, page, ln (from 0 in the document), text."""
    out = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "text"))
    return out.select("doc_id", (F.floor(F.col("ln") / PAGE_LINES) + 1).cast("int").alias("page"), "ln", "text")


def page_text(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, page, markdown."""
    whole = F.split("text", "\n")
    pages = F.transform(F.sequence(F.lit(0), F.ceil(F.size(whole) / PAGE_LINES).cast("int") - 1), lambda p: F.array_join(F.slice(whole, p * PAGE_LINES + 1, PAGE_LINES), "\n"))
    return table(spark, d, "documents").select("doc_id", F.posexplode(pages).alias("p", "markdown")).select("doc_id", (F.col("p") + 1).alias("page"), "markdown")


def order_lines(spark: SparkSession, d: str, by: dict | None = None) -> DataFrame:
    """lineitem with n, from 1 in each order: line numbers repeat. With columns `by` (by name), which the order tells, rows are dealt out by them alone and sorted by them first, once."""
    li = table(spark, d, "lineitem")
    if by:
        li = li.repartition(*by.values()).withColumns(by)
    w = Window.partitionBy(*(by or ()), "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.withColumn("n", F.row_number().over(w))


def bookmarks(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, ord, title, level, page: an order is a document, its lines are its bookmarks."""
    return order_lines(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.col("n").alias("ord"), F.concat(F.lit("Part "), (F.col("l_partkey") % 12).cast("string")).alias("title"), (F.col("l_suppkey") % 3 + 1).cast("int").alias("level"), (F.col("n") * 3 + F.col("l_quantity") % 9 - 2).cast("int").alias("page"))


def doc_pages(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, n_pages of the documents with bookmarks."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 5 + 20).cast("int").alias("n_pages"))


def spans(spark: SparkSession, d: str, by_page: bool = False) -> DataFrame:
    """doc_id, page, ix, left, right, top, bottom, text, size, bold, skew: boxes made from the lines of orders. by_page: dealt out once, by page, and sorted by it."""
    doc, page = F.col("l_orderkey") % 997, (F.col("l_orderkey") % 5 + 1).cast("int")
    li = order_lines(spark, d)
    if by_page:
        li, doc, page = order_lines(spark, d, {"doc_id": doc, "page": page}), F.col("doc_id"), F.col("page")
    left, top = (F.col("l_quantity") * 10), (F.col("l_partkey") % 700).cast("double")
    return li.select(doc.alias("doc_id"), page.alias("page"), (F.col("l_orderkey") * 64 + F.col("n")).alias("ix"), left.alias("left"), (left + 40 + F.col("l_discount") * 100).alias("right"), (top + 8 + F.col("l_linenumber")).alias("top"), top.alias("bottom"), F.concat("l_returnflag", F.lit(" "), "l_linestatus", F.lit(" "), (F.col("l_suppkey") % 40).cast("string")).alias("text"), (F.col("l_linenumber") + 7).cast("double").alias("size"), (F.col("l_returnflag") == "A").alias("bold"), F.when(F.col("l_linenumber") == 7, 1.0).otherwise(0.0).alias("skew"))


def drawn_pages(spark: SparkSession, d: str) -> DataFrame:
    """page_text with image_coverage and path_objects by document, and texts of some documents made bare, vowelless or bad, so that every label occurs."""
    doc, t = F.col("doc_id"), F.col("markdown")
    made = F.when(doc % 11 == 0, F.substring(t, 1, 15)).when(doc % 11 == 1, F.translate(t, "aeiouyAEIOUY", "")).when(doc % 11 == 2, F.concat(F.repeat(F.lit("\ufffd"), 200), t)).otherwise(t)
    return page_text(spark, d).select("doc_id", "page", made.alias("markdown"), (doc % 10 / F.lit(10.0)).alias("image_coverage"), (doc % 7 * 40).alias("path_objects"))


def made_bookmarks(spark: SparkSession, d: str) -> DataFrame:
    """bookmarks with titles of every kind, by order: generic, with two counters, content units, one counter, told apart, all alike, mixed."""
    n, x = F.col("ord").cast("string"), F.col("doc_id") % 7
    mixed = F.element_at(F.array(*[F.lit(t) for t in MIXED]), (F.col("ord") % len(MIXED) + 1).cast("int"))
    title = F.when(x == 0, F.concat(F.lit("Page "), n)).when(x == 1, F.concat(F.lit("file "), n, F.lit(" v"), n)).when(x == 2, F.concat(F.lit("Chapter "), n)).when(x == 3, F.concat(F.lit("Item "), n)).when(x == 4, F.concat(F.translate(n, "0123456789", "abcdefghij"), F.lit(" – Word"))).when(x == 5, F.lit("Notes")).otherwise(mixed)
    return bookmarks(spark, d).withColumn("title", title)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Heading candidates of every kind, made from the lines of orders."""
    o, n = order_lines(spark, d), F.col("n")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("l_partkey") % len(KINDS) + 1).cast("int"))
    one, two = F.array(n.cast("int")), F.array(n.cast("int"), (F.col("l_suppkey") % 3 + 1).cast("int"))
    numbers = F.when((kind == 1) & (F.col("l_suppkey") % 2 == 0), two).when(kind.isin(1, 2, 4), one).otherwise(F.expr("cast(array() as array<int>)"))
    size = (F.col("l_suppkey") % 4 + 10).cast("double")
    return o.select(F.col("l_orderkey").alias("doc_id"), n.cast("int").alias("ord"), (n * 2 + F.col("l_partkey") % 2).cast("int").alias("page"), (F.col("l_quantity") % 10 / 10).alias("y_frac"), kind.alias("kind"), numbers.alias("numbering"), (kind.isin(5, 8) | (F.col("l_suppkey") % 5 == 0)).alias("prominent"), F.concat(F.lit("Heading "), (F.col("l_partkey") % 3).cast("string")).alias("title"), F.concat(F.lit("f"), (F.col("l_suppkey") % 4).cast("string")).alias("style"), size.alias("size"), (size + F.col("l_partkey") % 2).alias("score"), (F.col("l_partkey") % 2 == 0).alias("caps"), (F.col("l_suppkey") % 6 == 0).alias("centred"), F.lit(0.0).alias("italic"), (F.col("l_suppkey") % 2).cast("double").alias("bold"), (F.col("l_quantity") % 2 == 0).alias("at_top"), (F.col("l_quantity") * 100).alias("body"))


KINDS = (0, 1, 2, 4, 5, 8, 11)


def margin_parts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, page, seq, part, text, left, right, top, bottom, font, size, bold, skew: two lines of a document a page, under a running head that is misspelled, moved or larger on some pages, over page numbers, copyright or a volume."""
    whole = F.split("text", "\n")
    doc, p = F.col("doc_id"), F.col("page")
    pages = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.size(whole) / 2).cast("int") - 1), lambda i: F.slice(whole, i * 2 + 1, 2))).alias("at", "two")).withColumn("page", F.col("at") + 1)
    high = F.lit(800.0) - F.when(p % 3 == 2, 12).otherwise(0)

    def part(seq, n, text, left, top, when=True, size=10.0, skew=0.0):
        return F.when(F.lit(when), F.struct(F.lit(seq).alias("seq"), F.lit(n).alias("part"), text.alias("text"), F.lit(left).alias("left"), F.lit(top).cast("double").alias("top"), F.lit(size).cast("double").alias("size"), F.lit(skew).cast("double").alias("skew")))

    two = lambda i: F.coalesce(F.get("two", F.lit(i)), F.lit(""))
    rows = F.array(
        part(0, 0, F.concat(F.when((doc + p) % 4 == 3, "Yearly reviev of ").otherwise("Yearly review of "), "source"), 50.0, high, size=F.when((doc + p) % 5 == 4, 11.0).otherwise(10.0)),
        part(1, 0, F.concat(F.lit("Part "), (doc % 5).cast("string")), 400.0, F.lit(800.0), doc % 3 == 0),
        part(1, 1, p.cast("string"), 450.0, F.lit(800.0), doc % 3 == 0),
        part(2, 0, two(0), 50.0, F.lit(760.0)),
        part(3, 0, two(1), 50.0, F.lit(720.0), skew=F.when(doc % 13 == 0, 1.5).otherwise(0.0)),
        part(8, 0, F.when(doc % 5 == 0, F.concat(F.lit("Copyright 2021 "), "source")).otherwise((p + 3).cast("string")), 280.0, F.lit(60.0)),
        part(9, 0, F.concat(F.lit("Vol. "), (doc % 9).cast("string"), F.when(p % 2 == 0, ", draft").otherwise(", drafts")), 280.0, F.lit(45.0), doc % 7 == 0),
    )
    out = pages.select("doc_id", "page", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("doc_id", "page", "x.*")
    return out.select("doc_id", "page", "seq", "part", "text", "left", (F.col("left") + F.least(F.lit(500), F.length("text") * 6)).alias("right"), "top", (F.col("top") - 10).alias("bottom"), F.lit("f1").alias("font"), "size", F.lit(False).alias("bold"), "skew")


def margin_pages(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, page, page_height, page_width, page_size, body_size of the pages of margin_parts."""
    n = F.ceil(F.size(F.split("text", "\n")) / 2).cast("int")
    return table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), n)).alias("page")).select("doc_id", "page", F.lit(842.0).alias("page_height"), F.lit(600.0).alias("page_width"), F.lit(10.0).alias("page_size"), F.lit(10.0).alias("body_size"))


def column_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines in two columns under headings, with numbered notes, marks and leaders among them: the spans of a page moved to a grid by their ids."""
    i = F.col("ix") % 60
    text = F.when(i % 11 == 0, F.concat((i % 9 + 1).cast("string"), F.lit(". "), "text")).when(i % 13 == 0, F.concat(F.lit("["), i.cast("string"), F.lit("]"))).when(i % 17 == 0, F.concat("text", F.lit(" . . . . . ."))).otherwise(F.concat("text", F.lit(" running text of a line")))
    head = (F.col("ix") % 7 == 0)
    left = F.when(head, 40.0).when(i % 2 == 0, 40.0 + F.col("ix") % 3).otherwise(320.0)
    bottom = (F.lit(760.0) - F.floor(i / 2) * 24 + F.when(i % 5 == 0, 3).otherwise(0)).cast("double")
    size = F.when(head, 14.0).otherwise(10.0)
    return spans(spark, d).select("doc_id", "page", "ix", left.alias("left"), (left + F.when(head, 500.0).otherwise(150.0 + F.col("ix") % 90)).alias("right"), (bottom + size).alias("top"), bottom.alias("bottom"), text.alias("text"), size.alias("size"))


def column_pages(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, page, size, overlap_gap, char_width of the pages of column_lines."""
    return spans(spark, d).groupBy("doc_id", "page").agg(F.lit(10.0).alias("size"), (F.lit(14.0) + F.count(F.lit(1)) % 4).cast("double").alias("overlap_gap"), F.lit(5.0).alias("char_width"))


#: Texts of blocks that begin like captions, and others.
CAPTIONED = ("Figure {} Plot of it", "TABLE {} SUMS OF ALL THE YEARS", "Fig. {} shows that the rest holds", "Table II.{} sums", "Chart B{}: bars", "图{} 总论", "A line of text {}", "II. Heading {}", "Plain words", "Tables {} and more")


def figure_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of pages with captions of every kind among them: the spans of a page in order of height, with made texts."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("top"), "left", "ix")
    i = F.col("ix") % 23
    text = F.element_at(F.array(*[F.concat(*[F.lit(x) if x else (F.col("ix") % 6).cast("string") for y in t.split("{}") for x in (y, "")][:-1]) for t in CAPTIONED]), (i % len(CAPTIONED) + 1).cast("int"))
    return spans(spark, d).select("doc_id", "page", (F.row_number().over(w) - 1).alias("reading"), F.when(F.col("left") < 275, 0).otherwise(1).alias("column"), "left", "right", "top", "bottom", text.alias("text"), "size", (F.col("size") + i % 3).alias("score"), (i % 4 + 1).cast("int").alias("n_lines"), "skew", F.when(i == 19, 1).otherwise(0).alias("kind"), (i % 7 == 6).alias("body"))


def figure_pages(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, page, left, right, top, bottom, size, overlap_gap, body_size of the pages of figure_blocks."""
    return spans(spark, d).select("doc_id", "page").distinct().select("doc_id", "page", F.lit(0.0).alias("left"), F.lit(600.0).alias("right"), F.lit(800.0).alias("top"), F.lit(0.0).alias("bottom"), F.lit(10.0).alias("size"), F.lit(13.0).alias("overlap_gap"), F.lit(10.0).alias("body_size"))


def figure_columns(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, page, column, left, right, top, bottom: two columns a page."""
    box = lambda c, lo, hi: F.struct(F.lit(c).alias("column"), F.lit(lo).alias("left"), F.lit(hi).alias("right"), F.lit(800.0).alias("top"), F.lit(0.0).alias("bottom"))
    return spans(spark, d).select("doc_id", "page").distinct().select("doc_id", "page", F.inline(F.array(box(0, 0.0, 275.0), box(1, 275.0, 600.0))))


def run_in_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of blocks of three lines of a document; the first line begins with three words as a numbered, capital, slanted, larger or bold heading, or as none."""
    whole = F.split("text", "\n")
    blocks = table(spark, d, "documents").select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.size(whole) / 3).cast("int") - 1), lambda i: F.slice(whole, i * 3 + 1, 3))).alias("block", "three"))
    words, k, b = F.split(F.col("three")[0], " "), F.col("doc_id") % 7, F.col("block")
    three = F.array_join(F.slice(words, 1, 3), " ")
    head = F.when(k == 0, F.concat(F.lit("2."), (b % 5 + 1).cast("string"), F.lit(" "), three, F.lit(" "))).when(k == 1, F.concat(F.upper(F.replace(three, F.lit("ß"), F.lit("s"))), F.lit(". "))).when(k == 2, F.concat(three, F.lit(". "))).when(k == 3, F.concat(three, F.lit(": "))).when(k == 4, F.lit("Abstract. ")).when(k == 6, F.concat(F.lit("Chapter "), b.cast("string"), F.lit(" "), three, F.lit(": "))).otherwise(F.concat(three, F.lit(" ")))
    rest = F.array_join(F.slice(words, 4, F.greatest(F.size(words), F.lit(1))), " ")
    span = lambda line, ix, text, first=False: F.struct(F.lit(line).alias("line"), F.lit(ix).alias("ix"), text.alias("text"), F.when(F.lit(first) & (k == 3), "h").otherwise("r").alias("font"), (F.lit(first) & k.isin(0, 1, 4, 6)).alias("bold"), (F.lit(first) & (k == 2)).alias("italic"), F.when(F.lit(first) & (k == 3), 12.0).otherwise(10.0).alias("size"))
    rows = F.array(span(0, 0, head, True), span(0, 1, rest), *[F.when(F.size("three") > i, span(i, i + 1, F.get("three", F.lit(i)))) for i in (1, 2)])
    out = blocks.select("doc_id", F.lit(1).alias("page"), "block", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("doc_id", "page", "block", "x.*").where("text <> ''")
    top = F.lit(700.0) - 12 * F.col("line")
    return out.select("*", F.lit(50.0).alias("left"), (F.lit(500.0) - F.col("doc_id") % 3 * 40 * F.col("line")).alias("right"), top.alias("top"), (top - 10).alias("bottom"))


def run_in_blocks(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, page, block, body, body_size, above_bottom, above_right, above_word of the blocks of run_in_spans."""
    n = F.ceil(F.size(F.split("text", "\n")) / 3).cast("int")
    b, doc = F.col("block"), F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("block")).select("doc_id", F.lit(1).alias("page"), "block", (doc % 5 != 1).alias("body"), F.lit(10.0).alias("body_size"), F.when(b > 0, 701.0 + b % 4).alias("above_bottom"), F.when(b > 0, 300.0 + b % 3 * 100).alias("above_right"), F.when(b > 0, b % 2 == 0).alias("above_word"))


def set_candidates(spark: SparkSession, d: str) -> DataFrame:
    """candidates of many headings a document, with keyword and font: the made ones of all orders, dealt to 1009 documents."""
    of = F.col("doc_id") % 1009
    c = candidates(spark, d).select("*", (F.col("kind").isin(5, 8) | (F.col("ord") % 3 == 0)).alias("keyword"), F.substring("style", 1, 2).alias("font"))
    return c.select(of.alias("doc_id"), (F.col("doc_id") * 64 + F.col("ord")).alias("ord"), F.col("page"), "kind", "numbering", F.concat("title", F.lit(" "), F.col("doc_id").cast("string")).alias("title"), "keyword", "font", "style", "size", F.col("score").cast("double").alias("score"), "centred")


#: Titles that reach every branch of the title rules.
MIXED = ("Part IV-3a", "12", "Document  page 3", "XIV. Mix", "Growth $x_1$ of div 2", "mcmxc and iii", "Page layout rules")


def records(spark: SparkSession, d: str) -> DataFrame:
    """id, name, created_at, page_num, status: orders as records of stored documents."""
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("file-"), (F.col("o_custkey") % 400).cast("string"), F.lit(".pdf")).alias("name"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 37 + 1).alias("page_num"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("processing").alias("status"))


#: The same inputs as common table expressions for DuckDB.
SQL = {
    "lines": f"lines AS (SELECT doc_id, (ln // {PAGE_LINES} + 1)::INT AS page, ln::INT AS ln, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents))",
    "page_text": "page_text AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY ln) AS markdown FROM lines GROUP BY doc_id, page)",
    "bookmarks": "bookmarks AS (SELECT l_orderkey AS doc_id, n AS ord, 'Part ' || (l_partkey % 12) AS title, (l_suppkey % 3 + 1)::INT AS level, (n * 3 + l_quantity % 9 - 2)::INT AS page FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS n FROM lineitem))",
    "doc_pages": "doc_pages AS (SELECT o_orderkey AS doc_id, (o_orderkey % 5 + 20)::INT AS n_pages FROM orders)",
    "valid": "valid0 AS (SELECT doc_id, ord, title, level, page, n_pages FROM (SELECT b.*, n_pages, max(page) OVER (PARTITION BY doc_id ORDER BY ord) AS m FROM bookmarks b JOIN doc_pages USING (doc_id) WHERE page BETWEEN 1 AND n_pages) WHERE page = m), opened AS (SELECT v.doc_id, v.ord, count(*) AS c FROM valid0 v JOIN valid0 x ON x.doc_id = v.doc_id AND x.ord < v.ord AND x.level < v.level WHERE NOT EXISTS (SELECT 1 FROM valid0 y WHERE y.doc_id = x.doc_id AND y.ord > x.ord AND y.ord < v.ord AND y.level <= x.level) GROUP BY ALL), valid AS (SELECT v.doc_id, v.ord, v.title, (1 + coalesce(o.c, 0))::INT AS level, v.page, v.n_pages FROM valid0 v LEFT JOIN opened o ON o.doc_id = v.doc_id AND o.ord = v.ord)",
    "candidates": "candidates AS (SELECT l_orderkey AS doc_id, n AS ord, (n * 2 + l_partkey % 2)::INT AS page, [0, 1, 2, 4, 5, 8, 11][l_partkey % 7 + 1] AS kind, CASE WHEN [0, 1, 2, 4, 5, 8, 11][l_partkey % 7 + 1] = 1 AND l_suppkey % 2 = 0 THEN [n, (l_suppkey % 3 + 1)::INT] WHEN [0, 1, 2, 4, 5, 8, 11][l_partkey % 7 + 1] IN (1, 2, 4) THEN [n] ELSE []::INT[] END AS numbering, 'Heading ' || l_partkey % 3 AS title, 'f' || l_suppkey % 4 AS style FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS n FROM lineitem))",
    "drawn": "drawn AS (SELECT doc_id, page, CASE doc_id % 11 WHEN 0 THEN substr(markdown, 1, 15) WHEN 1 THEN translate(markdown, 'aeiouyAEIOUY', '') WHEN 2 THEN repeat(chr(65533), 200) || markdown ELSE markdown END AS markdown, (doc_id % 10) / 10.0::DOUBLE AS image_coverage, doc_id % 7 * 40 AS path_objects FROM page_text)",
    "made_bookmarks": "made_bookmarks AS (SELECT doc_id, ord, CASE doc_id % 7 WHEN 0 THEN 'Page ' || ord WHEN 1 THEN 'file ' || ord || ' v' || ord WHEN 2 THEN 'Chapter ' || ord WHEN 3 THEN 'Item ' || ord WHEN 4 THEN translate(ord::VARCHAR, '0123456789', 'abcdefghij') || ' – Word' WHEN 5 THEN 'Notes' ELSE [" + ", ".join(f"'{t}'" for t in MIXED) + "][ord % 7 + 1] END AS title, level, page FROM bookmarks)",
    "nodes": "nodes AS (SELECT v.doc_id, v.ord, (SELECT max(x.ord) FROM valid x WHERE x.doc_id = v.doc_id AND x.ord < v.ord AND x.level < v.level) AS parent_ord, v.level, v.title, v.page AS start_page, greatest(v.page, coalesce((SELECT arg_min(x.page, x.ord) FROM valid x WHERE x.doc_id = v.doc_id AND x.ord > v.ord AND x.level <= v.level), v.n_pages)) AS end_page, printf('%04d', row_number() OVER (PARTITION BY v.doc_id ORDER BY v.ord) - 1) AS node_id FROM valid v)",
    "spans": "spans AS (SELECT l_orderkey % 997 AS doc_id, (l_orderkey % 5 + 1)::INT AS page, l_orderkey * 64 + n AS ix, l_quantity * 10 AS \"left\", l_quantity * 10 + 40 + l_discount * 100 AS \"right\", (l_partkey % 700)::DOUBLE + 8 + l_linenumber AS top, (l_partkey % 700)::DOUBLE AS bottom, l_returnflag || ' ' || l_linestatus || ' ' || (l_suppkey % 40) AS text, (l_linenumber + 7)::DOUBLE AS size, l_returnflag = 'A' AS bold, CASE WHEN l_linenumber = 7 THEN 1.0 ELSE 0.0 END::DOUBLE AS skew FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS n FROM lineitem))",
    "margin_parts": """margin_lines AS (SELECT doc_id, coalesce(source, 'none') AS source, unnest(range(1, (len(l) + 1) // 2 + 1))::INT AS page, l FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)),
  margin_parts0 AS (SELECT doc_id, page, 0 AS seq, 0 AS part, (CASE WHEN (doc_id + page) % 4 = 3 THEN 'Yearly reviev of ' ELSE 'Yearly review of ' END) || source AS text, 50.0 AS "left", 800.0 - CASE WHEN page % 3 = 2 THEN 12 ELSE 0 END AS top, CASE WHEN (doc_id + page) % 5 = 4 THEN 11.0 ELSE 10.0 END AS size, 0.0 AS skew FROM margin_lines
  UNION ALL SELECT doc_id, page, 1, 0, 'Part ' || doc_id % 5, 400, 800, 10, 0 FROM margin_lines WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, page, 1, 1, page::VARCHAR, 450, 800, 10, 0 FROM margin_lines WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, page, 2, 0, coalesce(l[2 * page - 1], ''), 50, 760, 10, 0 FROM margin_lines UNION ALL SELECT doc_id, page, 3, 0, coalesce(l[2 * page], ''), 50, 720, 10, CASE WHEN doc_id % 13 = 0 THEN 1.5 ELSE 0 END FROM margin_lines
  UNION ALL SELECT doc_id, page, 8, 0, CASE WHEN doc_id % 5 = 0 THEN 'Copyright 2021 ' || source ELSE (page + 3)::VARCHAR END, 280, 60, 10, 0 FROM margin_lines
  UNION ALL SELECT doc_id, page, 9, 0, 'Vol. ' || doc_id % 9 || CASE WHEN page % 2 = 0 THEN ', draft' ELSE ', drafts' END, 280, 45, 10, 0 FROM margin_lines WHERE doc_id % 7 = 0),
  margin_parts AS (SELECT doc_id, page, seq, part, text, "left"::DOUBLE AS "left", ("left" + least(500, length(text) * 6))::DOUBLE AS "right", top::DOUBLE AS top, (top - 10)::DOUBLE AS bottom, 'f1' AS font, size::DOUBLE AS size, false AS bold, skew::DOUBLE AS skew FROM margin_parts0),
  margin_pages AS (SELECT doc_id, page, 842.0::DOUBLE AS page_height, 600.0::DOUBLE AS page_width, 10.0::DOUBLE AS page_size, 10.0::DOUBLE AS body_size FROM margin_lines)""",
    "column_lines": """column_lines AS (SELECT doc_id, page, ix, x AS "left", (x + CASE WHEN ix % 7 = 0 THEN 500.0 ELSE 150.0 + ix % 90 END)::DOUBLE AS "right", (b + CASE WHEN ix % 7 = 0 THEN 14 ELSE 10 END)::DOUBLE AS top, b AS bottom, CASE WHEN i % 11 = 0 THEN (i % 9 + 1) || '. ' || text WHEN i % 13 = 0 THEN '[' || i || ']' WHEN i % 17 = 0 THEN text || ' . . . . . .' ELSE text || ' running text of a line' END AS text, CASE WHEN ix % 7 = 0 THEN 14.0 ELSE 10.0 END::DOUBLE AS size
  FROM (SELECT *, ix % 60 AS i, (CASE WHEN ix % 7 = 0 THEN 40 WHEN ix % 2 = 0 THEN 40 + ix % 3 ELSE 320 END)::DOUBLE AS x, (760 - (ix % 60) // 2 * 24 + CASE WHEN ix % 5 = 0 THEN 3 ELSE 0 END)::DOUBLE AS b FROM spans)),
  column_pages AS (SELECT doc_id, page, 10.0::DOUBLE AS size, (14 + count(*) % 4)::DOUBLE AS overlap_gap, 5.0::DOUBLE AS char_width FROM spans GROUP BY doc_id, page)""",
    "run_in_spans": """run_in0 AS (SELECT doc_id, unnest(range(0, (len(l) + 2) // 3))::INT AS block, l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
  run_in1 AS (SELECT doc_id, block, l[block * 3 + 2] AS l1, l[block * 3 + 3] AS l2, string_split(l[block * 3 + 1], ' ') AS w, doc_id % 7 AS k FROM run_in0),
  run_in2 AS (SELECT *, array_to_string(w[1:3], ' ') AS h FROM run_in1),
  run_in3 AS (SELECT doc_id, block, k, 0 AS line, 0 AS ix, CASE k WHEN 0 THEN '2.' || (block % 5 + 1) || ' ' || h || ' ' WHEN 1 THEN upper(replace(h, 'ß', 's')) || '. ' WHEN 2 THEN h || '. ' WHEN 3 THEN h || ': ' WHEN 4 THEN 'Abstract. ' WHEN 6 THEN 'Chapter ' || block || ' ' || h || ': ' ELSE h || ' ' END AS text FROM run_in2
    UNION ALL SELECT doc_id, block, k, 0, 1, array_to_string(w[4:], ' ') FROM run_in2 UNION ALL SELECT doc_id, block, k, 1, 2, l1 FROM run_in2 WHERE l1 IS NOT NULL UNION ALL SELECT doc_id, block, k, 2, 3, l2 FROM run_in2 WHERE l2 IS NOT NULL),
  run_in_spans AS (SELECT *, CASE WHEN ix = 0 AND k = 3 THEN 'h' ELSE 'r' END AS font, ix = 0 AND k IN (0, 1, 4, 6) AS bold, ix = 0 AND k = 2 AS italic, CASE WHEN ix = 0 AND k = 3 THEN 12.0 ELSE 10.0 END::DOUBLE AS size, 50.0::DOUBLE AS "left", (500 - doc_id % 3 * 40 * line)::DOUBLE AS "right", (700 - 12 * line)::DOUBLE AS top, (690 - 12 * line)::DOUBLE AS bottom FROM run_in3 WHERE text <> '')""",
    "records": "records AS (SELECT o_orderkey::VARCHAR AS id, 'file-' || (o_custkey % 400) || '.pdf' AS name, o_orderdate AS created_at, o_orderkey % 37 + 1 AS page_num, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'processing' END AS status FROM orders)",
}


def sql(body: str, *names: str) -> str:
    """body after the common table expressions of these inputs; body may start with more of them, after a comma."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names) + ("" if body.startswith(",") else " ") + body
