"""Page triage, OCR replies and tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import rects as R
from quire.functions import text as T
from quire.operators.grouped import by_group
from quire.operators.trees import uncovered


#: White space, and scripts that part no words by blanks or write no Latin vowels.
SPACE = r"\x09-\x0D\x{85}\p{Z}"
UNSPACED = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}\x{0590}-\x{08FF}\x{0900}-\x{0DFF}\x{0E00}-\x{0EFF}]"
#: Private use, replacement characters, and controls that are no white space.
BAD = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFF}\x{FFFD}\x{FFFE}\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}]"


def word_stats(text):
    """(ratio of word-like tokens, letters): tokens are parted by white space, trimmed to letters and digits, and have a letter; ratio 1 without any.

    Word-like: in a script without blanks; or of four characters at most; or of three letters at most with a digit; or of 30
    characters at most, seven tenths of them letters, with a vowel or beyond ASCII.
    """
    letters = lambda t: F.length(F.regexp_replace(t, r"[^\p{IsAlphabetic}]+", ""))
    plain = lambda t: t.rlike(r"^[A-Za-z]{5,30}$") & t.rlike("[aeiouyAEIOUY]")
    long = lambda t: (F.length(t) <= 30) & (10 * letters(t) >= 7 * F.length(t)) & t.rlike(r"[aeiouyAEIOUY]|[^\x00-\x7F]")
    like = lambda t: (F.length(t) <= 4) | plain(t) | t.rlike(UNSPACED) | (t.rlike("[0-9]") & (letters(t) <= 3)) | long(t)
    tokens = F.filter(F.regexp_extract_all(text, F.lit(rf"[\p{{IsAlphabetic}}\p{{N}}](?:[^{SPACE}]*[\p{{IsAlphabetic}}\p{{N}}])?"), F.lit(0)), lambda t: t.rlike(r"\p{IsAlphabetic}"))
    ratio = T.let(tokens, lambda ts: F.when(F.size(ts) == 0, 1.0).otherwise(F.size(F.filter(ts, like)) / F.size(ts)))
    return F.struct(ratio.alias("ratio"), F.regexp_count(text, F.lit(r"\p{IsAlphabetic}")).alias("letters"))


def visible(text):
    """Characters that are no white space."""
    return F.length(F.regexp_replace(text, f"[{SPACE}]+", ""))


def bad_share(text):
    """Share of bad characters among the visible ones; 0 without any."""
    n = visible(text)
    return F.when(n == 0, 0.0).otherwise(F.regexp_count(text, F.lit(BAD)) / n)


def signals(pages: DataFrame) -> DataFrame:
    """doc_id, page, chars (visible), ratio, letters, bad, score, image_coverage, path_objects of page texts; score = ratio * ln(1 + letters).

    pages: doc_id, page, markdown and, where a page's drawing is known, image_coverage and path_objects; these are 0 otherwise.
    """
    text = F.coalesce(F.col("markdown"), F.lit(""))
    drawn = [F.col(c) if c in pages.columns else F.lit(z).alias(c) for c, z in (("image_coverage", 0.0), ("path_objects", 0))]
    out = pages.select("doc_id", "page", visible(text).alias("chars"), word_stats(text).alias("w"), bad_share(text).alias("bad"), *drawn)
    return out.select("doc_id", "page", "chars", F.col("w.ratio").alias("ratio"), F.col("w.letters").alias("letters"), "bad", (F.col("w.ratio") * F.log1p(F.col("w.letters").cast("double"))).alias("score"), "image_coverage", "path_objects")


def labelled(signals: DataFrame, least_chars=20, scanned=0.3, mixed=0.25, bad=0.1, words=0.45, least_letters=80, least_paths=150) -> DataFrame:
    """signals with `label`.

    With hardly any text: scanned by image coverage, graphic by path objects, else text (a blank page). With text: garbled by bad
    characters, or by few word-like tokens among enough letters; mixed by image coverage; else text.
    """
    bare = F.when(F.col("image_coverage") >= scanned, "scanned").when(F.col("path_objects") >= least_paths, "graphic").otherwise("text")
    garbled = (F.col("bad") > bad) | ((F.col("letters") >= least_letters) & (F.col("ratio") < words))
    return signals.withColumn("label", F.when(F.col("chars") < least_chars, bare).when(garbled, "garbled").when(F.col("image_coverage") >= mixed, "mixed").otherwise("text"))


def label_counts(labels: DataFrame) -> DataFrame:
    """label, n_pages over all documents."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_pages"))


def coverage(boxes: DataFrame, width: float, height: float, cells: int = 200) -> DataFrame:
    """doc_id, page, share: cells of a grid over the page that the boxes (left, right, top, bottom) cover, as a share of all; 0 for a page without area.

    A box is told by grid column, and a column adds up the rows its boxes span, so no box is told cell by cell.
    """
    if width <= 0 or height <= 0:
        return boxes.select("doc_id", "page").distinct().withColumn("share", F.lit(0.0))
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(cells), x)).cast("long")
    lo, hi = (lambda c, most: clamp(F.floor(F.col(c) / most * cells))), (lambda c, most: clamp(F.ceil(F.col(c) / most * cells)))
    b = boxes.select("doc_id", "page", lo("left", width).alias("x"), hi("right", width).alias("z"), F.struct((lo("bottom", height) + 1).alias("start"), hi("top", height).alias("end")).alias("rows"))
    filled = b.where("x < z and rows.start <= rows.end").select("doc_id", "page", F.explode(F.sequence(F.col("x"), F.col("z") - 1)).alias("x"), "rows")
    columns = filled.groupBy("doc_id", "page", "x").agg((cells - uncovered(F.lit(1), F.lit(cells), F.collect_set("rows"))).alias("n"))
    shares = columns.groupBy("doc_id", "page").agg((F.sum("n") / F.lit(float(cells * cells))).alias("share"))
    return boxes.select("doc_id", "page").distinct().join(shares, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("share", F.lit(0.0)).alias("share"))


def without_overlapping(found: DataFrame, known: DataFrame, most: float = 0.5) -> DataFrame:
    """found boxes less those that overlap a known box of the page by more than `most` (over the union, or over the box itself).

    An anti-join on the page, refined inside it by bands of y, so only boxes that share a band are compared.
    """
    band = lambda d: d.withColumn("_b", F.explode(F.sequence(F.floor(F.col("bottom") / 50), F.floor(F.col("top") / 50))))
    box = lambda p: R.rect(F.col(f"{p}.left"), F.col(f"{p}.right"), F.col(f"{p}.top"), F.col(f"{p}.bottom"))
    a, b = band(found).alias("a"), band(known).alias("b")
    both = R.area(R.meet(box("a"), box("b")))
    hit = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a._b") == F.col("b._b")) & ((R.overlap_ratio(box("a"), box("b")) > most) | (both > most * R.area(box("a")))), "left_semi").select("doc_id", "page", "ix").distinct()
    return found.join(hit, ["doc_id", "page", "ix"], "left_anti")


def route(label):
    """Where a page's text comes from: the reader, the better of both, the text layer and what the reader adds, or the text layer."""
    return F.when(label == "scanned", "ocr").when(label == "garbled", "best").when(label == "mixed", "merge").otherwise("text_layer")


def routed(labels: DataFrame) -> DataFrame:
    """label, route, n_pages."""
    return labels.select("label", route(F.col("label")).alias("route")).groupBy("label", "route").agg(F.count(F.lit(1)).alias("n_pages"))


def combined(text_spans: DataFrame, ocr_spans: DataFrame, labels: DataFrame) -> DataFrame:
    """The spans of each page by its label, with their source (text_layer or ocr).

    Spans: doc_id, page, ix, left, right, top, bottom, text. labels: doc_id, page, label. scanned: the reader's; garbled: the reader's
    if their text scores higher; mixed: the text layer's and those of the reader's that do not overlap them; others, and pages
    that the reader knows nothing of: the text layer's.
    """
    cols = ["doc_id", "page", "ix", "left", "right", "top", "bottom", "text"]

    def scored(spans, name):
        w = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "text"))), lambda x: x["text"]), " ")
        return spans.groupBy("doc_id", "page").agg(w.alias("t")).select("doc_id", "page", T.let(word_stats(F.col("t")), lambda x: x["ratio"] * F.log1p(x["letters"].cast("double"))).alias(name))

    way = labels.select("doc_id", "page", route(F.col("label")).alias("route"))
    read = ocr_spans.select("doc_id", "page").distinct()
    best = way.where("route = 'best'").select("doc_id", "page")
    better = scored(ocr_spans.join(best, ["doc_id", "page"], "left_semi"), "a").join(scored(text_spans.join(best, ["doc_id", "page"], "left_semi"), "b"), ["doc_id", "page"], "left").where("a > coalesce(b, 0)").select("doc_id", "page")
    whole = way.where("route = 'ocr'").select("doc_id", "page").join(read, ["doc_id", "page"], "left_semi").unionByName(better)
    some = ocr_spans.select(*cols).join(way.where("route = 'merge'"), ["doc_id", "page"], "left_semi")
    kept = ocr_spans.select(*cols).join(whole, ["doc_id", "page"], "left_semi").unionByName(without_overlapping(some, text_spans.select(*cols)))
    return text_spans.select(*cols).join(whole, ["doc_id", "page"], "left_anti").withColumn("source", F.lit("text_layer")).unionByName(kept.withColumn("source", F.lit("ocr")))


#: Entities that are resolved, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, table_no, row_no, cells of tables in HTML: tags are stripped, entities resolved, white space collapsed.

    A cell that spans k columns is followed by k - 1 empty ones, k taken as 1 to 50.
    """

    def clean(c):
        c = F.regexp_replace(c, "<[^>]*>", "")
        for name, put in ENTITIES:
            c = F.replace(c, F.lit(name), F.lit(put))
        return F.trim(F.regexp_replace(c, r"\s+", " "))

    def spread(tag):
        k = F.coalesce(F.regexp_extract(tag, r"(?is)^<t[dh]\b[^>]*?\bcolspan\s*=\s*[\"']?\s*([0-9]{1,9})", 1).try_cast("int"), F.lit(1))
        return F.concat(F.array(clean(F.regexp_extract(tag, r"(?is)^<t[dh]\b[^>]*>(.*)$", 1))), F.array_repeat(F.lit(""), F.greatest(F.lit(1), F.least(F.lit(50), k)) - 1))

    tables = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), F.lit(1))).alias("table_no", "t"))
    rows = tables.select("page_id", "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr\b[^>]*>(.*?)(?:</tr>|(?=<tr\b)|\z)"), F.lit(1))).alias("row_no", "r"))
    tags = F.regexp_extract_all("r", F.lit(r"(?is)(<t[dh]\b[^>]*>.*?)(?:</t[dh]>|(?=<t[dh]\b)|\z)"), F.lit(1))
    return rows.select("page_id", "table_no", "row_no", F.flatten(F.transform(tags, spread)).alias("cells"))


def markdown_rows(cells, width):
    """A row of a Markdown table, padded to `width` cells."""
    padded = F.concat(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(cells))))
    return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))


def page_texts_of_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, title, text, links: visible text of pages without scripts and styles, their title and number of links."""
    body = F.regexp_replace(F.col(html), r"(?is)<(script|style|head)\b.*?</\1>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"\s+", " "))
    return pages.select("page_id", F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), text.alias("text"), F.regexp_count(html, F.lit(r"(?i)<a\s[^>]*href")).alias("links"))


def boxes_in_reply(reply):
    """Boxes of a spotting reply with location tokens, as arrays left, top, right, bottom: four numbers are a box, eight the corners of a quadrilateral."""
    found = F.regexp_extract_all(reply, F.lit(r"(?i)(?:<loc_[0-9]+>){8}|(?:<loc_[0-9]+>){4}"), F.lit(0))
    numbers = F.transform(found, lambda b: F.transform(F.regexp_extract_all(b, F.lit("(?i)<loc_([0-9]+)>"), F.lit(1)), lambda x: x.cast("int")))
    at = lambda v, odd: F.filter(v, lambda x, i: i % 2 == odd)
    return F.transform(numbers, lambda v: F.when(F.size(v) == 4, v).otherwise(F.array(F.array_min(at(v, 0)), F.array_min(at(v, 1)), F.array_max(at(v, 0)), F.array_max(at(v, 1)))))


def reply_blocks(reply):
    """Blocks of a reader's reply as structs kind, level, text: of its JSON blocks or, where it holds none, of its lines, a line with # signs being a heading."""
    kind = "array<struct<kind:string,level:int,text:string>>"
    body = F.regexp_extract(F.regexp_replace(reply, r"(?s)^.*?```(?:json)?\s*(.*?)```.*$", "$1"), r"(?s)\[.*\]", 0)
    given = F.from_json(F.when(body != "", F.regexp_replace(body, r",(\s*[}\]])", "$1")), "array<struct<type:string,kind:string,level:int,text:string,content:string>>")
    blocks = F.filter(F.transform(given, lambda b: F.struct(F.lower(F.coalesce(b["kind"], b["type"], F.lit("text"))).alias("kind"), b["level"].alias("level"), F.coalesce(b["text"], b["content"]).alias("text"))), lambda b: F.trim(b["text"]) != "")
    lines = F.filter(F.split(reply, r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("```"))
    marks = lambda x: F.length(F.regexp_extract(F.trim(x), r"^(#{1,6})\s", 1))
    plain = F.transform(lines, lambda x: F.struct(F.when(marks(x) > 0, "heading").otherwise("text").alias("kind"), F.when(marks(x) > 0, marks(x)).alias("level"), F.trim(F.regexp_replace(F.trim(x), r"^#{1,6}\s+", "")).alias("text")))
    return F.when(F.size(blocks) > 0, blocks).otherwise(plain).cast(kind)


#: A reader's line as a span has a size of so much of its height, and its baseline so much above the bottom.
SIZE_SHARE, BASELINE_SHARE = 0.8, 0.2


def spans_of_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, ix, left, right, top, bottom, text, size, baseline, confidence of a reader's lines (boxes in pixels from the top left corner).

    lines: doc_id, page, ix, x0, y0, x1, y1, text, confidence. pages: doc_id, page, width, height (points), width_px, height_px. y grows upwards.
    """
    at = lines.where("trim(text) <> '' and x1 > x0 and y1 > y0").join(pages, ["doc_id", "page"])
    x, y = (lambda c: F.col(c) * F.col("width") / F.col("width_px")), (lambda c: F.col("height") - F.col(c) * F.col("height") / F.col("height_px"))
    out = at.select("doc_id", "page", "ix", x("x0").alias("left"), x("x1").alias("right"), y("y0").alias("top"), y("y1").alias("bottom"), F.trim("text").alias("text"), "confidence")
    high = F.col("top") - F.col("bottom")
    return out.select("doc_id", "page", "ix", "left", "right", "top", "bottom", "text", (SIZE_SHARE * high).alias("size"), (F.col("bottom") + BASELINE_SHARE * high).alias("baseline"), "confidence")


NUMBER = re.compile(r"[(\[]?[-+\u2212]?\s?[$\u20ac\u00a3]?\s?[0-9][0-9.,\s]*%?[)\]]?%?")


def table_regions(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, region, x0, y0, x1, y1, n_rows: where a page's lines stand as a table. lines: doc_id, page, ix, x0, y0, x1, y1, text, y downwards. pages: doc_id, page, width_px, height_px.

    From top to bottom, a line whose centre is within half the median height of a row's first line joins that row. A row counts if it
    has two cells, one of them a number. Three such rows or more in succession, with gaps of three heights at most, are a region,
    widened by half a height inside the page. Pages of fewer than six lines have none. A page is one fold.
    """

    def fold(rows):
        heights = sorted(r.y1 - r.y0 for r in rows if r.y1 > r.y0)
        if len(rows) < 6 or not heights:
            return []
        unit, middle = heights[len(heights) // 2], lambda r: (r.y0 + r.y1) / 2
        grid: list[list] = []
        for r in sorted(rows, key=middle):
            if grid and middle(r) - middle(grid[-1][0]) <= 0.5 * unit:
                grid[-1].append(r)
            else:
                grid.append([r])
        runs, bottom = [[]], None
        for cells in grid:
            counts = len(cells) >= 2 and any(NUMBER.fullmatch((c.text or "").strip()) for c in cells)
            far = bottom is not None and min(c.y0 for c in cells) - bottom > 3 * unit
            if runs[-1] and (far or not counts):
                runs.append([])
            if counts:
                runs[-1].append(cells)
            bottom = max(c.y1 for c in cells)
        found = []
        for run in runs:
            if len(run) >= 3:
                all_, pad, page = [c for cells in run for c in cells], 0.5 * unit, rows[0]
                found.append((page.doc_id, page.page, len(found) + 1, max(0.0, min(c.x0 for c in all_) - pad), max(0.0, min(c.y0 for c in all_) - pad), min(page.width_px, max(c.x1 for c in all_) + pad), min(page.height_px, max(c.y1 for c in all_) + pad), len(run)))
        return found

    of = lines.join(pages, ["doc_id", "page"]).select("doc_id", "page", "ix", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "width_px", "height_px")], "text")
    return by_group(of, ["doc_id", "page"], ["ix"], fold, "doc_id long, page int, region int, x0 double, y0 double, x1 double, y1 double, n_rows int")


def table_rows_of_tokens(c):
    """Rows of a table in cell tokens: <fcel> a cell with the text after it, <ecel> an empty one, <lcel>, <ucel> and <xcel> one merged with its neighbour (empty), <nl> a new row; each an array of texts, blanks collapsed. Rows without cells go."""
    cells = lambda row: F.filter(F.split(row, "(?=<[felux]cel>)"), lambda x: x.rlike("^<[felux]cel>"))
    text = lambda x: F.when(x.startswith("<fcel>"), F.trim(F.regexp_replace(F.substring(x, F.lit(7), F.length(x)), r"[\s\p{Z}]+", " "))).otherwise("")
    return F.filter(F.transform(F.split(c, "<nl>"), lambda row: F.transform(cells(row), text)), lambda row: F.size(row) > 0)


def table_of_rows(rows):
    """Rows of a table (arrays of texts) as a Markdown table whose first row is the head, rows filled up to the widest; null where no cell has text. The widest is found once, whatever the number of rows."""
    line = lambda r, wide: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, lambda x: F.replace(x, F.lit("|"), F.lit("\\|"))), F.array_repeat(F.lit(""), wide - F.size(r))), " | "), F.lit(" |"))
    rule = lambda wide: F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), wide), "|"), F.lit("|"))
    table = T.let(F.array_max(F.transform(rows, F.size)), lambda wide: F.array_join(F.concat(F.array(line(rows[0], wide), rule(wide)), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: line(r, wide))), "\n"))
    return F.when((F.size(rows) > 0) & F.exists(rows, lambda r: F.exists(r, lambda x: x != "")), table)


def table_of_tokens(c):
    """A reply of cell tokens, read once, as the Markdown table of its rows; null where no cell has text."""
    return T.let(table_rows_of_tokens(c), table_of_rows)


def spotted_lines(reply, width, height):
    """Lines of a spotting reply as structs text, left, top, right, bottom in pixels, or null where it has no location tokens.

    A run of tokens (thousandths of the page) belongs to the text before it, or after it where the reply begins with one, so texts and
    runs pair in order. Eight numbers are a quadrilateral's corners, four are two corners; shorter runs and what has no partner go.
    """
    at = r"(?:\s*<\|LOC_[0-9]{1,4}\|>)+\s*"
    runs = F.transform(F.regexp_extract_all(reply, F.lit(at), F.lit(0)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"LOC_([0-9]+)"), F.lit(1)), lambda x: F.least(x.cast("double"), F.lit(1000.0))))
    texts = F.filter(F.transform(F.split(reply, at), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")

    def box(z):
        v = F.when((F.size(z["r"]) >= 8) & (F.size(z["r"]) % 8 == 0), F.slice(z["r"], 1, 8)).otherwise(F.slice(z["r"], 1, 4))
        side = lambda odd, f, of: f(F.filter(v, lambda x, i: i % 2 == odd)) / 1000 * of
        return F.struct(z["t"].alias("text"), side(0, F.array_min, width).alias("left"), side(1, F.array_min, height).alias("top"), side(0, F.array_max, width).alias("right"), side(1, F.array_max, height).alias("bottom"))

    pairs = F.filter(F.arrays_zip(texts.alias("t"), runs.alias("r")), lambda z: z["t"].isNotNull() & (F.size(z["r"]) >= 4))
    return F.when(reply.rlike(r"<\|LOC_[0-9]{1,4}\|>"), F.transform(pairs, box))
