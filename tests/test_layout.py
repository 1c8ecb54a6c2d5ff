"""Lines and blocks of made pages."""

from pyspark.sql import functions as F

from quire.operators import layout

SPANS = "doc_id long, page int, ix long, left double, right double, top double, bottom double, text string, size double, bold boolean, skew double"


def span(ix, x, y, text, size=10.0, bold=False, skew=0.0, width=None, page=1):
    return (1, page, ix, float(x), float(x) + (width or 5.0 * len(text)), float(y) + size, float(y), text, size, bold, skew)


def lines(spark, rows):
    return [(r["text"], r["spans"]) for r in layout.page_lines(spark.createDataFrame(rows, SPANS)).orderBy("page", "line").collect()]


def test_spans_become_lines(spark):
    rows = [span(0, 0, 100, "Read"), span(1, 20, 100, "ing"), span(2, 42, 100, "on"), span(3, 300, 100, "far"), span(4, 0, 80, "next"), span(5, 0, 80.2, "next"), span(6, 0, 60, "", width=3), span(7, 500, 50, "turned", skew=2.0), span(8, 0, 40, "dust", size=1e-7, width=1e-4)]
    assert lines(spark, rows) == [("Readingon", [0, 1, 2]), ("far", [3]), ("next", [4]), ("turned", [7])]
    bold = layout.page_lines(spark.createDataFrame(rows, SPANS)).where("text = 'next'").first()
    assert bold["bold"] == 1.0  # struck over


def test_contents_rows_reach_their_numbers(spark):
    rows = [span(0, 0, 100, "Scope ......"), span(1, 72, 100, "12"), span(2, 0, 80, "Scope"), span(3, 72, 80, "12")]
    assert [t for t, _ in lines(spark, rows)] == ["Scope ......12", "Scope", "12"]


def test_line_numbers_go(spark):
    rows = [span(2 * i, 0, 200 - 20 * i, str(i + 3)) for i in range(6)] + [span(2 * i + 1, 100, 200 - 20 * i, f"text of line {i}") for i in range(6)]
    assert [t for t, _ in lines(spark, rows)] == [f"text of line {i}" for i in range(6)]
    assert len(lines(spark, rows[:4] + rows[6:])) == 10  # four numbers are no column


def test_lines_become_blocks(spark):
    body = [span(10 + i, 0, 180 - 12 * i, "body text of a paragraph that goes on", 10.0) for i in range(4)]
    rows = [span(0, 0, 300, "A Large Title", 20.0, True), span(1, 0, 192, "Results", 10.0, True), *body, span(30, 400, 174, "a note beside"), span(31, 0, 60, "far below"), span(40, 0, 10, "other page", page=2)]
    got = layout.page_paragraphs(spark.createDataFrame(rows, SPANS)).orderBy("page", "block").collect()
    assert [(r["page"], r["text"], r["n_lines"]) for r in got] == [(1, "A Large Title", 1), (1, "Results", 1), (1, " ".join(["body text of a paragraph that goes on"] * 4), 4), (1, "a note beside", 1), (1, "far below", 1), (2, "other page", 1)]
    text = {r["page"]: r["markdown"] for r in layout.document_text(layout.page_paragraphs(spark.createDataFrame(rows, SPANS))).collect()}
    assert text[2] == "other page" and text[1].startswith("A Large Title\nResults\nbody")


def test_no_span_is_lost(spark):
    from quire.plans import inputs

    spans = inputs.spans(spark, "/root/testdata/sf0.001").where("length(text) > 0")
    for found in (layout.page_lines(spans), layout.page_paragraphs(spans)):
        told = found.select("doc_id", "page", F.explode("spans").alias("ix"))
        assert told.count() == told.distinct().count()
        lost = spans.join(told, ["doc_id", "page", "ix"], "left_anti")
        # Only what is struck over itself is not told twice.
        same = spans.groupBy("doc_id", "page", "text").count().where("count > 1")
        assert lost.join(same, ["doc_id", "page", "text"], "left_anti").count() == 0


def test_page_box(spark):
    box = lambda r: spark.range(1).select(layout.page_box(*[F.lit(float(x)) for x in (0, 600, 800, 0)], F.lit(r)).alias("b")).first()["b"]
    assert (box(90)["right"], box(270)["top"], box(180)["right"], box(0)["top"]) == (800.0, 600.0, 600.0, 800.0)


def test_a_long_line_and_block_are_read_once(monkeypatch):
    """A page of one row of many spans, and one of many lines of a block: what is asked of texts grows with the page, and sums are those of all at once."""
    from collections import namedtuple

    asked = []
    plain = layout.weight
    monkeypatch.setattr(layout, "weight", lambda text: asked.append(text) or plain(text))
    span = namedtuple("Span", "ix left right top bottom text size bold skew")
    row = [span(i, 4.0 * i, 4.0 * i + 3.9, 20.0, 10.0, f"w{i % 7}", 10 + i % 3 / 10, i % 2 == 0, i % 4 / 10) for i in range(500)]
    (line,) = layout.merged([layout.Line([s]) for s in row], 0.75)
    assert (line.size, line.bold, line.skew) == tuple(getattr(layout.Line(row), k) for k in ("size", "bold", "skew"))
    assert line.text == "".join(s.text for s in row) and len(asked) <= 4 * len(row)
    asked.clear()
    lines = [layout.Line([span(i, 10.0, 200.0, 9000.0 - 12 * i, 8990.0 - 12 * i, "plain words here", 10.1 + i % 3 / 10, False, 0.1)]) for i in range(500)]
    (block,) = layout.blocks(lines)
    assert len(block.lines) == 500 and block.size == sum(x.weight * x.size for x in lines) / sum(x.weight for x in lines) and len(asked) <= 500
    assert block.text == " ".join(["plain words here"] * 500) and block.case == layout.cased(block.text)
