"""Run-in headings of made blocks."""

from pyspark.sql import functions as F

from quire.operators import classify, runin

SPAN = "doc_id long, page int, block int, line int, ix int, text string, font string, bold boolean, italic boolean, size double, left double, right double, top double, bottom double"
BLOCK = "doc_id long, page int, block int, body boolean, body_size double, above_bottom double, above_right double, above_word boolean"
REST = "the paragraph goes on in plain type for as long as a paragraph of body text goes on, over two lines and more, and then some."


def found(spark, *blocks, body=True, above=None):
    """blocks: lists of lines, each a list of (text, font, bold, italic[, size])."""
    rows, i = [], 0
    for b, lines in enumerate(blocks):
        for n, line in enumerate(lines):
            for text, font, bold, italic, *size in line:
                rows.append((1, 1, b, n, i, text, font, bold, italic, float(size[0]) if size else 10.0, 50.0, 400.0, 500.0 - 12 * n, 490.0 - 12 * n))
                i += 1
    frame = spark.createDataFrame([(1, 1, b, body, 10.0, *(above or (None, None, None))) for b in range(len(blocks))], BLOCK)
    return {r["block"]: (r["kind"], r["numbering"], r["title"], r["rest"][:12]) for r in runin.run_in_headings(spark.createDataFrame(rows, SPAN), frame).collect()}


def bold(head, rest="The paragraph. ", second=REST):
    return [[(head, "b", True, False), (rest, "r", False, False)], [(second, "r", False, False)]]


def test_by_number_word_and_capitals(spark):
    got = found(spark, bold("2.1 Aims of it "), bold("3 Introduction "), bold("3 some small words "), bold("Abstract. "), bold("Introduction: "), bold("DATA AND SOURCES. "), bold("RESULTS. "), bold("4 RESULTS OF IT ALL. "), bold("Chapter 2 The Long Way: "), bold("Keywords: "), bold("NO MARK AT ALL "), bold("Just bold. "))
    assert got == {0: (1, "2.1", "Aims of it", "The paragrap"), 1: (1, "3", "Introduction", "The paragrap"), 3: (5, None, "Abstract.", "The paragrap"), 4: (11, None, "Introduction:", "The paragrap"), 5: (0, None, "DATA AND SOURCES.", "The paragrap"), 6: (6, None, "RESULTS.", "The paragrap"), 7: (1, "4", "RESULTS OF IT ALL.", "The paragrap"), 8: (8, None, "Chapter 2 The Long Way", "The paragrap")}


def test_capitals_count_before_a_paragraph_only(spark):
    assert found(spark, bold("DATA AND SOURCES. "), body=False) == {}


def test_by_font_over_two_lines_and_words_that_the_cut_parts(spark):
    two = [[("2.3 A heading that", "h", False, False, 12)], [(" goes on. ", "h", False, False, 12), ("Then text. ", "r", False, False)], [(REST, "r", False, False)], [(REST, "r", False, False)]]
    parted = [[("1.2 Head", "b", True, False), ("ing The rest. ", "r", False, False)], [(REST, "r", False, False)]]
    again = [[("2.4 Font ", "h", False, False, 12), ("x. ", "r", False, False)], [("h again ", "h", False, False), ("r", "r", False, False)], [("r", "r", False, False)]]
    assert found(spark, two, parted, again) == {0: (1, "2.3", "A heading that goes on.", "Then text. t"), 1: (1, "1.2", "Heading", "The rest. th")}


def test_italics_stand_off(spark):
    slanted = [[("Aims of the work. ", "i", False, True), ("The rest. ", "r", False, False)], [("and so on", "r", False, False)]]
    assert found(spark, slanted)[0][:3] == (0, None, "Aims of the work.")
    assert found(spark, slanted, above=(501.0, 400.0, False)) == {} != found(spark, slanted, above=(501.0, 200.0, False))
    lower = [[("aims of the work. ", "i", False, True), ("The rest. ", "r", False, False)], [("and so on", "r", False, False)]]
    assert found(spark, lower) == {}


def test_one_line_one_style_and_nothing(spark):
    assert found(spark, bold("2.1 Aims ")[:1], [[("2.1 all in one style", "r", False, False)], [("as here", "r", False, False)]]) == {}
    empty = [spark.createDataFrame([], x) for x in (SPAN, BLOCK)]
    assert runin.run_in_headings(*empty).collect() == []


def test_labels(spark):
    given = {"Chapter IV: The way": (8, [4], "The way"), "第一章 总论": (8, [1], "总论"), "第二十三节 x": (8, [23], "x"), "Appendix A Data": (10, [1], "Data"), "附录二": None, "Box 3 Costs": (12, [3], "Costs"), "Box": None, "II. Sums": (2, [2], "Sums"), "II.": None, "十) x": (3, [10], "x"), "b) y": (4, [2], "y"), "A.3 z": (4, [1, 3], "z"), "A.20 z": None, "A word": None, "": None}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").orderBy("i").select(classify.heading_label(F.col("t")).alias("h")).collect()
    assert [tuple(r["h"]) if r["h"] else None for r in rows] == list(given.values())
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(("第一章 总论", "Appendix A Data", "Box 3 Costs", "plain words"))], "doc_id long, page int, ln int, text string")
    assert {r["ln"]: r["kind"] for r in classify.headings(lines).collect()} == {0: 8, 1: 10, 2: 12}
