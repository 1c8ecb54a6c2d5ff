"""Page headers and footers on made pages."""

import pytest
from pyspark.sql import functions as F

from quire.operators import margins

PART = "doc_id long, page int, seq int, part int, text string, left double, right double, top double, bottom double, font string, size double, bold boolean, skew double"


def made(spark, texts):
    """texts: (page, seq, text, top[, left])."""
    rows = [(1, p, q, 0, t, float(x[0] if x else 50), float((x[0] if x else 50) + 6 * len(t)), float(top), float(top - 10), "f", 10.0, False, 0.0) for p, q, t, top, *x in texts]
    pages = [(1, p, 842.0, 600.0, 10.0, 10.0) for p in sorted({t[0] for t in texts})]
    return spark.createDataFrame(rows, PART), spark.createDataFrame(pages, "doc_id long, page int, page_height double, page_width double, page_size double, body_size double")


def found(spark, texts, kind):
    return {(r["page"], r["seq"]): r["how"] for r in margins.running_blocks(*made(spark, texts), kind).collect()}


BODY = "a line of running prose that goes on and on over the page, as such lines do in a text that is long enough to end a margin, and which then has some more words so that it is surely body text; and even more words at the end of it all"


def test_headers_alike_by_edit_distance(spark):
    heads = ["Annual report 2020 of the board", "Annual reporl 2020 of the board", "Annual report 2020 of the hoard", "Annual rep0rt 2020 of the board", "Annual report 2020 of a board", "Something else 2020 altogether different"]
    texts = [(p, 1, BODY, 760) for p in range(1, 7)] + [(p, 0, h, 810 - 20 * (p % 2)) for p, h in enumerate(heads, 1)]
    assert found(spark, texts, 1) == {(p, 0): "alike" for p in range(1, 6)}


def test_headers_with_the_same_text_need_near_corners_and_pages(spark):
    at = {1: (810, 50), 2: (810, 50), 5: (810, 50), 9: (810, 50), 20: (700, 50), 21: (810, 300)}
    texts = [(p, 0, "Running title", top, left) for p, (top, left) in at.items()] + [(p, 1, BODY, 690) for p in range(1, 30)]
    assert found(spark, texts, 1) == {(1, 0): "same", (2, 0): "same", (5, 0): "same", **{(p, 0): "parts" for p in (9, 20, 21)}}


@pytest.mark.parametrize("shift", [0, 12])
def test_page_numbers_and_copyright_are_footers(spark, shift):
    texts = [(p, 8, str(p + shift), 40, 280) for p in range(1, 9)] + [(p, 7, "© 2020 A. Press", 60) for p in range(1, 9, 3)] + [(p, 2, BODY, 500) for p in range(1, 9)] + [(4, 9, "731", 30)]
    got = found(spark, texts, 2)
    assert {k for k, v in got.items() if v == "parts"} == {(p, 8) for p in range(1, 9)} and {k for k, v in got.items() if v == "copyright"} == {(1, 7), (4, 7), (7, 7)}
    assert got[(4, 9)] == "outside"


def test_title_of_the_first_page_stays(spark):
    texts = [(p, 0, "SHORT TITLE OF A PAPER", 810 - 3 * (p == 1)) for p in (1, 2, 3)] + [(p, 1, BODY, 690) for p in (1, 2, 3)]
    assert found(spark, texts, 1).get((1, 0)) == "parts" and found(spark, texts, 1)[(2, 0)] == "same"


def test_empty(spark):
    parts, pages = made(spark, [(1, 0, "x", 800)])
    assert margins.running_blocks(parts.limit(0), pages.limit(0), 1).collect() == []


def test_keys_and_numbers(spark):
    row = spark.sql("SELECT 'Éte\tDe  l’ Année' AS a, '| 12 |' AS b, 'xiv' AS c, '0' AS d, 'XXI' AS e")
    got = row.select(margins.text_key("a"), *[margins.page_number(F.col(c)) for c in "bcde"]).collect()[0]
    assert tuple(got) == ("etedel’annee", 12, 14, None, None)
