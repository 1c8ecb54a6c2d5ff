"""Characters and objects: given cases."""

import math
import random

from pyspark.sql import functions as F

from quire.operators import glyphs
from quire.plans import glyph_queries

OBJECT = "doc_id long, page int, k int, left double, right double, top double, bottom double, drawn double, size double"
CHAR = "doc_id long, page int, i long, x double, y double, drawn double, size double"


def test_objects_of_characters(spark):
    objects = [(1, 1, 0, 0.0, 100.0, 20.0, 10.0, 9.0, 9.0), (1, 1, 1, 0.0, 100.0, 20.0, 10.0, 12.0, 4.0), (1, 1, 2, 50.0, 60.0, 20.0, 10.0, 12.0, 12.0), (1, 1, 3, 50.0, 60.0, 20.0, 10.0, 12.0, 12.0), (1, 2, 4, 0.0, 100.0, 500.0, 10.0, 9.0, 9.0), (1, 1, 5, 200.0, 210.0, -10.0, -30.5, 9.0, 9.0)]
    chars = [(1, 1, 0, 10.0, 15.0, 11.0, 9.0), (1, 1, 1, 10.0, 15.0, 0.0, 5.0), (1, 1, 2, 55.0, 15.0, 12.0, 0.0), (1, 1, 3, 55.0, 15.0, 0.0, 0.0), (1, 1, 4, 102.0, 22.0, 9.0, 9.0), (1, 1, 5, 102.5, 15.0, 9.0, 9.0), (1, 2, 6, 5.0, 333.3, 1.0, 1.0), (2, 1, 7, 5.0, 15.0, 1.0, 1.0), (1, 1, 8, 205.0, -31.0, 9.0, 9.0)]
    got = {r["i"]: r["object"] for r in glyphs.objects_of_characters(spark.createDataFrame(chars, CHAR), spark.createDataFrame(objects, OBJECT)).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2, 4: 0, 5: None, 6: 4, 7: None, 8: 5}


def test_paint_order(spark):
    rows = [(1, 1, 0, 0, True), (1, 1, 1, 5, False), (1, 1, 2, 9, True), (1, 1, 3, 2, False), (1, 1, 4, 0, True), (1, 1, 5, 2, False), (1, 1, 6, 1, False)]
    got = glyphs.paint_order(spark.createDataFrame(rows, "doc_id long, page int, i long, order long, generated boolean")).orderBy("place").collect()
    assert [r["i"] for r in got] == [0, 6, 3, 4, 5, 1, 2]


def test_names_skew_and_view(spark):
    names = {"ABCDEF+Times-Roman": ("Times", False, False), "abcdef+X-Bold": ("abcdef+X-Bold", True, False), "ABCDEF+": ("", False, False), "TIMESNEW": ("Times", False, False), "CMTI10": ("CMTI10", False, True), "FooIt": ("FooIt", False, True), "Italy": ("Italy", False, True), "TimesBI": ("TimesBI", True, False)}
    df = spark.createDataFrame([(n,) for n in names], "n string").select(glyphs.font_name(F.col("n")), glyphs.is_bold(F.col("n")), glyphs.is_italic(F.col("n")))
    assert [tuple(r) for r in df.collect()] == list(names.values())
    turned = lambda *m: spark.range(1).select(glyphs.skew(*[F.lit(float(x)) for x in m]).alias("s")).first()["s"]
    assert (turned(1, 0, 0, 1), turned(2, 1, 3, 1), turned(0, 1, 0, 1)) == (0.0, 9.25, math.inf) and math.isnan(turned(0, 0, 0, 1))
    box = lambda v: F.lit(None).cast("array<double>") if v is None else F.array(*[F.lit(float(x)) for x in v])
    view = lambda m, c: spark.range(1).select(glyphs.view_box(box(m), box(c)).alias("v")).first()["v"]
    assert view(None, None) == [0, 0, 612, 792] and view([600, 800, 0, 0], [10, 20, 900, 700]) == [10, 20, 600, 700] and view([0, 0, 9, 9], [10, 10, 20, 20]) == [0, 0, 9, 9] and view([0, 0, 9, 9], [1, 1, 1, 5]) == [0, 0, 9, 9]


def test_characters_are_dealt_out_once(spark):
    """One exchange of the characters and one of the objects; nothing is dealt out again after the join."""
    chars = spark.createDataFrame([(1, 1, 0, 10.0, 15.0, 11.0, 9.0)], CHAR)
    objects = spark.createDataFrame([(1, 1, 0, 0.0, 20.0, 20.0, 10.0, 9.0, 9.0)], OBJECT)
    plan = glyphs.objects_of_characters(chars, objects).hint("merge")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1


def test_a_view_box_names_its_boxes_once(spark):
    assert str(glyphs.view_box(F.col("mediabox"), F.col("cropbox"))).count("cropbox") < 20


def test_objects_on_pages(spark):
    """Equal to the join, over pages of crowded boxes, with equal ones, missing numbers, an i on two objects and a page without a number."""
    n = "doc_id long, page int, k long, left double, right double, top double, bottom double, drawn double, size double, chars array<struct<i:long,x:double,y:double,drawn:double,size:double>>"
    r, rows = random.Random(5), []
    for k in range(900):
        left, bottom, size = float(r.randrange(60)), r.choice((-3.5, 0.0, 4.0, 4.25, 20.0)) + r.randrange(3), float(r.randrange(8, 12))
        chars = [(k * 8 + j, left + j * 7.25, r.choice((bottom - 2, bottom + 2.5, bottom + 30, None)), r.choice((0.0, size, size + 1, None)), r.choice((0.0, size - 1, None))) for j in range(r.randrange(5))]
        rows.append((1 + k % 2, r.choice((1, 2, 2, 2, None)), k, left, left + 20 if k % 9 else None, bottom + size, bottom, size * 1.1, size, chars if k % 7 else None))
    rows.append((1, 2, 900, 0.0, 90.0, 30.0, -9.0, 9.0, 9.0, [(16, 30.0, 4.0, 9.0, 9.0), (None, 1.0, 1.0, 1.0, 1.0), (None, 30.0, 4.0, 0.0, 0.0)]))
    objects = spark.createDataFrame(rows, n).repartition(2, "doc_id", "page")
    chars = objects.select("doc_id", "page", F.inline("chars"))
    joined = glyphs.objects_of_characters(chars.where("i <> 16 and page is not null"), objects.drop("chars")).collect()
    told = [tuple(x) for x in glyphs.objects_on_pages(objects).collect()]
    assert sorted(tuple(x) for x in joined) == sorted(x for x in told if x[2] not in (16, None) and x[1] is not None) and len({x[3] for x in told}) > 90
    assert sorted(x[:3] for x in told if x[1] is not None and x[2] is not None) == sorted({(x[0], x[1], x[2]) for x in chars.where("page is not null and i is not null").collect()})
    assert [x[3] for x in told if x[1] is None and x[3] is not None] == [] and sum(x[2] is None for x in told) == 1
    assert [x for x in told if x[:3] == (1, 2, None)][0][3] is not None


def test_character_objects_deal_out_spans_once(spark):
    """One exchange and one sort, of spans; characters, six times as many, were dealt out beside them by row of a page, and each pair that may belong together was sorted."""
    plan = glyph_queries.character_objects(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Join" not in plan
