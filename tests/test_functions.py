import random

import pytest
from pyspark.sql import functions as F

from quire.functions import pages as P
from quire.functions import rects as R
from quire.functions import text as T
from quire.operators import optimizer, store, trees, triage
from quire.plans import catalog


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("spec, pages", [("12", [12]), ("4-6", [4, 5, 6]), ("9, 2-3,9", [2, 3, 9]), ("8-8,1", [1, 8])])
def test_page_specs(spark, spec, pages):
    """One page; a range; parts out of order, repeated and after a blank; a range of one page."""
    assert one(spark, P.expanded(F.col("s")), s=spec) == pages
    assert one(spark, P.page_spec_problem(F.col("s")), s=spec) is None


@pytest.mark.parametrize("spec, problem", [("4 -6", "invalid"), ("4,", "invalid"), ("-4", "invalid"), ("x", "invalid"), ("4;5", "invalid"), ("6-4", "invalid"), ("٤", "invalid"), ("2,0", "nonpositive"), ("0-1", "nonpositive"), ("3-10003", "too_many"), ("1-5000,4000-10500", "too_many"), ("1-9000,2-9001", None)])
def test_page_spec_problems(spark, spec, problem):
    """Blanks and signs that the form has not, digits of other scripts, falling ranges; page 0; over 10,000 pages in one range or in all, where pages named twice count once."""
    assert one(spark, P.page_spec_problem(F.col("s")), s=spec) == problem


@pytest.mark.parametrize("pages, spec", [([4, 2, 3, 9], "2-4,9"), ([7], "7"), ([5, 5, 6], "5-6")])
def test_formatted_pages(spark, pages, spec):
    """Runs become ranges whatever the order; one page; a page named twice."""
    assert one(spark, P.formatted(F.array(*map(F.lit, pages)))) == spec


@pytest.mark.parametrize("text, lines", [("one\x0btwo\x85three", ["one", "two", "three"]), ("x\r\n\r\ny", ["x", "", "y"]), ("\u2029end\n", ["", "end"]), ("none", ["none"])])
def test_split_lines(spark, text, lines):
    """Rare breaks; pairs that are one break; a break at the start and one at the end; no break."""
    assert one(spark, T.split_lines(F.col("t")), t=text) == lines


@pytest.mark.parametrize("lo, hi, ranges, n", [(3, 8, [], 6), (3, 8, [(1, 4), (7, 20)], 2), (3, 8, [(5, 5), (4, 6)], 3), (3, 8, [(9, 12), (6, 2)], 6), (3, 2, [], 0)])
def test_uncovered(spark, lo, hi, ranges, n):
    """None; ranges over both edges; one inside another; ranges outside or turned round; an empty span."""
    r = spark.createDataFrame([(lo, hi, ranges)], "lo long, hi long, r array<struct<start:long,end:long>>")
    assert r.select(trees.uncovered(F.col("lo"), F.col("hi"), F.col("r")).alias("n")).first()["n"] == n == optimizer.uncovered(lo, hi, ranges)


def test_edit_distance_is_bounded(spark):
    for a, b, limit, want in (("kitten", "sitting", 5.0, 3), ("kitten", "sitting", 1.5, 2), ("abc", "", 0.0, 3), ("same", "same", 2.0, 0)):
        assert one(spark, T.bounded_edit_distance(F.col("a"), F.col("b"), F.lit(limit)), a=a, b=b) == want


def test_rects(spark):
    a, b = R.rect(F.lit(0), F.lit(2), F.lit(2), F.lit(0)), R.rect(F.lit(1), F.lit(3), F.lit(2), F.lit(0))
    assert one(spark, R.overlap_ratio(a, b)) == pytest.approx(1 / 3)
    assert one(spark, R.contains(R.union(a, b), a)) is True
    assert one(spark, F.isnan(R.nan_max(F.lit(float("nan")), F.lit(1.0)))) is True


def test_roman(spark):
    for s, n in (("iv", 4), ("XIX", 19), ("lxxxviii", 88), ("iiii", None), ("", None), ("mix", None)):
        assert one(spark, T.roman_value(F.col("s")), s=s) == n


def test_html_table(spark):
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>1 &lt; 2</td></tr></table> text <table><tr><td>x|y</td></tr></table>"
    t = triage.html_tables(spark.createDataFrame([(1, html)], "page_id long, html string"))
    rows = [(r["table_no"], r["row_no"], r["row"]) for r in t.select("table_no", "row_no", triage.markdown_rows(F.col("cells"), F.lit(2)).alias("row")).collect()]
    assert sorted(rows) == [(0, 0, "| A | B |"), (0, 1, "| 1 < 2 |  |"), (1, 0, "| x\\|y |  |")]


def test_replies(spark):
    assert one(spark, triage.table_rows_of_tokens(F.col("s")), s="<fcel>a<fcel>b<nl><ecel><fcel>d<nl>") == [["a", "b"], ["", "d"]]
    assert one(spark, triage.boxes_in_reply(F.col("s")), s="x<loc_1><loc_2><loc_30><loc_4> y <LOC_9><LOC_2><LOC_8><LOC_7><LOC_1><LOC_6><LOC_2><LOC_3>") == [[1, 2, 30, 4], [1, 2, 9, 7]]
    assert one(spark, store.reply_json(F.col("s")), s='so: ```json\n{"a": [1, 2,],}\n``` done') == '{"a":[1,2]}'
    assert one(spark, store.reply_json(F.col("s")), s="no object") is None


def test_merging_follows_the_recursion(spark):
    r = random.Random(2)
    rows, want = [], set()
    for doc in range(60):
        spans, parents = {0: (1, r.randint(1, 12))}, {0: None}
        for o in range(1, r.randint(1, 9)):
            p = r.randrange(o) if o < 3 else r.choice([o - 1, parents[o - 1] if parents[o - 1] is not None else o - 1])
            a = r.randint(*spans[p])
            spans[o], parents[o] = (a, r.randint(a, spans[p][1] + 1)), p
        rows += [(doc, o, parents[o], f"t{o}", *spans[o]) for o in spans]
        kids = lambda o: [k for k in parents if parents[k] == o]
        end = lambda o: max([spans[o][1], *map(end, kids(o))])

        def cost(o, dead):
            pages = end(o) - spans[o][0] + 1
            below = [] if o in dead else kids(o)
            if not below:
                return pages
            gaps = len(set(range(spans[o][0], end(o) + 1)) - {x for k in below for x in range(spans[k][0], end(k) + 1)})
            return 2 + max([gaps, *(cost(k, dead) for k in below)])

        dead = set()
        for o in sorted(spans, reverse=True):
            if kids(o) and end(o) - spans[o][0] + 1 <= cost(o, dead):
                dead.add(o)
        todo = [0]
        while todo:
            o = todo.pop()
            want.add((doc, o))
            todo += [] if o in dead else kids(o)
    got = optimizer.merged(spark.createDataFrame(rows, "doc_id long, ord int, parent_ord int, title string, start_page int, end_page int"), 2)
    assert {(x["doc_id"], x["ord"]) for x in got.collect()} == want


def test_marks_go_in_every_language(spark, tmp_path):
    import hashlib

    rows = [(1, "Überfluß", "de"), (2, "naïve", "en"), (3, "Élève", "fr"), (4, "señor", "es"), (5, "Žluťoučký", None), (6, None, "de"), (None, "ä", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["texts_without_marks"](spark, str(tmp_path)).collect()
    plain = {1: "uberfluß", 2: "naive", 3: "eleve", 4: "senor", 5: "zlutoucky", 6: None, None: "a"}
    assert {r["doc_id"]: r["digest"] for r in got} == {i: t and hashlib.md5(t.encode()).hexdigest() for i, t in plain.items()} and len(got) == len(rows)


@pytest.mark.parametrize("spec, problem", [("1-9000000000", "too_many"), ("1-10000, 3-7, 9-10000", None), ("5000-10001, 1-5000", "too_many"), ("2-10001, 2-9, 20000", "too_many"), ("7, 7, 1-9999", None)])
def test_page_specs_are_counted_without_expanding(spark, spec, problem):
    assert one(spark, P.page_spec_problem(F.col("s")), s=spec) == problem
