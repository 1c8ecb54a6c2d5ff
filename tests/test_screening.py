"""Guards of headings, covers, boilerplate, number columns and running matter, on made blocks."""

from pyspark.sql import functions as F

from quire.operators import screening


def told(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column(F.col("t"))).collect()]


def test_texts(spark):
    assert told(spark, screening.box_number, "Box 3: Terms", "box 12", "Box", "Boxes 3", "Box 0") == [3, 12, None, None, None]
    assert told(spark, screening.is_year, "1987", "1700", "2100", "87", "x") == [True, False, False, False, False]
    assert told(spark, screening.is_formula, "x = 3 + y", "a long line of plain words", "f(x) / 2 * 3", "∑ 4") == [True, False, True, True]
    entry = lambda c: screening.is_reference_entry(c, F.lit(1))
    assert told(spark, entry, "[4] Smith, A. On texts. Press, 1999, pp. 3-9", "Plain words go on here without any figures", "12 13 14 15") == [True, False, False]
    light = lambda c: screening.is_boilerplate(c, F.lit(50.0))
    assert told(spark, light, "Faculty of Arts", "Prof. A\nDr. B", "Prof. A\nMr. B", "Some words") == [True, True, False, False]


def test_widths(spark):
    pages = spark.createDataFrame([(1, p, 600.0, w, 400.0) for p, w in ((1, 500.0), (2, 200.0), (3, 210.0))], "doc_id long, page int, page_width double, line_width double, doc_line_width double")
    blocks = spark.createDataFrame([(1, 1, 0, 150.0), (1, 2, 1, 150.0), (1, 3, 2, 100.0), (1, 1, 3, 220.0)], "doc_id long, page int, ix int, width double")
    assert {r["ix"]: r["too_wide"] for r in screening.too_wide(blocks, pages).collect()} == {0: False, 1: True, 2: False, 3: True}


def test_page_filter(spark):
    rows = [(1, 0, 1, 4, [2], True), (1, 1, 2, 4, [1], True), (1, 2, 3, 4, [3], True), (1, 3, 3, 1, [3], True), (1, 4, 3, 1, [1], True), (1, 5, 4, 1, [40], True), (1, 6, 4, 1, [40], False), (1, 7, 5, 0, [], True), (2, 0, 2, 1, [3], True), (2, 1, 2, 1, [3, 1], True)]
    rows += [(3, i, 1, 0, [], True) for i in range(20)] + [(3, 20 + i, 2, 1, [i + 1], True) for i in range(5)] + [(3, 30, 2, 1, [2, 1], True), (3, 31, 2, 8, [], True)]
    got = screening.page_filter(spark.createDataFrame(rows, "doc_id long, ord int, page int, kind int, numbering array<int>, plain boolean"))
    assert sorted((r["doc_id"], r["ord"]) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 6), (1, 7), (2, 1), (3, 31)]


def test_covers_and_boilerplate(spark):
    weights = {1: 100.0, 2: 900.0, 3: 300.0, **{p: 1000.0 for p in range(4, 21)}}
    pages = spark.createDataFrame([(1, p, w, False) for p, w in weights.items()] + [(2, 1, 10.0, True), (2, 2, 1000.0, False), (2, 3, 1000.0, False)], "doc_id long, page int, weight double, captions boolean")
    assert sorted((r["doc_id"], r["page"]) for r in screening.cover_pages(pages).where("cover").collect()) == [(1, 1), (1, 3)]
    blocks = spark.createDataFrame([(1, 3, t, 40.0, 10.0) for t in ("Faculty of Arts", "Dissertation", "Prof. A", "x")] + [(1, 1, "Thesis", 40.0, 10.0)] * 3, "doc_id long, page int, text string, weight double, heading_score double")
    assert screening.boilerplate_pages(blocks, pages).collect() == []  # three quarters of it
    assert [(r["doc_id"], r["page"]) for r in screening.boilerplate_pages(blocks.where("text <> 'x'"), pages).collect()] == [(1, 3)]


def test_number_columns(spark):
    texts = {0: ["3", "5", "5", "9"], 1: ["3", "5", "4"], 2: ["3", "x", "5"], 3: ["0", "2"], 4: ["7", "1.5"], 5: ["2", "12000"]}
    rows = [(1, 1, b, i, t) for b, ts in texts.items() for i, t in enumerate(ts)]
    got = {r["block"]: (r["first"], r["last"], r["length"], r["increasing"]) for r in screening.number_columns(spark.createDataFrame(rows, "doc_id long, page int, block int, ln int, text string")).collect()}
    assert got == {0: (3, 9, 4, True), 1: (3, 5, 2, False), 3: (0, 0, 0, False), 4: (7, 7, 1, False), 5: (2, 2, 1, False)}


def test_running_matter_by_place(spark):
    cols = "doc_id long, page int, ix int, cy double, edge double, text string"
    blocks = spark.createDataFrame([(1, p, 0, 780.0, 790.0, t) for p, t in enumerate(["Annual Report", "Annual Report", "Annual Reprot", "Else entirely here", "Vol. 7"], 1)] + [(1, 1, 1, 400.0, 410.0, "Annual Repor")], cols)
    known = blocks.where("text = 'Annual Report'").select("doc_id", "page", "ix", "cy", F.lit(13).alias("weight"), "text")
    got = screening.running_matter(blocks, known, spark.createDataFrame([(1, 5)], "doc_id long, n_pages int"))
    assert sorted(r["page"] for r in got.collect()) == [3, 5]


def test_neighbours(spark):
    rows = [(1, 1, 0, 0.0, 100.0, 100.0, 90.0, False), (1, 1, 1, 0.0, 40.0, 80.0, 70.0, True), (1, 1, 2, 60.0, 100.0, 60.0, 50.0, False), (1, 1, 3, 0.0, 100.0, 40.0, 30.0, True), (1, 1, 4, 300.0, 310.0, 85.0, 80.0, False)]
    got = {r["ix"]: (r["above"], r["below"], r["body_above"], r["body_below"]) for r in screening.neighbours(spark.createDataFrame(rows, "doc_id long, page int, ix int, left double, right double, top double, bottom double, body boolean"), 600.0).collect()}
    assert got == {0: (None, 1, None, 1), 1: (0, 3, None, 3), 2: (0, 3, None, 3), 3: (2, None, 1, None), 4: (None, None, None, None)}


def test_neighbours_deal_blocks_out_once_by_page(spark):
    rows = [(1, 1, 1, 0.0, 10.0, 100.0, 90.0, True), (1, 1, 2, 0.0, 200.0, 50.0, 40.0, True)]
    df = spark.createDataFrame(rows, "doc_id long, page int, ix int, left double, right double, top double, bottom double, body boolean")
    plan = screening.neighbours(df, 600.0).groupBy("doc_id", "page").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
