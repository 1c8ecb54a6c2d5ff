from pyspark.sql import functions as F

from quire.operators import blocks, bookmarks, classify, lines, outline, store, summaries


def test_columns_follow_the_gutters(spark):
    rows = [(1, 1, i, x, x + 40.0, y, y + 8.0) for i, (x, y) in enumerate([(0.0, 100.0), (0.0, 88.0), (100.0, 100.0), (100.0, 88.0), (0.0, 10.0)])]
    df = spark.createDataFrame(rows, "doc_id long, page int, ix long, left double, right double, bottom double, top double")
    got = {r["ix"]: r["column"] for r in blocks.columns(df).collect()}
    assert got[0] == got[1] == 0 and got[2] == got[3] and got[4] not in (got[0], got[2])


def test_accepted_sections(spark):
    pages = spark.createDataFrame([(1, 1, "Intro. First part"), (1, 2, "Second part"), (1, 3, "Third")], "doc_id long, page int, markdown string")
    rows = [(1, 0, 1, "First Part", 1, 1, 3), (1, 0, 2, "Second part", 2, 1, 3), (1, 0, 3, "first part", 1, 1, 3), (1, 0, 4, "Intro", 1, 1, 3), (1, 0, 5, "Third", 3, 1, 2), (1, 0, 6, "Absent", 2, 1, 3)]
    got = summaries.accepted_sections(spark.createDataFrame(rows, "doc_id long, ord int, k int, title string, page int, lo int, hi int"), pages)
    assert sorted(r["k"] for r in got.collect()) == [1, 2]


def test_cache_then_model(spark):
    asked = spark.createDataFrame([("a", "user", "x"), ("b", "user", "y"), ("b", "user", "y")], "key string, role string, content string")
    kept = spark.createDataFrame([("a", "kept")], "key string, reply string")

    def complete(messages):
        return messages[0]["content"].upper()

    assert {(r["key"], r["reply"]) for r in summaries.with_cache(asked, kept, complete).collect()} == {("a", "kept"), ("b", "Y")}
    assert {r["key"] for r in summaries.with_cache(asked, kept).collect()} == {"a"}


def test_leaf_requests(spark):
    texts = spark.createDataFrame([(1, 0, "short text"), (1, 1, "word " * 300)], "doc_id long, ord int, text string")
    got = {r["ord"]: r for r in summaries.leaf_requests(texts).collect()}
    assert got[0]["summary"] == "short text" and got[0]["key"] is None and got[1]["summary"] is None and len(got[1]["key"]) == 64


def test_rejection(spark):
    got = summaries.rejection(spark.createDataFrame([(1, 11, 1, 5), (2, 10, 1, 5), (3, 3, 2, 0)], "doc_id long, tops int, depth int, words int"))
    assert {r["doc_id"]: r["reason"] for r in got.collect()} == {1: "flat", 2: None, 3: "unreadable"}


def test_bookmarks_are_backfilled(spark):
    nodes = spark.createDataFrame([(1, 0, "II. Results $x^2$", 4)], "doc_id long, ord int, title string, start_page int")
    marks = spark.createDataFrame([(1, 7, "2 Results", 4), (1, 8, "Annex", 9), (1, 9, "Nowhere", 9)], "doc_id long, ord int, title string, page int")
    pages = spark.createDataFrame([(1, 10, "The ANNEX.")], "doc_id long, page int, markdown string")
    assert [r["b_ord"] for r in bookmarks.same_headings(nodes, marks).collect()] == [7]
    assert [r["ord"] for r in bookmarks.backfilled(marks, nodes, pages).collect()] == [8]


def test_tree_by_levels(spark):
    marks = spark.createDataFrame([(1, i, f"t{i}", lv, p) for i, (lv, p) in enumerate([(1, 1), (2, 2), (3, 2), (2, 5), (1, 7)], 1)], "doc_id long, ord int, title string, level int, page int")
    got = {r["ord"]: (r["parent_ord"], r["start_page"], r["end_page"], r["node_id"]) for r in outline.tree(marks, spark.createDataFrame([(1, 9)], "doc_id long, n_pages int"), 3).collect()}
    assert got == {1: (None, 1, 7, "0000"), 2: (1, 2, 5, "0001"), 3: (2, 2, 5, "0002"), 4: (1, 5, 7, "0003"), 5: (None, 7, 9, "0004")}


def test_pages_in_budget_skips_what_does_not_fit(spark):
    pages = spark.createDataFrame([(1, 1, "a" * 50), (1, 2, "b" * 60), (1, 3, "c" * 40)], "doc_id long, page int, markdown string")
    assert sorted(r["page"] for r in store.pages_in_budget(pages, 90).collect()) == [1, 3]
    assert sorted(r["page"] for r in store.pages_in_budget(pages, 10).collect()) == [1]


def test_scalar_metadata(spark):
    df = spark.createDataFrame([('{"a": "x", "b": 2, "c": [1], "d": {"e": 1}, "f": null}',), ("{}",)], "m string")
    assert [r["m"] for r in df.select(store.scalar_metadata(F.col("m")).alias("m")).collect()] == [{"a": "x", "b": "2"}, None]


def test_heading_kinds(spark):
    texts = ["Abstract", "1 Introduction", "Chapter 4 Methods", "2.3 Data", "IV. Results", "B) Notes", "References", "A sentence that ends.", "Figure 2: x"]
    got = {r["ln"]: r["kind"] for r in classify.headings(spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(texts)], "doc_id long, page int, ln int, text string")).collect()}
    assert got == {0: 5, 1: 11, 2: 8, 3: 1, 4: 2, 5: 4, 6: 7}


def test_line_number_runs(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 1, 2, 3, 4, 5, 9])], "doc_id long, ln int, number int")
    assert [(r["first"], r["last"], r["n"]) for r in lines.line_number_runs(df).collect()] == [(1, 5, 5)]


def test_failing_calls_are_made_again_and_told(spark):
    def complete(messages):
        import os

        text = messages[0]["content"]
        error = RuntimeError(f"no {text}")
        error.status = 404 if text == "never" else 500
        path = f"/tmp/quire-{os.getpid()}-{text}"
        if text == "later" and os.path.exists(path):
            os.remove(path)
            return "done"
        if text == "later":
            open(path, "w").close()
        raise error

    asked = spark.createDataFrame([("a", "user", "later"), ("b", "user", "never")], "key string, role string, content string").coalesce(1)
    got = {r["key"]: (r["reply"], r["error"]) for r in summaries.answered(asked, complete, 3, 0.01).collect()}
    assert got == {"a": ("done", None), "b": (None, "RuntimeError: no never")}


def test_parents_are_summarised_after_their_children(spark):
    nodes = spark.createDataFrame([(1, 0, None, "Top", 1, 6), (1, 1, 0, "Mid", 2, 6), (1, 2, 1, "A", 3, 4), (1, 3, 1, "B", 5, 6)], "doc_id long, ord int, parent_ord int, title string, start_page int, end_page int")
    leaves = spark.createDataFrame([(1, 2, "sa"), (1, 3, "sb")], "doc_id long, ord int, summary string")
    pages = spark.createDataFrame([(1, p, f"page {p}") for p in range(1, 7)], "doc_id long, page int, markdown string")
    first = summaries.parent_requests(nodes, leaves, pages).collect()
    assert [r["ord"] for r in first] == [1] and "page 2\n\nA: sa\nB: sb" in first[0]["content"]

    def complete(messages):
        return messages[0]["content"].split("\n\n")[1].lower()

    got = summaries.summarised(nodes, leaves, pages, spark.createDataFrame([], "key string, reply string"), complete)
    assert {r["ord"]: r["summary"] for r in got.collect()} == {0: "top", 1: "mid", 2: "sa", 3: "sb"}
    d = summaries.description_requests(nodes, leaves).first()
    assert d["content"].endswith('[{"title":"Top"},{"title":"Mid"},{"title":"A","summary":"sa"},{"title":"B","summary":"sb"}]')
