"""Bookmarks merged into outlines as one fold a document, against the joins."""

import random

from quire.operators import assembly, merging, trees
from quire.plans import catalog

ENTRY = "doc_id long, ord int, title string, level int, page int"
TITLES = ("Scope", "Scope of it", "The scope of it", "Terms", "Notes", "Methods of work", "Method of works", "IV. Results", "Results", "", "  ", None, "x" * 101, "Tables and more")


def made(r):
    """An outline, bookmarks and page counts of documents of every tier; titles are near one another, missing, blank, too long or repeated."""
    headings, entries, pages = [], [], []
    for doc in range(120):
        if doc % 17:
            pages.append((doc, r.choice((1, 6, 12, 30))))
        title, level, up, last = {}, {}, {}, 0
        for o in range(r.choice((0, 3, 9, 14))):
            above = r.choice([None, *[x for x in title if level[x] < 6]])
            title[o], level[o] = r.choice(TITLES), 1 if above is None else level[above] + 1
            up[o] = [] if above is None or not (title[above] or "").strip(" ") else [*up[above], above]
            last += r.choice((0, 0, 1, 2))
            headings.append((doc, o, above, level[o], title[o], 1 + last, 0.5, 1, r.random() < 0.5, r.random() < 0.5, up[o]))
        kind, page = doc % 6, 0
        for o in range(1, r.choice((1, 3, 6, 10, 16))):
            page += r.choice((0, 0, 1, 2, -1))
            text = f"Page {o}" if kind == 0 else f"Chapter {o}" if kind == 1 else f"Item {o}" if kind == 2 else r.choice(TITLES)
            entries.append((doc, o, text, r.choice((1, 1, 2, 2, 3, 4, 12)) if doc % 5 else o, page if o % 7 else None))
    return headings, entries, pages


def test_equal_to_the_joins(spark):
    headings, entries, pages = made(random.Random(3))
    h, e, p = spark.createDataFrame(headings, assembly.OUTLINE), spark.createDataFrame(entries, ENTRY), spark.createDataFrame(pages, "doc_id long, n_pages int")
    want, got = merging.applied(assembly.sections(h, p), e, p), merging.of_outlines(h, e, p)
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    key = lambda x: (x["doc_id"], x["ord"])
    rows = sorted(got.collect(), key=key)
    assert rows == sorted(want.collect(), key=key) and {x["source"] for x in rows} == {"bookmarks", "hybrid", "detected"} and max(x["depth"] for x in rows) > 5


def test_bookmarked_trees_keep_nothing(spark, monkeypatch):
    """Exchanges of the lines and of what a document has alone, no joins, and nothing written to be read again; before, each level of each tree was."""
    for module in (assembly, merging, trees):
        monkeypatch.setattr(module, "kept", None)
    df = catalog.QUERIES["bookmarked_trees"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 4 and df.count() > 1000
