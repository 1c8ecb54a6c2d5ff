"""Operators on trees, outlines, bookmarks, replies and pages that no SQL says: against definitions, and by their invariants."""

import json
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.functions import text as T
from quire.operators import assembly, bookmarks, merging, optimizer, outline, retrieval, triage
from quire.operators.grouped import values

NODES = "doc_id long, ord int, parent_ord int, title string, start_page int, end_page int"


def random_trees(n, seed=5):
    r, rows = random.Random(seed), []
    for doc in range(n):
        spans, parents = {}, {}
        for o in range(r.randint(1, 14)):
            p = None if o == 0 or r.random() < 0.2 else r.choice([o - 1, parents[o - 1]])
            lo, hi = spans[p] if p is not None else (1, 20)
            a = r.randint(lo, hi)
            spans[o], parents[o] = (a, r.randint(a, hi)), p
            rows.append((doc, o, p, f"t{o}", *spans[o]))
    return rows


def test_optimiser_keeps_its_promises(spark):
    rows = random_trees(150)
    given = {}
    for d, o, p, t, a, b in rows:
        given.setdefault(d, {})[o] = (p, t, a, b)
    out = {}
    for r in optimizer.optimised(spark.createDataFrame(rows, NODES)).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert set(out) == set(given)
    for d, kept in out.items():
        by = {r["ord"]: r for r in kept}
        assert [r["node_id"] for r in kept] == [f"{i:04d}" for i in range(len(kept))]
        told = [x for r in kept for x in (r["title"].split("; ") if r["same_page"] else [r["title"]]) + r["key_items"]]
        assert {t for _, t, *_ in given[d].values()} <= set(told)  # what goes is kept by name
        for r in kept:
            assert r["parent_ord"] is None or r["parent_ord"] in by
            kids = [k for k in kept if k["parent_ord"] == r["ord"]]
            leaves = [(k["start_page"], k["end_page"]) for k in kids if not any(x["parent_ord"] == k["ord"] for x in kept)]
            assert len(leaves) == len(set(leaves))  # no two leaves over the same pages
    again = spark.createDataFrame([(d, r["ord"], r["parent_ord"], r["title"], r["start_page"], r["end_page"]) for d, x in out.items() for r in x], NODES)
    assert optimizer.optimised(again).count() == sum(map(len, out.values()))  # a fixpoint


def test_a_search_costs_what_its_frontier_says(spark):
    df = spark.createDataFrame(random_trees(80, 9), NODES)
    cost = {(r["doc_id"], r["ord"]): r for r in optimizer.node_costs(df, 1).collect()}
    worst = {}
    for r in optimizer.frontier(df, 1).collect():
        worst[r["doc_id"]] = max(worst.get(r["doc_id"], 0), r["cost"])
    for d, w in worst.items():
        assert w == max(x["cost"] for (k, _), x in cost.items() if k == d and x["depth"] == 1) + 1


def test_settled_nodes_and_gains(spark):
    df = spark.createDataFrame([(1, 0, None, "a", 1, 9), (1, 1, None, "b", 10, 12)], NODES)
    assert {r["ord"]: r["settled"] for r in optimizer.optimised(df).collect()} == {0: False, 1: True}
    proposed = spark.createDataFrame([(1, 0, 1, 4), (1, 0, 5, 9)], "doc_id long, ord int, start_page int, end_page int")
    assert [tuple(r) for r in optimizer.expand_gain(df, proposed).collect()] == [(1, 0, 9, 6, True)]


def test_parts_hold_all_nodes_within_the_budget():
    r = random.Random(3)

    def node(depth):
        n = {"title": "x" * r.randint(1, 40), "node_id": f"{r.randint(0, 9999):04d}"}
        return n | ({"nodes": [node(depth - 1) for _ in range(r.randint(1, 4))]} if depth and r.random() < 0.7 else {})

    def ids(nodes):
        return [y for n in nodes for y in [n["node_id"], *ids(n.get("nodes", []))]]

    for _ in range(60):
        tree = [node(3) for _ in range(r.randint(1, 5))]
        for budget in (80, 200, 1000):
            parts = retrieval.split(tree, budget)
            assert list(dict.fromkeys(x for p in parts for x in ids(p))) == list(dict.fromkeys(ids(tree)))
            if len(retrieval.dumps(tree)) <= budget:
                assert parts == [tree]
            for p in parts:  # only what was split, or cannot be, is over the budget, and alone
                assert len(p) == 1 or sum(len(retrieval.dumps(n)) for n in p) <= budget


def test_trees_for_readers(spark):
    df = spark.createDataFrame([(1, 0, None, "Top", "0000", 1, 2, "all", ["k"], "hidden"), (1, 1, 0, "Leaf", "0001", 2, 2, "part", [], None)], NODES.replace("title string,", "title string, node_id string,") + ", summary string, key_items array<string>, text string")
    part = retrieval.structure_part(df, 7).first()
    assert (part["part"], part["n_parts"], part["has_more"]) == (1, 1, False)
    top = json.loads(part["structure"])[0]
    assert list(top) == ["title", "node_id", "start_index", "end_index", "summary", "nodes", "key_items"] and "text" not in top
    tree = json.loads(retrieval.reader_trees(df).first()["tree"])[0]
    assert tree["prefix_summary"] == "all" and tree["nodes"][0]["summary"] == "part" and tree["page_index"] == 1 and tree["text"] == "hidden"
    pages = spark.createDataFrame([(1, 1, "one"), (1, 2, "two")], "doc_id long, page int, markdown string")
    rows = {r["ord"]: (r["level"], r["text"]) for r in retrieval.flattened(df.withColumn("level", F.col("ord") + 1).drop("text"), pages).collect()}
    assert rows == {0: (1, "one\ntwo"), 1: (2, "two")}
    assert retrieval.page_texts(pages, "raw").first()["text"] == "one\n\ntwo"
    with pytest.raises(ValueError):
        retrieval.page_texts(pages, "other")


def test_tool_calls(spark):
    assert retrieval.bound("get_document", {"doc_name": "a", "_scope": 1, "wait_for_completion": " No "}) == {"doc_name": "a", "wait_for_completion": False}
    for name, given, said in (("nothing", {}, "unknown tool"), ("get_document", {"other": 1}, "needs doc_name"), ("get_document", {"doc_name": "a", "other": 1}, "takes no other"), ("get_document", [], "object"), ("remove_document", {"doc_names": [str(i) for i in range(11)]}, "10 documents")):
        with pytest.raises(retrieval.InvalidCall, match=said):
            retrieval.call(name, given, spark.range(0).select(F.col("id").cast("string"), F.lit("").alias("name")), None, None)
    assert [retrieval.whole(x, -1) for x in ("1_0", " +5 ", 2.9, True, "x", None, float("nan"))] == [10, 5, 2, 1, -1, -1, -1]
    records = spark.createDataFrame([Row(id="1", name="a.pdf", created_at="2024-01-01", page_num=3, status="completed"), Row(id="2", name="a.pdf", created_at="2025-01-01", page_num=30, status="completed"), Row(id="3", name="b.pdf", created_at="2023-01-01", page_num=9, status="processing")]).withColumn("created_at", F.to_timestamp("created_at"))
    nodes = spark.createDataFrame([(2, 0, None, "Only", "0000", 1, 2)], NODES.replace("title string,", "title string, node_id string,"))
    pages = spark.createDataFrame([(2, 1, "one"), (2, 2, "two"), (1, 1, "old")], "doc_id long, page int, markdown string")
    run = lambda name, allowed=None, **given: retrieval.call(name, given, records, nodes, pages, allowed).collect()
    assert [(r["id"], r["hint"]) for r in run("get_document", doc_name="a.pdf")] == [("2", "large")]
    assert [r["page"] for r in run("get_page_content", doc_name="a.pdf", pages="2-9")] == [2] and run("get_page_content", doc_name="a.pdf", pages="x") == []
    assert run("get_document_structure", doc_name="b.pdf") == [] and len(run("get_document_structure", doc_name="a.pdf", part="9")) == 1
    assert [r["id"] for r in run("browse_documents", spark.createDataFrame([("3",)], "id string"), limit=99)] == ["3"]
    assert sorted(r["id"] for r in run("remove_document", doc_names=["a.pdf", "a.pdf"])) == ["1", "2"]
    assert [r["name"] for r in retrieval.close_names(records, "a.pdx").collect()][0] == "a.pdf"


def merged(spark, detected, marks, n_pages=20, texts=None):
    d = spark.createDataFrame([(1, *x) for x in detected], NODES)
    m = spark.createDataFrame([(1, i, *x) for i, x in enumerate(marks)], "doc_id long, ord int, title string, level int, page int")
    t = spark.createDataFrame([(1, p, x) for p, x in texts.items()], "doc_id long, page int, markdown string") if texts else None
    out = merging.applied(d, m, spark.createDataFrame([(1, n_pages)], "doc_id long, n_pages int"), t).orderBy("ord").collect()
    return {r["source"] for r in out}, [(r["title"], r["depth"], r["start_page"], r["end_page"]) for r in out]


def test_full_bookmarks_take_the_detected_nodes_in(spark):
    marks = [("Alpha", 1, 2), ("Alpha one", 2, 3), ("Beta", 1, 8), ("Beta one", 2, 9), ("Beta two", 2, 12), ("Gamma", 1, 15)]
    detected = [(0, None, "Foreword", 1, 1), (1, None, "ALPHA", 2, 7), (2, 1, "Detail", 4, 5), (3, None, "Label", 5, 5), (4, None, "Label", 9, 9), (5, None, "label", 13, 13), (6, None, "Long", 14, 16), (7, 6, "Inside", 16, 16)]
    source, rows = merged(spark, detected, marks)
    assert source == {"bookmarks"}
    assert rows == [("Foreword", 1, 1, 2), ("Alpha", 1, 2, 8), ("Alpha one", 2, 3, 8), ("Detail", 3, 4, 8), ("Beta", 1, 8, 15), ("Beta one", 2, 9, 12), ("Beta two", 2, 12, 15), ("Long", 3, 14, 15), ("Gamma", 1, 15, 20), ("Inside", 2, 16, 20)]


def test_skeleton_bookmarks_are_chapters(spark):
    marks = [("First part", 1, 3), ("Wanted", 2, 5), ("Absent", 2, 6), ("Second part", 1, 9)]
    detected = [(0, None, "Before", 1, 2), (1, None, "Frist part", 3, 8), (2, 1, "Point", 4, 5), (3, None, "Late", 10, 12)]
    source, rows = merged(spark, detected, marks, texts={5: "…", 6: "here is WANTED text", 20: "Absent"})
    assert source == {"hybrid"}
    assert rows == [("Before", 1, 1, 3), ("First part", 1, 3, 9), ("Point", 2, 4, 5), ("Wanted", 2, 5, 9), ("Second part", 1, 9, 20), ("Late", 2, 10, 20)]


def test_generic_bookmarks_are_left_out(spark):
    source, rows = merged(spark, [(0, None, "Real", 1, 20), (1, 0, "Inner", 3, 9)], [(f"Page {i}", 1, i) for i in range(1, 6)])
    assert (source, rows) == ({"detected"}, [("Real", 1, 1, 20), ("Inner", 2, 3, 9)])


def test_levels_are_stacked_anew(spark):
    marks = spark.createDataFrame([(1, i, f"t{i}", lv, p) for i, (lv, p) in enumerate([(3, 1), (5, 2), (4, 2), (9, 1), (4, 3), (1, 4), (2, 99)])], "doc_id long, ord int, title string, level int, page int")
    got = outline.valid_bookmarks(marks, spark.createDataFrame([(1, 9)], "doc_id long, n_pages int")).orderBy("ord").collect()
    assert [(r["ord"], r["level"]) for r in got] == [(0, 1), (1, 2), (2, 2), (4, 2), (5, 1)]


def test_titles(spark):
    rows = [("Kapitel 7b: Öl", "kapitel#böl", "kapitel7böl", False), ("iv", "#", "4", False), ("Mix XI mcd", "mixxi#", "mixxi1400", False), ("folie\t12", "folie#", "folie12", True), ("٣", "٣", "٣", True), ("Page", "page", "page", False), ("a $b$ 1 $q", "a#q", "a1q", False), ("x1y22", "x#y#", "x1y22", False)]
    df = spark.createDataFrame([r[:1] for r in rows], "t string")
    assert [tuple(r) for r in df.select("t", T.title_template(F.col("t")), T.title_key(F.col("t")), T.is_generic_title(F.col("t"))).collect()] == rows


def test_likeness_is_only_computed_where_lengths_allow_it(spark):
    nodes = spark.createDataFrame([(1, 0, "Market overview", 4), (1, 1, "Terms", 4)], "doc_id long, ord int, title string, start_page int")
    marks = spark.createDataFrame([(1, 5, "Market  Overveiw", 5), (1, 6, "A very long title of terms and more", 4), (1, 7, "$x$", 4)], "doc_id long, ord int, title string, page int")
    assert sorted((r["ord"], r["b_ord"]) for r in bookmarks.same_headings(nodes, marks).collect()) == [(0, 5)]


def test_dot_leaders(spark):
    rows = {"Scope .... 4": True, "Scope . . . iv  ": True, "....5": True, "...5": False, "  . . . . 5": True, "a.  . . . 7": True, "Scope .. 4": False, "Scope .... 4 x": False, "x" * 30_000 + " ..... 9": True, "." * 30_000: False, "word " * 6_000: False}
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r[0] for r in df.select(T.is_dot_leader_row(F.col("t"))).collect()] == list(rows.values())


def candidate(ord, page, kind, title, numbering=(), **more):
    base = dict(doc_id=1, ord=ord, page=page, y_frac=0.1, kind=kind, numbering=list(numbering), prominent=False, title=title, style="s", size=12.0, score=12.0, caps=False, centred=False, italic=0.0, bold=0.0, at_top=False, body=0.0)
    return tuple((base | more)[c] for c in assembly.COLUMNS)


KINDS = "doc_id long, ord int, page int, y_frac double, kind int, numbering array<int>, prominent boolean, title string, style string, size double, score double, caps boolean, centred boolean, italic double, bold double, at_top boolean, body double"


def test_outline_of_numbered_chapters(spark):
    rows = [candidate(0, 1, 5, "Abstract", prominent=True), candidate(1, 2, 8, "Chapter 1", prominent=True, score=16.0), candidate(2, 2, 1, "Scope", (1,)), candidate(3, 3, 1, "Terms", (1, 1)), candidate(4, 4, 1, "Leap", (9,)), candidate(5, 5, 1, "Uses", (2,), at_top=True), candidate(6, 6, 1, "Uses again", (2,)), candidate(7, 7, 0, "Odd size", size=30.0), candidate(8, 8, 8, "Chapter 2", prominent=True, score=16.0, at_top=True)]
    out = assembly.assembled(spark.createDataFrame(rows, KINDS))
    assert [(r["ord"], r["parent_ord"], r["level"]) for r in out.orderBy("ord").collect()] == [(0, None, 1), (1, None, 1), (2, 1, 2), (3, 2, 3), (5, 1, 2), (8, None, 1)]
    pages = spark.createDataFrame([(1, 10)], "doc_id long, n_pages int")
    assert [(r["title"], r["start_page"], r["end_page"], r["node_id"]) for r in assembly.sections(out, pages).orderBy("ord").collect()] == [("Abstract", 1, 2, "0000"), ("Chapter 1", 2, 7, "0001"), ("Scope", 2, 4, "0002"), ("Terms", 3, 4, "0003"), ("Uses", 5, 7, "0004"), ("Chapter 2", 8, 10, "0005")]
    g = assembly.gates(out, pages).first()
    assert (g["tops"], g["valid"], g["chapters"], g["chaptered"], g["kept"]) == (3, False, 2, False, True)


def test_an_outline_is_computed_once_and_read_without_rounds_of_joins(spark):
    rows = [candidate(0, 1, 8, "Chapter 1", prominent=True, score=16.0), candidate(1, 2, 1, "  ", (1,)), candidate(2, 2, 1, "Scope", (1, 1)), candidate(3, 9, 1, "Terms", (1, 1, 1)), candidate(4, 9, 1, "Uses", (2,)), candidate(5, 5, 1, "Uses", (2,))]
    rows += [(2, *r[1:]) for r in rows[2:]] + [(None, *r[1:]) for r in rows]
    df = spark.createDataFrame(rows, KINDS)
    out, pages = assembly.assembled(df), spark.createDataFrame([(1, 10), (2, 12)], "doc_id long, n_pages int")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan(assembly.gates(out, pages)) + plan(assembly.sections(out, pages))
    assert sorted(assembly.sections(out, pages).collect()) == sorted(assembly.sections(out.drop("up"), pages).collect()) != []
    kept = df.join(assembly.nearby_duplicates(df), ["doc_id", "ord"], "left_anti")
    told = kept.join(assembly.keyword_clique(kept, (1, 8)).select("doc_id", F.col("style").alias("clique")), "doc_id", "left").select("doc_id", "ord", "clique")
    fast = assembly.with_clique(assembly.without_duplicates(df), (1, 8)).select("doc_id", "ord", "clique")
    assert sorted(map(str, fast.collect())) == sorted(map(str, told.collect()))


def test_values_of_arrow_columns():
    columns = [pa.array([1, None, 3]), pa.array([1.5, None, math.inf]), pa.array([True, None, False]), pa.array(["a", None, "é"]), pa.array([[1.0, None], None, []]), pa.array([["x"], [None], None]), pa.array([{"a": 1}, None, {"a": 2}]), pa.array([2**53 + 1, 2**62, None]), pa.array([1, 2, 3], pa.int32())]
    for c in columns:
        for part in (c, c.slice(1), c.slice(2, 1), c.slice(0, 0)):
            got = values(part)
            assert got == part.to_pylist() and [type(x) for x in got] == [type(x) for x in part.to_pylist()]


def test_which_heading_is_shallower(spark):
    r = random.Random(4)
    rows = [candidate(i, 1, r.choice([0, 1, 2, 4, 5, 8]), "t", [1] * r.randint(0, 3), size=r.choice([10.0, 12.0]), score=r.choice([10.0, 11.0, 13.0]), caps=r.random() < 0.5, centred=r.random() < 0.5, italic=r.choice([0.0, 1.0]), bold=r.choice([0.0, 1.0]), style=r.choice("ab")) for i in range(150)]
    rows += [candidate(200 + i, 1, k, "t", n, **more) for i, (k, n, more) in enumerate([(8, (1,), {}), (1, (1,), {}), (1, (1, 2), {}), (2, (1,), {}), (2, (4,), {}), (11, (), {}), (0, (), {"score": 15.0}), (0, (), {"score": 14.5, "bold": 1.0}), (0, (), {"score": 12.0, "caps": True})])]
    df = assembly.ranked(spark.createDataFrame(rows, KINDS).withColumn("clique", F.lit("a"))).withColumn("rank", F.array("rank.*"))
    got = {x["ord"]: x for x in df.collect()}
    for i in range(150):
        for j in range(i):
            assert assembly.shallower(got[i], got[j]) == -assembly.shallower(got[j], got[i]), (got[i], got[j])
    of = lambda a, b: assembly.shallower(got[200 + a], got[200 + b])
    assert [of(0, 1), of(1, 2), of(3, 4), of(5, 1), of(6, 1), of(6, 7), of(7, 6), of(8, 6), of(1, 3)] == [1, 1, 0, -1, 1, -1, 1, -1, 0]


def test_page_labels(spark):
    rows = [("blank", "", 0.0, 0, "text"), ("scan", "x", 0.5, 900, "scanned"), ("drawing", "Fig 1", 0.1, 150, "graphic"), ("good", "Plain words stand here in good order", 0.0, 0, "text"), ("mixed", "Plain words stand here in good order", 0.25, 0, "mixed"), ("bad", "abc� def� words here follow on", 0.9, 0, "garbled"), ("noise", "bcdfghj klmnpqr " * 12, 0.0, 0, "garbled"), ("little noise", "bcdfghj klmnpqr stvwxzb", 0.0, 0, "text")]
    df = spark.createDataFrame([(i, 1, t, c, p) for i, (_, t, c, p, _) in enumerate(rows)], "doc_id long, page int, markdown string, image_coverage double, path_objects int")
    got = {r["doc_id"]: r["label"] for r in triage.labelled(triage.signals(df)).collect()}
    assert [got[i] for i in range(len(rows))] == [r[-1] for r in rows]


def test_word_like_tokens(spark):
    rows = {"(n/a), FY25-x 3rd!": (1.0, 7), "12 34": (1.0, 0), "ありがとう": (1.0, 5), "brzdtk Straße": (0.5, 12), "a1b2c3d4": (0.0, 4), "x" * 31 + "a": (0.0, 32)}
    df = spark.createDataFrame([(t,) for t in rows], "t string").select(triage.word_stats(F.col("t")).alias("w"))
    assert [(r["w"]["ratio"], r["w"]["letters"]) for r in df.collect()] == list(rows.values())


def test_readers_replies(spark):
    lines = [(1, 1, i, 10.0, 20.0 * i, 60.0, 20.0 * i + 10, t) for i, t in enumerate(["Name", "Sums"])]
    lines += [(1, 1, 10 + 2 * i + j, 10.0 + 100 * j, 100.0 + 15 * i, 60.0 + 100 * j, 110.0 + 15 * i, t) for i in range(4) for j, t in enumerate(["row", f"({i},000)"])]
    df = spark.createDataFrame(lines, "doc_id long, page int, ix long, x0 double, y0 double, x1 double, y1 double, text string")
    pages = spark.createDataFrame([(1, 1, 100.0, 200.0, 200.0, 400.0)], "doc_id long, page int, width double, height double, width_px double, height_px double")
    assert [tuple(r)[2:] for r in triage.table_regions(df, pages).collect()] == [(1, 5.0, 95.0, 165.0, 160.0, 4)]
    s = triage.spans_of_lines(df.withColumn("confidence", F.lit(0.5)), pages).where("ix = 10").first()
    assert (s["left"], s["right"], s["top"], s["bottom"], s["size"], s["baseline"]) == (5.0, 30.0, 150.0, 145.0, 4.0, 146.0)
    made = lambda t: [tuple(x) for x in spark.createDataFrame([(t,)], "r string").select(triage.reply_blocks(F.col("r")).alias("b")).first()["b"]]
    assert made('```json\n[{"type": "Title", "level": 1, "text": "A"}, {"content": "b",}]\n```') == [("title", 1, "A"), ("text", None, "b")]
    assert made("## Head\n\nplain #1\n") == [("heading", 2, "Head"), ("text", None, "plain #1")]
    html = spark.createDataFrame([(1, '<table><tr><td colspan="3">a&quot;</td><td>b</td></tr></table>')], "page_id long, html string")
    assert triage.html_tables(html).first()["cells"] == ['a"', "", "", "b"]


def test_pages_take_the_better_text(spark):
    box = "doc_id long, page int, ix long, left double, right double, top double, bottom double, text string"
    layer = spark.createDataFrame([(1, p, 1, 0.0, 10.0, 10.0, 0.0, t) for p, t in enumerate(["keep", "gone", "brzdtkl mnpqrst", "side", "fine words here"], 1)], box)
    read = spark.createDataFrame([(1, p, 5, 0.0 if p != 4 else 50.0, 10.0 if p != 4 else 60.0, 10.0, 0.0, t) for p, t in ((1, "other"), (2, "scan"), (3, "clear words"), (4, "region"), (5, "zzzzz"))] + [(1, 4, 6, 1.0, 9.0, 9.0, 1.0, "double")], box)
    labels = spark.createDataFrame([(1, 1, "graphic"), (1, 2, "scanned"), (1, 3, "garbled"), (1, 4, "mixed"), (1, 5, "garbled")], "doc_id long, page int, label string")
    got = sorted((r["page"], r["text"], r["source"]) for r in triage.combined(layer, read, labels).collect())
    assert got == [(1, "keep", "text_layer"), (2, "scan", "ocr"), (3, "clear words", "ocr"), (4, "region", "ocr"), (4, "side", "text_layer"), (5, "fine words here", "text_layer")]


def test_grid_coverage(spark):
    rows = [(1, 1, 0.0, 50.0, 100.0, 0.0), (1, 1, 25.0, 75.0, 100.0, 50.0), (1, 2, -10.0, 0.0, 5.0, 1.0), (1, 3, -5.0, 500.0, 500.0, -5.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, left double, right double, top double, bottom double")
    assert {r["page"]: r["share"] for r in triage.coverage(df, 100.0, 100.0).collect()} == {1: 0.625, 2: 0.0, 3: 1.0}
    assert {r["share"] for r in triage.coverage(df, 0.0, 10.0).collect()} == {0.0}


def test_scalars(spark):
    one = lambda c, **v: spark.range(1).select(*[F.lit(x).alias(k) for k, x in v.items()]).select(c.alias("o")).first()["o"]
    for t, n in (("III", 3.0), ("Twelve", 12.0), ("14", 14.0), ("0", None), ("iii", None)):
        assert one(S.ordinal(F.col("t")), t=t) == n
    assert [one(S.letter_ordinal(F.col("t")), t=t) for t in ("c", "H", "i", "ab")] == [3, 8, None, None]
    for x in (2.675, 0.125, 0.375, -1.5, 1e17):
        assert one(S.rounded(F.col("x"), F.lit(2)), x=x) == round(x, 2)
    assert one(S.significant(F.col("x"), F.lit(6)), x=math.pi * 1000) == 3141.59
    assert [one(S.half_up(F.col("x")), x=x) for x in (0.25, 0.35, -0.75, float("inf"))] == ["0.3", "0.3", "-0.8", "Infinity"]
    assert one(S.serialized_length(F.col("j")), j='{"a":[1,"é"]}') == len('{"a": [1, "é"]}')
    assert one(S.without_fields("text")(F.col("j")), j='[{"text":1,"n":[{"text":2,"k":3}]}]') == '[{"n": [{"k": 3}]}]'
    assert one(S.style_key(F.lit("Times"), F.lit(True), F.lit(9.25))) == "Times B 9.3"
    assert one(S.tokens(F.col("t")), t="co­\noperate 12ab ...!") == ["cooperate", "12", "ab", "...", "!"]
    p = S.phrases("Table of contents", "table", "Annex (A)")
    assert one(S.earliest_phrase(F.col("t"), p), t="See the TABLE of Contents, annex (a)").asDict() == {"at": 2, "phrase": "table of contents"}
    assert one(S.is_phrase(F.col("t"), p), t="Annex (A)") and not one(S.is_phrase(F.col("t"), p), t="tables") and one(S.starts_with_phrase(F.col("t"), p), t="Table 3") and one(S.earliest_phrase(F.col("t"), p), t="none") is None
    span = lambda t, a, b: F.struct(F.lit(t).alias("text"), F.lit(a).alias("top"), F.lit(b).alias("bottom"))
    assert one(S.raised_number(span("3", 12.0, 8.0), span("Note", 10.0, 2.0))) and not one(S.raised_number(span("x", 12.0, 8.0), span("Note", 10.0, 2.0)))


def test_a_tree_sorts_its_entries_once_a_direction(spark):
    """Entries that come with n_pages are not joined to it again, and nothing goes back to an order left before."""
    rows = [(d, o, f"t{o}", 1 + (o * d) % 3, min(9, 1 + o)) for d in (1, 2) for o in range(6)]
    e, pages = spark.createDataFrame(rows, "doc_id long, ord int, title string, level int, page int"), spark.createDataFrame([(1, 9), (2, 9)], "doc_id long, n_pages int")
    with_pages = outline.valid_bookmarks(e, pages)
    got = outline.tree(with_pages, pages)
    assert sorted(got.collect()) == sorted(outline.tree(with_pages.drop("n_pages"), pages).collect()) and got.count() == 12
    dealt = e.join(pages, "doc_id").repartition("doc_id").sortWithinPartitions("doc_id", "ord")
    plan = outline.tree(dealt, pages)._jdf.queryExecution().executedPlan().toString()
    assert [len(re.findall(rf"Sort \[doc_id#\d+L ASC NULLS FIRST, ord#\d+ {way}", plan)) for way in ("ASC", "DESC")] == [1, 1]


def test_the_smallest_node_of_a_page_whatever_nodes_span(spark):
    rows = [(d, o, 1 + o % 3, a, b) for d, o, p, t, a, b in random_trees(60, 8)] + [(900, 0, 1, 1, 2_147_483_640), (900, 1, 2, 7, 7), (900, 2, 2, 7, 7)]
    nodes = spark.createDataFrame(rows, "doc_id long, ord int, level int, start_page int, end_page int")
    asked = [(d, p) for d in range(60) for p in range(0, 22, 3)] + [(900, 7), (900, 2_000_000_000), (900, 7), (901, 1)]
    want = set()
    for d, p in asked:
        held = min(((b - a, -level, o) for doc, o, level, a, b in rows if doc == d and a <= p <= b), default=None)
        if held:
            want.add((d, p, held[2], held[0] + 1))
    got = outline.smallest_containing(nodes, spark.createDataFrame(asked, "doc_id long, page int")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
