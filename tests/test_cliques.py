"""Keyword cliques against one that adds headings in turn."""

import random

from quire.operators import cliques

HEADING = "doc_id long, ord int, page int, kind int, numbering array<int>, title string, keyword boolean, font string, style string, size double, score double, centred boolean"


def alike(a, b, near):
    if abs(a["score"] - b["score"]) >= near:
        return False
    m, n = len(a["numbering"]), len(b["numbering"])
    if m and n:
        return a["kind"] == b["kind"] and m == n
    if (not m and n > 1) or (not n and m > 1):
        return False
    if a["centred"] or b["centred"]:
        return a["centred"] == b["centred"]
    return a["style"] == b["style"] or (a["font"] == b["font"] and abs(a["size"] - b["size"]) < near)


def plain(rows):
    buckets = {}
    sig = lambda r: (r["kind"], tuple(r["numbering"]) or r["title"].lower().replace(" ", ""))
    for r in rows:
        if r["keyword"]:
            held = buckets.setdefault(r["font"], [])
            last = [x for x in held if sig(x) == sig(r)][-1:]
            if last and abs(last[0]["page"] - r["page"]) < 20:
                return set()
            if not held or any(alike(r, x, 2.0) for x in held):
                held.append(r)
    core = max(buckets.values(), key=len, default=[])
    if len(core) < 2:
        return set()
    held, names = list(core), {x["ord"] for x in core}
    for r in rows:
        if r["ord"] not in names and any(alike(r, x, 0.5) for x in held):
            held.append(r)
    return {(r["doc_id"], r["ord"], r["ord"] in names) for r in held}


def test_cliques_are_those_added_in_turn(spark):
    r, rows = random.Random(5), []
    for doc in range(150):
        for i in range(r.randint(0, 25)):
            rows.append(dict(doc_id=doc, ord=i, page=1 + i * r.choice([1, 9, 30]), kind=r.choice([0, 1, 5, 7]), numbering=r.choice([[], [], [i], [i, 2]]), title=r.choice(["Methods", "Results", "Discussion of it", "Other words"]) + str(r.choice(["", i])), keyword=r.random() < 0.4, font=r.choice("ab"), style=r.choice(["a1", "a2", "b1", "b2"]), size=r.choice([9.0, 9.4, 9.8, 12.0]), score=r.choice([9.0, 9.3, 9.6, 9.9, 10.2, 12.0, 15.0]), centred=r.random() < 0.2))
    want = set().union(*(plain([x for x in rows if x["doc_id"] == doc]) for doc in range(150)))
    got = cliques.keyword_cliques(spark.createDataFrame([tuple(x.values()) for x in rows], HEADING))
    assert {tuple(x) for x in got.collect()} == want and sum(not core for *_, core in want) > 100


def test_no_headings(spark):
    assert cliques.keyword_cliques(spark.createDataFrame([], HEADING)).collect() == []
    one = spark.createDataFrame([(1, 0, 1, 5, [], None, True, "a", "a", 9.0, 9.0, None)], HEADING)
    assert cliques.keyword_cliques(one).collect() == []
