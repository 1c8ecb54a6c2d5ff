"""Bookmarks and a detected tree made into one: bookmarks as the tree, as its chapters, or left out, by their tier.

In `applied` everything is joins, windows and aggregates over the nodes of all documents. A node's ancestors are an array, found level by
level. `of_outlines` is the same without texts, as one fold a document: what is read is dealt out once, and nothing is kept in between.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import outline
from quire.operators.grouped import by_group
from quire.operators.trees import with_ancestors
from quire.sources.scratch import kept

#: Likeness of titles that name one heading; times a detected title recurs as a running label; characters of one at most.
LIKENESS, RECURS, LONGEST = 0.7, 3, 100


def alike(a, b):
    """Whether two keys name one heading: neither is empty, and one ends the other or they are alike, which is asked only where the lengths allow it."""
    possible = 2 * F.least(F.length(a), F.length(b)) >= LIKENESS * (F.length(a) + F.length(b))
    return (a != "") & (b != "") & (F.endswith(a, b) | F.endswith(b, a) | (T.similarity(F.when(possible, a), F.when(possible, b)) >= LIKENESS))


def without_labels(nodes: DataFrame) -> DataFrame:
    """The tree without nodes whose key its document repeats, or whose title is as long as a paragraph; their children move up to the nearest ancestor that stays."""
    often = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "key"))
    label = ((F.col("key") != "") & (often >= RECURS)) | (F.length("title") > LONGEST)
    up = with_ancestors(kept(nodes.withColumn("label", label)), ["label"])
    stays = F.filter("up", lambda x: ~x["label"])
    return up.where(~F.col("label")).withColumn("parent", F.try_element_at(stays, F.lit(-1))["id"]).drop("label", "up")


def within_targets(nodes: DataFrame, targets: DataFrame, pages: DataFrame) -> DataFrame:
    """nodes with parents among the targets (doc_id, id, key, start), which hold the pages up to the next one's start; nodes that name their target's heading go.

    A subtree inside one target goes there whole, without its head if that is the target's heading. Where one reaches beyond, its head
    goes to its own target, and so does each child for itself. What lies before all targets keeps no parent among them. The target is
    found by an as-of join: a union in order of pages and a running last value.
    """
    w = Window.partitionBy("doc_id").orderBy("id")
    t = targets.select("doc_id", F.struct("id", "key", "start", F.lead("start").over(w).alias("next")).alias("t"), F.first("start").over(w).alias("first"))
    none = F.lit(None)
    marks = t.select("doc_id", F.col("t.start").alias("start"), F.lit(0).alias("side"), F.col("t.id").alias("id"), none.cast("int").alias("parent"), none.cast("string").alias("title"), none.cast("string").alias("key"), "t")
    rows = nodes.select("doc_id", "start", F.lit(1).alias("side"), "id", "parent", "title", "key").withColumn("t", none.cast(_ddl_of(marks, "t")))
    asof = Window.partitionBy("doc_id").orderBy("start", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(rows).withColumn("t", F.last("t", ignorenulls=True).over(asof)).where("side = 1").drop("side")
    found = found.join(t.groupBy("doc_id").agg(F.min("first").alias("first")), "doc_id").join(pages.select("doc_id", "n_pages"), "doc_id")
    found = kept(found.withColumn("bound", F.when(F.col("t").isNull(), F.col("first")).otherwise(F.coalesce(F.col("t.next"), F.col("n_pages") + 1))).withColumn("same", F.coalesce((F.col("start") == F.col("t.start")) & alike(F.when(F.col("start") == F.col("t.start"), F.col("key")), F.col("t.key")), F.lit(False))))
    over = with_ancestors(found, []).select("doc_id", "start", F.explode(F.concat(F.transform("up", lambda x: x["id"]), F.array("id"))).alias("id")).groupBy("doc_id", "id").agg(F.max("start").alias("last"))
    found = kept(found.join(over, ["doc_id", "id"]).withColumn("split", F.col("last") >= F.col("bound")))
    up = with_ancestors(found, ["split", "same"])
    # Whether a node is placed for itself: its parent is split, or goes and was itself placed for itself.
    alone = F.aggregate("up", F.lit(True), lambda so_far, x: x["split"] | (x["same"] & so_far))
    up = up.withColumn("alone", alone).where(~(F.col("alone") & F.col("same")))
    return up.select("doc_id", "id", F.when(F.col("alone"), F.col("t.id")).otherwise(F.col("parent")).alias("parent"), "title", "key", "start")


def _ddl_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def mended(nodes: DataFrame, said: DataFrame) -> DataFrame:
    """nodes with the titles of the bookmarks of their page that they are like without ending one another, the likest one's, of equals the last."""
    e = said.where("key <> ''").select("doc_id", F.col("id").alias("e_id"), F.col("title").alias("e_title"), F.col("key").alias("e_key"), F.col("start"))
    both = nodes.where("key <> ''").join(e, ["doc_id", "start"]).where(~F.endswith("key", "e_key") & ~F.endswith("e_key", "key")).where(2 * F.least(F.length("key"), F.length("e_key")) >= LIKENESS * (F.length("key") + F.length("e_key")))
    best = both.withColumn("r", T.similarity("key", "e_key")).where(F.col("r") >= LIKENESS).groupBy("doc_id", "id").agg(F.max_by(F.struct("e_title", "e_key"), F.struct("r", "e_id")).alias("e"))
    return nodes.join(best, ["doc_id", "id"], "left").withColumn("title", F.coalesce("e.e_title", "title")).withColumn("key", F.coalesce("e.e_key", "key")).drop("e")


def lower_entries(said: DataFrame, chapters: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bookmarks below level 1 whose title stands in the text near their page and names no node of their chapter within a page: as nodes under the bookmark above them, or that one's node, or their chapter.

    nodes: doc_id, id, key, start, chapter, path of the chapters and what lies in them.
    """
    w = Window.partitionBy("doc_id").orderBy("start", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    both = chapters.select("doc_id", "start", F.lit(0).alias("side"), "id").unionByName(said.where("level > 1").select("doc_id", "start", F.lit(1).alias("side"), "id"))
    of = both.withColumn("chapter", F.last(F.when(F.col("side") == 0, F.col("id")), ignorenulls=True).over(w)).where("side = 1 and chapter is not null").select("doc_id", "id", "chapter")
    low = said.join(of, ["doc_id", "id"])
    near = low.withColumn("near", F.explode(F.array(F.col("start") - 1, F.col("start"), F.col("start") + 1)))
    there = nodes.select("doc_id", F.col("id").alias("n_id"), F.col("key").alias("n_key"), F.col("start").alias("near"), "chapter", "path")
    hit = near.join(there, ["doc_id", "chapter", "near"]).where(alike(F.col("n_key"), F.col("key"))).groupBy("doc_id", "id").agg(F.min(F.struct("path", "n_id")).alias("h")).select("doc_id", "id", F.col("h.n_id").alias("is"))
    known = low.join(hit, ["doc_id", "id"], "left").withColumn("made", F.col("is").isNull() & F.coalesce("in_text", F.lit(False)) & ~F.col("generic")).withColumn("is", F.coalesce("is", F.when(F.col("made"), F.col("id"))))
    named = known.select("doc_id", F.col("id").alias("above"), F.col("is").alias("under")).unionByName(chapters.select("doc_id", F.col("id").alias("above"), F.col("id").alias("under")))
    return known.where("made").join(named, ["doc_id", "above"], "left").select("doc_id", "id", F.coalesce("under", "chapter").alias("parent"), "title", "key", "start")


def ordered(nodes: DataFrame) -> DataFrame:
    """nodes with `up` and `path`, by which they stand in pre-order: siblings by start, bookmarks (odd ids) before others, then by id."""
    mine = F.struct("start", (1 - F.col("id") % 2).alias("side"), "id").alias("k")
    up = with_ancestors(kept(nodes.withColumn("k", mine)), ["k"])
    return up.withColumn("path", F.concat(F.transform("up", lambda x: x["k"]), F.array("k"))).drop("k")


def finished(nodes: DataFrame, pages: DataFrame, source: str) -> DataFrame:
    """The tree as rows: numbered in pre-order; a node ends where the next one starts, or later if one below it does."""
    w = Window.partitionBy("doc_id").orderBy("path")
    o = kept(ordered(nodes).join(pages.select("doc_id", "n_pages"), "doc_id").withColumn("ord", F.row_number().over(w) - 1).withColumn("end", F.greatest("start", F.coalesce(F.lead("start").over(w), F.col("n_pages")))))
    end = o.select("doc_id", "end", F.explode(F.concat(F.transform("up", lambda x: x["id"]), F.array("id"))).alias("id")).groupBy("doc_id", "id").agg(F.max("end").alias("end_page"))
    above = o.select("doc_id", F.col("id").alias("parent"), F.col("ord").alias("parent_ord"))
    out = o.join(end, ["doc_id", "id"]).join(above, ["doc_id", "parent"], "left")
    return out.select("doc_id", F.col("ord").cast("int").alias("ord"), F.col("parent_ord").cast("int").alias("parent_ord"), (F.size("up") + 1).alias("depth"), F.format_string("%04d", "ord").alias("node_id"), "title", F.col("start").alias("start_page"), F.col("end_page").cast("int").alias("end_page"), F.lit(source).alias("source"))


def applied(detected: DataFrame, entries: DataFrame, pages: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The tree of each document after its bookmarks, and its source: bookmarks (full tier), hybrid (skeleton), detected (ignore or none).

    detected: doc_id, ord, parent_ord, title, start_page, end_page. entries: doc_id, ord, title, level, page as read. pages: doc_id,
    n_pages. texts: doc_id, page, markdown, if known: then detected titles take the form of a bookmark of their page that they are like, and lower
    bookmarks are added where their title stands within a page of theirs.
    """
    pages = pages.select("doc_id", F.col("n_pages").cast("int").alias("n_pages"))
    good = kept(outline.valid_bookmarks(entries, pages).drop("n_pages"))
    tiers = outline.bookmark_tiers(good, pages).select("doc_id", "tier")
    nodes = detected.select("doc_id", (F.col("ord") * 2).cast("int").alias("id"), (F.col("parent_ord") * 2).cast("int").alias("parent"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce(T.title_key(F.col("title")), F.lit("")).alias("key"), F.col("start_page").cast("int").alias("start"), F.col("end_page").cast("int").alias("end_page")).join(tiers, "doc_id", "left")
    nodes = kept(nodes.withColumn("tier", F.coalesce("tier", F.lit("none"))))
    above = outline.tree(good, pages).select("doc_id", "ord", F.col("parent_ord").alias("above"))
    said = good.join(above, ["doc_id", "ord"]).join(tiers, "doc_id").select("doc_id", (F.col("ord") * 2 + 1).cast("int").alias("id"), (F.col("above") * 2 + 1).cast("int").alias("above"), "title", T.title_key(F.col("title")).alias("key"), F.col("page").cast("int").alias("start"), "level", T.is_generic_title(F.col("title")).alias("generic"), "tier")
    said = kept(said)
    plain = ["doc_id", "id", "parent", "title", "key", "start"]

    own = with_ancestors(nodes.where("tier not in ('full', 'skeleton')"), [])
    by_doc = Window.partitionBy("doc_id").orderBy("id")
    out = own.select("doc_id", (F.col("id") / 2).cast("int").alias("ord"), (F.col("parent") / 2).cast("int").alias("parent_ord"), (F.size("up") + 1).alias("depth"), F.format_string("%04d", F.row_number().over(by_doc) - 1).alias("node_id"), "title", F.col("start").alias("start_page"), "end_page", F.lit("detected").alias("source"))

    full = said.where("tier = 'full'")
    placed = within_targets(without_labels(nodes.where("tier = 'full'").select(plain)), full, pages)
    out = out.unionByName(finished(full.withColumn("parent", F.col("above")).select(plain).unionByName(placed.select(plain)), pages, "bookmarks"))

    few = said.where("tier = 'skeleton'")
    chapters = kept(few.where("level = 1"))
    heads = chapters.withColumn("parent", F.lit(None).cast("int")).select(plain)
    parts = nodes.where("tier = 'skeleton'").select(plain)
    if texts is not None:
        parts = mended(parts, few)
    both = heads.unionByName(within_targets(parts, chapters, pages).select(plain))
    if texts is not None:
        both = kept(both)
        near = few.where("key <> ''").select("doc_id", "id", "key", F.explode(F.array(F.col("start") - 1, F.col("start"), F.col("start") + 1)).alias("page"))
        hits = near.join(texts.select("doc_id", "page", T.title_key(F.col("markdown")).alias("m")), ["doc_id", "page"]).where(F.contains("m", "key")).select("doc_id", "id").distinct().withColumn("in_text", F.lit(True))
        inside = ordered(both).withColumn("chapter", F.col("path")[0]["id"])
        both = both.unionByName(lower_entries(few.join(hits, ["doc_id", "id"], "left"), chapters, inside).select(plain))
    return out.unionByName(finished(both, pages, "hybrid"))


TREE = "doc_id long, ord int, parent_ord int, depth int, node_id string, title string, start_page int, end_page int, source string"


class Node:
    """A heading or bookmark (an odd id) of one document, under its parent."""

    __slots__ = ("id", "parent", "title", "key", "start", "end", "level", "path", "ord", "target", "same", "last", "split", "moved")

    def __init__(self, id, parent, title, key, start, level=0):
        self.id, self.parent, self.title, self.key, self.start, self.end, self.level = id, parent, title, key, start, start, level


def _alike(a: str, b: str | None) -> bool:
    """alike, of texts."""
    if not a or not b:
        return False
    possible = 2 * min(len(a), len(b)) >= LIKENESS * (len(a) + len(b))
    return a.endswith(b) or b.endswith(a) or (possible and SequenceMatcher(None, a, b).ratio() >= LIKENESS)


def _said(rows, n_pages) -> list[Node]:
    """The valid bookmarks under one another, as outline.valid_bookmarks and outline.tree say."""
    out, most, last, at = [], 1, [-1] * 15, {}
    for r in rows:
        if r.page is None or n_pages is None or not most <= r.page <= n_pages:
            continue
        most, depth, top = r.page, 1, -1
        for k in range(1, min(r.level or 0, 15)):
            if last[k] > top:
                depth, top = depth + 1, last[k]
        if 1 <= (r.level or 0) < 15:
            last[r.level] = r.ord
        above = max((x for k, x in at.items() if k < depth), key=lambda x: x.id, default=None) if depth <= 10 else None
        out.append(Node(2 * r.ord + 1, above, r.title, r.key, r.page, depth))
        if depth < 10:
            at[depth] = out[-1]
    return out


def _tier(said: list[Node], marks: dict, n_pages) -> str:
    """As outline.bookmark_tiers; marks: (generic, template) by id."""
    n, by = len(said), Counter(marks[x.id][1] for x in said)
    if n < 3:
        return "ignore" if n else "none"
    template, c = by.most_common(1)[0]  # of equally frequent ones the first
    counters, unit = (template or "").count("#"), (template or "").replace("#", "")
    listed = counters > 0 and 2 * c >= n and (counters >= 2 or unit not in outline.CONTENT_UNITS)
    if 2 * sum(bool(marks[x.id][0]) for x in said) >= n or listed or 4 * len({x.key for x in said} - {None}) <= n:
        return "ignore"
    return "full" if max(x.level for x in said) >= 2 and n >= max(6, n_pages // 20) else "skeleton"


def _without_labels(nodes: list[Node]) -> list[Node]:
    often = Counter(x.key for x in nodes)
    label = {x.id for x in nodes if (x.key and often[x.key] >= RECURS) or len(x.title) > LONGEST}
    stay = [x for x in nodes if x.id not in label]
    for x in stay:
        while x.parent is not None and x.parent.id in label:
            x.parent = x.parent.parent
    return stay


def _within_targets(nodes: list[Node], targets: list[Node], n_pages: int) -> list[Node]:
    """As within_targets; nodes and targets in order of ids, parents before what is under them. `moved`: what is under the node is placed for itself."""
    if not targets:
        return []
    starts = [t.start for t in targets]
    for x in nodes:
        i = bisect_right(starts, x.start)
        x.target, x.last = targets[i - 1] if i else None, x.start
        x.split = starts[i] if i < len(starts) else n_pages + 1  # the bound, until all below is known
        x.same = x.target is not None and x.start == x.target.start and _alike(x.key, x.target.key)
    for x in reversed(nodes):
        x.split = x.last >= x.split
        if x.parent is not None:
            x.parent.last = max(x.parent.last, x.last)
    out = []
    for x in nodes:
        alone = x.parent is None or x.parent.moved
        x.moved = x.split or (x.same and alone)
        if not (alone and x.same):
            out.append(x)
        if alone:
            x.parent = x.target
    return out


def _finished(nodes: list[Node], n_pages: int) -> list[Node]:
    """As finished: nodes, parents before what is under them, in pre-order with `ord` and `end`."""
    for x in nodes:
        x.path = [*(x.parent.path if x.parent is not None else ()), (x.start, 1 - x.id % 2, x.id)]
    out = sorted(nodes, key=lambda x: x.path)
    for i, x in enumerate(out):
        x.ord, x.end = i, max(x.start, out[i + 1].start if i + 1 < len(out) else n_pages)
    for x in reversed(out):
        if x.parent is not None:
            x.parent.end = max(x.parent.end, x.end)
    return out


def _detected(rows, n_pages) -> list[Node]:
    """The sections of an outline, as assembly.sections says."""
    out, at = [], {}
    for i, r in enumerate(rows):
        x = at[r.ord] = Node(2 * r.ord, at[r.parent_ord] if r.up else None, r.title, r.key, r.page)
        after = rows[i + 1] if i + 1 < len(rows) else None
        end = n_pages if after is None else after.page - 1 if after.at_top else after.page
        x.end = x.start if end is None else max(x.start, end)
        out.append(x)
    for x in reversed(out):
        if x.parent is not None:
            x.parent.end = max(x.parent.end, x.end)
    return out


def _merged(rows) -> list[tuple]:
    if rows[0].doc_id is None or rows[0].side:  # its pages are not known
        return []
    doc, n_pages = rows[0].doc_id, rows[0].n_pages
    marked = [r for r in rows if r.side == 2]
    said = _said(marked, n_pages)
    tier = _tier(said, {2 * r.ord + 1: (r.generic, r.template) for r in marked}, n_pages)
    nodes = _detected([r for r in rows if r.side == 1], n_pages)
    if tier == "full":
        source, out = "bookmarks", _finished(said + _within_targets(_without_labels(nodes), said, n_pages), n_pages)
    elif tier == "skeleton":
        chapters = [x for x in said if x.level == 1]
        for x in chapters:
            x.parent = None
        source, out = "hybrid", _finished(chapters + _within_targets(nodes, chapters, n_pages), n_pages)
    else:
        for x in nodes:
            x.ord, x.path = x.id // 2, [*(x.parent.path if x.parent is not None else ()), x.id]
        source, out = "detected", nodes
    return [(doc, x.ord, None if x.parent is None else x.parent.ord, len(x.path), f"{i:04d}", x.title, x.start, x.end, source) for i, x in enumerate(out)]


def of_outlines(headings: DataFrame, entries: DataFrame, pages: DataFrame) -> DataFrame:
    """applied(sections(headings, pages), entries, pages) of an assembled outline (with `up`), as one fold a document.

    What texts say of themselves is columns. Headings, entries and pages of a document meet in one exchange, and nothing is joined.
    """
    title = F.trim("title")
    h = headings.select("doc_id", F.lit(1).alias("side"), "ord", title.alias("title"), F.coalesce(T.title_key(title), F.lit("")).alias("key"), F.col("page").cast("int").alias("page"), "parent_ord", "at_top", (F.size("up") > 0).alias("up")).where("title <> ''")
    e = entries.select("doc_id", F.lit(2).alias("side"), F.col("ord").cast("int").alias("ord"), "title", T.title_key(F.col("title")).alias("key"), F.col("page").cast("int").alias("page"), F.col("level").cast("int").alias("level"), T.is_generic_title(F.col("title")).alias("generic"), T.title_template(F.col("title")).alias("template"))
    p = pages.select("doc_id", F.lit(0).alias("side"), F.col("n_pages").cast("int").alias("n_pages"))
    return by_group(p.unionByName(h, allowMissingColumns=True).unionByName(e, allowMissingColumns=True), ["doc_id"], ["side", "ord"], _merged, TREE)
