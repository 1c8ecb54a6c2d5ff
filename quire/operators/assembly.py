"""Outline assembly: heading candidates of a document chosen, ranked and nested into a tree of sections.

A candidate is a row: doc_id, ord (heading order), page, y_frac (place on the page, 0 at its top), kind, numbering (numbers, perhaps
none), prominent, title, style (font, weight and size), size (of its font), score (size, and more for capitals and bold), caps, centred,
italic (share), bold (share), at_top (nothing but running matter stands above it), body (weight of body text since the candidate
before). Kinds: 0 by font, 1 decimal, 2 roman, 4 letter, 5 abstract, 6 keyword, 7 references, 8 to 10 chapters, 11 introduction.

What depends on one candidate, or on two neighbours, is a column; the choice itself, where each candidate is judged by those chosen
before it, is one fold a document.
"""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.operators import trees
from quire.operators.grouped import by_group
from quire.sources.scratch import kept

#: Font distance up to which styles are neighbours, pages in which a repeated signature is a duplicate, depth of a tree,
#: and body text before a document's leading keywords.
NEIGHBOUR, NEARBY, DEEPEST, MOST_BODY = 0.9, 20, 8, 2000.0
SPECIAL, NUMBERED_ALONE = (8, 9, 10), (1, 5, 7, 9, 10)


def ranked(candidates: DataFrame) -> DataFrame:
    """candidates (with `clique`, the style of the document's keyword headings or null) with `rank`: what decides which of two headings is the shallower, each larger for the shallower one."""
    one = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    number = F.size("numbering")
    return candidates.withColumn("rank", F.struct(
        one(F.col("kind").isin(*SPECIAL)).alias("chapter"), (-number).cast("double").alias("shorter"), one(number == 0).alias("plain"), one(F.col("kind") != 11).alias("body"), F.col("score").cast("double").alias("score"),
        one(F.col("caps")).alias("caps"), one(F.col("centred")).alias("centred"), one(F.col("italic") <= 0.99).alias("upright"), one(F.col("style") == F.col("clique")).alias("member"), one(F.col("bold") > 0.5).alias("bold"), F.lit(0.0).alias("level"),
    ))


Rule = namedtuple("Rule", "by margin speaks settles")
_always, _never = (lambda a, b: True), (lambda a, b: False)
_both = lambda what: lambda a, b: bool(a.rank[what] and b.rank[what])
#: Fields of `rank` in the order in which they decide: by how much they must differ, for which pairs they speak, and which pairs they leave level.
_AT = {name: i for i, name in enumerate("chapter shorter plain body score caps centred upright member bold level".split())}
RULES = (
    Rule("chapter", 0.5, _always, _both(_AT["chapter"])),
    Rule("shorter", 0.5, lambda a, b: a.kind == b.kind and a.kind in (1, 4), _always),
    Rule("level", 0.5, lambda a, b: a.kind == b.kind == 2, _always),
    Rule("body", 0.5, lambda a, b: a.kind == 11 and len(b.numbering) == 1, _never),
    Rule("plain", 0.5, _always, lambda a, b: bool(a.numbering) and abs(a.size - b.size) < NEIGHBOUR),
    Rule("score", 1.9, _both(_AT["member"]), _never),
    Rule("score", 0.9, lambda a, b: not _both(_AT["member"])(a, b), _never),
    Rule("caps", 0.5, _always, _never),
    Rule("centred", 0.5, _always, _never),
    Rule("upright", 0.5, lambda a, b: not a.kind == b.kind == 5, lambda a, b: a.caps or _both(_AT["member"])(a, b)),
    Rule("level", 0.5, lambda a, b: a.kind == b.kind == 5, lambda a, b: a.caps or _both(_AT["member"])(a, b)),
    Rule("member", 0.5, lambda a, b: (b if a.rank[_AT["member"]] else a).kind != 4, _never),
    Rule("bold", 0.5, _always, _always),
)


def shallower(a, b) -> int:
    """1 if heading a is shallower than b (b may nest under it), -1 if deeper, 0 at one level: the first of RULES that tells them apart, or leaves them level."""
    for rule in RULES:
        if rule.speaks(a, b):
            apart = a.rank[_AT[rule.by]] - b.rank[_AT[rule.by]]
            if abs(apart) > rule.margin:
                return 1 if apart > 0 else -1
            if rule.settles(a, b):
                return 0
    return 0


def keyword_clique(candidates: DataFrame, keywords=(5, 6, 7, 11)) -> DataFrame:
    """doc_id, style, n: the style most keyword headings of a document have, if more than one has it (the first of equally frequent ones)."""
    by = candidates.where(F.col("kind").isin(*keywords)).groupBy("doc_id", "style").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("o"))
    top = by.groupBy("doc_id").agg(F.max_by(F.struct("style", "n"), F.struct("n", -F.col("o"))).alias("t"))
    return top.where("t.n > 1").select("doc_id", "t.style", "t.n")


def partitioned(candidates: DataFrame, labelled: DataFrame) -> DataFrame:
    """candidates with `anchor`, the ord of the last labelled heading (doc_id, ord) at or before each; null before the first. An as-of join by a union and a running last value."""
    marks = labelled.select("doc_id", "ord", F.lit(0).alias("_side"), F.col("ord").alias("_mark"))
    rows = candidates.withColumn("_side", F.lit(1))
    w = Window.partitionBy("doc_id").orderBy("ord", "_side")
    both = rows.unionByName(marks, allowMissingColumns=True)
    return both.withColumn("anchor", F.last("_mark", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_mark")


def nearby_duplicates(candidates: DataFrame, pages: int = NEARBY) -> DataFrame:
    """doc_id, ord of candidates whose signature a candidate before them has within fewer than `pages` pages: neighbours in a window by signature, no self-join."""
    signed = candidates.withColumn("sig", S.heading_signature(F.col("kind"), F.col("numbering"), F.col("title")))
    w = Window.partitionBy("doc_id", "sig").orderBy("ord")
    return signed.withColumn("gap", F.col("page") - F.lag("page").over(w)).where(F.col("gap") < pages).select("doc_id", "ord")


def without_duplicates(candidates: DataFrame, pages: int = NEARBY) -> DataFrame:
    """candidates without nearby_duplicates, by windows of a document alone."""
    w = Window.partitionBy("doc_id", S.heading_signature(F.col("kind"), F.col("numbering"), F.col("title"))).orderBy("ord")
    again = F.coalesce((F.col("page") - F.lag("page").over(w) < pages) & F.col("doc_id").isNotNull() & F.col("ord").isNotNull(), F.lit(False))
    marked = candidates.withColumn("_again", again).withColumn("_again", F.max("_again").over(Window.partitionBy("doc_id", "ord")))
    return marked.where(~F.col("_again")).drop("_again")


def with_clique(candidates: DataFrame, keywords=(5, 6, 7, 11)) -> DataFrame:
    """candidates with `clique`, the style that keyword_clique says or null, by windows of a document alone."""
    by, of = F.col("kind").isin(*keywords), Window.partitionBy("doc_id")
    alike = Window.partitionBy("doc_id", "style")
    counted = candidates.withColumn("_n", F.count(F.when(by, 1)).over(alike)).withColumn("_o", F.min(F.when(by, F.col("ord"))).over(alike))
    told = counted.withColumn("_t", F.max_by(F.struct("style", "_n"), F.when(F.col("_n") > 0, F.struct("_n", -F.col("_o")))).over(of))
    return told.withColumn("clique", F.when((F.col("_t._n") > 1) & F.col("doc_id").isNotNull(), F.col("_t.style"))).drop("_n", "_o", "_t")


def recurring_styles(candidates: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, style, n, pages: styles that so many unnumbered candidates of a document share, over how many pages."""
    return candidates.where(F.size("numbering") == 0).groupBy("doc_id", "style").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("pages")).where(F.col("n") >= least)


class Chosen:
    """What was chosen so far, and whether a further candidate fits it."""

    def __init__(self, rows):
        self.last, self.largest, self.in_chapter, self.single, self.sizes = None, 0, 0, None, {r.size for r in rows if r.numbering or r.prominent}
        self.levels: dict[int, object] = {}
        self.siblings: dict[tuple, set] = {}
        for r in rows:
            if r.kind == 1 and r.numbering:
                self.siblings.setdefault(tuple(r.numbering[:-1]), set()).add(r.numbering[-1])

    def add(self, c) -> None:
        if c.numbering:
            self.levels[len(c.numbering)] = c
        if c.kind == 1 and c.numbering:
            self.largest, self.in_chapter = max(self.largest, c.numbering[0]), max(self.in_chapter, c.numbering[0])
            self.single = c if len(c.numbering) == 1 else self.single
        elif c.kind in (8, 9):
            self.in_chapter = 0
        self.last = c

    def rejects(self, c) -> bool:
        return self.out_of_sequence(c) or self.out_of_style(c) or self.repeats(c)

    def out_of_sequence(self, c) -> bool:
        """Numbers that fall back, leap by more than two, or stand alone; letters that fall back."""
        if c.kind == 1 and c.numbering:
            first = c.numbering[0]
            alone = len(c.numbering) == 1 and len(self.siblings.get((), ())) <= 1
            again = len(c.numbering) == 1 and self.single is not None and first == self.in_chapter
            return alone or again or (first < self.largest and first < self.in_chapter) or (self.largest > 0 and first > self.largest + 2)
        last = self.last
        if last is not None and c.kind == last.kind == 4 and c.numbering and last.numbering:
            return last.numbering[0] > c.numbering[0] or (len(c.numbering) == 1 and last.numbering[0] == c.numbering[0])
        return False

    def out_of_style(self, c) -> bool:
        """Font headings far in size from every numbered or prominent one, and single numbers set unlike the last."""
        if c.kind not in NUMBERED_ALONE:
            return not c.caps and min((abs(c.size - x) for x in self.sizes), default=0.0) > NEIGHBOUR
        if c.kind == 1 and len(c.numbering) == 1 and self.single is not None and c.style != self.single.style:
            return abs(c.size - self.single.size) > 0.5 or (c.bold >= 0.5) != (self.single.bold >= 0.5)
        return False

    def repeats(self, c) -> bool:
        """An unnumbered heading right below a chapter that says the same, or a sentence of a font heading below a prominent one."""
        if self.last is None:
            return False
        words = lambda t: (t or "").lower().split()
        same = self.last.kind == 8 and not c.numbering and words(c.title) == words(self.last.title)
        return same or (self.last.prominent and c.kind == 0 and len(words(c.title)) >= 3 and (c.title or "").rstrip().endswith("."))


class Path:
    """The open headings, from the top down."""

    def __init__(self):
        self.open, self.letters, self.prominent = [], False, False

    def push(self, c) -> None:
        self.open.append(c)
        self.letters, self.prominent = self.letters or c.kind == 4, self.prominent or c.prominent

    def parent(self, c):
        """Closes what c does not nest under; what is then on top is its parent, or None.

        A prominent heading with at most one number closes all but chapters, and a keyword closes prominent ones. Letters and roman
        numerals may nest under a heading of another kind where none was prominent, if they start at one or continue what they closed.
        """
        closed = None
        while self.open:
            top = self.open[-1]
            shut = (c.prominent and len(c.numbering) <= 1 and top.kind != 8) or (top.prominent and c.kind == 5)
            if not shut:
                order = shallower(top, c)
                if order == 1:
                    return top
                inner = order == 0 and top.kind != c.kind and c.kind in (2, 4) and c.numbering and not self.prominent
                inner = inner and (c.kind == 2 or self.letters or not top.numbering or top.numbering[0] <= 3)
                if inner and (c.numbering[0] == 1 if closed is None else closed.kind == c.kind and closed.numbering and c.numbering[0] > closed.numbering[0]):
                    return top
            closed = self.open.pop()
        return None


def leading_keywords(rows, chosen: Chosen):
    """The candidates at the very start of a document that are an abstract or keywords on one page, in the order taken, and how many were read. None if much body text stands before them, or if three or more make a run that no abstract opens."""
    if not rows or rows[0].body >= MOST_BODY:
        return [], 0
    taken, seen, n = [], set(), 0
    for c in rows:
        if c.kind not in (5, 6) and not (c.kind == 11 and c.numbering and taken and n <= 1):
            break
        if taken and c.page > taken[0].page:
            break
        n += 1
        if (c.title or "").lower() not in seen and not chosen.rejects(c):
            seen.add((c.title or "").lower())
            chosen.add(c)
            taken.append(c)
    return ([], n) if len(taken) >= 3 and taken[0].kind != 5 else (taken, n)


COLUMNS = ("doc_id", "ord", "page", "y_frac", "kind", "numbering", "prominent", "title", "style", "size", "score", "caps", "centred", "italic", "bold", "at_top", "body")
OUTLINE = "doc_id long, ord int, parent_ord int, level int, title string, page int, y_frac double, kind int, prominent boolean, at_top boolean, up array<int>"


def assembled(candidates: DataFrame) -> DataFrame:
    """The outlines that `assembling` says, computed once for all that read them."""
    return kept(assembling(candidates))


def assembling(candidates: DataFrame) -> DataFrame:
    """doc_id, ord, parent_ord, level, title, page, y_frac, kind, prominent, at_top, up of the headings that an outline keeps; up: the ords above it, down to its parent, from the last one under an untitled heading.

    Near duplicates go first. Then the candidates of a document are read in order: those that fit what was chosen before are added, and
    nest under the nearest open heading that is shallower, DEEPEST levels at most. An outline needs a prominent heading, or candidates
    on more than one page; leading keywords stand at the top. What a candidate's document says of it is windows by document, so rows
    are dealt out once.
    """
    c = with_clique(without_duplicates(candidates.select(*COLUMNS)))

    def fold(rows):
        if not any(r.prominent for r in rows) and rows[-1].page <= rows[0].page:
            return []
        chosen, path, chosen_rows = Chosen(rows), Path(), []
        leading, read = leading_keywords(rows, chosen)
        chosen_rows += [(r, None) for r in leading]
        for r in rows[read:]:
            if not chosen.rejects(r):
                chosen.add(r)
                parent = path.parent(r)
                del path.open[DEEPEST - 1 :]
                path.push(r)
                chosen_rows.append((r, parent))
        level, up, out = {}, {}, []
        for r, parent in chosen_rows:
            level[r.ord] = 1 if parent is None else level[parent.ord] + 1
            up[r.ord] = [] if parent is None or not (parent.title or "").strip(" ") else [*up[parent.ord], parent.ord]
            out.append((r.doc_id, r.ord, None if parent is None else parent.ord, level[r.ord], r.title, r.page, r.y_frac, r.kind, r.prominent, r.at_top, up[r.ord]))
        return out

    ints = c.withColumn("numbering", F.coalesce(F.col("numbering").cast("array<int>"), F.expr("cast(array() as array<int>)"))).withColumn("ord", F.col("ord").cast("int"))
    return by_group(ranked(ints).withColumn("rank", F.array("rank.*")), ["doc_id"], ["ord"], fold, OUTLINE)


def sections(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """The outline as a section tree: doc_id, ord, parent_ord, level, node_id, title, start_page, end_page. pages: doc_id, n_pages.

    A section ends on the page before the next heading if that stands at its page's top, else on the next heading's page; the last one
    with the document; and no earlier than it starts or than its children end.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    o = outline.where("trim(coalesce(title, '')) <> ''").join(pages.select("doc_id", "n_pages"), "doc_id")
    following = F.lead(F.when(F.col("at_top"), F.col("page") - 1).otherwise(F.col("page"))).over(w)
    o = o.withColumn("end", F.greatest(F.col("page"), F.coalesce(following, F.col("n_pages")).cast("int"))).withColumn("n", F.row_number().over(w) - 1)
    if "up" in outline.columns:
        o = o.select("doc_id", F.col("ord").alias("id"), F.when(F.size("up") > 0, F.col("parent_ord")).alias("parent"), "level", "title", "page", "end", "n", "up")
    else:
        there = o.select("doc_id", F.col("ord").alias("parent_ord"), F.lit(True).alias("there"))
        o = o.join(there, ["doc_id", "parent_ord"], "left").withColumn("parent_ord", F.when(F.col("there"), F.col("parent_ord")))
        o = kept(trees.with_ancestors(kept(o.select("doc_id", F.col("ord").cast("int").alias("id"), F.col("parent_ord").cast("int").alias("parent"), "level", "title", "page", "end", "n")), []))
        o = o.withColumn("up", F.transform("up", lambda x: x["id"]))
    below = o.withColumn("at", F.explode(F.concat("up", F.array("id")))).withColumn("end_page", F.max("end").over(Window.partitionBy("doc_id", "at"))).where("at = id")
    return below.select("doc_id", F.col("id").alias("ord"), F.col("parent").alias("parent_ord"), "level", F.format_string("%04d", "n").alias("node_id"), F.trim("title").alias("title"), F.col("page").alias("start_page"), "end_page")


def gates(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, tops, widest, valid, chapters, chaptered, longest_gap, kept of each outline. pages: doc_id, n_pages.

    valid: three prominent headings or more with no gap of over half of the pages between them, or five of them. chaptered: three
    chapters or more (kinds 8 to 10) that reach over seven tenths of the pages, none of a hundred pages. longest_gap: between
    neighbouring headings, in pages. A valid outline that is not chaptered is not kept, nor one with a gap of over 0.85 of the pages.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    at = F.col("page") + F.col("y_frac")
    o = outline.withColumn("gap", at - F.lag(at, 1, 0.0).over(w))
    top = o.where("prominent").withColumn("top_gap", F.col("page") - F.lag("page").over(w)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("tops"), F.coalesce(F.max("top_gap"), F.lit(0)).alias("widest"))
    part = o.where(F.col("kind").isin(*SPECIAL)).withColumn("len", F.lead("page").over(w) - F.col("page")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chapters"), (F.max("page") - F.min("page")).alias("reach"), F.coalesce(F.max("len"), F.lit(0)).alias("longest"))
    out = o.groupBy("doc_id").agg(F.max("gap").alias("longest_gap")).join(pages.select("doc_id", "n_pages"), "doc_id").join(top, "doc_id", "left").join(part, "doc_id", "left").na.fill(0, ["tops", "widest", "chapters", "reach", "longest"])
    valid = (F.col("tops") >= 3) & ((F.col("widest") <= F.col("n_pages") / 2) | (F.col("tops") >= 5))
    chaptered = (F.col("chapters") >= 3) & (F.col("reach") >= 0.7 * F.col("n_pages")) & (F.col("longest") < 100)
    out = out.withColumn("valid", valid).withColumn("chaptered", chaptered)
    kept = ~(F.col("valid") & ~F.col("chaptered")) & (F.col("longest_gap") <= 0.85 * F.col("n_pages"))
    return out.select("doc_id", "tops", "widest", "valid", "chapters", "chaptered", "longest_gap", kept.alias("kept"))
