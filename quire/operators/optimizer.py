"""The tree optimiser: what a search through a section tree costs, and the rewriting that lowers it.

A search walks down the tree, one hop costing `routing` pages, and ends at a frontier entry whose pages it reads: a leaf, or an inner
node's pages that no child covers (one hop further). Costs are joins and aggregates over nodes and
their ancestors; rewriting, where each step depends on those before, is one fold a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import trees
from quire.operators.grouped import by_group
from quire.sources.scratch import kept

#: Rounds of rewriting at most; characters of a joined title at most.
ROUNDS, LONGEST_TITLE = 3, 200


def uncovered(lo: int, hi: int, ranges) -> int:
    """Pages of lo to hi in none of the ranges (start, end)."""
    at, gaps = lo - 1, 0
    for start, end in sorted(r for r in ranges if r[0] <= r[1] and r[1] >= lo and r[0] <= hi):
        gaps += max(0, start - at - 1)
        at = max(at, min(end, hi))
    return gaps + max(0, hi - at)


def page_label(start: int, end: int) -> str:
    return f"p.{start}" if start == end else f"p.{start}-{end}"


class Tree:
    """A document's nodes by position in pre-order. rows: ord, parent_ord, title, start_page, end_page[, key_items], by ord."""

    def __init__(self, rows):
        self.title, self.start, self.end, self.items, self.kids, self.roots, self.same = {}, {}, {}, {}, {}, [], set()
        for r in rows:
            self.title[r.ord], self.start[r.ord], self.end[r.ord], self.kids[r.ord] = r.title, r.start_page, r.end_page, []
            self.items[r.ord] = list(getattr(r, "key_items", None) or [])
            (self.kids[r.parent_ord] if r.parent_ord in self.kids else self.roots).append(r.ord)

    def preorder(self, nodes=None) -> list[int]:
        out, todo = [], list(reversed(self.roots if nodes is None else nodes))
        while todo:
            out.append(todo.pop())
            todo.extend(reversed(self.kids[out[-1]]))
        return out

    def measure(self, routing: int) -> None:
        """reach (last page of the subtree), residual and cost of each node, from the leaves up."""
        self.reach, self.residual, self.cost = {}, {}, {}
        for o in reversed(self.preorder()):
            below = self.kids[o]
            self.reach[o] = max([self.end[o], *(self.reach[k] for k in below)])
            self.residual[o] = uncovered(self.start[o], self.reach[o], [(self.start[k], self.reach[k]) for k in below])
            self.cost[o] = routing + max([self.residual[o], *(self.cost[k] for k in below)]) if below else self.pages(o)

    def pages(self, o: int) -> int:
        return self.reach[o] - self.start[o] + 1

    def join_same_page(self) -> int:
        """Leaf siblings over the same pages become the first of them, which keeps the others' titles and items; how many went."""
        gone = 0
        for siblings in [self.kids[o] for o in reversed(self.preorder())] + [self.roots]:
            alike: dict = {}
            for o in siblings:
                if not self.kids[o]:
                    alike.setdefault((self.start[o], self.end[o]), []).append(o)
            for (start, end), group in alike.items():
                if len(group) > 1:
                    names = [x for o in group for x in (self.title[o], *self.items[o])]
                    joined = "; ".join(x for x in names if x)
                    first = group[0]
                    self.items[first], self.title[first] = names, joined if 0 < len(joined) <= LONGEST_TITLE else page_label(start, end)
                    self.same.add(first)
                    siblings[:] = [o for o in siblings if o not in group[1:]]
                    gone += len(group) - 1
        return gone

    def collapse(self, routing: int) -> set[int]:
        """From the leaves up, nodes whose pages cost no more to read than to search take in all below them (ties too); those nodes."""
        done = set()
        self.measure(routing)
        for o in reversed(self.preorder()):
            if below := self.kids[o]:
                # What collapsed below changed its own cost only to the pages it has.
                searched = routing + max([self.residual[o], *(self.cost[k] for k in below)])
                self.cost[o] = searched
                if self.pages(o) <= searched:
                    self.items[o] = [x for k in self.preorder(below) for x in (self.title[k], *self.items[k])]
                    self.end[o], self.kids[o], self.cost[o] = self.reach[o], [], self.pages(o)
                    done.add(o)
        return done

    def optimise(self, routing: int, rounds: int = ROUNDS) -> dict:
        """Rounds of joining and collapsing until nothing changes; what was done."""
        told = {"merges": 0, "same_page": 0, "rounds": 0, "frozen": set()}
        for _ in range(rounds):
            told["rounds"] += 1
            joined = self.join_same_page()
            collapsed = self.collapse(routing)
            if collapsed:
                joined += self.join_same_page()  # what collapsed can land on a sibling's pages
            told["merges"] += len(collapsed)
            told["same_page"] += joined
            told["frozen"] |= collapsed
            if not (joined or collapsed):
                break
        self.measure(routing)
        return told

    def settled(self, trigger: int, frozen) -> list[int]:
        """The nodes that later rounds leave alone: all but leaves of more than `trigger` pages that were not judged."""
        return [o for o in self.preorder() if self.kids[o] or self.pages(o) <= trigger or o in frozen]


def given(nodes: DataFrame) -> DataFrame:
    items = [F.col("key_items")] if "key_items" in nodes.columns else []
    return nodes.select("doc_id", F.col("ord").cast("int").alias("ord"), F.col("parent_ord").cast("int").alias("parent_ord"), "title", F.col("start_page").cast("int").alias("start_page"), F.col("end_page").cast("int").alias("end_page"), *items)


KEPT = "doc_id long, ord int, parent_ord int, depth int, node_id string, title string, start_page int, end_page int, key_items array<string>, same_page boolean, settled boolean"


def optimised(nodes: DataFrame, routing: int = 1, rounds: int = ROUNDS, trigger: int = 5) -> DataFrame:
    """The nodes that rewriting keeps: doc_id, ord, parent_ord, depth, node_id (anew, in pre-order), title, start_page, end_page, key_items, same_page, settled.

    nodes: doc_id, ord (pre-order), parent_ord, title, start_page, end_page and perhaps key_items. A round joins leaf siblings over the
    same pages and collapses what is no dearer to read than to search; rounds go on until nothing changes, `rounds` at most. settled
    tells what is final: leaves of more than `trigger` pages that did not collapse may still be expanded by a model.
    """

    def fold(rows):
        tree = Tree(rows)
        told = tree.optimise(routing, rounds)
        final, parent, depth = set(tree.settled(trigger, told["frozen"])), {}, {o: 1 for o in tree.roots}
        out = []
        for n, o in enumerate(tree.preorder()):
            for k in tree.kids[o]:
                parent[k], depth[k] = o, depth[o] + 1
            out.append((rows[0].doc_id, o, parent.get(o), depth[o], f"{n:04d}", tree.title[o], tree.start[o], tree.end[o], tree.items[o], o in tree.same, o in final))
        return out

    return by_group(given(nodes), ["doc_id"], ["ord"], fold, KEPT)


def merged(nodes: DataFrame, routing: int = 1) -> DataFrame:
    """As optimised(), with the collapsing alone, once."""

    def fold(rows):
        tree = Tree(rows)
        done, parent = tree.collapse(routing), {}
        for o in tree.preorder():
            parent.update(dict.fromkeys(tree.kids[o], o))
        return [(rows[0].doc_id, o, parent.get(o), tree.title[o], tree.start[o], tree.end[o], tree.items[o], o in done) for o in tree.preorder()]

    return by_group(given(nodes), ["doc_id"], ["ord"], fold, "doc_id long, ord int, parent_ord int, title string, start_page int, end_page int, key_items array<string>, collapsed boolean")


def node_costs(nodes: DataFrame, routing: int = 1) -> DataFrame:
    """doc_id, ord, depth, leaf, subtree_end, pages, residual (0 for leaves), cost of each node.

    A node's cost is the largest, over the places below it where a search can end, of its hops times `routing` and the pages read there. So
    with each node's ancestors known, all measures are two aggregates over (node, ancestor) and a join of children; nothing is walked.
    """
    there = nodes.select("doc_id", F.col("ord").alias("parent_ord"), F.lit(True).alias("there"))
    n = nodes.join(there, ["doc_id", "parent_ord"], "left").select("doc_id", F.col("ord").cast("int").alias("id"), F.when(F.col("there"), F.col("parent_ord")).cast("int").alias("parent"), F.col("start_page").cast("int").alias("start"), F.col("end_page").cast("int").alias("end"))
    up = kept(trees.with_ancestors(kept(n), []))
    line = F.explode(F.transform(F.concat(F.transform("up", lambda x: x["id"]), F.array("id")), lambda x, i: F.struct(x.alias("anc"), (F.size("up") - i).alias("dist")))).alias("a")
    reach = up.select("doc_id", "end", line).groupBy("doc_id", F.col("a.anc").alias("id")).agg(F.max("end").alias("reach"))
    up = up.join(reach, ["doc_id", "id"])
    below = up.where("parent is not null").groupBy("doc_id", F.col("parent").alias("id")).agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("reach").cast("long").alias("end"))).alias("below"))
    up = up.join(below, ["doc_id", "id"], "left").withColumn("leaf", F.col("below").isNull()).withColumn("pages", F.col("reach") - F.col("start") + 1)
    up = kept(up.withColumn("residual", F.when(F.col("leaf"), F.lit(0)).otherwise(trees.uncovered(F.col("start").cast("long"), F.col("reach").cast("long"), F.col("below"))).cast("long")).drop("below"))
    ends = up.select("doc_id", F.when(F.col("leaf"), F.col("pages")).otherwise(routing + F.col("residual")).alias("read"), line)
    cost = ends.groupBy("doc_id", F.col("a.anc").alias("id")).agg(F.max(F.col("a.dist") * routing + F.col("read")).alias("cost"))
    return up.join(cost, ["doc_id", "id"]).select("doc_id", F.col("id").alias("ord"), (F.size("up") + 1).alias("depth"), "leaf", F.col("reach").alias("subtree_end"), "pages", "residual", F.col("cost").cast("long").alias("cost"))


def frontier(nodes: DataFrame, routing: int = 1) -> DataFrame:
    """doc_id, ord, depth, pages, cost: where a search can end (roots have depth 1), and what it then has cost: leaves, and inner nodes, one hop deeper, with what their children leave."""
    c = node_costs(nodes, routing).where("leaf or residual > 0")
    depth, pages = (F.col("depth") + F.when(F.col("leaf"), 0).otherwise(1)).cast("long"), F.when(F.col("leaf"), F.col("pages")).otherwise(F.col("residual")).cast("long")
    return c.select("doc_id", "ord", depth.alias("depth"), pages.alias("pages"), (depth * routing + pages).alias("cost"))


def search_complexity(nodes: DataFrame, pages: DataFrame, routing: int = 1) -> DataFrame:
    """doc_id, n_pages, frontier, worst, average, normalised, max_depth, mean_depth, mass of each tree. pages: doc_id, n_pages.

    average weighs each frontier entry by its share of the pages: hops and half of its pages; mass is the sum of those shares, over 1
    where neighbours share pages. All 0 for a document without pages.
    """
    share = F.when(F.col("n_pages") > 0, F.col("pages") / F.col("n_pages")).otherwise(0.0)
    both = frontier(nodes, routing).join(pages.select("doc_id", "n_pages"), "doc_id").withColumn("share", share)
    out = both.groupBy("doc_id", "n_pages").agg(F.count(F.lit(1)).alias("frontier"), F.max("cost").alias("worst"), F.sum(F.col("share") * (F.col("depth") * routing + (F.col("pages") + 1) / 2)).alias("average"), F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"), F.sum("share").alias("mass"))
    return out.select("doc_id", "n_pages", "frontier", "worst", "average", F.when(F.col("n_pages") > 0, F.col("worst") / F.col("n_pages")).otherwise(0.0).alias("normalised"), "max_depth", "mean_depth", "mass")


def expand_gain(nodes: DataFrame, proposed: DataFrame, routing: int = 1, least_pages: int = 5) -> DataFrame:
    """doc_id, ord, pages, cost, gained: whether the proposed children of a leaf (doc_id, ord, start_page, end_page) are worth it.

    A leaf of more than `least_pages` pages is expanded only if one hop and the longest of its children, or of the pages they leave,
    cost less than its pages.
    """
    inner = nodes.where("parent_ord is not null").select("doc_id", F.col("parent_ord").alias("ord")).distinct()
    leaves = nodes.join(inner, ["doc_id", "ord"], "left_anti").withColumn("pages", F.col("end_page") - F.col("start_page") + 1).where(F.col("pages") > least_pages)
    span = F.struct(F.col("start_page").cast("long").alias("start"), F.col("end_page").cast("long").alias("end"))
    kids = proposed.groupBy("doc_id", "ord").agg(F.collect_list(span).alias("kids"), F.max(F.col("end_page") - F.col("start_page") + 1).alias("longest"))
    rest = trees.uncovered(F.col("start_page").cast("long"), F.col("end_page").cast("long"), F.col("kids"))
    cost = (F.lit(routing) + F.greatest(F.col("longest"), rest)).cast("long")
    return leaves.join(kids, ["doc_id", "ord"]).select("doc_id", "ord", F.col("pages").cast("long").alias("pages"), cost.alias("cost"), (cost < F.col("pages")).alias("gained"))
