"""Structure retrieval: trees as JSON, split into parts of a bounded size, trees for readers, page texts, and the tool calls over them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import pages as P
from quire.operators import store
from quire.operators.grouped import by_group

#: The order of a node's keys in JSON, and the characters of a reply.
KEYS = ("title", "node_id", "start_index", "end_index", "page_index", "prefix_summary", "summary", "nodes")
BUDGET = 95_000
#: Documents a call removes at most.
MOST_REMOVED = 10


def dumps(value) -> str:
    """JSON with a blank after commas and colons and characters as they are; its code points are what budgets count."""
    return json.dumps(value, ensure_ascii=False)


def nested(rows) -> list[dict]:
    """A document's rows (ord, parent_ord, title, node_id, start_page, end_page and perhaps summary, key_items, text), by ord, as nested nodes."""
    at, roots = {}, []
    for r in rows:
        node = {"title": r.title, "node_id": r.node_id, "start_index": r.start_page, "end_index": r.end_page}
        for k in ("summary", "key_items", "text"):
            if (v := getattr(r, k, None)) is not None and v != []:
                node[k] = v
        at[r.ord] = node
        (at[r.parent_ord].setdefault("nodes", []) if r.parent_ord in at else roots).append(node)
    return roots


def formatted(node):
    """A node without texts and with its keys in order, all the way down."""
    if isinstance(node, list):
        return [formatted(x) for x in node]
    kept = {k: formatted(v) if k == "nodes" else v for k, v in node.items() if k != "text"}
    return {k: kept[k] for k in [*(k for k in KEYS if k in kept), *(k for k in kept if k not in KEYS)]}


def split(nodes: list, budget: int) -> list[list]:
    """Lists of neighbouring nodes of `budget` characters at most, as JSON without what stands between nodes.

    A larger node is split into parts of its own: each repeats the node without its children and has some of them, which get what the
    node itself leaves of the budget, or half of it. A larger node without children is a part as it is.
    """
    if len(dumps(nodes)) <= budget:
        return [nodes]
    parts, used = [], None  # characters of the last part, None when it is closed
    for node in nodes:
        size = len(dumps(node))
        if size > budget:
            kids, shell = node.get("nodes"), {k: v for k, v in node.items() if k != "nodes"}
            parts += [[{**shell, "nodes": chunk}] for chunk in split(kids, max(budget - len(dumps(shell)), budget // 2))] if kids else [[node]]
            used = None
        elif used is not None and used + size <= budget:
            parts[-1].append(node)
            used += size
        else:
            parts.append([node])
            used = size
    return parts or [nodes]


def _columns(nodes: DataFrame, *more: str) -> DataFrame:
    return nodes.select("doc_id", "ord", "parent_ord", "title", "node_id", "start_page", "end_page", *[c for c in more if c in nodes.columns])


def structure_parts(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, part (from 1), n_parts, structure (JSON) of each document's tree."""

    def fold(rows):
        parts = split(formatted(nested(rows)), budget)
        return [(rows[0].doc_id, n, len(parts), dumps(x)) for n, x in enumerate(parts, 1)]

    return by_group(_columns(nodes, "summary", "key_items"), ["doc_id"], ["ord"], fold, "doc_id long, part int, n_parts int, structure string")


def structure_part(nodes: DataFrame, part: int = 1, budget: int = BUDGET) -> DataFrame:
    """The wanted part of each document, the nearest one where there is no such part, and whether more follow."""
    parts = structure_parts(nodes, budget)
    return parts.where(F.col("part") == F.greatest(F.lit(1), F.least(F.lit(part), F.col("n_parts")))).withColumn("has_more", F.col("part") < F.col("n_parts"))


def reader_trees(nodes: DataFrame, summaries: bool = True) -> DataFrame:
    """doc_id, tree (JSON) for readers: title, node_id, page_index, key_items, a leaf's summary or a parent's prefix_summary, text, nodes."""

    def shown(node: dict) -> dict:
        kids = node.get("nodes", [])
        out = {"title": node["title"] or "", "node_id": node["node_id"], "page_index": node["start_index"]}
        if node.get("key_items"):
            out["key_items"] = node["key_items"]
        if summaries and node.get("summary") is not None:
            out["prefix_summary" if kids else "summary"] = node["summary"]
        if "text" in node:
            out["text"] = node["text"]
        return out | ({"nodes": [shown(k) for k in kids]} if kids else {})

    def fold(rows):
        return [(rows[0].doc_id, dumps([shown(x) for x in nested(rows)]))]

    return by_group(_columns(nodes, "summary", "key_items", "text"), ["doc_id"], ["ord"], fold, "doc_id long, tree string")


def with_text(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """nodes with the text of their pages, joined by line breaks; pages: doc_id, page, markdown. Nodes are told by page, so no document is one key."""
    by_page = nodes.select("doc_id", "ord", F.explode(F.sequence("start_page", "end_page")).alias("page")).join(pages, ["doc_id", "page"])
    text = by_page.groupBy("doc_id", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "markdown"))), lambda x: x["markdown"]), "\n").alias("text"))
    return nodes.join(text, ["doc_id", "ord"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def flattened(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, ord, title, level, page_index, text: a tree as rows in pre-order, for readers. level comes from nodes' depth or level."""
    level = "depth" if "depth" in nodes.columns else "level"
    return with_text(nodes, pages).select("doc_id", "ord", F.coalesce("title", F.lit("")).alias("title"), F.col(level).alias("level"), F.col("start_page").alias("page_index"), "text")


def page_texts(pages: DataFrame, form: str, nodes: DataFrame | None = None) -> DataFrame:
    """What a document says: as its pages (page), as one text of pages parted by blank lines (raw), or by node (node)."""
    if form == "page":
        return pages.select("doc_id", F.col("page").alias("page_index"), "markdown")
    if form == "raw":
        return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "markdown"))), lambda x: x["markdown"]), "\n\n").alias("text"))
    if form == "node" and nodes is not None:
        return flattened(nodes, pages)
    raise ValueError("form must be page, node or raw")


# Tool calls


#: Tools with their parameters: name, whether it is required, whether it is a truth value.
TOOLS = {
    "browse_documents": (("limit", False, False), ("offset", False, False)),
    "get_document": (("doc_name", True, False), ("wait_for_completion", False, True)),
    "get_document_structure": (("doc_name", True, False), ("part", False, False), ("wait_for_completion", False, True)),
    "get_page_content": (("doc_name", True, False), ("pages", True, False), ("wait_for_completion", False, True)),
    "remove_document": (("doc_names", True, False),),
}


class InvalidCall(ValueError):
    """A call that names no tool, or arguments it does not take."""


def bound(name: str, arguments: dict | None) -> dict:
    """The arguments of a call: private (underscore) and null ones left out, texts as truth values where those are meant; required ones are missed first, then unknown ones."""
    if name not in TOOLS:
        raise InvalidCall(f"unknown tool {name}; there are {', '.join(TOOLS)}")
    if arguments is not None and not isinstance(arguments, dict):
        raise InvalidCall(f"arguments of {name} must be an object")
    given = {k: v for k, v in (arguments or {}).items() if not k.startswith("_") and v is not None}
    for k, required, truth in TOOLS[name]:
        if required and k not in given:
            raise InvalidCall(f"{name} needs {k}")
        if truth and isinstance(given.get(k), str):
            given[k] = given[k].strip().lower() not in ("false", "no", "0", "")
    if unknown := [k for k in given if k not in {p for p, *_ in TOOLS[name]}]:
        raise InvalidCall(f"{name} takes no {unknown[0]}")
    return given


def whole(value, default: int) -> int:
    """value as a whole number, as forgiving as int(): truth values, numbers cut at the point, texts with signs and single underscores between digits."""
    if isinstance(value, str):
        try:
            return int(value)
        except ValueError:
            return default
    return int(value) if isinstance(value, (bool, int, float)) and value == value else default


def call(name: str, arguments: dict | None, records: DataFrame, nodes: DataFrame, pages: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """The rows that a tool call answers with. records: id, name, created_at, page_num, status; nodes and pages with doc_id = id; allowed: ids it may see."""
    given = bound(name, arguments)
    seen = records.join(allowed, "id", "left_semi") if allowed is not None else records
    if name == "browse_documents":
        return store.browsed(seen, whole(given.get("limit"), 10), whole(given.get("offset"), 0))
    if name == "remove_document":
        names = list(dict.fromkeys([given["doc_names"]] if isinstance(given["doc_names"], str) else given["doc_names"]))
        if len(names) > MOST_REMOVED:
            raise InvalidCall(f"{name} takes {MOST_REMOVED} documents at most")
        return seen.where(F.col("name").isin(*names)).select("id", "name")
    newest = store.resolved(seen.where(F.col("name") == F.lit(given["doc_name"]))).select("id")
    if name == "get_document":
        hint = F.when(F.col("page_num") <= 5, "small").when(F.col("page_num") <= 20, "medium").otherwise("large")
        return seen.join(newest, "id", "left_semi").withColumn("hint", hint)
    ready = seen.where("status = 'completed'").join(newest, "id", "left_semi").select(F.col("id").cast("long").alias("doc_id"))
    if name == "get_document_structure":
        return structure_part(nodes.join(ready, "doc_id", "left_semi"), whole(given.get("part"), 1))
    spec = F.lit(str(given["pages"]))
    wanted = ready.where(P.page_spec_problem(spec).isNull()).select("doc_id", F.explode(P.expanded(spec).cast("array<int>")).alias("page"))
    chosen = pages.join(wanted, ["doc_id", "page"], "left_semi")
    return chosen.join(store.pages_in_budget(chosen, BUDGET), ["doc_id", "page"], "left_semi")


def close_names(records: DataFrame, name: str, most: int = 3, least: float = 0.5) -> DataFrame:
    """name, ratio of the documents named most like `name`: three at most, alike by a half at least. A length bound comes before the costly likeness."""
    from quire.functions import text as T

    length = F.length("name")
    can = 2 * F.least(length, F.lit(len(name))) >= least * (length + len(name))
    named = records.select("name").distinct().where(can).withColumn("ratio", T.similarity(F.lit(name), F.col("name")))
    return named.where(F.col("ratio") >= least).orderBy(F.desc("ratio"), F.desc("name")).limit(most)
