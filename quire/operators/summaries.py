"""Model-assisted steps around tables of kept replies: what to ask, in which order, and what to take from the answers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import store, trees

#: Texts of fewer tokens stand for their own summary.
SHORT = 200


def token_estimate(c):
    """Tokens of a text, about: words and marks, long words counted by four characters."""
    return F.aggregate(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}]+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"), F.lit(0)), F.lit(0), lambda n, w: n + F.ceil(F.length(w) / 4).cast("int"))


#: Calls of a request at most, seconds between them, and statuses that no further call mends.
ATTEMPTS, PAUSE, FINAL = 10, 1.0, (400, 401, 403, 404)


def answered(requests: DataFrame, complete: Callable[[list[dict]], str], attempts: int = ATTEMPTS, pause: float = PAUSE) -> DataFrame:
    """requests (key, role, content) with `reply` and `error` of a model called from batches on the executors.

    A call that fails is made again after a pause, but for errors whose `status` says that this won't help. What fails to the end has no
    reply and the error's text, so no row is lost and no cause hidden.
    """

    def run(batches):
        import time

        def one(role, content):
            for n in range(attempts):
                try:
                    return complete([{"role": role, "content": content}]), None
                except Exception as e:  # noqa: BLE001  a lost call must not lose the batch
                    told = f"{type(e).__name__}: {e}"
                    if getattr(e, "status", None) in FINAL or n + 1 == attempts:
                        break
                    time.sleep(pause)
            return None, told

        for pdf in batches:
            got = [one(r, c) for r, c in zip(pdf.role, pdf.content)]
            yield pdf.assign(reply=[r for r, _ in got], error=[e for _, e in got])[["key", "reply", "error"]]

    return requests.mapInPandas(run, "key string, reply string, error string")


def with_cache(requests: DataFrame, cache: DataFrame, complete: Callable | None = None) -> DataFrame:
    """key, reply, error: kept replies, and new ones for the rest where a model is given. Requests of one key are asked once."""
    wanted = requests.dropDuplicates(["key"])
    hit = wanted.join(cache, "key").select("key", "reply", F.lit(None).cast("string").alias("error"))
    return hit if complete is None else hit.unionByName(answered(wanted.join(cache, "key", "left_anti"), complete))


def parent_requests(nodes: DataFrame, summaries: DataFrame, pages: DataFrame, intro_pages: int = 3) -> DataFrame:
    """doc_id, ord, key, role, content of the requests that can be made next: for nodes without a summary all of whose children have one.

    nodes: doc_id, ord, parent_ord, title, start_page, end_page. summaries: doc_id, ord, summary. A request has the node's title, its
    introduction (the pages before its first child, `intro_pages` at most) and its children's titles and summaries in order.
    """
    told = nodes.join(summaries, ["doc_id", "ord"], "left")
    kids = told.where("parent_ord is not null").groupBy("doc_id", F.col("parent_ord").alias("ord")).agg(F.array_sort(F.collect_list(F.struct("ord", "title", "summary", "start_page"))).alias("kids"), F.min("start_page").alias("first"))
    ready = told.where("summary is null").select("doc_id", "ord", "title", "start_page").join(kids, ["doc_id", "ord"]).where(~F.exists("kids", lambda k: k["summary"].isNull()))
    last = F.least(F.col("first") - 1, F.col("start_page") + intro_pages - 1)
    intro = ready.where(F.col("start_page") <= last).select("doc_id", "ord", F.explode(F.sequence("start_page", last.cast("int"))).alias("page")).join(pages, ["doc_id", "page"])
    intro = intro.groupBy("doc_id", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "markdown"))), lambda x: x["markdown"]), "\n").alias("intro"))
    parts = F.array_join(F.transform("kids", lambda k: F.concat(k["title"], F.lit(": "), k["summary"])), "\n")
    both = ready.join(intro, ["doc_id", "ord"], "left")
    content = F.concat(F.lit("Summarise the section in 150 words at most, from its introduction and its parts.\n\n"), F.col("title"), F.lit("\n\n"), F.coalesce("intro", F.lit("")), F.lit("\n\n"), parts)
    role = F.lit("user")
    return both.select("doc_id", "ord", store.message_key(role, content).alias("key"), role.alias("role"), content.alias("content"))


def summarised(nodes: DataFrame, leaves: DataFrame, pages: DataFrame, cache: DataFrame, complete: Callable | None = None, deepest: int = 10) -> DataFrame:
    """doc_id, ord, summary of all nodes that can be told: leaves (doc_id, ord, summary) first, then their parents, a wave for each level.

    A wave is one pass over all documents; it ends when none is ready, after `deepest` waves at most.
    """
    have = leaves.where("summary is not null").select("doc_id", "ord", "summary")
    for _ in range(deepest):
        asked = parent_requests(nodes, have, pages).persist()
        if asked.isEmpty():
            break
        new = asked.select("doc_id", "ord", "key").join(with_cache(asked.select("key", "role", "content"), cache, complete), "key").where("reply is not null")
        before = have
        have = have.unionByName(new.select("doc_id", "ord", F.col("reply").alias("summary"))).persist()
        if have.count() == before.count():
            break
    return have


def description_requests(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """doc_id, key, role, content: a request to describe each document in a sentence, from the titles and summaries of its tree without anything else."""
    told = nodes.select("doc_id", "ord", "parent_ord", "title").join(summaries, ["doc_id", "ord"], "left")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", "title", "summary"))), lambda x: F.struct(x["title"].alias("title"), x["summary"].alias("summary")))
    content = F.concat(F.lit("Describe the document in one sentence, from its sections.\n\n"), F.to_json(rows))
    role = F.lit("user")
    return told.groupBy("doc_id").agg(content.alias("content")).select("doc_id", store.message_key(role, F.col("content")).alias("key"), role.alias("role"), "content")


def summary_levels(nodes: DataFrame, deepest: int = 10) -> DataFrame:
    """doc_id, ord, height: 0 for leaves; a node can be summarised once those of smaller height are. Each height is one pass over all documents."""
    up = trees.ancestors(nodes, deepest)
    return up.groupBy("doc_id", F.col("anc").alias("ord")).agg(F.max("dist").alias("height"))


def leaf_requests(texts: DataFrame) -> DataFrame:
    """texts (doc_id, ord, text) with `summary` where the text is short enough to stand for itself, and else the request's key, role and content."""
    content = F.concat(F.lit("Summarise the section below in 150 words at most.\n\n"), F.col("text"))
    short = token_estimate(F.col("text")) < SHORT
    role = F.lit("user")
    return texts.select("doc_id", "ord", F.when(short, F.col("text")).alias("summary"), F.when(~short, store.message_key(role, content)).alias("key"), role.alias("role"), F.when(~short, content).alias("content"))


def accepted_sections(proposed: DataFrame, pages: DataFrame) -> DataFrame:
    """Proposed subsections (doc_id, ord, k, title, page, lo, hi) that hold: in the node's pages, printed on their page, the first of
    their title, and on no page before the ones accepted so far in order of k."""
    there = proposed.join(pages, ["doc_id", "page"]).where("page between lo and hi").where(F.contains(T.normalized("markdown"), T.normalized("title")) & (T.normalized("title") != ""))
    first = there.groupBy("doc_id", "ord", T.normalized("title").alias("t")).agg(F.min_by(F.struct("k", "title", "page"), "k").alias("s")).select("doc_id", "ord", "s.*")

    def rising(pdf: pd.DataFrame) -> pd.DataFrame:
        last, keep = 0, []
        for r in pdf.sort_values("k").itertuples():
            keep.append(r.page >= last)
            last = r.page if keep[-1] else last
        return pdf.sort_values("k")[keep]

    return first.groupBy("doc_id", "ord").applyInPandas(rising, first.schema)


def rejection(results: DataFrame, flat: int = 10) -> DataFrame:
    """results (doc_id, tops, depth, words) with `reason`: no text, or a flat list of too many entries; null where the tree is kept."""
    return results.withColumn("reason", F.when(F.col("words") == 0, "unreadable").when((F.col("depth") <= 1) & (F.col("tops") > flat), "flat"))


def page_nodes(pages: DataFrame) -> DataFrame:
    """doc_id, ord, title, start_page, end_page: a node for each page, for documents without an outline."""
    return pages.select("doc_id", (F.col("page") - 1).alias("ord"), F.concat(F.lit("Page "), F.col("page").cast("string")).alias("title"), F.col("page").alias("start_page"), F.col("page").alias("end_page"))


def prefaced(nodes: DataFrame) -> DataFrame:
    """nodes and, where the first one starts after page 1, a Preface (ord -1) before it."""
    first = nodes.groupBy("doc_id").agg(F.min("start_page").alias("s")).where("s > 1")
    return nodes.select("doc_id", "ord", "title", "start_page", "end_page").unionByName(first.select("doc_id", F.lit(-1).alias("ord"), F.lit("Preface").alias("title"), F.lit(1).alias("start_page"), (F.col("s") - 1).alias("end_page")))
