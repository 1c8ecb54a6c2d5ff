"""Stored documents: listing, lookup, structure and pages within a budget, replies kept by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources.scratch import kept


def listed(records: DataFrame, limit: int, offset: int = 0, name: str | None = None) -> DataFrame:
    """Newest first, ties by id; `total` counts all before the page is cut. A top-k, not a sort of everything."""
    if not 1 <= limit <= 10_000 or offset < 0:
        raise ValueError("limit must be 1 to 10000 and offset 0 or more")
    r = records.where(F.col("name") == name) if name else records
    total = r.agg(F.count(F.lit(1)).alias("total"))
    page = r.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))  # one row


def browsed(records: DataFrame, limit: int = 10, offset: int = 0, allowed: DataFrame | None = None) -> DataFrame:
    """listed() with clamped arguments, the documents limited to an allow-list of ids, and has_more, next_offset."""
    limit, offset = max(1, min(50, limit)), max(0, offset)
    r = records.join(allowed, "id", "left_semi") if allowed is not None else records
    return listed(r, limit, offset).withColumn("has_more", F.col("total") > offset + limit).withColumn("next_offset", F.when(F.col("total") > offset + limit, offset + limit))


def resolved(records: DataFrame) -> DataFrame:
    """name, id, versions: the newest document of each name; of equally new ones that of the smallest id."""
    key = F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("a"), F.col("id").alias("b"))
    return records.groupBy("name").agg(F.min_by("id", key).alias("id"), F.count(F.lit(1)).alias("versions"))


def names_to_store(records: DataFrame, taken: DataFrame) -> DataFrame:
    """id, name under which each record (id, name, created_at) is stored: its own, or with _1 to _99 before the extension, the first that no stored document (taken: name) and no earlier record has; null where all are taken.

    Records of one name take the free ones of its hundred names in order. Where two names lead to one, the earlier record has it, and
    the other name loses it; that is repeated until none is claimed twice, which ends as no name loses more than a hundred.
    """
    first = F.struct("created_at", "id")
    order = Window.partitionBy("name").orderBy("created_at", "id")
    mine = kept(records.select("id", "name", "created_at").withColumn("nth", F.row_number().over(order)))
    could = mine.select("name").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(T.NAME_SUFFIXES))))
    could = could.select("name", "k", F.when(F.col("k") == 0, F.col("name")).otherwise(T.truncated_name(F.col("name"), F.concat(F.lit("_"), F.col("k").cast("string")))).alias("made"))
    free = kept(could.join(taken.select(F.col("name").alias("made")).distinct(), "made", "left_anti"))
    while True:
        numbered = free.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("k")))
        got = kept(mine.join(numbered, ["name", "nth"], "left"))
        claims = got.where("made is not null").withColumn("who", F.min(first).over(Window.partitionBy("made")))
        lost = kept(claims.where((F.col("who.id") != F.col("id")) | (F.col("who.created_at") != F.col("created_at"))).select("name", "made").distinct())
        if lost.isEmpty():
            return got.select("id", F.col("made").alias("name"))
        free = kept(free.join(lost, ["name", "made"], "left_anti"))


def unique_names(records: DataFrame) -> DataFrame:
    """id, name made unique: the first of a name keeps it, later ones get _1, _2, … before the extension."""
    w = Window.partitionBy("name").orderBy("created_at", "id")
    n = F.row_number().over(w) - 1
    return records.select("id", F.when(n == 0, F.col("name")).otherwise(F.concat(F.regexp_replace("name", r"\.pdf$", ""), F.lit("_"), n.cast("string"), F.lit(".pdf"))).alias("name"))


def size_hints(records: DataFrame) -> DataFrame:
    """hint, n: documents by length."""
    hint = F.when(F.col("page_num") <= 5, "small").when(F.col("page_num") <= 20, "medium").otherwise("large")
    return records.groupBy(hint.alias("hint")).agg(F.count(F.lit(1)).alias("n"))


def removed(records: DataFrame, names: DataFrame) -> DataFrame:
    """The records left once those of the names are removed."""
    return records.join(names, "name", "left_anti")


def pages_in_budget(pages: DataFrame, budget: int) -> DataFrame:
    """doc_id, page of the pages a reply holds: the first always, then each that still fits; a later smaller one may fit where an earlier did not.

    The rule is a running choice, so it is one fold over a document's sizes.
    """
    sizes = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.length("markdown").alias("n")))).alias("p"))
    zero = F.struct(F.lit(budget).alias("left"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc, x):
        fits = (F.size(acc["out"]) == 0) | (x["n"] <= acc["left"])
        return F.struct(F.when(fits, acc["left"] - x["n"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.concat(acc["out"], F.array(x["page"].cast("int")))).otherwise(acc["out"]).alias("out"))

    return sizes.select("doc_id", F.explode(F.aggregate("p", zero, step, lambda acc: acc["out"])).alias("page"))


def structure_parts(nodes: DataFrame, budget: int) -> DataFrame:
    """doc_id, ord, part: nodes in pre-order packed greedily into parts of `budget` characters of JSON; a larger node is a part of its own."""
    size = F.length(F.to_json(F.struct("title", "node_id", "start_page", "end_page")))
    rows = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", size.alias("n")))).alias("p"))
    zero = F.struct(F.lit(1).alias("part"), F.lit(0).alias("used"), F.expr("cast(array() as array<struct<ord:int,part:int>>)").alias("out"))

    def step(acc, x):
        over = (acc["used"] > 0) & (acc["used"] + x["n"] > budget)
        part = F.when(over, acc["part"] + 1).otherwise(acc["part"])
        return F.struct(part.alias("part"), F.when(over, x["n"]).otherwise(acc["used"] + x["n"]).alias("used"), F.concat(acc["out"], F.array(F.struct(x["ord"].alias("ord"), part.alias("part")))).alias("out"))

    return rows.select("doc_id", F.inline(F.aggregate("p", zero, step, lambda acc: acc["out"])))


def node_texts(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, ord, n_chars, digest: texts of pages start to end of each node, joined; an interval join inside the document."""
    both = nodes.join(pages, "doc_id").where("page between start_page and end_page")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "markdown"))), lambda x: x["markdown"]), "\n")
    return both.groupBy("doc_id", "ord").agg(text.alias("t")).select("doc_id", "ord", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


def scalar_metadata(c):
    """Entries of a JSON object whose values are scalars, as a map of texts; null if there are none."""
    m = F.map_filter(F.from_json(c, "map<string,string>"), lambda k, v: v.isNotNull() & ~v.rlike(r"^\s*[\[{]"))
    return F.when(F.size(m) > 0, m)


def message_key(role, content):
    """Key of a request: the hash of its messages as compact JSON."""
    return F.sha2(F.to_json(F.array(F.struct(role.alias("role"), content.alias("content")))), 256)


def replayed(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (with key) and the kept replies; misses have none."""
    return requests.join(cache, "key", "left")


def reply_json(c):
    """The JSON object of a model's reply: out of a code fence, from the first brace to the last, without trailing commas; null if it isn't JSON."""
    body = F.regexp_extract(F.regexp_replace(c, r"(?s)^.*?```(?:json)?\s*(.*?)```.*$", "$1"), r"(?s)\{.*\}", 0)
    return F.when(body != "", F.try_parse_json(F.regexp_replace(body, r",(\s*[}\]])", "$1")).cast("string"))
