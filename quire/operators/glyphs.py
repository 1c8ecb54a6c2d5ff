"""Characters and text objects as an extractor gives them: the object of each character, the order of paint, skew, font names, the visible page."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import let

#: Points that an object's rows reach beyond it; sides of a page that gives none.
REACH, LETTER = 6, (0.0, 0.0, 612.0, 792.0)
#: Points of a grid row.
CELL = 16
#: Characters of a strip of a page at least, and pairs of a character and an object looked at in one step.
STRIP, PAIRS = 128, 1 << 18
#: Names of one font, and what in a name makes it bold or italic.
TIMES = ("timesnewroman", "times-new-roman", "timesroman", "times-roman", "timesnew", "times-new")
BOLD, ITALIC, SUBSET = r"(?i)(bold|timesb)", r"(?i)(ital|it\z|i[1-9][0-9]*\z|obliq)", r"^[A-Z]{6}\+"


def font_name(c):
    """A font's name without the prefix of a subset; the names of Times are one."""
    plain = F.regexp_replace(c, SUBSET, "")
    return F.when(F.lower(plain).isin(*TIMES), "Times").otherwise(plain)


def is_bold(c):
    return c.rlike(BOLD)


def is_italic(c):
    return c.rlike(ITALIC)


def skew(a, b, c, d):
    """How far a text matrix turns or slants: the squares of b/a and c/d, infinite where only the divisor is 0."""
    over = lambda x, y: F.when(y != 0, x / y).when(x == 0, float("nan")).otherwise(float("inf"))
    return over(b, a) * over(b, a) + over(c, d) * over(c, d)


def view_box(media, crop):
    """The visible part of a page as left, bottom, right, top: the crop box inside the media box; that alone where there is no crop box or nothing would be left, and a letter page where there is neither. Boxes (arrays) may name their corners in any order; without area they are none."""
    box = lambda v: F.array(F.least(v[0], v[2]), F.least(v[1], v[3]), F.greatest(v[0], v[2]), F.greatest(v[1], v[3]))
    good = lambda v: F.when((F.size(v) == 4) & (v[0] != v[2]) & (v[1] != v[3]), box(v))
    both = lambda cut, whole: F.array(F.greatest(cut[0], whole[0]), F.greatest(cut[1], whole[1]), F.least(cut[2], whole[2]), F.least(cut[3], whole[3]))
    inside = lambda cut, whole: let(both(cut, whole), lambda v: F.when((v[2] <= v[0]) | (v[3] <= v[1]), whole).otherwise(v))
    whole = F.coalesce(good(media), F.array(*[F.lit(x) for x in LETTER]))
    return let(whole, lambda w: let(good(crop), lambda cut: F.when(cut.isNull(), w).otherwise(inside(cut, w))))


def objects_of_characters(chars: DataFrame, objects: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """doc_id, page, i, object: for each character (doc_id, page, i, x, y, drawn, size) the text object (doc_id, page, k, left, right, top, bottom, drawn, size) it belongs to, or null.

    An object may have a character if it holds its place within the tolerance, and its rows, to the next whole points and REACH beyond, hold the
    character's. Of several the one nearest in drawn size is taken, or where the character has none in its own size (relative), or else the smallest; then
    the smaller one, then the first. Characters meet the objects of their row of a grid alone, so no page is paired with itself; a character has one row, so
    those it meets are where it is, and nothing is dealt out again after the join.
    """
    low, high = F.floor("bottom") - REACH, F.ceil("top") + REACH
    cell = lambda c: F.floor(c / CELL).cast("long")
    o = objects.select("doc_id", "page", "k", "left", "right", "top", "bottom", F.col("drawn").alias("o_drawn"), F.col("size").alias("o_size"), low.alias("low"), high.alias("high"), ((F.col("right") - F.col("left")) * (F.col("top") - F.col("bottom"))).alias("area"), F.explode(F.sequence(cell(low), cell(high))).alias("cell"))
    c = chars.withColumn("row", F.bround("y")).withColumn("cell", cell(F.col("row")))
    inside = F.col("x").between(F.col("left") - tolerance, F.col("right") + tolerance) & F.col("y").between(F.col("bottom") - tolerance, F.col("top") + tolerance) & F.col("row").between(F.col("low"), F.col("high"))
    apart = F.when(F.col("drawn") > 0, F.abs(F.col("o_drawn") - F.col("drawn"))).when(F.col("size") > 0, F.abs(F.col("o_size") - F.col("size")) / F.greatest("size", F.lit(0.01))).otherwise(F.col("area"))
    o = o.withColumnsRenamed({x: f"o_{x}" for x in ("doc_id", "page", "cell")})
    same = (F.col("doc_id") == F.col("o_doc_id")) & (F.col("page") == F.col("o_page")) & (F.col("cell") == F.col("o_cell"))
    found = c.join(o, same & inside, "left").groupBy("doc_id", "page", "cell", "i").agg(F.min(F.when(F.col("k").isNotNull(), F.struct(apart.alias("apart"), "area", "k"))).alias("o"))
    return found.select("doc_id", "page", "i", F.col("o.k").alias("object"))


def nearest_objects(c: dict, o: dict, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The place in o (arrays left, right, top, bottom, drawn, size, k of a page's objects) of the object of each character (arrays x, y, drawn, size), as objects_of_characters says, or -1, and how far apart they are.

    Objects stand in order of area and k, so the first of those nearest is meant. Characters are taken by strips of the page and along each strip, and meet what reaches there, so memory is bounded whatever a page holds.
    """
    best, gap = np.full(len(c["x"]), -1), np.full(len(c["x"]), np.inf)
    area = (o["right"] - o["left"]) * (o["top"] - o["bottom"])
    rank = np.lexsort((o["k"], area))
    left, right, bottom, top = o["left"][rank] - tolerance, o["right"][rank] + tolerance, o["bottom"][rank] - tolerance, o["top"][rank] + tolerance
    low, high = np.floor(o["bottom"][rank]) - REACH, np.ceil(o["top"][rank]) + REACH
    there = np.flatnonzero(~np.isnan(c["x"]) & ~np.isnan(c["y"]))
    if not len(there) or not len(rank):
        return best, gap
    there = there[np.argsort(c["y"][there], kind="stable")]
    tall = c["y"][there[-1]] - c["y"][there[0]]
    for strip in np.array_split(there, max(1, int(min(len(there) // STRIP, 1 + 2 * tall // CELL)))):
        strip = strip[np.argsort(c["x"][strip], kind="stable")]
        y = c["y"][strip]
        near = np.flatnonzero((bottom <= y.max()) & (top >= y.min()))
        at = 0
        while at < len(strip) and len(near):
            some = strip[at : at + max(1, min(2 * STRIP, PAIRS // len(near)))]
            at += len(some)
            x, y = c["x"][some], c["y"][some]
            m = near[(left[near] <= x[-1]) & (right[near] >= x[0])]
            x_, y_ = x[:, None], y[:, None]
            which, of = np.nonzero((x_ >= left[m]) & (x_ <= right[m]) & (y_ >= bottom[m]) & (y_ <= top[m]))
            of, row = m[of], np.rint(y)[which]
            held = (row >= low[of]) & (row <= high[of])
            which, of = which[held], of[held]
            if not len(which):
                continue
            drawn, size, place = c["drawn"][some][which], c["size"][some][which], rank[of]
            apart = np.where(drawn > 0, np.abs(o["drawn"][place] - drawn), np.where(size > 0, np.abs(o["size"][place] - size) / np.maximum(size, 0.01), area[place]))
            apart[np.isnan(apart)] = -np.inf
            first = np.flatnonzero(np.diff(which, prepend=-1))
            least = np.repeat(np.minimum.reduceat(apart, first), np.diff(first, append=len(which)))
            nearest = np.flatnonzero(apart == least)
            one, at_first = np.unique(which[nearest], return_index=True)
            best[some[one]], gap[some[one]] = place[nearest[at_first]], apart[nearest[at_first]]
    return best, gap


def objects_on_pages(objects: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """doc_id, page, i, object as objects_of_characters says, of objects (doc_id, page, k, left, right, top, bottom, drawn, size) each with some characters of its page (`chars`, structs of i, x, y, drawn, size).

    Rows come dealt out by page; those sorted by it are not sorted again. A task holds one page as arrays, so no character is dealt out and no pair becomes a row. A character's i is one row, whichever objects carry it.
    """
    boxes, marks = ("left", "right", "top", "bottom", "drawn", "size"), ("x", "y", "drawn", "size")

    def told(t: pa.Table) -> pa.RecordBatch:
        numbers = lambda a: a.cast(pa.float64()).to_numpy(zero_copy_only=False)
        chars = pa.concat_arrays([x.flatten() for x in t["chars"].chunks])
        i, n = chars.field("i"), len(chars)
        same = t["doc_id"][0].is_valid and t["page"][0].is_valid
        o = {x: numbers(t[x].combine_chunks()) for x in boxes} | {"k": t["k"].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)}
        c = {x: numbers(chars.field(x)) for x in marks}
        best, gap = nearest_objects(c, o, tolerance) if same else (np.full(n, -1), np.full(n, np.inf))
        ids, none = i.fill_null(0).to_numpy(zero_copy_only=False), i.is_null().to_numpy(zero_copy_only=False)
        area = (o["right"] - o["left"]) * (o["top"] - o["bottom"])
        by = np.lexsort((o["k"][best], area[best], gap, best < 0, ids, none))
        found = by[np.flatnonzero(np.append(True, (np.diff(ids[by]) != 0) | (np.diff(none[by].astype(int)) != 0))[:n])]
        k = t["k"].combine_chunks().take(pa.array(best[found], mask=best[found] < 0))
        one = lambda x, kind: pa.repeat(pa.scalar(t[x][0].as_py(), kind), len(found))
        return pa.RecordBatch.from_arrays([one("doc_id", pa.int64()), one("page", pa.int32()), i.take(pa.array(found)), k], ["doc_id", "page", "i", "object"])

    def run(batches):
        page = []
        for b in batches:
            keys = [b["doc_id"], b["page"]]
            now = [[x.fill_null(0).to_numpy(zero_copy_only=False), x.is_null().to_numpy(zero_copy_only=False)] for x in keys]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for pair in now for x in pair], axis=0)) + 1
            for start, end in zip([0, *new.tolist()], [*new.tolist(), len(b)]):
                part = b.slice(start, end - start)
                if page and any(page[-1][x][0] != part[x][0] for x in ("doc_id", "page")):
                    yield told(pa.Table.from_batches(page))
                    page = []
                if len(part):
                    page.append(part)
        if page:
            yield told(pa.Table.from_batches(page))

    return objects.sortWithinPartitions("doc_id", "page").mapInArrow(run, "doc_id long, page int, i long, object long")


def paint_order(chars: DataFrame, key=None) -> DataFrame:
    """doc_id, page, i, place: characters (doc_id, page, i, order of their object, generated) in the order they are painted: by object, then by i, or by another key (a column); generated white space stays behind the character before it, or comes first. Of equal keys generated characters follow the others."""
    w = Window.partitionBy("doc_id", "page").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    key = F.last(F.when(~F.col("generated"), F.struct("order", "i") if key is None else key), ignorenulls=True).over(w)
    by = Window.partitionBy("doc_id", "page").orderBy(F.col("key").asc_nulls_first(), "generated", "i")
    return chars.withColumn("key", key).select("doc_id", "page", "i", (F.row_number().over(by) - 1).alias("place"))
