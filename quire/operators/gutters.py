"""Columns of a page from scored gutters: a page's region is swept, cut at its best gap, and so are the parts. What lines say is columns; a page is one group of arrays.

direction 1 is a sweep along x, whose gaps part columns; 0 a sweep along y, whose gaps part rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.functions import scalars as S

INF = float("inf")


def measured(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """lines (doc_id, page, ix, left, right, top, bottom, text, size) of some area, with what the sweep asks of them and the page's thresholds.

    pages: doc_id, page, size (median), overlap_gap (median), char_width (mean). A column's gap is a character wide at least, a row's
    gap half the size, or more where lines stand far apart.
    """
    t, n = F.col("text"), F.length("text")
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    number = S.numbering_prefix(F.trim(t))
    out = lines.where((F.col("right") > F.col("left")) & (F.col("top") > F.col("bottom"))).withColumn("weight", letters + F.regexp_count(t, F.lit(r"\p{Lo}")) + 0.5 * (n - letters)).withColumn("chars", n)
    out = out.withColumn("kind", number["kind"]).withColumn("number", F.when(number["kind"] == 1, S.to_number(number["text"])))
    out = out.withColumn("mark", ((n <= 10) & (t.rlike(r"^\[.*\]$") | t.rlike(r"^[\p{Lu}\p{Lt}].*\.$"))).cast("int")).withColumn("leader", t.rlike(r"(?:\.\s*){5,}$").cast("int")).drop("text")
    size = F.col("page_size")
    row = F.greatest(0.5 * size, F.least(1.1 * (F.col("overlap_gap") - size), 3 * size))
    of = pages.select("doc_id", "page", F.col("size").alias("page_size"), "overlap_gap", F.col("char_width").alias("column_gap")).withColumn("row_gap", row).drop("overlap_gap")
    return out.join(of, ["doc_id", "page"])


class Page:
    """The measured lines of one page as arrays, its box and its thresholds; cut 2 log2(lines) levels deep at most."""

    def __init__(self, got: pa.Table):
        for c in ("left", "right", "top", "bottom", "size", "weight", "number"):
            setattr(self, c, got[c].cast(pa.float64()).to_numpy())
        for c in ("ix", "chars", "kind", "mark", "leader"):
            setattr(self, c, got[c].to_numpy())
        self.wide, self.one = self.right - self.left, self.kind == 1
        self.page_size, self.column_gap, self.row_gap = (float(got[c][0].as_py()) for c in ("page_size", "column_gap", "row_gap"))
        self.x0, self.x1, self.y0, self.y1 = (float(x) for x in (self.left.min(), self.right.max(), self.bottom.min(), self.top.max()))
        self.deepest = math.floor(2 * math.log2(len(self.ix)))

    def box(self) -> tuple[float, float, float, float]:
        return self.x0, self.x1, self.y0, self.y1

    def beside(self, near: np.ndarray, edge: np.ndarray, direction: int) -> SimpleNamespace:
        """What stands on one side of a gap, no farther than it is wide: counts, weights, sizes and edges; `edge` marks what stands at it."""
        lead, trail = (self.bottom, self.top) if direction else (self.left, self.right)
        at, one = near[edge], near[self.one[near]]
        numbers, size, weight = self.number[one], self.size[near], self.weight[near]
        largest = size.max()
        return SimpleNamespace(
            n=len(near), wide=self.wide[near].max(), weight=weight.sum(), size=largest, main=weight[size == largest].sum(), edge=len(at), edge_wide=self.wide[at].max(), lead=lead[near].min(), trail=trail[near].max(), edge_lead=lead[at].min(), edge_trail=trail[at].max(),
            numbered=len(one), one_left=min(self.left[one[numbers == 1]], default=None), most=np.nanmax(numbers, initial=0.0), numbered_top=max(self.top[one], default=0.0), short=np.count_nonzero((self.chars[near] <= 5) & (self.kind[near] != 0)), marks=self.mark[near].sum(), leaders=self.leader[near].sum(), chars=self.chars[near].max(),
        )

    def gaps(self, lines: np.ndarray, box: tuple) -> list[tuple]:
        """(direction, nr, start, end, score) of the stretches that no line of the region covers, wide enough, in a region large enough, and that no rule forbids. nr is the place from 0 of the end before among all beginnings and ends."""
        left, right, bottom, top = box
        tall, wide, out = top - bottom, right - left, []
        for direction, lo, hi, large, least, extent in ((1, self.left, self.right, tall >= 1.5 * self.page_size, self.column_gap, tall), (0, self.bottom, self.top, wide >= (self.x1 - self.x0) / 6, self.row_gap, wide)):
            if not large:
                continue
            begin, end = lines[np.argsort(lo[lines])], lines[np.argsort(hi[lines])]
            begins, ends, reach = lo[begin], hi[end], np.maximum.accumulate(hi[begin])
            width = begins[1:] - reach[:-1]
            for k in np.flatnonzero((width > 0) & (width >= least)):
                s, e, gap = float(reach[k]), float(begins[k + 1]), float(width[k])
                b0, b1, a0, a1 = np.searchsorted(ends, s - gap), np.searchsorted(ends, s, "right"), np.searchsorted(begins, e), np.searchsorted(begins, e + gap, "right")
                b, a = self.beside(end[b0:b1], s - ends[b0:b1] < 1, direction), self.beside(begin[a0:a1], begins[a0:a1] - e < 1, direction)
                g = SimpleNamespace(direction=direction, nr=2 * int(k) + 1, start=s, end=e, gap=gap, extent=extent, least=least, tall=tall, wide=wide, top=top)
                if not self.vetoed(g, b, a):
                    out.append((direction, g.nr, s, e, float(self.score(g, b, a))))
        return out

    def vetoed(self, g, b, a) -> bool:
        """Whether a gap is none: numbers, marks or leaders before it; single lines or light texts at a page's side; lines of one large heading."""
        if g.direction:
            half, width = max(2.0, b.n / 2), self.x1 - self.x0
            list_like = b.short >= b.n or b.short >= half or b.marks >= b.n or b.leaders >= half or b.chars <= 1
            footnotes = g.top < self.y0 + 0.3 * (self.y1 - self.y0) and b.one_left is not None and a.most <= 4
            light = b.weight <= LIGHT and a.weight <= LIGHT and (g.start < self.x0 + 0.2 * width or g.end > self.x0 + 0.8 * width)
            return list_like or (b.edge <= 1 and a.edge <= 1 and not footnotes) or light
        mid, size = (b.size + a.size) / 2, self.page_size
        stands = lambda by: b.size >= size + by and a.size >= size + by
        same = abs(b.size - a.size) < 0.1 and stands(0.5) and g.gap < max(1.3 * mid, 2 * g.least)
        return b.main >= 0.8 * b.weight and a.main >= 0.8 * a.weight and (same or (stands(LARGE) and g.gap < max(1.5 * mid, 3 * g.least)))

    def score(self, g, b, a) -> float:
        """extent squared times gap, times factors for its direction."""
        width, height, middle = self.x1 - self.x0, self.y1 - self.y0, (self.x0 + self.x1) / 2
        if g.direction:
            apart = a.most - a.numbered
            steep = max(0.3, min(1.0, 1 / apart if apart else INF))
            factors = [
                min(b.edge, a.edge),
                0.01 if b.weight <= SMALL and b.n <= 1 else 1.0,
                steep * steep if a.numbered >= 3 and a.most >= 6 and a.numbered_top < g.top - 0.2 * g.tall else 1 + (g.tall / height) * (g.tall / height) if g.tall > height / 2 else 1.0,
                max(1.0, 2 - abs(middle - (g.start + g.end) / 2) / width * 10),
            ]
        else:
            low, high = min(b.lead, a.lead), max(b.trail, a.trail)
            foot, head = g.start < self.y0 + 0.2 * height, g.end > self.y0 + 0.8 * height
            note = lambda x: x.numbered >= 1 and x.edge_wide < width / 4
            size = max(b.size, a.size)
            factors = [
                max(b.edge_wide, a.edge_wide) / g.wide * (max(b.wide, a.wide) / g.wide),
                1 + min(middle - low, high - middle) / max(middle - low, high - middle) if low < middle < high else 1.0,
                36.0 if (foot and note(b)) or (head and note(a)) else 4.0 if foot or head else 1.0,
                100.0 if 2 * b.edge >= g.nr and b.size > a.size + 0.5 else 1.0,
                (100.0 if b.one_left < middle else 1.0) if b.one_left is not None else 0.25 if b.numbered >= 2 or a.numbered >= 2 else 1.0,
                g.gap / size if g.extent >= 0.99 * width and b.edge_lead < middle < b.edge_trail and b.size >= a.size + 0.5 and g.gap > size else 1.0,
            ]
        blank = 10.0 if b.weight < 1 or a.weight < 1 else 1.0
        return max(0.0, g.extent * g.extent * g.gap * math.prod(factors, start=1.0) * blank)

    def thin_places(self, lines: np.ndarray, box: tuple) -> list[float]:
        """Where a region without gaps, nearly as wide as the page, has one or two places that at most two lines cross between stretches full of lines (else none).

        Eight lines and weight 100 at once make a stretch full, and a place within a tenth of the page's width of the last one moves it.
        What follows the last must have four lines and weight 50.
        """
        width = self.x1 - self.x0
        if box[1] - box[0] < 0.8 * width:
            return []
        n, span, ix = len(lines), self.wide[lines], self.ix[lines]
        at, ends = np.concatenate([self.left[lines], self.right[lines]]), np.repeat([0, 1], n)
        order = np.lexsort((np.tile(ix, 2), np.tile(span, 2), ends, at))[:-1]
        order = order[at[order] <= self.x0 + width * 5 / 6]
        signs = 1 - 2 * ends[order]
        weights = np.cumsum(signs * np.tile(self.weight[lines], 2)[order])
        places, full, heavy = [], 0, 0.0
        for x, end, active, weight in zip(at[order].tolist(), ends[order].tolist(), np.cumsum(signs).tolist(), weights.tolist()):
            full, heavy = max(full, active), max(heavy, weight)
            if end and active <= 2 and x >= self.x0 + width / 6:
                if places and x < places[-1] + width / 10:
                    places[-1] = x
                elif full >= 8 and heavy >= 100:
                    places.append(x)
                full, heavy = 0, 0.0
        return places if 1 <= len(places) <= 2 and full >= 4 and heavy >= 50 else []

    def parts(self) -> list[np.ndarray]:
        """The lines of each column, in reading order: a row's upper part and a column's left part come first; of equal scores the first gap cuts, columns before rows, then by place."""
        done, todo = [], [(np.arange(len(self.ix)), self.box(), 0)]
        while todo:
            lines, box, depth = todo.pop()
            cut = min(((-score, 1 - d, nr, s, e) for d, nr, s, e, score in self.gaps(lines, box)), default=None) if depth < self.deepest else None
            if cut is None:
                places = self.thin_places(lines, box) if depth < self.deepest else []
                of = np.searchsorted(places, self.left[lines])
                done += [part for k in range(len(places) + 1) if len(part := lines[of == k])]
                continue
            _, row, _, s, e = cut
            first = self.top[lines] > s if row else self.left[lines] < e
            for part, near in ((lines[~first], False), (lines[first], True)):
                if row:
                    to = self.left[part].min(), self.right[part].max(), e if near else box[2], box[3] if near else s
                else:
                    to = box[0] if near else e, s if near else box[1], self.bottom[part].min(), self.top[part].max()
                todo.append((part, to, depth + 1))
        return done


#: Fixed values of the score: weights of small texts, sizes that stand out, and what raises a gap.
LIGHT, SMALL, LARGE = 100.0, 50.0, 2.0


def by_page(lines: DataFrame, pages: DataFrame, use: Callable, schema: str) -> DataFrame:
    """use(page), as the columns of schema after doc_id and page, for each page of measured lines."""
    struct = StructType.fromDDL(schema)

    def run(got: pa.Table) -> pa.Table:
        kind, columns = to_arrow_schema(struct), use(Page(got))
        n = len(columns[0])
        return pa.table([pa.array([got[c][0].as_py()] * n, kind.field(c).type) for c in ("doc_id", "page")] + [pa.array(x, f.type) for x, f in zip(columns, list(kind)[2:])], schema=kind)

    return measured(lines, pages).groupBy("doc_id", "page").applyInArrow(run, schema)


def scored_gaps(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """The gaps of whole pages that no rule forbids, with their scores."""

    def use(page: Page) -> list:
        return list(zip(*page.gaps(np.arange(len(page.ix)), page.box()))) or [[]] * 5

    return by_page(lines, pages, use, "doc_id long, page int, direction int, nr int, start double, end double, score double")


def columns(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, ix, column (from 0, in reading order) for each line of some area.

    A page is cut at its best gap, and each part again; regions without a gap close, and the widest of them are cut at thin places. Lines
    are dealt out once, by page, however many levels a page has.
    """

    def use(page: Page) -> list:
        parts = page.parts()
        return [page.ix[np.concatenate(parts)], np.repeat(np.arange(len(parts)), [len(x) for x in parts])]

    return by_page(lines, pages, use, "doc_id long, page int, ix long, column int")
