"""Page layout: spans of a page into lines, lines into blocks. A page is one fold over its spans, many pages to an Arrow batch.

Spans: doc_id, page, ix (order of the producer), left, right, top, bottom (y upwards), text, size, bold, skew, and perhaps font.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.grouped import by_group

#: Share of the page below which a mark is dropped, tolerance of overstrike (share of a span's extent), skew of turned text.
TINY, OVERSTRIKE, TURNED = 1e-6, 0.1, 1.0
#: Line heights within which lines are neighbours, first and second time; gap in harmonic character widths.
NEAR, GAP = (0.75, 0.5), 2.0
LEADER = re.compile(r"(?:\.\s*){4,}$")


def page_box(left, right, top, bottom, rotation):
    """Columns of a page's rectangle from its view box, sides swapped where it is turned by 90 or 270 degrees."""
    turned = F.pmod(rotation, F.lit(180)) == 90
    return F.struct(left.alias("left"), F.when(turned, left + top - bottom).otherwise(right).alias("right"), F.when(turned, bottom + right - left).otherwise(top).alias("top"), bottom.alias("bottom"))


def weight(text: str) -> float:
    """What a text says: letters count one (two in scripts without case), other characters a half."""
    cased = sum(c.islower() or c.isupper() for c in text)
    letters = sum(c.isalpha() for c in text)
    return cased + 2.0 * (letters - cased) + 0.5 * (len(text) - letters)


def cased(text: str) -> tuple[int, int, int]:
    """Capitals, letters and characters of a text."""
    return sum(c.isupper() for c in text), sum(c.isalpha() for c in text), len(text)


def caps(upper: int, letters: int, chars: int) -> bool:
    return upper > max(0.75 * letters, letters - 4) and upper > max(3, chars / 3)


class Sum:
    """The sum of numbers added one by one, compensated in the way of Python's sum() of all of them at once."""

    def __init__(self):
        self.high = self.low = 0.0

    def add(self, x: float):
        t = self.high + x
        self.low += (self.high - t) + x if abs(self.high) >= abs(x) else (x - t) + self.high
        self.high = t

    total = property(lambda self: self.high + self.low)


class Line:
    """Spans read as one, with the means of their properties by weight, taken when asked for: a line may be joined to others many times before."""

    def __init__(self, spans):
        self.spans = list(spans)
        seen = [s for s in self.spans if s.text.strip()] or self.spans
        self.seen = bool(seen[0].text.strip())
        self.left, self.right, self.top, self.bottom = min(s.left for s in seen), max(s.right for s in seen), max(s.top for s in seen), min(s.bottom for s in seen)
        self.raw = "".join(s.text for s in self.spans)
        self.text = self.raw.strip()
        self.chars = sum(len(s.text.strip()) for s in self.spans)
        self.tallest = max(s.top - s.bottom for s in self.spans)

    @classmethod
    def joined(cls, a: Line, b: Line) -> Line:
        """The line of a's spans and b's, from what is known of both."""
        out = cls.__new__(cls)
        out.spans, out.raw, out.seen = a.spans + b.spans, a.raw + b.raw, a.seen or b.seen
        boxes = [a, b] if a.seen == b.seen else [a if a.seen else b]
        out.left, out.right, out.top, out.bottom = min(x.left for x in boxes), max(x.right for x in boxes), max(x.top for x in boxes), min(x.bottom for x in boxes)
        out.text, out.chars, out.tallest = out.raw.strip(), a.chars + b.chars, max(a.tallest, b.tallest)
        return out

    @cached_property
    def weights(self) -> list[float]:
        return [weight(s.text.strip()) for s in self.spans]

    def mean(self, f) -> float:
        return sum(w * f(s) for w, s in zip(self.weights, self.spans)) / self.weight if self.weight > 0 else 0.0

    weight = cached_property(lambda self: sum(self.weights))
    size = cached_property(lambda self: self.mean(lambda s: s.size))
    bold = cached_property(lambda self: self.mean(lambda s: float(s.bold)))
    skew = cached_property(lambda self: self.mean(lambda s: s.skew))
    middle = property(lambda self: (self.top + self.bottom) / 2)
    height = property(lambda self: self.top - self.bottom)
    width = property(lambda self: self.right - self.left)
    place = property(lambda self: (-self.top, -self.bottom, self.left, self.right))

    def char_width(self) -> float:
        return self.width / self.chars if self.chars else 0.0


def struck_over(a, b) -> bool:
    """Whether span b prints the same text over span a."""
    x, y = OVERSTRIKE * (a.right - a.left), OVERSTRIKE * (a.top - a.bottom)
    return bool(a.text.strip()) and a.text.strip() == b.text.strip() and abs(a.left - b.left) <= x and abs(a.right - b.right) <= x and abs(a.top - b.top) <= y and abs(a.bottom - b.bottom) <= y


def continues(line: Line, span) -> bool:
    """Whether a span goes on where the line ends: as skewed, at its height, and within a character's width of its end."""
    middle = (span.top + span.bottom) / 2
    level = span.bottom <= line.middle <= span.top or line.bottom <= middle <= line.top
    near = min(5.0, max(0.1, line.char_width(), (span.right - span.left) / max(1, len(span.text.strip())) if span.text.strip() else 0.0))
    back = 2 * near * (2 if line.text[-1:] in ".?!｡。？！．" and line.text else 1)
    return line.spans[-1].skew == span.skew and level and line.right - back < span.left < line.right + near


def first_lines(spans, area: float) -> list[Line]:
    """Lines in the producer's order. Empty spans and marks too small to see go; a text struck over itself is one bold span."""
    kept: list = []
    for s in spans:
        if not s.text or (len(s.text.strip()) > 1 and (s.right - s.left) * (s.top - s.bottom) < TINY * area):
            continue
        if kept and struck_over(kept[-1], s):
            kept[-1] = kept[-1]._replace(bold=True)
        else:
            kept.append(s)
    lines: list[Line] = []
    for s in kept:
        if lines and continues(lines[-1], s):
            lines[-1] = Line.joined(lines[-1], Line([s]))
        else:
            lines.append(Line([s]))
    return lines


#: A list mark or a bracketed label, which stands off from its text.
MARK = re.compile(r"(?:[IVX]+|[0-9]{1,2}|[A-Ha-h])[.):]?$|\[[^\]]{1,8}\]$")


def reach(a: Line, b: Line, column=None) -> float:
    """How far right of a, in its and b's harmonic character width, b may stand and still go on in a's row.

    GAP in a column known to hold both (column: its bounds), half of it elsewhere, half as much again on one base line; three times that
    from leaders to their number, and twice from a mark to its text.
    """
    inside = column is not None and column[0] <= min(a.left, b.left) and max(a.right, b.right) <= column[1]
    far = 3.0 if b.text.isdigit() and LEADER.search(a.text) else 2.0 if MARK.match(a.text) and any(c.isalpha() for c in b.text) else 1.0
    even = 1.5 if max(abs(a.top - b.top), abs(a.bottom - b.bottom)) <= 0.1 else 1.0
    return far * even * (GAP if inside else GAP / 2)


def joins(a: Line, b: Line, column=None) -> bool:
    """Whether b goes on in a's row: they are of like height, and b within reach."""
    tall, low = sorted((a.tallest, b.tallest), reverse=True)
    if tall > max(2 * low, low + 10) and a.chars and b.chars:
        return False
    widths = [w for w in (a.char_width(), b.char_width()) if w > 0]
    unit = 2 / sum(1 / w for w in widths) if len(widths) == 2 else 0.0
    return b.left - a.right <= reach(a, b, column) * unit


def stacked(a: Line, b: Line, body: float) -> bool:
    """Whether one stands over the other as a larger label."""
    upper, lower = (a, b) if a.middle > b.middle else (b, a)
    across = (min(a.right, b.right) - max(a.left, b.left)) / max(1e-6, min(a.width, b.width))
    down = (min(a.top, b.top) - max(a.bottom, b.bottom)) / max(1e-6, min(a.height, b.height))
    return across > 0.5 > down and body > 0 and upper.size >= 1.2 * body and upper.size >= 1.2 * lower.size


def merged(lines: list[Line], near: float, columns=()) -> list[Line]:
    """Lines in reading order, those of a row joined: from left to right, each meets the nearer of the lines just above and below it.

    If that is within `near` line heights, the two are joined or, where they do not fit, the neighbour is finished and this line takes
    its place among the open ones.
    """
    sizes = sorted(s.size for line in lines for s in line.spans if s.size > 0)
    body = sizes[len(sizes) // 2] if sizes else 0.0
    open_lines: list[tuple] = []  # (place, number), so that equal places keep an order
    known: list[Line] = []
    done: list[Line] = []

    def put(line):
        known.append(line)
        insort(open_lines, (line.place, len(known) - 1))

    for line in sorted(lines, key=lambda x: (x.left, x.right, -x.top, -x.bottom)):
        if line.spans[-1].skew > TURNED:
            done.append(line)
            continue
        at = bisect_left(open_lines, (line.place, -1))
        apart = lambda i: abs(known[open_lines[i][1]].middle - line.middle) / (max(known[open_lines[i][1]].height, line.height) or float("inf"))
        by = sorted((apart(i), -i) for i in (at - 1, at) if 0 <= i < len(open_lines))
        if not by or by[0][0] >= near:
            put(line)
            continue
        other = known[open_lines.pop(-by[0][1])[1]]
        column = next(((lo, hi) for lo, hi in columns if lo <= other.left and other.right <= hi), None)
        if joins(other, line, column):
            first, second = (line, other) if stacked(other, line, body) and line.middle > other.middle else (other, line)
            put(Line.joined(first, second))
        else:
            done.append(other)
            put(line)
    return sorted([*done, *(known[n] for _, n in open_lines)], key=lambda x: x.place)


def numbered(lines: list[Line], left: float, width: float) -> list[Line]:
    """The lines without a column of line numbers: five or more at the left edge, one more each time, beside four fifths of the lines."""
    marks = [x for x in lines if x.text.isdigit() and x.right <= left + 0.15 * width]
    runs = sum(int(b.text) == int(a.text) + 1 for a, b in zip(marks, marks[1:]))
    rest = len(lines) - len(marks)
    return [x for x in lines if x not in marks] if len(marks) >= 5 and runs == len(marks) - 1 and rest and len(marks) >= 0.8 * rest else lines


class Block:
    """Lines read as one; a line is added without asking those before it again."""

    def __init__(self, lines):
        self.lines, self.case, self.end = [], (0, 0, 0), ""
        self.left, self.right, self.top, self.bottom = float("inf"), float("-inf"), float("-inf"), float("inf")
        self.weight, self.sums = Sum(), {k: Sum() for k in ("size", "bold", "skew")}
        for x in lines:
            self.add(x)

    def add(self, x: Line):
        self.left, self.right, self.top, self.bottom = min(self.left, x.left), max(self.right, x.right), max(self.top, x.top), min(self.bottom, x.bottom)
        self.weight.add(x.weight)
        for k, s in self.sums.items():
            s.add(x.weight * getattr(x, k))
        self.size, self.bold, self.skew = (s.total / (self.weight.total or 1.0) for s in self.sums.values())
        if x.text:
            upper, letters, chars = cased(x.text)
            self.case = self.case[0] + upper, self.case[1] + letters, self.case[2] + chars + bool(self.end)
            self.end = x.text[-1]
        self.lines.append(x)

    text = property(lambda self: " ".join(x.text for x in self.lines if x.text))
    width = property(lambda self: self.right - self.left)


def takes(block: Block, line: Line, nearest: Block) -> bool:
    """Whether a line goes on in a block: like in skew, size and weight, below it, and within a tolerance of its line pitch."""
    step, last = line.size - block.size, block.lines[-1]
    left, right = abs(block.left - line.left) <= 1, abs(block.right - line.right) <= 2
    if abs(block.skew - line.skew) > 1 or step > 2 or (step > 1 and not (left and right)) or step < -5 or (step < -2 and line.chars >= 5):
        return False
    ratio = max(block.width, line.width) / max(1e-6, min(block.width, line.width))
    weightier = (last.bold > 0.5) != (line.bold > 0.5)
    if weightier and (ratio > 2 or last.text[-1:] in tuple(".?!") or block.width > 1.5 * last.width):
        return False
    centred = abs((block.left + block.right) - (line.left + line.right)) <= 2
    shift = line.left - block.left
    if not centred and ((block.bottom - line.top > -1 and shift > 0.33 * block.width) or shift > 0.98 * block.width or (line.left + line.right) / 2 < block.left):
        return False
    pitch = (block.top - block.bottom) / len(block.lines)
    flips = caps(*block.case) != caps(*cased(line.text)) and sum(c.isalpha() for c in line.text) >= 3
    number = re.compile(r"(?:[0-9]{1,2}|[IVX]+|[A-H])[.)]\s")
    mine, theirs = bool(number.match(block.lines[0].text)), bool(number.match(line.text))
    factors = (
        (not weightier and not flips and (ratio <= 1.2 or abs(last.left - line.left) <= 0.1) and last.width > 0.9 * block.width, 1.3),
        (left and line.width < 0.5 * block.width and line.text[-1:] in tuple(".?!") and block.end not in tuple(".?!"), 1.3),
        (left and right, 1.1),
        (mine and step <= -0.5, 0.5),
        ((mine or theirs) and weightier, 1 / 1.5),
        (mine and theirs, 1 / 1.3),
        (flips, 1 / 1.1),
        (flips and ratio > 1.5, 1 / min(3.0, ratio)),
        (block is not nearest and block.bottom - line.bottom > 1.1 * (nearest.bottom - line.bottom), 0.5),
    )
    most = 1.3 * (pitch + block.size) / 2
    for holds, factor in factors:
        most *= factor if holds else 1.0
    return block.bottom - line.bottom <= most


#: Headings that stand alone, for parting a heading from the body it runs into. Own list.
ALONE = re.compile(r"(?i)(?:[0-9.]+\s+)?(?:abstract|summary|introduction|background|methods?|results?|discussion|conclusions?|references|bibliography|acknowledge?ments?|appendix)\W*$")


def blocks(lines: list[Line]) -> list[Block]:
    """Blocks in reading order: each line, from the top, goes to the nearest open block above it that takes it.

    Only blocks that overlap it in x are asked, in order of their lower edge, the nearest first; all of them that do not take it are
    closed. A known heading in its own style over a body is parted from it.
    """
    open_blocks: list[Block] = []
    done: list[Block] = []
    for line in lines:
        over = sorted((b for b in open_blocks if b.left <= line.right and line.left <= b.right), key=lambda b: (b.bottom, b.top, b.left, b.right))
        into = next((b for b in over if takes(b, line, over[0])), None)
        open_blocks = [b for b in open_blocks if b not in over]
        done += [b for b in over if b is not into]
        if into:
            into.add(line)
        open_blocks.append(into or Block([line]))
    out = []
    for b in [*done, *open_blocks]:
        style = lambda x: (x.size, x.bold > 0.5, getattr(x.spans[0], "font", None))
        heading = len(b.lines) > 1 and ALONE.match(b.lines[0].text) and (style(b.lines[0]) != style(b.lines[-1]) or b.lines[0].width <= 0.5 * b.width)
        out += [Block(b.lines[:1]), Block(b.lines[1:])] if heading else [b]
    return sorted(out, key=lambda b: (-b.top, -b.bottom, b.left, b.right))


def page_layout(rows) -> list[Line]:
    """The lines of a page: first lines, joined within three quarters of a line height, then within half of one, without line numbers."""
    left, right, top, bottom = min(r.left for r in rows), max(r.right for r in rows), max(r.top for r in rows), min(r.bottom for r in rows)
    lines = first_lines(rows, (right - left) * (top - bottom))
    for near in NEAR:
        lines = merged(lines, near) if lines else []
    return numbered(lines, left, right - left)


def _spans(spans: DataFrame) -> DataFrame:
    more = ["font"] if "font" in spans.columns else []
    return spans.select("doc_id", "page", "ix", *[F.col(c).cast("double").alias(c) for c in ("left", "right", "top", "bottom", "size", "skew")], F.coalesce("text", F.lit("")).alias("text"), F.coalesce("bold", F.lit(False)).alias("bold"), *more)


def page_lines(spans: DataFrame) -> DataFrame:
    """doc_id, page, line, left, right, top, bottom, text, size, bold, skew, spans (their ix) of each page's lines in reading order."""

    def fold(rows):
        return [(rows[0].doc_id, rows[0].page, n, x.left, x.right, x.top, x.bottom, x.text, x.size, x.bold, x.skew, [s.ix for s in x.spans]) for n, x in enumerate(page_layout(rows))]

    return by_group(_spans(spans), ["doc_id", "page"], ["ix"], fold, "doc_id long, page int, line int, left double, right double, top double, bottom double, text string, size double, bold double, skew double, spans array<long>")


def page_paragraphs(spans: DataFrame) -> DataFrame:
    """doc_id, page, block, left, right, top, bottom, text, size, bold, n_lines, spans of each page's blocks in reading order."""

    def fold(rows):
        found = blocks(page_layout(rows))
        return [(rows[0].doc_id, rows[0].page, n, b.left, b.right, b.top, b.bottom, b.text, b.size, b.bold, len(b.lines), [s.ix for x in b.lines for s in x.spans]) for n, b in enumerate(found)]

    return by_group(_spans(spans), ["doc_id", "page"], ["ix"], fold, "doc_id long, page int, block int, left double, right double, top double, bottom double, text string, size double, bold double, n_lines int, spans array<long>")


def document_text(paragraphs: DataFrame) -> DataFrame:
    """doc_id, page, markdown: a page's blocks in reading order, a line each."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n")
    return paragraphs.where("text <> ''").groupBy("doc_id", "page").agg(text.alias("markdown"))
