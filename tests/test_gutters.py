"""Columns by scored gutters, against a page-by-page version in plain Python."""

import math
import random
import re

from quire.operators import gutters

LINES = "doc_id long, page int, ix long, left double, right double, top double, bottom double, text string, size double"
PAGES = "doc_id long, page int, size double, overlap_gap double, char_width double"


class Line:
    def __init__(self, row):
        _, _, self.ix, self.l, self.r, self.t, self.b, self.text, self.size = row
        self.weight = sum(c.isalpha() for c in self.text) * 0.5 + 0.5 * len(self.text)
        m = re.match(r"([1-9][0-9]?)(?:[.:)]|\s|$)", self.text) or re.match(r"\[([1-9])\]", self.text)
        self.number = float(m[1]) if m else None
        self.wide = self.r - self.l

    def edges(self, d):
        return (self.l, self.r) if d else (self.b, self.t)

    def across(self, d):
        return (self.b, self.t) if d else (self.l, self.r)


def sweep(lines, d):
    """(place, ends, line) in order, and after how many of them no line is open."""
    e = sorted([(x.edges(d)[k], k, x.edges(d)[1] - x.edges(d)[0], x.ix, x) for x in lines for k in (0, 1)], key=lambda v: v[:4])
    open_ = 0
    for i, v in enumerate(e):
        open_ += 1 - 2 * v[1]
        yield i, v[0], v[1], v[4], open_, e[i + 1][0] if i + 1 < len(e) else None


def score(lines, cur, root, d, nr, s, e, least, fs):
    gap = e - s
    before, after = [x for x in lines if s - gap <= x.edges(d)[1] <= s], [x for x in lines if e <= x.edges(d)[0] <= e + gap]
    at_s, at_e = [x for x in before if s - x.edges(d)[1] < 1], [x for x in after if x.edges(d)[0] - e < 1]
    ones, nums = [x for x in before if x.number == 1], [x for x in after if x.number is not None]
    most, w, h, mid = max([x.number for x in nums], default=0), root[1] - root[0], root[3] - root[2], (root[0] + root[1]) / 2
    wb, wa, sb, sa = sum(x.weight for x in before), sum(x.weight for x in after), max(x.size for x in before), max(x.size for x in after)
    tall, wide = cur[3] - cur[2], cur[1] - cur[0]
    out = (tall if d else wide) ** 2 * gap
    if d:
        half = max(2, len(before) / 2)
        short = sum(len(x.text) <= 5 and x.number is not None for x in before)
        marks = sum(len(x.text) <= 10 and (bool(re.fullmatch(r"\[.*\]", x.text)) or bool(re.fullmatch(r"[A-Z].*\.", x.text))) for x in before)
        leaders = sum(bool(re.search(r"(\.\s*){5,}$", x.text)) for x in before)
        notes = cur[3] < root[2] + 0.3 * h and ones and most <= 4
        if short >= min(half, len(before)) or marks >= len(before) or leaders >= half or max(len(x.text) for x in before) <= 1 or (len(at_s) <= 1 and len(at_e) <= 1 and not notes) or (max(wb, wa) <= 100 and (s < root[0] + 0.2 * w or e > root[0] + 0.8 * w)):
            return None
        out *= min(len(at_s), len(at_e)) / (100 if wb <= 50 and len(before) <= 1 else 1)
        if len(nums) >= 3 and most >= 6 and max(x.t for x in nums) < cur[3] - 0.2 * tall:
            out *= max(0.3, min(1, 1 / (most - len(nums)) if most != len(nums) else math.inf)) ** 2
        elif tall > h / 2:
            out *= 1 + (tall / h) ** 2
        out *= max(1, 2 - abs(mid - (s + e) / 2) / w * 10)
    else:
        main = all(sum(x.weight for x in v if x.size == z) >= 0.8 * t for v, z, t in ((before, sb, wb), (after, sa, wa)))
        if main and ((abs(sb - sa) < 0.1 and min(sb, sa) >= fs + 0.5 and gap < max(0.65 * (sb + sa), 2 * least)) or (min(sb, sa) >= fs + 2 and gap < max(0.75 * (sb + sa), 3 * least))):
            return None
        narrow = lambda v: max([x.wide for x in v], default=0)
        out *= max(narrow(at_s), narrow(at_e)) * max(narrow(before), narrow(after)) / wide**2
        low, high = min(x.l for x in before + after), max(x.r for x in before + after)
        if low < mid < high:
            out *= 1 + min(mid - low, high - mid) / max(mid - low, high - mid)
        foot, head = s < root[2] + 0.2 * h, e > root[2] + 0.8 * h
        out *= 4 if foot or head else 1
        out *= 9 if (foot and any(x.number is not None for x in before) and narrow(at_s) < w / 4) or (head and nums and narrow(at_e) < w / 4) else 1
        out *= 100 if 2 * len(at_s) >= nr and sb > sa + 0.5 else 1
        if ones:
            out *= 100 if min(x.l for x in ones) < mid else 1
        elif max(sum(x.number is not None for x in before), len(nums)) >= 2:
            out /= 4
        if wide >= 0.99 * w and at_s and min(x.l for x in at_s) < mid < max(x.r for x in at_s) and sb >= sa + 0.5 and gap > max(sb, sa):
            out *= gap / max(sb, sa)
    return max(0, out * (10 if min(wb, wa) < 1 else 1))


def parts(lines, cur, root, depth, deepest, stat):
    """Groups of lines in reading order."""
    fs, overlap, char = stat
    found, w = [], root[1] - root[0]
    for d, ok, least in ((1, cur[3] - cur[2] >= 1.5 * fs, char), (0, cur[1] - cur[0] >= w / 6, max(0.5 * fs, min(1.1 * (overlap - fs), 3 * fs)))):
        for nr, at, _, _, active, after in sweep(lines, d):
            if depth < deepest and ok and active <= 0 and after is not None and after - at >= least and (x := score(lines, cur, root, d, nr, at, after, least, fs)) is not None:
                found.append((-x, 1 - d, nr, at, after))
    if found:
        _, row, _, s, e = min(found)
        first = [x for x in lines if (x.t > s if row else x.l < e)]
        second = [x for x in lines if x not in first]
        side = lambda v: (min(x.l for x in v), max(x.r for x in v)) if row else (min(x.b for x in v), max(x.t for x in v))
        a, b = ((*side(first), e, cur[3]), (*side(second), cur[2], s)) if row else ((cur[0], s, *side(first)), (e, cur[1], *side(second)))
        return parts(first, a, root, depth + 1, deepest, stat) + parts(second, b, root, depth + 1, deepest, stat)
    places, lines_, heavy, weight = [], 0, 0.0, 0.0
    if depth < deepest and cur[1] - cur[0] >= 0.8 * w:
        for _, at, ends, x, active, after in sweep(lines, 1):
            if after is None or at > root[0] + w * 5 / 6:
                break
            weight += x.weight * (1 - 2 * ends)
            lines_, heavy = max(lines_, active), max(heavy, weight)
            if ends and active <= 2 and at >= root[0] + w / 6:
                if places and at < places[-1] + w / 10:
                    places[-1] = at
                elif lines_ >= 8 and heavy >= 100:
                    places.append(at)
                lines_, heavy = 0, 0.0
    if 1 <= len(places) <= 2 and lines_ >= 4 and heavy >= 50:
        return [[x for x in lines if sum(x.l > p for p in places) == k] for k in range(len(places) + 1)]
    return [lines]


def plain(rows, stat):
    lines = [Line(r) for r in rows if r[4] > r[3] and r[5] > r[6]]
    root = (min(x.l for x in lines), max(x.r for x in lines), min(x.b for x in lines), max(x.t for x in lines))
    return {x.ix: c for c, part in enumerate(p for p in parts(lines, root, root, 0, math.floor(2 * math.log2(len(lines))), stat) if p) for x in part}


WORDS = ["running text of a line here", "some more words that stand in it", "a Title", "12", "3. item", "1. first note", "[7]", "Intro . . . . . .", "Ab.", "2: two", "x"]


def page(r, kind):
    rows, y, ix = [], 780.0, 0
    for _ in range(r.randint(3, 40)):
        size = r.choice([10.0, 10.0, 10.0, 12.0, 14.0])
        lefts = {"columns": [40, 320], "three": [40, 220, 400], "plain": [40], "mixed": r.choice([[40], [40, 320], [60, 200, 330, 450]]), "thin": [40, 60, 80, 300, 320, 340]}[kind]
        for left in lefts:
            if r.random() < 0.85:
                width = r.uniform(20, 520 if kind in ("plain",) else 150 if kind != "thin" else 235)
                x, b = left + r.choice([0, 0, 0, 3]), y - r.choice([0, 0, 2])
                rows.append((1, 1, ix, float(x), round(x + width, 1), b + size, b, r.choice(WORDS), size))
                ix += 1
        y -= r.choice([11, 12, 14, 24, 40])
    return rows


def test_columns_are_those_of_the_plain_version(spark):
    r, rows, stats, want, kinds = random.Random(7), [], [], {}, ["columns", "three", "plain", "mixed", "thin"]
    for p in range(1, 76):
        made = [(1, p, *x[2:]) for x in page(r, kinds[p % 5])]
        if len(made) < 2:
            continue
        stat = (10.0, r.choice([11.0, 14.0, 18.0]), r.choice([4.0, 6.0]))
        rows += made
        stats.append((1, p, *stat))
        want |= {(p, i): c for i, c in plain(made, stat).items()}
    got = {(x["page"], x["ix"]): x["column"] for x in gutters.columns(spark.createDataFrame(rows, LINES), spark.createDataFrame(stats, PAGES)).collect()}
    assert got == want and max(want.values()) > 1


def test_no_lines_and_one_line(spark):
    one = spark.createDataFrame([(1, 1, 0, 0.0, 10.0, 10.0, 0.0, "x", 10.0), (1, 1, 1, 5.0, 5.0, 9.0, 0.0, "no width", 10.0)], LINES)
    pages = spark.createDataFrame([(1, 1, 10.0, 12.0, 5.0)], PAGES)
    assert [tuple(r) for r in gutters.columns(one, pages).collect()] == [(1, 1, 0, 0)]
    assert gutters.columns(one.limit(0), pages).collect() == []


def test_columns_deal_lines_out_once(spark):
    """However many levels a page has, its columns start as few jobs as those of a page of one line."""
    pages = spark.createDataFrame([(1, 1, 10.0, 12.0, 5.0)], PAGES)

    def jobs(n):
        rows = [(1, 1, i, 40.0 + 300 * (i % 2), 300.0 + 300 * (i % 2), 780.0 - 40 * (i // 2), 770.0 - 40 * (i // 2), "words of a line that runs on", 10.0) for i in range(n)]
        spark.sparkContext.setJobGroup(group := f"columns of {n}", group)
        got = gutters.columns(spark.createDataFrame(rows, LINES), pages).collect()
        return max(x["column"] for x in got), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    one, many = jobs(1), jobs(24)
    assert many[0] > 1 and many[1] <= one[1] + 2
