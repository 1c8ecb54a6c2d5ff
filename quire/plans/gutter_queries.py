"""Queries of columns and their gutters; one level of gutters has SQL, the columns of all levels a brute-force test."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import gutters
from quire.plans import inputs
from quire.plans.inputs import sql

NEAR = r"""count(*) AS n, max(wide) AS wide, sum(weight) AS weight, max(size) AS size, count(*) FILTER (WHERE edge) AS edge, coalesce(max(wide) FILTER (WHERE edge), 0) AS edge_wide, min(lead) AS lead, max(trail) AS trail, min(lead) FILTER (WHERE edge) AS edge_lead, max(trail) FILTER (WHERE edge) AS edge_trail,
  count(*) FILTER (WHERE kind = 1) AS numbered, min("left") FILTER (WHERE number = 1) AS one_left, coalesce(max(number), 0) AS most, coalesce(max(top) FILTER (WHERE kind = 1), 0) AS numbered_top, count(*) FILTER (WHERE chars <= 5 AND kind <> 0) AS short, count(*) FILTER (WHERE mark) AS marks, count(*) FILTER (WHERE leader) AS leaders, max(chars) AS chars"""

GUTTERS = rf""", m0 AS (SELECT *, length(text) AS chars, len(regexp_extract_all(text, '\p{{L}}')) AS letters, len(regexp_extract_all(text, '\p{{Lo}}')) AS lo, regexp_extract(text, '^([1-9][0-9]?)(?:[.:)]|\s)', 1) AS digits, regexp_extract(text, '^[\[(] *([1-9][0-9]?) *[)\]]', 1) AS bracket, regexp_matches(text, '^([IVX]+)(?:[.:)]|-\P{{N}}|-$|\s|$)') OR regexp_matches(text, '^([A-Ha-h]|[ivx])[.)]') AS other FROM column_lines),
  m AS (SELECT *, letters + lo + 0.5 * (chars - letters) AS weight, CASE WHEN digits <> '' OR (NOT other AND bracket <> '') THEN 1 WHEN other THEN 2 ELSE 0 END AS kind, coalesce(nullif(digits, ''), CASE WHEN NOT other THEN nullif(bracket, '') END)::DOUBLE AS number, chars <= 10 AND (regexp_matches(text, '^\[.*\]$') OR regexp_matches(text, '^[\p{{Lu}}\p{{Lt}}].*\.$')) AS mark, regexp_matches(text, '(\.\s*){{5,}}$') AS leader FROM m0),
  box AS (SELECT m.doc_id, m.page, min("left") AS x0, max("right") AS x1, min(bottom) AS y0, max(top) AS y1, max(p.size) AS ps, max(char_width) AS column_gap, max(greatest(0.5 * p.size, least(1.1 * (overlap_gap - p.size), 3 * p.size))) AS row_gap FROM m JOIN column_pages p ON p.doc_id = m.doc_id AND p.page = m.page GROUP BY m.doc_id, m.page),
  ev AS (SELECT *, 1 AS direction, 0 AS ends, "left" AS pos, "right" - "left" AS span FROM m UNION ALL SELECT *, 1, 1, "right", "right" - "left" FROM m UNION ALL SELECT *, 0, 0, bottom, top - bottom FROM m UNION ALL SELECT *, 0, 1, top, top - bottom FROM m),
  sw AS (SELECT *, "right" - "left" AS wide, CASE direction WHEN 1 THEN bottom ELSE "left" END AS lead, CASE direction WHEN 1 THEN top ELSE "right" END AS trail, sum(1 - 2 * ends) OVER w AS active, row_number() OVER w - 1 AS nr, lead(pos) OVER w AS nxt FROM ev WINDOW w AS (PARTITION BY doc_id, page, direction ORDER BY pos, ends, span, ix)),
  gap AS (SELECT doc_id, page, direction, nr, pos AS gs, nxt AS ge, nxt - pos AS gap, CASE direction WHEN 1 THEN y1 - y0 ELSE x1 - x0 END AS extent, CASE direction WHEN 1 THEN column_gap ELSE row_gap END AS least FROM sw JOIN box USING (doc_id, page) WHERE active <= 0 AND nxt IS NOT NULL AND CASE direction WHEN 1 THEN y1 - y0 >= 1.5 * ps AND nxt - pos >= column_gap ELSE nxt - pos >= row_gap END),
  b AS (SELECT g.doc_id, g.page, g.direction, g.nr, {NEAR} FROM (SELECT g.nr, s.* EXCLUDE (nr), g.gs - s.pos < 1 AS edge FROM gap g JOIN sw s ON s.doc_id = g.doc_id AND s.page = g.page AND s.direction = g.direction AND s.ends = 1 AND s.pos BETWEEN g.gs - g.gap AND g.gs) g GROUP BY ALL),
  a AS (SELECT g.doc_id, g.page, g.direction, g.nr, {NEAR} FROM (SELECT g.nr, s.* EXCLUDE (nr), s.pos - g.ge < 1 AS edge FROM gap g JOIN sw s ON s.doc_id = g.doc_id AND s.page = g.page AND s.direction = g.direction AND s.ends = 0 AND s.pos BETWEEN g.ge AND g.ge + g.gap) g GROUP BY ALL),
  bm AS (SELECT g.doc_id, g.page, g.direction, g.nr, sum(s.weight) AS main FROM gap g JOIN b USING (doc_id, page, direction, nr) JOIN sw s ON s.doc_id = g.doc_id AND s.page = g.page AND s.direction = g.direction AND s.ends = 1 AND s.pos BETWEEN g.gs - g.gap AND g.gs AND s.size = b.size GROUP BY ALL),
  am AS (SELECT g.doc_id, g.page, g.direction, g.nr, sum(s.weight) AS main FROM gap g JOIN a USING (doc_id, page, direction, nr) JOIN sw s ON s.doc_id = g.doc_id AND s.page = g.page AND s.direction = g.direction AND s.ends = 0 AND s.pos BETWEEN g.ge AND g.ge + g.gap AND s.size = a.size GROUP BY ALL),
  j AS (SELECT g.*, b, a, bm.main AS b_main, am.main AS a_main, x0, x1, y0, y1, ps, x1 - x0 AS width, y1 - y0 AS height, (x0 + x1) / 2 AS middle FROM gap g JOIN b USING (doc_id, page, direction, nr) JOIN a USING (doc_id, page, direction, nr) JOIN bm USING (doc_id, page, direction, nr) JOIN am USING (doc_id, page, direction, nr) JOIN box USING (doc_id, page)),
  ok AS (SELECT * FROM j WHERE NOT (direction = 1 AND (b.short >= b.n OR b.short >= greatest(2, b.n / 2) OR b.marks >= b.n OR b.leaders >= greatest(2, b.n / 2) OR b.chars <= 1))
    AND NOT (direction = 1 AND b.edge <= 1 AND a.edge <= 1 AND NOT (y1 < y0 + 0.3 * height AND b.one_left IS NOT NULL AND a.most <= 4)) AND NOT (direction = 1 AND b.weight <= 100 AND a.weight <= 100 AND (gs < x0 + 0.2 * width OR ge > x0 + 0.8 * width))
    AND NOT (direction = 0 AND b_main >= 0.8 * b.weight AND a_main >= 0.8 * a.weight AND ((abs(b.size - a.size) < 0.1 AND b.size >= ps + 0.5 AND a.size >= ps + 0.5 AND gap < greatest(1.3 * (b.size + a.size) / 2, 2 * least)) OR (b.size >= ps + 2 AND a.size >= ps + 2 AND gap < greatest(1.5 * (b.size + a.size) / 2, 3 * least))))),
  f AS (SELECT *, greatest(0.3, least(1, CASE WHEN a.most <> a.numbered THEN 1 / (a.most - a.numbered) ELSE 1 END)) AS steep, least(b.lead, a.lead) AS low, greatest(b.trail, a.trail) AS high, gs < y0 + 0.2 * height AS foot, ge > y0 + 0.8 * height AS head FROM ok)
  SELECT doc_id, page, direction, nr, round(greatest(0, extent ** 2 * gap * CASE WHEN b.weight < 1 OR a.weight < 1 THEN 10 ELSE 1 END * CASE WHEN direction = 1 THEN
    least(b.edge, a.edge) * CASE WHEN b.weight <= 50 AND b.n <= 1 THEN 0.01 ELSE 1 END * CASE WHEN a.numbered >= 3 AND a.most >= 6 AND a.numbered_top < y1 - 0.2 * height THEN steep ** 2 ELSE 2 END * greatest(1, 2 - abs(middle - (gs + ge) / 2) / width * 10)
    ELSE greatest(b.edge_wide, a.edge_wide) * greatest(b.wide, a.wide) / width ** 2 * CASE WHEN low < middle AND high > middle THEN 1 + least(middle - low, high - middle) / greatest(middle - low, high - middle) ELSE 1 END
      * CASE WHEN (foot AND b.numbered >= 1 AND b.edge_wide < width / 4) OR (head AND a.numbered >= 1 AND a.edge_wide < width / 4) THEN 36 WHEN foot OR head THEN 4 ELSE 1 END * CASE WHEN 2 * b.edge >= nr AND b.size > a.size + 0.5 THEN 100 ELSE 1 END
      * CASE WHEN b.one_left IS NOT NULL THEN CASE WHEN b.one_left < middle THEN 100 ELSE 1 END WHEN b.numbered >= 2 OR a.numbered >= 2 THEN 0.25 ELSE 1 END
      * CASE WHEN extent >= 0.99 * width AND b.edge_lead < middle AND b.edge_trail > middle AND b.size >= a.size + 0.5 AND gap > greatest(b.size, a.size) THEN gap / greatest(b.size, a.size) ELSE 1 END END), 3) AS score FROM f"""


def gutter_scores(spark, d):
    return gutters.scored_gaps(inputs.column_lines(spark, d), inputs.column_pages(spark, d)).select("doc_id", "page", "direction", "nr", F.round("score", 3).alias("score"))


def page_columns(spark, d):
    """All levels; no SQL says the recursion."""
    return gutters.columns(inputs.column_lines(spark, d), inputs.column_pages(spark, d))


QUERIES = {"gutter_scores": gutter_scores, "page_columns": page_columns}
ORACLES = {"gutter_scores": sql(GUTTERS, "spans", "column_lines")}
