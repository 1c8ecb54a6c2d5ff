"""Queries of page headers and footers, with their SQL."""

from __future__ import annotations

from quire.operators import margins
from quire.plans import inputs
from quire.plans.inputs import sql


def rule(kind: int) -> str:
    """The three passes over margin_parts and margin_pages, for headers (1) or footers (2)."""
    walk = f"PARTITION BY doc_id, page ORDER BY seq{'' if kind == 1 else ' DESC'}"
    far = "top < 0.8 * page_height" if kind == 1 else "bottom > 0.2 * page_height"
    level = ("top > first_value(CASE WHEN letters >= 5 THEN bottom END IGNORE NULLS)" if kind == 1 else "bottom < first_value(CASE WHEN letters >= 5 THEN top END IGNORE NULLS)") + f" OVER ({walk} ROWS UNBOUNDED PRECEDING)"
    beyond = "a.top < line" if kind == 1 else "a.bottom > line"
    title = lambda x, y="": f"({x}page = 1 AND {x}score >= {y or x}page_size + 0.5)"
    corners = " + ".join(f'(b."{c}" - o."{c}") ** 2' for c in ("left", "right", "top", "bottom"))
    near = lambda limit: f"levenshtein(b.key, o.key) < {limit}"
    return rf""", blocks0 AS (SELECT doc_id, page, seq, min("left") AS "left", max("right") AS "right", max(top) AS top, min(bottom) AS bottom, max(skew) AS skew, string_agg(text, ' ' ORDER BY part, text) AS text, count(DISTINCT top) AS n_lines, arg_max(size, length(text) * 1000 + size) AS size, sum(CASE WHEN bold THEN length(text) ELSE 0 END) / greatest(1, sum(length(text))) AS bold FROM margin_parts GROUP BY ALL),
  blocks1 AS (SELECT *, length(text) AS chars, len(regexp_extract_all(text, '\p{{L}}')) AS letters, len(regexp_extract_all(text, '\p{{N}}')) AS digits, len(regexp_extract_all(text, '\p{{Lo}}')) AS lo, translate(regexp_replace(lower(text), '\s+', '', 'g'), '{margins.MARKED}', '{margins.UNMARKED}') AS key,
    size + CASE WHEN len(regexp_extract_all(text, '\p{{Lu}}')) > 2 * len(regexp_extract_all(text, '\p{{Ll}}')) THEN 2 ELSE 0 END + CASE WHEN bold > 0.5 THEN 1 ELSE 0 END AS score FROM blocks0),
  blocks2 AS (SELECT * FROM (SELECT *, letters + lo + 0.5 * (chars - letters) AS info FROM blocks1) JOIN margin_pages USING (doc_id, page) WHERE skew < 1 AND "right" > "left" AND top > bottom),
  blocks3 AS (SELECT *, max(CASE WHEN {far} OR ((n_lines >= 3 OR info * (1 + bold) >= 200 OR regexp_matches(text, '(?i)^{margins.CAPTION_WORDS}\b')) AND NOT regexp_matches(text, '(?i){margins.COPYRIGHT}')) THEN 1 ELSE 0 END) OVER ({walk} ROWS UNBOUNDED PRECEDING) AS ended FROM blocks2),
  found AS (SELECT *, coalesce({level}, true) AND n_lines = 1 AND info >= 8 AND letters >= 5 AND digits >= 1 AS beside, row_number() OVER ({walk}) AS place FROM blocks3 WHERE ended = 0 AND chars > 0),
  n_pages AS (SELECT doc_id, count(*) AS n_pages FROM margin_pages GROUP BY doc_id),
  stated AS (SELECT doc_id, page, seq FROM found WHERE regexp_matches(text, '(?i)^{margins.COPYRIGHT}') AND len(regexp_extract_all(text, '\p{{L}}+|\p{{N}}+|[^\p{{L}}\p{{N}}\s]')) < 10),
  op AS (SELECT * FROM found ANTI JOIN stated USING (doc_id, page, seq)),
  same AS (SELECT * FROM (SELECT b.doc_id, b.page, b.seq, o.page AS o_page, o.seq AS o_seq, row_number() OVER (PARTITION BY b.doc_id, b.page, b.seq ORDER BY o.page, o.place) AS k FROM op b JOIN op o ON o.doc_id = b.doc_id AND o.key = b.key AND o.page <> b.page AND abs(o.page - b.page) <= 3 WHERE b.letters >= 5 AND o.letters >= 5
    AND ({corners} < 1 OR ({corners} < 100 AND NOT {title('b.')} AND NOT {title('o.', 'b.')}))) WHERE k = 1),
  words AS (SELECT *, list_filter(regexp_extract_all(text, '\p{{L}}+'), lambda w: length(w) = list_max(list_transform(regexp_extract_all(text, '\p{{L}}+'), lambda v: length(v))))[1] AS word, list_filter(regexp_extract_all(text, '\p{{N}}+'), lambda w: length(w) = list_max(list_transform(regexp_extract_all(text, '\p{{N}}+'), lambda v: length(v))))[1] AS number FROM op WHERE beside),
  keyed AS (SELECT *, translate(lower(word), '{margins.MARKED}', '{margins.UNMARKED}') AS wkey, 1 AS rank FROM words WHERE length(word) > 3 UNION ALL SELECT *, number, 2 FROM words WHERE number IS NOT NULL),
  often AS (SELECT doc_id, wkey FROM keyed JOIN n_pages USING (doc_id) GROUP BY doc_id, wkey HAVING count(DISTINCT page) >= greatest(4, max(n_pages) / 4)),
  ones AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, wkey, page ORDER BY place) AS nth FROM keyed SEMI JOIN often USING (doc_id, wkey)) WHERE nth = 1),
  alike AS (SELECT * FROM (SELECT b.doc_id, b.page, b.seq, o.page AS o_page, o.seq AS o_seq, row_number() OVER (PARTITION BY b.doc_id, b.page, b.seq ORDER BY b.rank, o.page, o.seq) AS k FROM keyed b JOIN ones o ON o.doc_id = b.doc_id AND o.wkey = b.wkey AND o.page <> b.page AND abs(o.page - b.page) <= 2
    WHERE abs(b.score - o.score) <= 1 AND NOT {title('b.')} AND NOT {title('o.', 'b.')} AND {near('least(length(b.key), length(o.key)) / 5.0')}) WHERE k = 1),
  marks AS (SELECT doc_id, page, seq, 'copyright' AS how, 0 AS rank FROM stated UNION ALL SELECT doc_id, page, seq, 'same', 1 FROM same UNION ALL SELECT doc_id, o_page, o_seq, 'same', 1 FROM same UNION ALL SELECT doc_id, page, seq, 'alike', 2 FROM alike UNION ALL SELECT doc_id, o_page, o_seq, 'alike', 2 FROM alike),
  marked AS (SELECT doc_id, page, seq, arg_min(how, rank) AS how FROM marks GROUP BY ALL),
  p0 AS (SELECT p.*, f.place, f.chars, concat_ws(' ', font, floor(p.top - p.bottom + 0.5)::INT, CASE WHEN p.bold THEN 'B' ELSE 'R' END, lower(p.text)) AS style, CASE WHEN regexp_full_match(p.text, '[ |]*[1-9][0-9]{{0,5}}[ |]*') THEN regexp_extract(p.text, '[0-9]+')::INT ELSE list_position(['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII', 'XIII', 'XIV', 'XV', 'XVI', 'XVII', 'XVIII', 'XIX', 'XX'], upper(p.text)) END AS number FROM margin_parts p JOIN found f USING (doc_id, page, seq) WHERE length(p.text) > 0),
  styles AS (SELECT doc_id, style FROM p0 JOIN n_pages USING (doc_id) WHERE chars >= 4 GROUP BY doc_id, style HAVING count(DISTINCT page) >= greatest(2, least(max(n_pages) / 3, 5))),
  nums AS (SELECT DISTINCT doc_id, page, number FROM p0 WHERE number IS NOT NULL),
  p1 AS (SELECT p.*, (p.doc_id, p.style) IN (SELECT (doc_id, style) FROM styles) AS recurs, {', '.join(f'EXISTS (SELECT 1 FROM nums n WHERE n.doc_id = p.doc_id AND n.number - p.number = n.page - p.page AND abs(n.page - p.page) = {d}) AS a{d}' for d in (1, 2, 4))} FROM p0 p ANTI JOIN marked USING (doc_id, page, seq)),
  p2 AS (SELECT *, (a1 AND a2) OR (coalesce(number > page / 2 - 30, false) AND a1) OR (a2 AND a4) AS strict FROM p1),
  p3 AS (SELECT *, NOT recurs AND (strict OR (coalesce(number > page / 2 - 30, false) AND a2)) AS loose FROM p2),
  p4 AS (SELECT *, recurs OR strict OR (loose AND NOT coalesce(bool_or(loose) OVER (PARTITION BY doc_id, page ORDER BY place, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS good FROM p3),
  styled AS (SELECT doc_id, page, seq FROM p4 GROUP BY ALL HAVING sum(CASE WHEN good THEN length(text) ELSE 0 END) + count(*) - 1 >= max(chars)),
  marked2 AS (SELECT * FROM marked UNION ALL SELECT *, 'parts' FROM styled),
  all0 AS (SELECT f.*, how FROM found f LEFT JOIN marked2 USING (doc_id, page, seq)),
  firsts AS (SELECT doc_id, page, min(place) AS first_at, arg_min(top, place) AS first_top, arg_min(bottom, place) AS first_bottom, max(score) AS most, sum(chars)::DOUBLE AS n FROM all0 WHERE how IS NOT NULL GROUP BY doc_id, page),
  all1 AS (SELECT a.*, CASE WHEN how IS NOT NULL THEN how WHEN place < first_at AND "right" - "left" < page_width / 2 AND NOT (letters > 0 AND score >= most + 1) {'AND bottom >= first_bottom' if kind == 1 else ''}
    AND NOT (chars >= 40 AND len(string_split_regex(trim(text), '\s+')) >= 6 AND letters >= 0.6 * chars AND len(regexp_extract_all(text, '\p{{Lu}}')) < 0.5 * letters AND NOT contains(text, '|')) THEN 'outside' END AS how2 FROM all0 a LEFT JOIN firsts USING (doc_id, page)),
  enough AS (SELECT doc_id, n_pages FROM firsts JOIN n_pages USING (doc_id) GROUP BY doc_id, n_pages HAVING count(*) >= n_pages / 20),
  lines0 AS (SELECT doc_id, (first_top + first_bottom) / 2 AS line, sum(n) AS n FROM firsts SEMI JOIN enough USING (doc_id) GROUP BY ALL),
  lines1 AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY line) AS run, sum(n) OVER (PARTITION BY doc_id) * {0.2 if kind == 1 else 0.8}::DOUBLE AS target, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS nxt FROM lines0),
  line AS (SELECT doc_id, arg_min(CASE WHEN run = target AND nxt IS NOT NULL THEN (line + nxt) / 2 ELSE line END, line) AS line FROM lines1 WHERE run >= target GROUP BY doc_id),
  counts AS (SELECT doc_id, key, max(CASE WHEN how <> 'parts' THEN 2 ELSE 0 END) + count(*) FILTER (WHERE how = 'parts') AS k, min(page * 1000 + place) AS first FROM found JOIN marked2 USING (doc_id, page, seq) WHERE how <> 'copyright' AND length(key) >= 5 GROUP BY doc_id, key),
  tops AS (SELECT doc_id, key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, first) AS nth FROM counts JOIN enough USING (doc_id) WHERE k >= n_pages / 20) WHERE nth <= 3),
  late0 AS (SELECT a.*, max(CASE WHEN {beyond} THEN 1 ELSE 0 END) OVER (PARTITION BY a.doc_id, page ORDER BY place) AS over FROM all1 a JOIN line USING (doc_id) SEMI JOIN tops USING (doc_id)),
  late AS (SELECT doc_id, page, seq FROM late0 b WHERE over = 0 AND how2 IS NULL AND (regexp_matches(text, '(?i)\b{margins.VOLUME_WORDS}\W+\p{{N}}') OR (letters >= 5 AND NOT (page <= 1 AND score > body_size + 1) AND EXISTS (SELECT 1 FROM tops o WHERE o.doc_id = b.doc_id AND {near('least(length(b.key), length(o.key)) / 2.0')}))))
  SELECT doc_id, page, seq, how2 AS how FROM all1 WHERE how2 IS NOT NULL UNION ALL SELECT doc_id, page, seq, 'late' FROM late"""


def page_headers(spark, d):
    return margins.running_blocks(inputs.margin_parts(spark, d), inputs.margin_pages(spark, d), 1)


def page_footers(spark, d):
    return margins.running_blocks(inputs.margin_parts(spark, d), inputs.margin_pages(spark, d), 2)


QUERIES = {"page_headers": page_headers, "page_footers": page_footers}
ORACLES = {"page_headers": sql(rule(1), "margin_parts"), "page_footers": sql(rule(2), "margin_parts")}
