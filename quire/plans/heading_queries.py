"""Queries of run-in headings, with SQL, and of keyword cliques, which a test holds against one that adds in turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import assembly, classify, cliques, outline, runin
from quire.plans import inputs
from quire.plans.inputs import sql


def strings(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def loud(c: str) -> str:
    upper, letters = rf"len(regexp_extract_all({c}, '[\p{{Lu}}\p{{Lt}}]'))", rf"len(regexp_extract_all({c}, '[\p{{Lu}}\p{{Lt}}\p{{Ll}}\p{{Lo}}]'))"
    return f"({upper} > greatest(0.75 * {letters}, {letters} - 4) AND {upper} > greatest(3, length({c}) / 3))"


RUN_IN = rf""", s0 AS (SELECT *, max(line) OVER b + 1 AS lines, sum(length(text)) FILTER (WHERE bold AND line = 0) OVER b / sum(length(text)) FILTER (WHERE line = 0) OVER b AS bold_first, coalesce(sum(length(text)) FILTER (WHERE italic) OVER b, 0) / sum(length(text)) OVER b AS italics,
    first_value(font) OVER o AS font0, last_value(font) OVER o AS font9, min(ix) OVER (PARTITION BY doc_id, block, line) = ix AS begins FROM run_in_spans WINDOW b AS (PARTITION BY doc_id, block), o AS (PARTITION BY doc_id, block ORDER BY line, ix ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  s1 AS (SELECT *, coalesce(bold_first > 0 AND bold_first < 1, false) AS partly, count(*) FILTER (WHERE line > 0 AND begins AND font = font0) OVER (PARTITION BY doc_id, block) AS others FROM s0 WHERE lines >= 2),
  s2 AS (SELECT *, bool_and(CASE WHEN partly THEN line = 0 AND bold ELSE font9 <> font0 AND others <= lines / 4 AND font = font0 AND line <= 1 END) OVER (PARTITION BY doc_id, block ORDER BY line, ix) AS leads FROM s1),
  g AS (SELECT doc_id, block, string_agg(text, '' ORDER BY line, ix) FILTER (WHERE leads) AS head, string_agg(text, '' ORDER BY line, ix) FILTER (WHERE NOT leads) AS rest, arg_min(bold, line * 10 + ix) AS bold, arg_min(italic, line * 10 + ix) AS italic, arg_min(size, line * 10 + ix) AS first_size, arg_min(italic, line * 10 + ix) FILTER (WHERE NOT leads) AS next_italic, arg_min(line, line * 10 + ix) FILTER (WHERE NOT leads) AS next_line, max(line) FILTER (WHERE leads) AS head_line,
    max(italics) AS italics, sum(size * length(text)) / sum(length(text)) AS size, sum(size * length(text)) FILTER (WHERE line = 0) / sum(length(text)) FILTER (WHERE line = 0) AS line_size, bool_or(partly) AS partly, max("right") FILTER (WHERE line = 0) AS right0, max("right") FILTER (WHERE line = 1) AS right1, max(top) FILTER (WHERE line = 0) AS top0, min(bottom) FILTER (WHERE line = 0) AS bottom0, max(top) FILTER (WHERE line = 1) AS top1,
    coalesce(string_agg(text, '' ORDER BY ix) FILTER (WHERE line = 0), '') AS text0, coalesce(string_agg(text, '' ORDER BY ix) FILTER (WHERE line = 1), '') AS text1 FROM s2 GROUP BY doc_id, block HAVING count(*) FILTER (WHERE leads) > 0 AND count(*) FILTER (WHERE NOT leads) > 0),
  g1 AS (SELECT * EXCLUDE (head, rest), head || w AS head, substr(rest, length(w) + 1) AS rest FROM (SELECT *, CASE WHEN next_line = head_line AND regexp_matches(head, '[\p{{L}}\p{{N}}]$') THEN regexp_extract(rest, '^[\p{{L}}\p{{M}}\p{{N}}]+') ELSE '' END AS w FROM g)),
  g2 AS (SELECT *, doc_id % 5 <> 1 AS body, CASE WHEN block > 0 THEN 701.0 + block % 4 END AS above_bottom, CASE WHEN block > 0 THEN 300.0 + block % 3 * 100 END AS above_right, CASE WHEN block > 0 THEN block % 2 = 0 END AS above_word, regexp_extract_all(head, '[\p{{L}}\p{{M}}]+') AS words, head || rest AS joined, (right0 - 50) / greatest(1, length(text0)) AS width,
    nullif(regexp_extract(trim(head), '^\s*([1-9][0-9]?(?:\.[1-9][0-9]?){{0,3}})[.)]?(?:\s|$)', 1), '') AS numbering FROM g1 WHERE trim(rest) <> ''),
  g3 AS (SELECT *, len(list_filter(words, lambda x: length(x) > 1 OR (NOT partly AND regexp_matches(x, '\p{{Lo}}')))) AS letters, CASE WHEN numbering IS NULL THEN trim(head) ELSE trim(regexp_replace(trim(head), '^\s*[0-9.]+[.)]?\s+', '')) END AS title FROM g2),
  g4 AS (SELECT *, {norm('head')} AS key, regexp_extract_all(title, '[\p{{L}}\p{{M}}]+') AS tw, line_size >= 8 AND regexp_matches(head, '{runin.ENDS}') AS marked,
    NOT {loud('joined')} AND body AND len(regexp_extract_all(joined, '\p{{L}}')) + 0.5 * len(regexp_extract_all(joined, '\P{{L}}')) >= 100 AND {loud('head')} AND len(regexp_extract_all(head, '\p{{Lu}}')) <= len(regexp_extract_all(joined, '\p{{Ll}}')) AS caps,
    italic AND NOT next_italic AND (coalesce(above_bottom - top0, 'infinity'::DOUBLE) > 1.1 * (bottom0 - top1) OR coalesce(above_word, false) OR coalesce(above_right < right0 - 8 * width, false)) AND (right0 > right1 - 4 * width OR NOT regexp_matches(text0, '[.?!]\s*$') OR regexp_matches(text1, '^\s*\p{{Ll}}')) AND regexp_matches(head, '^[^\p{{L}}]*\p{{Lu}}') AND regexp_matches(rest, '^\s*\p{{Lu}}') AS slanted
    FROM g3 WHERE letters > 0 AND NOT (NOT bold AND NOT italic AND italics > 0.5) AND NOT (NOT bold AND first_size < size + 1 AND regexp_matches(rest, '^\s*\p{{Ll}}')) AND NOT regexp_matches(head, '{runin.KEYWORDS}')),
  g5 AS (SELECT *, CASE WHEN contains(numbering, '.') THEN 1 WHEN numbering IS NOT NULL AND ({norm('title')} IN {strings(classify.INTRODUCTION)} OR (len(list_filter(tw, lambda x: regexp_matches(x, '^\p{{Lu}}'))) > greatest(2, len(list_filter(tw, lambda x: regexp_matches(x, '^\p{{Ll}}')))) AND len(list_filter(tw, lambda x: regexp_matches(x, '^\p{{Ll}}\P{{Lu}}.{{3,}}'))) = 0)) THEN 1
    WHEN len(words) > 2 AND regexp_matches(head, '{runin.CHAPTER}') THEN 8 WHEN key IN {strings(classify.ABSTRACT)} THEN 5 WHEN key IN {strings(classify.INTRODUCTION)} THEN 11 WHEN marked AND caps THEN CASE WHEN numbering IS NOT NULL THEN 1 WHEN key IN {strings(runin.SECTIONS)} THEN 6 ELSE 0 END WHEN marked AND slanted AND (key IN {strings(runin.SECTIONS)} OR letters > 1) THEN CASE WHEN key IN {strings(runin.SECTIONS)} THEN 6 ELSE 0 END END AS kind FROM g4)
  SELECT doc_id, block, kind, numbering, CASE WHEN kind = 8 THEN regexp_replace(title, '[.:;,\s]+$', '') ELSE title END AS title, md5(trim(rest)) AS digest FROM g5 WHERE kind IS NOT NULL"""


def run_in_headings(spark, d):
    out = runin.run_in_headings(inputs.run_in_spans(spark, d), inputs.run_in_blocks(spark, d))
    return out.select("doc_id", "block", "kind", "numbering", "title", F.md5("rest").alias("digest"))


def keyword_clique_members(spark, d):
    return cliques.keyword_cliques(inputs.set_candidates(spark, d))


#: Labels that lines are given in turn, and what SQL says of each: kind, numbers.
LABELS = {"Chapter 3 ": (8, [3]), "第十二章 ": (8, [12]), "Appendix B: ": (10, [2]), "附录3 ": (10, [3]), "Box 4 ": (12, [4]), "Kasten 0 ": None, "XIV. ": (2, [14]), "二、": (3, [2]), "c) ": (4, [3]), "D.7 ": (4, [4, 7]), "D.70 ": None, "plain ": None}


def labelled_headings(spark, d):
    """Every line of every document behind a label."""
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), ((F.col("doc_id") + F.col("ln")) % len(LABELS) + 1).cast("int"))
    found = inputs.lines(spark, d).select("doc_id", "ln", classify.heading_label(F.concat(label, "text")).alias("h")).where("h is not null")
    return found.select("doc_id", "ln", "h.kind", F.array_join(F.col("h.numbers").cast("array<string>"), ".").alias("numbers"), F.md5("h.title").alias("digest"))


def label_case(i: int) -> str:
    return "CASE (doc_id + ln) % " + str(len(LABELS)) + "".join(f" WHEN {n} THEN {v[0] if i == 0 else repr('.'.join(map(str, v[1])))}" for n, v in enumerate(LABELS.values()) if v) + " END"


LABELLED = rf""", told AS (SELECT doc_id, ln, regexp_replace(text, '^\s+', '') AS title, text, {label_case(0)} AS kind, {label_case(1)} AS numbers FROM lines)
  SELECT doc_id, ln, kind, numbers, md5(title) AS digest FROM told WHERE kind IS NOT NULL AND (kind NOT IN (2, 3, 4) OR title <> '')"""

def made_outline(spark, d):
    """The tree of valid bookmarks as an outline, every other heading at its page's top."""
    n = inputs.doc_pages(spark, d)
    o = outline.tree(outline.valid_bookmarks(inputs.bookmarks(spark, d), n, 3).drop("n_pages"), n, deepest=3)
    kind = F.element_at(F.array(*[F.lit(x) for x in (0, 1, 8, 9)]), (F.col("ord") % 4 + 1).cast("int"))
    return o.select("doc_id", "ord", "parent_ord", "level", "title", F.col("start_page").alias("page"), ((F.col("ord") % 10) / 10).alias("y_frac"), kind.alias("kind"), F.col("parent_ord").isNull().alias("prominent"), (F.col("ord") % 2 == 0).alias("at_top"))


MADE = """, made AS (SELECT doc_id, ord, parent_ord, level, title, start_page AS page, (ord % 10) / 10.0::DOUBLE AS y_frac, [0, 1, 8, 9][ord % 4 + 1] AS kind, parent_ord IS NULL AS prominent, ord % 2 = 0 AS at_top FROM nodes)"""


def outline_sections(spark, d):
    return assembly.sections(made_outline(spark, d), inputs.doc_pages(spark, d))


SECTIONS = MADE + """, e AS (SELECT m.*, greatest(page, coalesce(lead(CASE WHEN at_top THEN page - 1 ELSE page END) OVER (PARTITION BY m.doc_id ORDER BY ord), n_pages)) AS "end", row_number() OVER (PARTITION BY m.doc_id ORDER BY ord) - 1 AS n FROM made m JOIN doc_pages USING (doc_id)),
  up AS (SELECT doc_id, ord, ord AS anc FROM e UNION ALL SELECT u.doc_id, u.ord, e.parent_ord FROM up u JOIN e ON e.doc_id = u.doc_id AND e.ord = u.anc WHERE e.parent_ord IS NOT NULL)
  SELECT e.doc_id, e.ord, e.parent_ord, e.level, printf('%04d', e.n) AS node_id, trim(e.title) AS title, e.page AS start_page, (SELECT max(k."end") FROM up u JOIN e k ON k.doc_id = u.doc_id AND k.ord = u.ord WHERE u.doc_id = e.doc_id AND u.anc = e.ord)::INT AS end_page FROM e"""


def outline_gates(spark, d):
    return assembly.gates(made_outline(spark, d), inputs.doc_pages(spark, d)).withColumn("longest_gap", F.round("longest_gap", 6))


GATES = MADE + """, g AS (SELECT *, page + y_frac - lag(page + y_frac, 1, 0) OVER (PARTITION BY doc_id ORDER BY ord) AS gap FROM made),
  t AS (SELECT doc_id, count(*) AS tops, coalesce(max(d), 0) AS widest FROM (SELECT doc_id, page - lag(page) OVER (PARTITION BY doc_id ORDER BY ord) AS d FROM made WHERE prominent) GROUP BY doc_id),
  c AS (SELECT doc_id, count(*) AS chapters, max(page) - min(page) AS reach, coalesce(max(d), 0) AS longest FROM (SELECT *, lead(page) OVER (PARTITION BY doc_id ORDER BY ord) - page AS d FROM made WHERE kind IN (8, 9, 10)) GROUP BY doc_id),
  a AS (SELECT doc_id, n_pages, max(gap) AS longest_gap, coalesce(any_value(tops), 0) AS tops, coalesce(any_value(widest), 0) AS widest, coalesce(any_value(chapters), 0) AS chapters, coalesce(any_value(reach), 0) AS reach, coalesce(any_value(longest), 0) AS longest FROM g JOIN doc_pages USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY doc_id, n_pages),
  v AS (SELECT *, tops >= 3 AND (widest <= n_pages / 2 OR tops >= 5) AS valid, chapters >= 3 AND reach >= 0.7 * n_pages AND longest < 100 AS chaptered FROM a)
  SELECT doc_id, tops, widest, valid, chapters, chaptered, round(longest_gap, 6) AS longest_gap, NOT (valid AND NOT chaptered) AND longest_gap <= 0.85 * n_pages AS kept FROM v"""

TREE = ("bookmarks", "doc_pages", "valid", "nodes")
QUERIES = {"outline_sections": outline_sections, "outline_gates": outline_gates, "labelled_headings": labelled_headings, "run_in_headings": run_in_headings, "keyword_clique_members": keyword_clique_members}
ORACLES = {"outline_sections": sql(SECTIONS, *TREE), "outline_gates": sql(GATES, *TREE), "labelled_headings": sql(LABELLED, "lines"), "run_in_headings": sql(RUN_IN, "run_in_spans")}
