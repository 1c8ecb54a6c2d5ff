"""Queries of captions and their regions; captions have SQL, the regions, which depend on those before, a test against a plain version."""

from __future__ import annotations

from quire.operators import figures
from quire.plans import inputs
from quire.plans.inputs import sql

TEXT = "[" + ", ".join("'" + t.replace("{}", "' || ix % 6 || '") + "'" for t in inputs.CAPTIONED) + f"][ix % 23 % {len(inputs.CAPTIONED)} + 1]"
HEAD = {4: r"^\s*(?:(?i:figure|fig|figura|abbildung|abb)(?:[.．｡。]|\b)|(?:图|図))\s*", 5: r"^\s*(?:(?i:table|tab|tableau|tabelle|tabla)(?:[.．｡。]|\b)|(?:表))\s*", 11: r"^\s*(?:(?i:chart|graph|diagram|diagramm|graphique|gráfico)(?:[.．｡。]|\b))\s*"}
LABELS = f""", blocks AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY "top" DESC, "left", ix) - 1 AS reading, {TEXT} AS text, ix FROM spans),
  heads AS (""" + " UNION ALL ".join(f"SELECT *, {k} AS kind, '{figures.LETTER[k]}' AS letter, regexp_replace(text, '{h}', '') AS after FROM blocks WHERE ix % 23 <> 19 AND regexp_matches(text, '{h}')" for k, h in HEAD.items()) + rf"""),
  found AS (SELECT * FROM (SELECT *, letter || number AS label, ltrim(substr(after, length(number) + 1)) AS rest FROM (SELECT *, regexp_extract(after, '^{figures.NUMBER}(?:[^\p{{L}}\p{{N}}]|$)', 1) AS number FROM heads)) WHERE NOT regexp_matches(rest, '^{figures.REFERENCES}\b')),
  ranked AS (SELECT *, regexp_extract_all(text, '[\p{{L}}\p{{M}}]+') AS w, CASE WHEN regexp_matches(rest, '^[.!?\-–—:]') THEN 2 WHEN regexp_matches(rest, '^\p{{Lu}}') THEN 1 WHEN regexp_matches(rest, '^\p{{Ll}}') THEN -1 ELSE 0 END AS mark, bool_or(length(label) > 1) OVER (PARTITION BY doc_id) AS numbered FROM found),
  loud AS (SELECT *, len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}'))) > greatest(2, len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Ll}}')))) AND len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Ll}}\P{{Lu}}.{{3,}}'))) = 0 AS loud FROM ranked)
  SELECT doc_id, page, reading::INT AS reading, kind, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY loud DESC, mark DESC, page, reading) AS k FROM loud) WHERE NOT numbered OR (length(label) > 1 AND k = 1)"""


def caption_labels(spark, d):
    blocks = inputs.figure_blocks(spark, d)
    return figures.chosen_captions(figures.captions(blocks), blocks)


def figure_regions(spark, d):
    return figures.caption_regions(inputs.figure_blocks(spark, d), inputs.figure_pages(spark, d), inputs.figure_columns(spark, d))


QUERIES = {"caption_labels": caption_labels, "figure_regions": figure_regions}
ORACLES = {"caption_labels": sql(LABELS, "spans")}
