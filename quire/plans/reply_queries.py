"""Queries of readers' replies, stored names and weighted percentiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import screening, stats, store, triage
from quire.plans import inputs
from quire.plans.inputs import table


def token_tables(spark, d):
    """Every text as a reply of cell tokens: commas merge cells, full stops leave one empty, lines are rows."""
    reply = F.concat(F.lit("<fcel>"), F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "\n", "<nl><fcel>"), ", ", "<lcel><fcel>"), r"\. ", "<ecel><ucel>lost<fcel>"))
    told = T.let(triage.table_rows_of_tokens(reply), lambda r: F.struct(F.size(r).alias("n_rows"), F.array_max(F.transform(r, F.size)).alias("widest"), F.md5(triage.table_of_rows(r)).alias("digest")))
    return table(spark, d, "documents").select("doc_id", F.inline(F.array(told)))


TABLES = r"""WITH cells AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: list_transform(string_split('<fcel>' || replace(replace(x, ', ', '<lcel><fcel>'), '. ', '<ecel><ucel>lost<fcel>'), 'cel>'), lambda y: y)), lambda r: len(r) > 1) AS parts FROM documents),
  rows AS (SELECT doc_id, list_transform(parts, lambda r: list_transform(range(2, len(r) + 1), lambda i: CASE WHEN right(r[i - 1], 2) = '<f' THEN trim(regexp_replace(regexp_replace(r[i], '<[felux]$', ''), '[\s\p{Z}]+', ' ', 'g')) ELSE '' END)) AS r FROM cells),
  wide AS (SELECT doc_id, r, list_max(list_transform(r, lambda x: len(x))) AS w FROM rows),
  shown AS (SELECT doc_id, r, w, list_transform(r, lambda x: '| ' || array_to_string(list_concat(list_transform(x, lambda y: replace(y, '|', '\|')), list_transform(range(w - len(x)), lambda z: '')), ' | ') || ' |') AS l FROM wide)
  SELECT doc_id, len(r)::INT AS n_rows, w::INT AS widest, CASE WHEN len(list_filter(flatten(r), lambda x: x <> '')) > 0 THEN md5(array_to_string(list_concat([l[1], '|' || array_to_string(list_transform(range(w), lambda z: ' --- '), '|') || '|'], l[2:]), chr(10))) END AS digest FROM shown"""


def spotted_boxes(spark, d):
    """A spotting reply a document, of its lines and boxes made of their lengths; on every third document boxes come first, on every fifth they are quadrilaterals."""
    loc = lambda n: F.concat(F.lit("<|LOC_"), n.cast("string"), F.lit("|>"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    box = lambda x, i: F.concat(loc(F.length(x) % 1200), loc(i % 90), loc(F.lit(40)), F.when(i % 4 == 3, "").otherwise(loc(i + 9)), F.when((F.col("doc_id") % 5 == 0) & (i % 4 != 3), F.concat(loc(F.lit(7)), loc(F.lit(8)), loc(F.lit(900)), loc(F.lit(11)))).otherwise(""))
    part = F.transform(lines, lambda x, i: F.when(F.col("doc_id") % 3 == 0, F.concat(box(x, i), x)).otherwise(F.concat(x, box(x, i))))
    found = table(spark, d, "documents").select("doc_id", triage.spotted_lines(F.array_join(part, "\n"), F.lit(1000.0), F.lit(2000.0)).alias("s"))
    return found.select("doc_id", F.posexplode("s").alias("line", "b")).select("doc_id", "line", F.md5("b.text").alias("digest"), *[F.round(f"b.{c}", 3).alias(f"box_{c}") for c in ("left", "top", "right", "bottom")])


SPOTTED = r"""WITH l AS (SELECT doc_id, x, i - 1 AS i, length(x) AS n FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents), LATERAL (SELECT unnest(ls) AS x, generate_subscripts(ls, 1) AS i)),
  k AS (SELECT doc_id, i, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x, least(1000, n % 1200) AS a, i % 90 AS b, least(1000, i + 9) AS e, doc_id % 5 = 0 AS quad FROM l WHERE i % 4 <> 3)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS line, md5(x) AS digest, round(CASE WHEN quad THEN least(a, 7) ELSE least(a, 40) END / 1000.0 * 1000, 3)::DOUBLE AS box_left, round(CASE WHEN quad THEN least(b, e, 8) ELSE least(b, e) END / 1000.0 * 2000, 3)::DOUBLE AS box_top,
    round(CASE WHEN quad THEN greatest(a, 900) ELSE greatest(a, 40) END / 1000.0 * 1000, 3)::DOUBLE AS box_right, round(CASE WHEN quad THEN greatest(b, e, 11) ELSE greatest(b, e) END / 1000.0 * 2000, 3)::DOUBLE AS box_bottom FROM k"""


def stored_names(spark, d):
    """Whole first lines as file names, of every length, with and without an extension."""
    name = F.concat(F.split("text", "\n")[0], F.when(F.col("doc_id") % 4 == 0, ".pdf").when(F.col("doc_id") % 4 == 1, " . ").when(F.col("doc_id") % 4 == 2, ".a: b?"). otherwise(""))
    made = T.stored_name(F.when(F.col("doc_id") % 50 == 7, "Con.txt").otherwise(name))
    return table(spark, d, "documents").select("doc_id", made.alias("name"), F.octet_length(made).alias("n_bytes"))


def sql_prefix(c: str, most: str) -> str:
    return f"CASE WHEN strlen({c}) <= {most} THEN {c} ELSE substr({c}, 1, coalesce(list_max(list_filter(range(0, least(length({c}), {most}) + 1), lambda k: strlen(substr({c}, 1, k)) <= {most})), 0)::INT) END"


NAMES = rf"""WITH n0 AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'Con.txt' ELSE string_split(text, chr(10))[1] || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN ' . ' WHEN 2 THEN '.a: b?' ELSE '' END END AS c FROM documents),
  n1 AS (SELECT doc_id, translate(nfc_normalize(regexp_replace(c, '[\x00-\x1f\x7f-\x{{9f}}\x{{2028}}\x{{2029}}]', '_', 'g')), '‘’ʼ“”', '''''''""') AS c FROM n0),
  n2 AS (SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(c, '[\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}} ]+', ' ', 'g')), '[<>:"/\\|?*]', '_', 'g'), '[ .]+$', '') AS c FROM n1),
  n3 AS (SELECT doc_id, CASE WHEN regexp_matches(c, '(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?$') THEN '_' || c WHEN c = '' THEN 'untitled' ELSE c END AS c FROM n2),
  n4 AS (SELECT *, CASE WHEN regexp_matches(c, '(?s)^(.*[^.].*|[^.])\.[^.]*$') THEN substr(c, 1, length(c) - strpos(reverse(c), '.')) ELSE c END AS base FROM n3),
  n5 AS (SELECT *, substr(c, length(base) + 1) AS ext, '_' || substr(md5(c), 1, 8) AS ending FROM n4),
  n6 AS (SELECT *, regexp_replace({sql_prefix('ext', '(171 - greatest(1, strlen(substr(base, 1, 1))))')}, '[ .]+$', '') AS kept FROM n5),
  n7 AS (SELECT *, {sql_prefix('base', '(171 - strlen(kept))')} AS head FROM n6),
  n8 AS (SELECT doc_id, CASE WHEN strlen(c) <= 180 THEN c ELSE CASE WHEN head = '' THEN '_' ELSE head END || ending || kept END AS name FROM n7)
  SELECT doc_id, name, strlen(name)::INT AS n_bytes FROM n8"""


def document_names(spark, d):
    """Records stored beside those of the customers' names; many share a name, and some are called as others would be with a suffix. Tested against one that stores them in turn."""
    r = inputs.records(spark, d)
    name = F.when(F.col("page_num") % 5 == 0, F.regexp_replace("name", r"\.pdf$", "_1.pdf")).when(F.col("page_num") % 7 == 0, F.regexp_replace("name", r"\.pdf$", "_2.pdf")).otherwise(F.col("name"))
    taken = table(spark, d, "customer").select(F.concat(F.lit("file-"), (F.col("c_custkey") % 97).cast("string"), F.lit("_3.pdf")).alias("name"))
    return store.names_to_store(r.select("id", name.alias("name"), "created_at"), taken)


def zero_weight_medians(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("double").alias("q"), ((F.col("l_partkey") % 3) * (F.col("l_orderkey") % 4)).cast("double").alias("w"))
    return stats.weighted_percentile(li, ["l_orderkey"], "q", "w", 0.5)


MEDIANS = """WITH v AS (SELECT l_orderkey, l_quantity::DOUBLE AS q, ((l_partkey % 3) * (l_orderkey % 4))::DOUBLE AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, (l_partkey % 3) * (l_orderkey % 4)) AS i FROM lineitem),
  a AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (PARTITION BY l_orderkey) / 2 AS half, lag(q) OVER (PARTITION BY l_orderkey ORDER BY i) AS p FROM v)
  SELECT l_orderkey, coalesce(arg_min(CASE WHEN before = half AND p IS NOT NULL THEN (p + q) / 2 ELSE q END, i) FILTER (WHERE before = half OR before + w > half), max(q)) AS q FROM a GROUP BY l_orderkey"""

def reader_spans(spark, d):
    """Boxes of pages as a reader's lines in pixels, some without text or turned inside out, back to points."""
    s = inputs.spans(spark, d)
    ok = F.col("ix") % 9 != 0
    lines = s.select("doc_id", "page", "ix", (F.col("left") * 2).alias("x0"), ((792 - F.col("top")) * 2).alias("y0"), F.when(ok, F.col("right") * 2).otherwise(F.col("left")).alias("x1"), ((792 - F.col("bottom")) * 2).alias("y1"), F.when(F.col("ix") % 11 == 0, " ").otherwise(F.concat(F.lit(" "), "text")).alias("text"), (F.col("ix") % 100 / 100).alias("confidence"))
    pages = s.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(1224.0).alias("width_px"), F.lit(1584.0).alias("height_px"))
    out = triage.spans_of_lines(lines, pages)
    return out.select("doc_id", "page", "ix", *[F.round(c, 4).alias(c) for c in ("left", "right", "top", "bottom", "size", "baseline")], "text", "confidence")


READER = inputs.sql("""SELECT doc_id, page, ix, round("left", 4) AS "left", round("right", 4) AS "right", round(top, 4) AS top, round(bottom, 4) AS bottom, round(0.8 * (top - bottom), 4) AS size, round(bottom + 0.2 * (top - bottom), 4) AS baseline, text, ix % 100 / 100 AS confidence
  FROM spans WHERE ix % 9 <> 0 AND ix % 11 <> 0""", "spans")


def wide_blocks(spark, d):
    """Boxes judged by the widths of their page, of their document and of the pages around."""
    s = inputs.spans(spark, d).select("doc_id", "page", "ix", (F.col("right") - F.col("left") + F.col("ix") % 170).alias("width"))
    pages = s.groupBy("doc_id", "page").agg(F.lit(400.0).alias("page_width"), F.median("width").alias("line_width")).withColumn("doc_line_width", F.lit(160.0))
    return screening.too_wide(s, pages)


WIDE = inputs.sql(""", w AS (SELECT doc_id, page, ix, "right" - "left" + ix % 170 AS width FROM spans), p AS (SELECT doc_id, page, median(width) AS m FROM w GROUP BY ALL)
  SELECT doc_id, page, ix, width, width > 140 OR width > 112 OR (SELECT count(*) FROM p WHERE p.doc_id = w.doc_id AND abs(p.page - w.page) <= 1 AND w.width > 0.7 * p.m) >= 2 AS too_wide FROM w""", "spans")

QUERIES = {f.__name__: f for f in (reader_spans, wide_blocks, token_tables, spotted_boxes, stored_names, document_names, zero_weight_medians)}
ORACLES = {"reader_spans": READER, "wide_blocks": WIDE, "token_tables": TABLES, "spotted_boxes": SPOTTED, "stored_names": NAMES, "zero_weight_medians": MEDIANS}
