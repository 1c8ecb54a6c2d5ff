"""Queries of the engine's own operators over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import pages as P
from quire.functions import rects as R
from quire.functions import scalars as S
from quire.functions import text as T
from quire.operators import assembly, blocks, bookmarks, classify, evaluate, layout, lines, merging, optimizer, outline, retrieval, screening, stats, store, summaries, trees, triage
from quire.plans import inputs
from quire.plans.inputs import sql, table

QUERIES, ORACLES = {}, {}


def query(oracle=None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def nodes_of(spark, d):
    """The tree of valid bookmarks."""
    n = inputs.doc_pages(spark, d)
    return outline.tree(outline.valid_bookmarks(inputs.bookmarks(spark, d), n, 3), n, deepest=3)


def wanted_of(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 22 + 1).cast("int").alias("page"))


WANTED = ", wanted AS (SELECT o_orderkey AS doc_id, (o_custkey % 22 + 1)::INT AS page FROM orders)"

# Text functions


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents")
def normalized_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalized(F.col("text"))).alias("digest"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END END::INT AS n FROM (SELECT doc_id, text, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]') AS l FROM documents)")
def split_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.split_lines(F.col("text"))).alias("n"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\p{Nd}')) AS number, len(regexp_extract_all(text, '[\p{Lu}\p{Lt}]')) AS upper, len(regexp_extract_all(text, '\p{Ll}')) AS lower,
  len(regexp_extract_all(text, '\p{Lo}')) AS letter, len(regexp_extract_all(text, '\p{M}')) AS mark, len(regexp_extract_all(text, '\p{Sm}')) AS math, len(regexp_extract_all(text, '[ \t-\r]')) AS space,
  len(regexp_extract_all(text, '\p{Pd}')) AS dash, len(regexp_extract_all(text, '[.!?]')) AS sentence, length(text) AS total FROM documents""")
def char_stats(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.char_stats(F.col("text")).alias("s"))
    return s.select("doc_id", *[F.col(f"s.{k}").cast("long").alias(k) for k in ("number", "upper", "lower", "letter", "mark", "sentence", "dash", "math", "space", "total")])


@query("SELECT source, " + ", ".join(f"sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS {k}" for k, p in {"number": r"\p{Nd}", "upper": r"[\p{Lu}\p{Lt}]", "lower": r"\p{Ll}", "letter": r"\p{Lo}", "mark": r"\p{M}", "sentence": "[.!?]", "dash": r"\p{Pd}", "math": r"\p{Sm}", "space": r"[ \t-\r]"}.items()) + ", sum(length(text))::BIGINT AS total FROM documents GROUP BY source")
def merged_char_stats(spark, d):
    s = table(spark, d, "documents").select("source", T.char_stats(F.col("text")).alias("s"))
    return stats.merged_char_stats(s, ["source"]).select("source", "number", "upper", "lower", "letter", "mark", "sentence", "dash", "math", "space", "total")


@query(r"SELECT 'latin' AS script, sum(len(regexp_extract_all(text, '\p{L}')))::BIGINT AS n_letters FROM documents")
def script_histogram(spark, d):
    return stats.script_histogram(table(spark, d, "documents"))


@query("SELECT p_partkey, q_partkey, least(levenshtein(a, b), ceil(length(a) / 3.0))::INT AS distance FROM (SELECT p_partkey, p_name AS a, lead(p_partkey) OVER w AS q_partkey, lead(p_name) OVER w AS b FROM part WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey)) WHERE b IS NOT NULL")
def bounded_edit_distance(spark, d):
    w = Window.partitionBy("p_size").orderBy("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.lead("p_partkey").over(w).alias("q_partkey"), F.lead("p_name").over(w).alias("b"))
    return p.where("b is not null").select("p_partkey", "q_partkey", T.bounded_edit_distance(F.col("a"), F.col("b"), F.length("a") / 3.0).cast("int").alias("distance"))


@query()
def similar_names(spark, d):
    """No SQL says longest matching blocks; tested against the standard library."""
    w = Window.partitionBy("p_size").orderBy("p_partkey")
    p = table(spark, d, "part").select("p_partkey", "p_name", F.lead("p_name").over(w).alias("b"))
    return p.where("b is not null").select("p_partkey", F.round(T.similarity("p_name", "b"), 6).alias("ratio"))


@query("SELECT doc_id, md5(strip_accents(lower(text))) AS digest FROM documents")
def texts_without_marks(spark, d):
    """Over the whole table: every language, and documents without one."""
    return table(spark, d, "documents").select("doc_id", F.md5(T.without_marks(F.lower("text"))).alias("digest"))


@query(r"SELECT l_orderkey, l_linenumber, 'chapter#of#' AS template FROM lineitem")
def title_templates(spark, d):
    title = F.concat(F.lit("Chapter "), F.col("l_linenumber").cast("string"), F.lit(" of "), (F.col("l_partkey") % 7).cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.title_template(title).alias("template"))


ROMAN = r"regexp_full_match(w, 'm{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})') AND w NOT IN ('di', 'div', 'li', 'liv', 'mi', 'mix', 'xi')"
WORTH = " + ".join(f"{v} * (length(w) - length(replace(w, '{k}', '')))" for k, v in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items()) + "".join(f" - CASE WHEN contains(w, '{a}') OR contains(w, '{b}') THEN {v} ELSE 0 END" for a, b, v in (("iv", "ix", 2), ("xl", "xc", 20), ("cd", "cm", 200)))
TITLED = rf""", titled AS (SELECT *, array_to_string(list_transform(w0, lambda w: CASE WHEN {ROMAN} THEN '#' ELSE regexp_replace(w, '[0-9]+', '#', 'g') END), '') AS template, array_to_string(list_transform(w0, lambda w: CASE WHEN {ROMAN} THEN ({WORTH})::VARCHAR ELSE w END), '') AS key,
  regexp_full_match(title, '(?i)((page|slide|folie|document\s+page)\s*)?[0-9]+') AS generic FROM (SELECT *, regexp_extract_all(regexp_replace(lower(title), '\$[^$]*\$', '', 'g'), '[\p{{L}}\p{{N}}]+') AS w0 FROM made_bookmarks))"""


@query(sql(TITLED + " SELECT doc_id, ord, template, key, generic FROM titled", "bookmarks", "made_bookmarks"))
def made_title_templates(spark, d):
    """Titles of every kind: counters, roman numerals and words like them, formulas, generic titles."""
    t = F.col("title")
    return inputs.made_bookmarks(spark, d).select("doc_id", "ord", T.title_template(t).alias("template"), T.title_key(t).alias("key"), T.is_generic_title(t).alias("generic"))


@query("""SELECT o_orderkey, list_aggregate(list_sort(list_distinct(list_concat(range(o_custkey % 90 + 1, o_custkey % 90 + 4), [o_orderkey % 50 + 1]))), 'string_agg', ' ') AS pages FROM orders""")
def expanded_page_specs(spark, d):
    o = table(spark, d, "orders")
    first = F.col("o_custkey") % 90 + 1
    spec = F.concat(first.cast("string"), F.lit("-"), (first + 2).cast("string"), F.lit(", "), (F.col("o_orderkey") % 50 + 1).cast("string"))
    return o.select("o_orderkey", F.array_join(P.expanded(spec), " ").alias("pages"))


@query("""SELECT l_orderkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS spec FROM (SELECT l_orderkey, min(p) AS a, max(p) AS b FROM
  (SELECT l_orderkey, p, p - row_number() OVER (PARTITION BY l_orderkey ORDER BY p) AS i FROM (SELECT DISTINCT l_orderkey, l_suppkey % 12 AS p FROM lineitem)) GROUP BY l_orderkey, i) GROUP BY l_orderkey""")
def formatted_page_specs(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(P.formatted(F.collect_set(F.col("l_suppkey") % 12)).alias("spec"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'nonpositive' WHEN o_custkey % 5 = 1 THEN 'invalid' WHEN o_custkey % 5 = 2 THEN 'too_many' WHEN o_custkey % 5 = 3 THEN 'invalid' END AS problem FROM orders""")
def page_spec_problems(spark, d):
    spec = F.element_at(F.array(*[F.lit(x) for x in ("0-3", "7-2", "1-6000, 5001-10001", "1,,2", "1-6000, 1-6000")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", P.page_spec_problem(spec).alias("problem"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS created_at FROM orders")
def created_at(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.created_at(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("created_at"))


@query(r"""SELECT page_id, CASE WHEN length(s) <= 24 THEN s ELSE substr(s, 1, 15) || '_' || substr(md5(url), 1, 8) END AS name FROM (SELECT page_id, url, regexp_replace(trim(url), '[\x00-\x1f<>:"/\\|?*]+', '_', 'g') AS s FROM pages)""")
def file_names(spark, d):
    return table(spark, d, "pages").select("page_id", T.file_name(F.col("url"), 24).alias("name"))


# Lines, columns and statistics


@query("""SELECT text, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents) GROUP BY text HAVING count(*) > 1""")
def recurring_lines(spark, d):
    """Recurring text histogram: exact line texts that occur more than once."""
    return classify.recurring(inputs.lines(spark, d).select("text"))


@query(sql("SELECT doc_id, page, md5(markdown) AS digest FROM page_text", "lines", "page_text"))
def page_texts(spark, d):
    return inputs.page_text(spark, d).select("doc_id", "page", F.md5("markdown").alias("digest"))


@query(sql(""", s AS (SELECT *, lag(skew) OVER w AS ls, lag("top") OVER w AS lt, lag(bottom) OVER w AS lb, lag("right") OVER w AS lr, ("right" - "left") / greatest(length(text), 1) AS cw FROM spans WINDOW w AS (PARTITION BY doc_id, page ORDER BY ix)),
  n AS (SELECT *, CASE WHEN ls = skew AND least(lt, "top") > greatest(lb, bottom) AND abs("left" - lr) <= least(5.0, greatest(0.1, cw)) THEN 0 ELSE 1 END AS new FROM s)
  SELECT doc_id, page, ix, sum(new) OVER (PARTITION BY doc_id, page ORDER BY ix)::BIGINT AS line FROM n""", "spans"))
def initial_lines(spark, d):
    return lines.initial_lines(inputs.spans(spark, d)).select("doc_id", "page", "ix", "line")


@query(sql("""SELECT doc_id, page, prev AS "left", "left" AS "right" FROM (SELECT doc_id, page, "left", max("right") OVER (PARTITION BY doc_id, page ORDER BY "left", "right" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM spans) WHERE "left" - prev >= 20""", "spans"))
def gutters(spark, d):
    return lines.gutters(inputs.spans(spark, d), 20.0)


@query(sql(""", e AS (SELECT doc_id, page, x, sum(a) AS a, sum(b) AS b FROM (SELECT doc_id, page, "left" AS x, 1 AS a, 0 AS b FROM spans UNION ALL SELECT doc_id, page, "right", 0, 1 FROM spans) GROUP BY ALL)
  SELECT doc_id, page, max(n)::BIGINT AS most FROM (SELECT doc_id, page, sum(a - b) OVER (PARTITION BY doc_id, page ORDER BY x) + b AS n FROM e) GROUP BY doc_id, page""", "spans"))
def most_open(spark, d):
    return lines.most_open(inputs.spans(spark, d))


@query("""SELECT doc_id, min(number) AS first, max(number) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ln) AS run FROM
  (SELECT *, CASE WHEN lag(i) OVER (PARTITION BY doc_id ORDER BY ln) = i THEN 0 ELSE 1 END AS new FROM (SELECT o_custkey AS doc_id, o_orderkey AS ln, (o_orderkey // 7) % 9 AS number, (o_orderkey // 7) % 9 - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders))) GROUP BY doc_id, run HAVING count(*) >= 2""")
def line_number_runs(spark, d):
    n = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ln"), (F.floor(F.col("o_orderkey") / 7) % 9).alias("number"))
    return lines.line_number_runs(n, 2)


@query(sql("""SELECT doc_id, page, ix, lag(ix) OVER w AS above, lead(ix) OVER w AS below FROM spans WINDOW w AS (PARTITION BY doc_id, page ORDER BY "top" DESC, "left", ix)""", "spans"))
def nearest_neighbours(spark, d):
    return lines.nearest_neighbours(inputs.spans(spark, d))


@query(sql("""SELECT doc_id, page, ix, (row_number() OVER (PARTITION BY doc_id, page ORDER BY floor("left" / 200), "top" DESC, bottom DESC, "left", "right", ix) - 1)::INT AS reading FROM spans""", "spans"))
def reading_order(spark, d):
    return lines.reading_order(inputs.spans(spark, d).withColumn("column", F.floor(F.col("left") / 200))).select("doc_id", "page", "ix", "reading")


@query(sql(""", o AS (SELECT *, unnest(range(least(19, floor("left" * 20 / 700.0))::INT, least(19, floor("right" * 20 / 700.0))::INT + 1)) AS b FROM spans)
  SELECT doc_id, page, min(gap) AS gap FROM (SELECT doc_id, page, lag(bottom) OVER (PARTITION BY doc_id, page, b ORDER BY "top" DESC, ix) - "top" AS gap FROM o) WHERE gap > 0 GROUP BY doc_id, page""", "spans"))
def overlap_gaps(spark, d):
    return lines.overlap_gaps(inputs.spans(spark, d))


@query(sql(""", v AS (SELECT doc_id, page, size, sum(length(text)) AS w FROM spans GROUP BY ALL),
  r AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, page ORDER BY size) AS run, sum(w) OVER (PARTITION BY doc_id, page) * 0.5::DOUBLE AS target, lead(size) OVER (PARTITION BY doc_id, page ORDER BY size) AS nxt FROM v)
  SELECT doc_id, page, CASE WHEN run = target AND nxt IS NOT NULL THEN (size + nxt) / 2 ELSE size END AS size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY size) AS k FROM r WHERE run >= target) WHERE k = 1""", "spans"))
def weighted_medians(spark, d):
    return stats.weighted_percentile(inputs.spans(spark, d).withColumn("w", F.length("text")), ["doc_id", "page"], "size", "w", 0.5)


PAGE_STATS = """, f AS (SELECT *, length(text) AS chars FROM spans WHERE skew < 1), s AS (SELECT doc_id, page, size, sum(chars) AS w FROM f GROUP BY ALL),
  dom AS (SELECT doc_id, page, size AS dominant_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY w DESC, size) AS k FROM s) WHERE k = 1),
  ps AS (SELECT doc_id, page, count(*) AS n_spans, sum(chars)::BIGINT AS n_chars, sum(size * chars) / sum(chars) AS mean_size, max("top") AS "top", min(bottom) AS bottom FROM f GROUP BY ALL)"""


@query(sql(PAGE_STATS + " SELECT doc_id, page, n_spans, n_chars, round(mean_size, 9) AS mean_size, dominant_size FROM ps JOIN dom USING (doc_id, page)", "spans"))
def page_stats(spark, d):
    return stats.page_stats(inputs.spans(spark, d)).select("doc_id", "page", "n_spans", "n_chars", F.round("mean_size", 9).alias("mean_size"), "dominant_size")


@query(sql(PAGE_STATS + " SELECT doc_id, count(*) AS n_pages, sum(n_chars)::BIGINT AS n_chars, round(sum(mean_size * least(100, n_chars)) / sum(least(100, n_chars)), 6) AS mean_size FROM ps GROUP BY doc_id", "spans"))
def doc_stats(spark, d):
    return stats.doc_stats(stats.page_stats(inputs.spans(spark, d))).select("doc_id", "n_pages", "n_chars", F.round("mean_size", 6).alias("mean_size"))


ROWS = """, y AS (SELECT *, ("top" + bottom) / 2 AS cy, "top" - bottom AS h FROM spans),
  z AS (SELECT *, CASE WHEN lag(cy) OVER w - cy <= 0.5 * greatest(lag(h) OVER w, h) THEN 0 ELSE 1 END AS new FROM y WINDOW w AS (PARTITION BY doc_id, page ORDER BY cy DESC, "left", ix)),
  rowed AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY cy DESC, "left", ix)::BIGINT AS row FROM z)"""


@query(sql(ROWS + " SELECT doc_id, page, ix, row FROM rowed", "spans"))
def page_rows(spark, d):
    return blocks.rows(inputs.spans(spark, d)).select("doc_id", "page", "ix", "row")


@query(sql(ROWS + """, p AS (SELECT *, CASE WHEN "left" - max("right") OVER (PARTITION BY doc_id, page, row ORDER BY "left", ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 2.0 * ("right" - "left") / greatest(length(text), 1) THEN 0 ELSE 1 END AS n2 FROM rowed),
  q AS (SELECT *, sum(n2) OVER (PARTITION BY doc_id, page, row ORDER BY "left", ix)::BIGINT AS part FROM p)
  SELECT doc_id, page, row, part, min("left") AS "left", max("right") AS "right", max("top") AS "top", min(bottom) AS bottom, count(*) AS n, string_agg(text, ' ' ORDER BY "left", ix) AS text FROM q GROUP BY doc_id, page, row, part""", "spans"))
def merged_rows(spark, d):
    return blocks.merged_rows(blocks.rows(inputs.spans(spark, d)))


BLOCKS = """, c AS (SELECT *, floor("left" / 200)::INT AS "column" FROM spans), k AS (SELECT *, CASE WHEN lag(bottom) OVER w - "top" <= 1.5 * ("top" - bottom) AND abs(lag(size) OVER w - size) <= 0.5 AND lag(bold) OVER w = bold THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY doc_id, page, "column" ORDER BY "top" DESC, "left", ix)),
  blocked AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page, "column" ORDER BY "top" DESC, "left", ix)::BIGINT AS block FROM k)"""


def blocked(spark, d):
    return blocks.blocks(inputs.spans(spark, d).withColumn("column", F.floor(F.col("left") / 200).cast("int")))


@query(sql(BLOCKS + ' SELECT doc_id, page, ix, "column", block FROM blocked', "spans"))
def page_blocks(spark, d):
    return blocked(spark, d).select("doc_id", "page", "ix", "column", "block")


@query(sql(BLOCKS + r""", b AS (SELECT doc_id, page, "column", block, min("left") AS "left", max("right") AS "right", max("top") AS "top", min(bottom) AS bottom, count(*) AS n_boxes, sum(length(text))::BIGINT AS n_chars, sum(size * length(text)) / sum(length(text)) AS size, sum(CASE WHEN bold THEN length(text) ELSE 0 END) / sum(length(text)) AS bold_share,
  sum(len(regexp_extract_all(text, '\p{Lu}'))) > 2 * sum(len(regexp_extract_all(text, '\p{Ll}'))) AS caps, max("left") - min("left") AS l, max("right") - min("right") AS r FROM blocked GROUP BY doc_id, page, "column", block)
  SELECT doc_id, page, "column", block, n_boxes, n_chars, caps, CASE WHEN l <= greatest(1.0, ("right" - "left") / 20) AND r <= greatest(1.0, ("right" - "left") / 20) THEN 1 WHEN l <= greatest(1.0, ("right" - "left") / 20) THEN 2 WHEN r <= greatest(1.0, ("right" - "left") / 20) THEN 4 ELSE 5 END AS alignment,
  round(size + CASE WHEN caps THEN 2 ELSE 0 END + CASE WHEN bold_share > 0.5 THEN 1 ELSE 0 END, 6) AS heading_score FROM b""", "spans"))
def block_stats(spark, d):
    return blocks.block_stats(blocked(spark, d)).select("doc_id", "page", "column", "block", "n_boxes", "n_chars", "caps", "alignment", F.round("heading_score", 6).alias("heading_score"))


@query()
def page_columns(spark, d):
    """Cuts that depend on the cuts before; tested on made pages."""
    return blocks.columns(inputs.spans(spark, d))


# Classification and headings


@query(sql(""", e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ln) AS u, row_number() OVER (PARTITION BY doc_id, page ORDER BY ln DESC) AS v FROM lines WHERE length(text) > 0),
  n AS (SELECT *, CASE WHEN u <= 2 THEN 1 ELSE 2 END AS kind, regexp_replace(text, '[0-9]+', '#', 'g') AS key FROM e WHERE u <= 2 OR v <= 2), pg AS (SELECT doc_id, count(DISTINCT page) AS pages FROM lines GROUP BY doc_id),
  o AS (SELECT doc_id, kind, key FROM n JOIN pg USING (doc_id) GROUP BY doc_id, kind, key, pages HAVING count(DISTINCT page) >= greatest(3, ceil(pages * 0.25)))
  SELECT doc_id, page, ln, kind FROM (SELECT *, lag(page) OVER w AS p, lead(page) OVER w AS q FROM n WINDOW w AS (PARTITION BY doc_id, kind, text ORDER BY page, ln)) x
  WHERE page - p BETWEEN 1 AND 3 OR q - page BETWEEN 1 AND 3 OR EXISTS (SELECT 1 FROM o WHERE o.doc_id = x.doc_id AND o.kind = x.kind AND o.key = x.key)""", "lines"))
def heads_and_feet(spark, d):
    return blocks.heads_and_feet(inputs.lines(spark, d))


@query(sql(""", f AS (SELECT doc_id, page, arg_min(text, ln) AS text FROM lines GROUP BY ALL), n AS (SELECT *, lag(page) OVER w AS p, lead(page) OVER w AS q FROM f WINDOW w AS (PARTITION BY doc_id, text ORDER BY page))
  SELECT doc_id, page, text FROM n WHERE page - p <= 3 OR q - page <= 3""", "lines"))
def running_heads(spark, d):
    return classify.running_heads(inputs.lines(spark, d))


@query("""WITH n AS (SELECT DISTINCT o_custkey AS doc_id, (o_orderkey % 40)::INT AS page, (o_orderkey % 11)::INT AS number FROM orders)
  SELECT DISTINCT a.doc_id, a.page, a.number FROM n a JOIN n b ON a.doc_id = b.doc_id AND abs(a.page - b.page) IN (1, 2, 4) AND a.page - b.page = a.number - b.number""")
def adjacent_numbers(spark, d):
    n = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 40).cast("int").alias("page"), (F.col("o_orderkey") % 11).cast("int").alias("number"))
    return classify.adjacent_numbers(n)


@query(sql("SELECT doc_id, text, count(*) AS n FROM spans WHERE skew >= 1 GROUP BY ALL HAVING count(*) >= 2", "spans"))
def watermarks(spark, d):
    return classify.watermarks(inputs.spans(spark, d), 2)


@query(sql(r"""SELECT doc_id, page, sum(CASE WHEN regexp_matches(text, '\S.*?(?:\.\s?){3,}\s*[0-9ivxlcIVXLC]+\s*$') THEN 1 ELSE 0 END)::BIGINT AS leaders,
  bool_or(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) IN ('contents', 'table of contents', 'inhalt', 'sommaire', 'índice')) AS titled FROM lines GROUP BY ALL HAVING leaders >= 5 OR titled""", "lines"))
def contents_pages(spark, d):
    return classify.contents_pages(inputs.lines(spark, d))


LEADERS = """, leaders AS (SELECT l_orderkey AS doc_id, (l_orderkey % 3 + 1)::INT AS page, CASE l_partkey % 6 WHEN 0 THEN 'Introduction ' || repeat('.', (l_suppkey % 5)::INT) || ' ' || l_linenumber WHEN 1 THEN 'Results' || repeat(' .', (l_suppkey % 7)::INT) || ' xiv' WHEN 2 THEN repeat('.', (l_suppkey % 6)::INT) || l_linenumber WHEN 3 THEN 'A.  ' || repeat('. ', (l_suppkey % 6)::INT) || '12  ' WHEN 4 THEN 'Text ... and then no number' ELSE CASE WHEN l_suppkey % 4 = 0 THEN 'Table of Contents' ELSE 'Plain 12' END END AS text FROM lineitem)"""


@query("WITH " + LEADERS[2:] + r""" SELECT doc_id, page, sum(CASE WHEN regexp_matches(text, '\S.*?(?:\.\s?){3,}\s*[0-9ivxlcIVXLC]+\s*$') THEN 1 ELSE 0 END)::BIGINT AS leaders, bool_or(text = 'Table of Contents') AS titled FROM leaders GROUP BY ALL HAVING leaders >= 2 OR titled""")
def made_contents_pages(spark, d):
    """Pages with rows of dot leaders of every form, and contents titles, which the documents have not."""
    n, s = F.col("l_linenumber").cast("string"), F.col("l_suppkey")
    rep = lambda t, k: F.repeat(F.lit(t), (s % k).cast("int"))
    kinds = [F.concat(F.lit("Introduction "), rep(".", 5), F.lit(" "), n), F.concat(F.lit("Results"), rep(" .", 7), F.lit(" xiv")), F.concat(rep(".", 6), n), F.concat(F.lit("A.  "), rep(". ", 6), F.lit("12  ")), F.lit("Text ... and then no number"), F.when(s % 4 == 0, "Table of Contents").otherwise("Plain 12")]
    made = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") % 3 + 1).cast("int").alias("page"), F.element_at(F.array(*kinds), (F.col("l_partkey") % 6 + 1).cast("int")).alias("text"))
    return classify.contents_pages(made, 2)


@query(sql(r"""SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE length(text) >= 40 AND len(string_split_regex(trim(text), '\s+')) >= 6 AND len(regexp_extract_all(text, '\p{L}')) >= 0.6 * length(text)
  AND len(regexp_extract_all(text, '\p{Lu}')) < 0.5 * len(regexp_extract_all(text, '\p{L}')) AND NOT contains(text, '|')) AS body FROM lines GROUP BY doc_id""", "lines"))
def body_lines(spark, d):
    return inputs.lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(classify.is_body(F.col("text")), 1)).alias("body"))


TITLES = r""", t AS (SELECT doc_id, ln, text, CASE WHEN length(text) BETWEEN 8 AND 120 THEN 1.0 ELSE 0.2 END::DOUBLE * (1.0::DOUBLE / (1 + ln)) * CASE WHEN regexp_matches(text, '[.;:]\s*$') THEN 0.5 ELSE 1.0 END::DOUBLE
  * CASE WHEN regexp_matches(text, '^\p{Lu}') THEN 1.0 ELSE 0.6 END::DOUBLE * CASE WHEN contains(text, '|') THEN 0.1 ELSE 1.0 END::DOUBLE AS score FROM lines WHERE page = 1 AND length(text) > 0),
  best AS (SELECT doc_id, ln, score, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ln) AS k FROM t) WHERE k = 1)"""


@query(sql(TITLES + " SELECT doc_id, ln, score FROM best", "lines"))
def titles(spark, d):
    return classify.title_scores(inputs.lines(spark, d))


@query(sql(TITLES + """ SELECT l.doc_id, l.ln FROM lines l JOIN best b ON l.doc_id = b.doc_id AND l.ln > b.ln WHERE (least(length(l.text), length(b.text)) > 20 AND (starts_with(l.text, b.text) OR starts_with(b.text, l.text)))
  OR (abs(length(l.text) - length(b.text)) < 0.2 * least(length(l.text), length(b.text)) AND levenshtein(l.text, b.text) < 0.2 * least(length(l.text), length(b.text)))""", "lines"))
def title_echoes(spark, d):
    ls = inputs.lines(spark, d)
    best = classify.title_scores(ls).join(ls.select("doc_id", "ln", F.col("text").alias("title")), ["doc_id", "ln"]).select("doc_id", F.col("ln").alias("title_ln"), "title")
    return classify.title_echoes(ls, best)


MADE = """, made AS (SELECT l_orderkey AS doc_id, l_linenumber AS ln, (l_linenumber // 3 + 1)::INT AS page, CASE l_partkey % 8 WHEN 0 THEN 'Figure ' || l_linenumber || ': Flow' WHEN 1 THEN 'Table ' || (l_suppkey % 3) || '. Sums' WHEN 2 THEN (l_linenumber % 4 + 1) || '.' || (l_suppkey % 5 + 1) || ' Results of ' || l_shipmode WHEN 3 THEN 'Chapter ' || l_linenumber
  WHEN 4 THEN 'Introduction' WHEN 5 THEN 'IV. Methods' WHEN 6 THEN 'B) Notes' ELSE 'References' END AS text FROM (SELECT *, 'x' AS l_shipmode FROM lineitem))"""


def made_lines(spark, d, *more):
    """Lines of all heading and caption kinds, as the documents have hardly any."""
    li = table(spark, d, "lineitem")
    n, s = F.col("l_linenumber").cast("string"), F.col("l_suppkey")
    kinds = [F.concat(F.lit("Figure "), n, F.lit(": Flow")), F.concat(F.lit("Table "), (s % 3).cast("string"), F.lit(". Sums")), F.concat((F.col("l_linenumber") % 4 + 1).cast("string"), F.lit("."), (s % 5 + 1).cast("string"), F.lit(" Results of x")), F.concat(F.lit("Chapter "), n), F.lit("Introduction"), F.lit("IV. Methods"), F.lit("B) Notes"), F.lit("References")]
    k = F.col("l_partkey") % 8
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ln"), (F.floor(F.col("l_linenumber") / 3) + 1).cast("int").alias("page"), F.element_at(F.array(*kinds), F.when(k.between(0, 6), k + 1).otherwise(8).cast("int")).alias("text"), *more)


@query("WITH " + MADE[2:] + r""" SELECT doc_id, CASE w WHEN 'table' THEN 5 ELSE 4 END AS label, number, min(ln) AS ln FROM (SELECT doc_id, ln, lower(regexp_extract(text, '^(Figure|Table) ([0-9]+)', 1)) AS w, regexp_extract(text, '^(Figure|Table) ([0-9]+)', 2) AS number FROM made) WHERE w <> '' GROUP BY ALL""")
def captions(spark, d):
    return classify.captions(made_lines(spark, d))


HEADS = "WITH " + MADE[2:] + r""", heads AS (SELECT doc_id, page, ln, CASE WHEN text = 'References' THEN 7 WHEN text = 'Introduction' THEN 11 WHEN text LIKE 'Chapter %' THEN 8 WHEN regexp_matches(text, '^[0-9]') THEN 1 WHEN text LIKE 'IV.%' THEN 2 WHEN text LIKE 'B)%' THEN 4 END AS kind,
  nullif(regexp_extract(text, '^([0-9]\.[0-9]) ', 1), '') AS numbering FROM made WHERE text NOT LIKE 'Figure%' AND text NOT LIKE 'Table%')"""


@query(HEADS + " SELECT doc_id, page, ln, kind, numbering FROM heads")
def heading_candidates(spark, d):
    return classify.headings(made_lines(spark, d))


@query(HEADS + " SELECT doc_id, page, ln, kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ln) AS k FROM heads) WHERE k = 1")
def section_openers(spark, d):
    """Line numbers repeat in an order; of lines with one number the first in the table opens, as where the SQL is run by one reader."""
    ties = {"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")}
    found = classify.headings(made_lines(spark, d, *[c.alias(n) for n, c in ties.items()]), tuple(ties))
    return classify.section_openers(found, tuple(ties)).select("doc_id", "page", "ln", "kind")


@query(HEADS + " SELECT doc_id, split_part(numbering, '.', 1) AS parent, count(DISTINCT split_part(numbering, '.', 2)) AS siblings FROM heads WHERE numbering IS NOT NULL GROUP BY ALL")
def sibling_counts(spark, d):
    return classify.sibling_counts(classify.headings(made_lines(spark, d)))


# Outlines and trees


@query(sql("SELECT doc_id, ord, title, level, page FROM valid", "bookmarks", "doc_pages", "valid"))
def valid_bookmarks(spark, d):
    return outline.valid_bookmarks(inputs.bookmarks(spark, d), inputs.doc_pages(spark, d), 3).drop("n_pages")


TIER = "CASE WHEN n < 3 OR 4 * titles <= n THEN 'ignore' WHEN depth >= 2 AND n >= greatest(6, n_pages // 20) THEN 'full' ELSE 'skeleton' END AS tier"


@query(sql(", s AS (SELECT doc_id, count(*) AS n, count(DISTINCT title) AS titles, max(level) AS depth FROM valid GROUP BY doc_id) SELECT doc_id, n, n AS counting, " + TIER + " FROM s JOIN doc_pages USING (doc_id)", "bookmarks", "doc_pages", "valid"))
def bookmark_tiers(spark, d):
    """All titles are "Part n", a content unit with one counter."""
    n = inputs.doc_pages(spark, d)
    return outline.bookmark_tiers(outline.valid_bookmarks(inputs.bookmarks(spark, d), n, 3).drop("n_pages"), n)


@query(sql(TITLED + """, s AS (SELECT doc_id, count(*) AS n, sum(generic::INT) AS generic, count(DISTINCT key) AS titles, max(level) AS depth FROM titled GROUP BY doc_id),
  c AS (SELECT doc_id, template, count(*) AS c, min(ord) AS o FROM titled GROUP BY ALL), t AS (SELECT doc_id, template, c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, o) AS k FROM c) WHERE k = 1)
  SELECT doc_id, n, CASE WHEN contains(template, '#') THEN c ELSE 0 END AS counting, CASE WHEN n < 3 OR 2 * generic >= n OR (contains(template, '#') AND 2 * c >= n AND (length(template) - length(replace(template, '#', '')) >= 2 OR replace(template, '#', '') NOT IN ('chapter', 'part', 'section'))) OR 4 * titles <= n THEN 'ignore'
  WHEN depth >= 2 AND n >= greatest(6, n_pages // 20) THEN 'full' ELSE 'skeleton' END AS tier FROM s JOIN t USING (doc_id) JOIN doc_pages USING (doc_id)""", "bookmarks", "doc_pages", "made_bookmarks"))
def made_bookmark_tiers(spark, d):
    return outline.bookmark_tiers(inputs.made_bookmarks(spark, d), inputs.doc_pages(spark, d))


TREE = ("bookmarks", "doc_pages", "valid", "nodes")


@query(sql("SELECT * FROM nodes", *TREE))
def section_tree(spark, d):
    return nodes_of(spark, d)


@query(sql(WANTED + " SELECT w.doc_id, w.page, max(n.ord) AS ord FROM wanted w LEFT JOIN nodes n ON n.doc_id = w.doc_id AND n.start_page = (SELECT max(x.start_page) FROM nodes x WHERE x.doc_id = w.doc_id AND x.start_page <= w.page) GROUP BY ALL", *TREE))
def pages_placed(spark, d):
    return outline.placed_pages(nodes_of(spark, d), wanted_of(spark, d))


CONTAINING = WANTED + ", held AS (SELECT doc_id, page, ord, end_page - start_page + 1 AS n_pages FROM (SELECT w.*, n.*, row_number() OVER (PARTITION BY w.doc_id, w.page ORDER BY end_page - start_page, level DESC, ord) AS k FROM wanted w JOIN nodes n ON n.doc_id = w.doc_id AND w.page BETWEEN start_page AND end_page) WHERE k = 1)"


@query(sql(CONTAINING + " SELECT doc_id, page, ord, n_pages FROM held", *TREE))
def smallest_containing(spark, d):
    return outline.smallest_containing(nodes_of(spark, d), wanted_of(spark, d))


@query(sql(CONTAINING + " SELECT count(*) AS n, round(avg((n_pages <= 3)::INT), 9) AS within_3, round(avg((n_pages <= 10)::INT), 9) AS within_10, max(n_pages) AS widest, quantile_cont(n_pages, 0.5)::DOUBLE AS p50, quantile_cont(n_pages, 0.9)::DOUBLE AS p90 FROM held", *TREE))
def localizability(spark, d):
    return evaluate.localizability(outline.smallest_containing(nodes_of(spark, d), wanted_of(spark, d))).select("n", F.round("within_3", 9).alias("within_3"), F.round("within_10", 9).alias("within_10"), "widest", "p50", "p90")


@query(sql(", g AS (SELECT doc_id, start_page - lag(start_page) OVER (PARTITION BY doc_id ORDER BY ord) AS gap FROM nodes WHERE parent_ord IS NULL), s AS (SELECT doc_id, count(*) AS tops, coalesce(max(gap), 0) AS widest FROM g GROUP BY doc_id) SELECT doc_id, tops, widest, tops >= 3 AND widest <= greatest(5, n_pages // 2) AS valid FROM s JOIN doc_pages USING (doc_id)", *TREE))
def outline_gates(spark, d):
    return outline.outline_gate(nodes_of(spark, d), inputs.doc_pages(spark, d))


UP = ", up AS (SELECT doc_id, ord, ord AS anc, 0 AS dist FROM nodes UNION ALL SELECT u.doc_id, u.ord, n.parent_ord, dist + 1 FROM up u JOIN nodes n ON n.doc_id = u.doc_id AND n.ord = u.anc WHERE n.parent_ord IS NOT NULL), ends AS (SELECT u.doc_id, u.anc AS ord, max(n.end_page) AS subtree_end FROM up u JOIN nodes n USING (doc_id, ord) GROUP BY ALL), sub AS (SELECT doc_id, ord, subtree_end, subtree_end - start_page + 1 AS pages FROM nodes JOIN ends USING (doc_id, ord))"


@query(sql(UP + " SELECT doc_id, ord, subtree_end, pages FROM sub", *TREE))
def subtree_ends(spark, d):
    return optimizer.node_costs(nodes_of(spark, d)).select("doc_id", "ord", "subtree_end", "pages")


RES = ", res AS (SELECT p.doc_id, p.ord, CASE WHEN count(k.ord) = 0 THEN 0 ELSE (SELECT count(*) FROM unnest(range(p.start_page, p.end_page + 1)) AS r(g) WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.doc_id = p.doc_id AND c.parent_ord = p.ord AND r.g BETWEEN c.start_page AND c.end_page)) END AS residual, count(k.ord) AS kids FROM nodes p LEFT JOIN nodes k ON k.doc_id = p.doc_id AND k.parent_ord = p.ord GROUP BY p.doc_id, p.ord, p.start_page, p.end_page)"


@query(sql(RES + " SELECT doc_id, ord, residual FROM res", *TREE))
def residual_pages(spark, d):
    return optimizer.node_costs(nodes_of(spark, d)).select("doc_id", "ord", "residual")


COST = UP + RES + ", own AS (SELECT doc_id, ord, CASE WHEN kids = 0 THEN pages WHEN residual > 0 THEN 2 + residual END AS own FROM res JOIN sub USING (doc_id, ord)), cost AS (SELECT u.doc_id, u.anc AS ord, max(dist * 2 + own)::BIGINT AS cost FROM up u JOIN own USING (doc_id, ord) WHERE own IS NOT NULL GROUP BY ALL)"


@query(sql(COST + " SELECT doc_id, ord, cost FROM cost", *TREE))
def tree_costs(spark, d):
    return optimizer.node_costs(nodes_of(spark, d), 2).select("doc_id", "ord", "cost")


@query(sql(COST + ", w AS (SELECT doc_id, max(cost) + 2 AS worst FROM cost JOIN nodes USING (doc_id, ord) WHERE parent_ord IS NULL GROUP BY doc_id), dd AS (SELECT doc_id, count(*) AS nodes, max(d) AS depth FROM (SELECT doc_id, ord, max(dist) + 1 AS d FROM up GROUP BY ALL) GROUP BY doc_id), lv AS (SELECT doc_id, count(*) AS leaves, avg(end_page - start_page + 1) AS leaf_pages FROM nodes JOIN res USING (doc_id, ord) WHERE kids = 0 GROUP BY doc_id) SELECT dd.doc_id, dd.nodes, depth, leaves, round(leaf_pages, 6) AS leaf_pages, worst FROM dd JOIN w USING (doc_id) JOIN lv USING (doc_id)", *TREE))
def tree_complexity(spark, d):
    c = optimizer.node_costs(nodes_of(spark, d), 2)
    leaf = F.when(F.col("leaf"), F.col("pages"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"), F.count(leaf).alias("leaves"), F.round(F.avg(leaf), 6).alias("leaf_pages"), (F.max(F.when(F.col("depth") == 1, F.col("cost"))) + 2).alias("worst"))


FRONTIER = ", fr AS (SELECT doc_id, ord, CASE WHEN kids = 0 THEN level ELSE level + 1 END AS depth, CASE WHEN kids = 0 THEN pages ELSE residual END AS pages FROM nodes JOIN res USING (doc_id, ord) JOIN sub USING (doc_id, ord) WHERE kids = 0 OR residual > 0)"


@query(sql(UP + RES + FRONTIER + " SELECT doc_id, ord, depth::BIGINT AS depth, pages::BIGINT AS pages, (depth + pages)::BIGINT AS cost FROM fr", *TREE))
def frontier_nodes(spark, d):
    return optimizer.frontier(nodes_of(spark, d))


@query(sql(UP + RES + FRONTIER + " SELECT doc_id, n_pages, count(*) AS frontier, max(depth + pages)::BIGINT AS worst, round(sum(pages / n_pages * (depth + (pages + 1) / 2)), 9) AS average, round(max(depth + pages) / n_pages, 9) AS normalised, max(depth)::BIGINT AS max_depth, round(avg(depth), 9) AS mean_depth, round(sum(pages / n_pages), 9) AS mass FROM fr JOIN doc_pages USING (doc_id) GROUP BY doc_id, n_pages", *TREE))
def search_complexity(spark, d):
    out = optimizer.search_complexity(nodes_of(spark, d), inputs.doc_pages(spark, d))
    return out.select("doc_id", "n_pages", "frontier", "worst", *[F.round(c, 9).alias(c) for c in ("average", "normalised")], "max_depth", *[F.round(c, 9).alias(c) for c in ("mean_depth", "mass")])


@query(sql(""", leaves AS (SELECT * FROM nodes n WHERE end_page - start_page + 1 > 5 AND NOT EXISTS (SELECT 1 FROM nodes k WHERE k.doc_id = n.doc_id AND k.parent_ord = n.ord)), kids AS (SELECT doc_id, ord, start_page AS a, start_page + (end_page - start_page) // 3 AS b, start_page + (end_page - start_page) // 3 + 1 + ord % 3 AS c, end_page - ord % 2 AS d FROM leaves)
  SELECT doc_id, ord, pages::BIGINT AS pages, cost::BIGINT AS cost, cost < pages AS gained FROM (SELECT doc_id, ord, d - a + 1 + ord % 2 AS pages, 1 + greatest(b - a + 1, d - c + 1, greatest(0, least(c, d + ord % 2 + 1) - b - 1) + CASE WHEN c <= d THEN ord % 2 ELSE 0 END) AS cost FROM kids WHERE c <= d)""", *TREE))
def expand_gains(spark, d):
    """Two children proposed for each leaf of more than five pages, which leave some pages between and behind them."""
    n = nodes_of(spark, d)
    third = F.floor((F.col("end_page") - F.col("start_page")) / 3).cast("int")
    a = n.withColumn("second", F.col("start_page") + third + 1 + F.col("ord") % 3).withColumn("last", F.col("end_page") - F.col("ord") % 2).where("second <= last")
    made = a.select("doc_id", "ord", F.col("start_page"), (F.col("start_page") + third).alias("end_page")).union(a.select("doc_id", "ord", "second", "last"))
    return optimizer.expand_gain(n, made)


@query()
def optimised_trees(spark, d):
    """Rounds of rewriting, which feed one another; tested against a recursive version and by their invariants."""
    return optimizer.optimised(nodes_of(spark, d)).select("doc_id", "ord", "parent_ord", "depth", "node_id", "title", "start_page", "end_page", F.size("key_items").alias("items"), "same_page", "settled")


@query(sql(", leaves AS (SELECT * FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes k WHERE k.doc_id = n.doc_id AND k.parent_ord = n.ord)) SELECT doc_id, min(ord) AS ord, string_agg(title, '; ' ORDER BY ord) AS title, count(*)::INT AS items, start_page, end_page FROM leaves GROUP BY doc_id, parent_ord, start_page, end_page", *TREE))
def same_page_merges(spark, d):
    return trees.same_page_merged(nodes_of(spark, d))


@query()
def merged_trees(spark, d):
    """A bottom-up rewriting, whose choices feed one another; tested against a recursive version."""
    return trees.relabelled(optimizer.merged(nodes_of(spark, d), 2)).select("doc_id", "ord", "parent_ord", "node_id", "start_page", "end_page", F.size("key_items").alias("items"))


# Triage, OCR and tables


TRIAGE = r""", tok AS (SELECT *, list_filter(regexp_extract_all(markdown, '[\p{L}\p{N}](?:[^\x09-\x0D\x{85}\p{Z}]*[\p{L}\p{N}])?'), lambda t: regexp_matches(t, '\p{L}')) AS t, length(regexp_replace(markdown, '[\x09-\x0D\x{85}\p{Z}]+', '', 'g')) AS chars, len(regexp_extract_all(markdown, '\p{L}')) AS letters, len(regexp_extract_all(markdown, '\x{FFFD}')) AS nb FROM PAGES),
  sig AS (SELECT doc_id, page, chars, letters, image_coverage, path_objects, CASE WHEN chars = 0 THEN 0 ELSE nb / chars END AS bad, CASE WHEN len(t) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(t, lambda x: length(x) <= 4 OR (regexp_matches(x, '[0-9]') AND len(regexp_extract_all(x, '\p{L}')) <= 3) OR (length(x) <= 30 AND 10 * len(regexp_extract_all(x, '\p{L}')) >= 7 * length(x) AND regexp_matches(x, '[aeiouyAEIOUY]|[^\x00-\x7F]'))))::DOUBLE / len(t) END AS ratio FROM tok),
  lab AS (SELECT *, CASE WHEN chars < 20 THEN CASE WHEN image_coverage >= 0.3 THEN 'scanned' WHEN path_objects >= 150 THEN 'graphic' ELSE 'text' END WHEN bad > 0.1 OR (letters >= 80 AND ratio < 0.45) THEN 'garbled' WHEN image_coverage >= 0.25 THEN 'mixed' ELSE 'text' END AS label FROM sig)"""
DRAWN = TRIAGE.replace("PAGES", "drawn")


@query(sql(DRAWN + " SELECT doc_id, page, chars, round(ratio, 9) AS ratio, letters, round(bad, 9) AS bad, label FROM lab", "lines", "page_text", "drawn"))
def page_triage(spark, d):
    """Pages of every label: text, scanned, graphic, garbled by bad characters and by words, mixed."""
    return triage.labelled(triage.signals(inputs.drawn_pages(spark, d))).select("doc_id", "page", F.col("chars").cast("long").alias("chars"), F.round("ratio", 9).alias("ratio"), F.col("letters").cast("long").alias("letters"), F.round("bad", 9).alias("bad"), "label")


@query(sql(DRAWN + " SELECT label, CASE label WHEN 'scanned' THEN 'ocr' WHEN 'garbled' THEN 'best' WHEN 'mixed' THEN 'merge' ELSE 'text_layer' END AS route, count(*) AS n_pages FROM lab GROUP BY ALL", "lines", "page_text", "drawn"))
def page_routes(spark, d):
    return triage.routed(triage.labelled(triage.signals(inputs.drawn_pages(spark, d))))


@query(sql(""", b AS (SELECT DISTINCT doc_id, page, greatest(0, least(200, floor("left" / 700 * 200)))::INT AS x0, greatest(0, least(200, ceil("right" / 700 * 200)))::INT AS x1, greatest(0, least(200, floor(bottom / 800 * 200)))::INT AS y0, greatest(0, least(200, ceil("top" / 800 * 200)))::INT AS y1 FROM spans),
  c AS (SELECT DISTINCT doc_id, page, x, unnest(range(y0, y1)) AS y FROM (SELECT *, unnest(range(x0, x1)) AS x FROM b)), n AS (SELECT doc_id, page, count(*) AS n FROM c GROUP BY ALL)
  SELECT doc_id, page, coalesce(n, 0) / 40000.0::DOUBLE AS share FROM (SELECT DISTINCT doc_id, page FROM spans) LEFT JOIN n USING (doc_id, page)""", "spans"))
def page_coverage(spark, d):
    return triage.coverage(inputs.spans(spark, d), 700.0, 800.0)


@query(sql(""", a AS (SELECT * FROM spans WHERE bold), b AS (SELECT * FROM spans WHERE NOT bold), p AS (SELECT a.doc_id, a.page, a.ix, greatest(0, least(a."right", b."right") - greatest(a."left", b."left")) * greatest(0, least(a."top", b."top") - greatest(a.bottom, b.bottom)) AS m,
  (a."right" - a."left") * (a."top" - a.bottom) AS sa, (b."right" - b."left") * (b."top" - b.bottom) AS sb FROM a JOIN b USING (doc_id, page)) SELECT doc_id, page, ix FROM a WHERE (doc_id, page, ix) NOT IN (SELECT (doc_id, page, ix) FROM p WHERE m / (sa + sb - m) > 0.5 OR m > 0.5 * sa)""", "spans"))
def without_overlapping(spark, d):
    s = inputs.spans(spark, d)
    return triage.without_overlapping(s.where("bold"), s.where("not bold")).select("doc_id", "page", "ix")


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<head\b.*?</head>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest, len(regexp_extract_all(html, '(?i)<a\s[^>]*href')) AS links FROM pages""")
def html_texts(spark, d):
    return triage.page_texts_of_html(table(spark, d, "pages")).select("page_id", "title", F.md5("text").alias("digest"), F.col("links").cast("long").alias("links"))


@query("SELECT n_nationkey AS page_id, row_no, CASE WHEN row_no = 0 THEN '| Key | Name |' ELSE '| ' || n_nationkey || ' | ' || n_name || ' |' END AS row FROM nation, (VALUES (0), (1)) t(row_no)")
def html_tables(spark, d):
    """Markdown rows of tables in pages made from nations, as the web pages have no tables."""
    html = F.concat(F.lit("<p>x</p><TABLE border=1><tr><th>Key</th><th> <b>Name</b></th></tr><tr><td>"), F.col("n_nationkey").cast("string"), F.lit("<td>\n"), F.col("n_name"), F.lit("</td></tr></TABLE>"))
    t = triage.html_tables(table(spark, d, "nation").select(F.col("n_nationkey").alias("page_id"), html.alias("html")))
    width = F.max(F.size("cells")).over(Window.partitionBy("page_id", "table_no"))
    return t.withColumn("w", width).select("page_id", "row_no", triage.markdown_rows(F.col("cells"), F.col("w")).alias("row"))


# Store and retrieval


@query(sql("SELECT id, name, created_at, page_num, status, count(*) OVER () AS total FROM records ORDER BY created_at DESC, id LIMIT 25 OFFSET 50", "records"))
def list_documents(spark, d):
    return store.listed(inputs.records(spark, d), 25, 50)


@query(sql("SELECT id, name, created_at, page_num, status, count(*) OVER () AS total, count(*) OVER () > 20 AS has_more, CASE WHEN count(*) OVER () > 20 THEN 20 END AS next_offset FROM records WHERE id IN (SELECT (c_custkey * 4)::VARCHAR FROM customer) ORDER BY created_at DESC, id LIMIT 20", "records"))
def browse_documents(spark, d):
    return store.browsed(inputs.records(spark, d), 20, 0, table(spark, d, "customer").select((F.col("c_custkey") * 4).cast("string").alias("id")))


@query(sql("SELECT name, id, versions FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, id) AS k, count(*) OVER (PARTITION BY name) AS versions FROM records) WHERE k = 1", "records"))
def resolve_documents(spark, d):
    return store.resolved(inputs.records(spark, d))


@query(sql("SELECT id, CASE WHEN n = 0 THEN name ELSE replace(name, '.pdf', '') || '_' || n || '.pdf' END AS name FROM (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY created_at, id) - 1 AS n FROM records)", "records"))
def unique_names(spark, d):
    return store.unique_names(inputs.records(spark, d))


@query(sql("SELECT CASE WHEN page_num <= 5 THEN 'small' WHEN page_num <= 20 THEN 'medium' ELSE 'large' END AS hint, count(*) AS n FROM records GROUP BY hint", "records"))
def size_hints(spark, d):
    return store.size_hints(inputs.records(spark, d))


@query(sql(", f AS (SELECT doc_id, page, n, 3000 - n AS budget, true AS kept FROM (SELECT doc_id, page, length(markdown) AS n FROM page_text) WHERE page = 1 UNION ALL SELECT p.doc_id, p.page, length(p.markdown), CASE WHEN length(p.markdown) <= f.budget THEN f.budget - length(p.markdown) ELSE f.budget END, length(p.markdown) <= f.budget FROM f JOIN page_text p ON p.doc_id = f.doc_id AND p.page = f.page + 1) SELECT doc_id, page FROM f WHERE kept", "lines", "page_text"))
def pages_in_budget(spark, d):
    return store.pages_in_budget(inputs.page_text(spark, d), 3000)


@query(sql(""", z AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i, length('{"title":"' || title || '","node_id":"' || node_id || '","start_page":' || start_page || ',"end_page":' || end_page || '}') AS n FROM nodes),
  f AS (SELECT doc_id, ord, i, n AS used, 1 AS part FROM z WHERE i = 1 UNION ALL SELECT z.doc_id, z.ord, z.i, CASE WHEN f.used + z.n > 150 THEN z.n ELSE f.used + z.n END, CASE WHEN f.used + z.n > 150 THEN f.part + 1 ELSE f.part END FROM f JOIN z ON z.doc_id = f.doc_id AND z.i = f.i + 1) SELECT doc_id, ord, part FROM f""", *TREE))
def structure_parts(spark, d):
    return store.structure_parts(nodes_of(spark, d), 150)


@query(sql(", t AS (SELECT n.doc_id, n.ord, string_agg(p.markdown, chr(10) ORDER BY p.page) AS t FROM nodes n JOIN page_text p ON p.doc_id = n.doc_id AND p.page BETWEEN start_page AND end_page GROUP BY ALL) SELECT doc_id, ord, length(t)::INT AS n_chars, md5(t) AS digest FROM t", *TREE, "lines", "page_text"))
def node_texts(spark, d):
    return store.node_texts(nodes_of(spark, d), inputs.page_text(spark, d))


@query("""WITH r AS (SELECT conv_id, turn, sha256('[{"role":' || to_json(role) || ',"content":' || to_json(text) || '}]') AS key, length(text) AS n FROM conversations), c AS (SELECT key, min(conv_id * 1000 + turn) AS first FROM r GROUP BY key) SELECT conv_id, turn, key, first FROM r JOIN c USING (key)""")
def replayed_messages(spark, d):
    r = table(spark, d, "conversations").select("conv_id", "turn", store.message_key(F.col("role"), F.col("text")).alias("key"))
    return store.replayed(r, r.groupBy("key").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first"))).select("conv_id", "turn", "key", "first")


@query(sql(WANTED + ", r AS (SELECT DISTINCT doc_id, page FROM bookmarks) SELECT w.doc_id, count(*) AS wanted, count(r.page) AS hit FROM (SELECT DISTINCT * FROM wanted) w LEFT JOIN r ON r.doc_id = w.doc_id AND r.page = w.page GROUP BY w.doc_id", "bookmarks"))
def evidence_hits(spark, d):
    return evaluate.evidence_hits(inputs.bookmarks(spark, d), wanted_of(spark, d))


@query(sql(""", u AS (SELECT a.doc_id, a.page, a.ix, least(a."left", b."left") AS "left", greatest(a."right", b."right") AS "right" FROM spans a JOIN spans b ON b.ix = a.ix + 1 AND a.doc_id = b.doc_id AND a.page = b.page) SELECT doc_id, page, ix, "right" - "left" AS width FROM u""", "spans"))
def union_boxes(spark, d):
    w = Window.partitionBy("doc_id", "page").orderBy("ix")
    s = inputs.spans(spark, d)
    box = R.rect(F.col("left"), F.col("right"), F.col("top"), F.col("bottom"))
    b = s.withColumn("b", box).withColumn("n", F.lead("b").over(w)).withColumn("nix", F.lead("ix").over(w)).where("nix = ix + 1").withColumn("u", R.union(F.col("b"), F.col("n")))
    return b.select("doc_id", "page", "ix", (F.col("u.right") - F.col("u.left")).alias("width"))


@query(sql("SELECT doc_id, ord, title, level, page FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, title) AS c FROM bookmarks) WHERE c < 3 AND length(title) <= 100", "bookmarks"))
def pruned_bookmarks(spark, d):
    return bookmarks.pruned(inputs.bookmarks(spark, d))


@query(sql("SELECT DISTINCT n.doc_id, n.ord, k.ord AS b_ord FROM nodes n JOIN bookmarks k ON n.doc_id = k.doc_id AND abs(n.start_page - k.page) <= 1", *TREE))
def same_headings(spark, d):
    """All titles here are alike ("Part n": likeness 0.71 at least), so a page or a neighbouring one makes them the same; likeness itself is tested on made titles."""
    return bookmarks.same_headings(nodes_of(spark, d), inputs.bookmarks(spark, d))


@query(sql(UP + " SELECT doc_id, anc AS ord, max(dist) AS height FROM up GROUP BY ALL", *TREE))
def summary_levels(spark, d):
    return summaries.summary_levels(nodes_of(spark, d), 3)


@query(sql("SELECT doc_id, page - 1 AS ord, 'Page ' || page AS title, page AS start_page, page AS end_page FROM page_text", "lines", "page_text"))
def page_nodes(spark, d):
    return summaries.page_nodes(inputs.page_text(spark, d))


@query(sql(", f AS (SELECT doc_id, min(start_page) AS s FROM nodes GROUP BY doc_id HAVING min(start_page) > 1) SELECT doc_id, ord, title, start_page, end_page FROM nodes UNION ALL SELECT doc_id, -1, 'Preface', 1, s - 1 FROM f", *TREE))
def prefaced_trees(spark, d):
    return summaries.prefaced(nodes_of(spark, d))


@query(r"""SELECT conv_id, turn, coalesce(list_sum(list_transform(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}{1,3}|[^\s\p{L}\p{N}]+'), lambda w: ceil(length(w) / 4))), 0)::INT AS tokens FROM conversations""")
def token_estimates(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", summaries.token_estimate(F.col("text")).alias("tokens"))


@query(sql(", t AS (SELECT doc_id, count(*) AS n, count(DISTINCT title) AS titles, max(level) AS depth FROM valid GROUP BY doc_id), tier AS (SELECT doc_id, CASE WHEN n < 3 OR 4 * titles <= n THEN 'ignore' WHEN depth >= 2 AND n >= greatest(6, n_pages // 20) THEN 'full' ELSE 'skeleton' END AS tier FROM t JOIN doc_pages USING (doc_id)), g AS (SELECT doc_id, count(*) AS tops FROM nodes WHERE parent_ord IS NULL GROUP BY doc_id) SELECT coalesce(tier.doc_id, g.doc_id) AS doc_id, CASE WHEN tier = 'full' THEN 'bookmarks' WHEN tier = 'skeleton' AND coalesce(tops, 0) > 0 THEN 'hybrid' WHEN tier = 'skeleton' THEN 'bookmarks' WHEN coalesce(tops, 0) > 0 THEN 'detected' ELSE 'pages' END AS source FROM tier FULL JOIN g ON tier.doc_id = g.doc_id", *TREE))
def toc_sources(spark, d):
    n = inputs.doc_pages(spark, d)
    tiers = outline.bookmark_tiers(outline.valid_bookmarks(inputs.bookmarks(spark, d), n, 3).drop("n_pages"), n)
    return bookmarks.toc_source(tiers, outline.outline_gate(nodes_of(spark, d), n))


# Outline assembly


SIGNED = ", signed AS (SELECT *, kind || '|' || CASE WHEN len(numbering) > 0 THEN array_to_string(numbering, ',') ELSE replace(lower(title), ' ', '') END AS sig FROM candidates)"


@query(sql(SIGNED + " SELECT doc_id, ord FROM (SELECT *, page - lag(page) OVER (PARTITION BY doc_id, sig ORDER BY ord) AS gap FROM signed) WHERE gap < 20", "candidates"))
def nearby_duplicates(spark, d):
    return assembly.nearby_duplicates(inputs.candidates(spark, d))


@query(sql(SIGNED + " SELECT doc_id, ord, sig, kind || '|' || array_to_string(numbering[:len(numbering) - 1], ',') AS parent FROM signed", "candidates"))
def heading_signatures(spark, d):
    k, n = F.col("kind"), F.col("numbering")
    return inputs.candidates(spark, d).select("doc_id", "ord", S.heading_signature(k, n, F.col("title")).alias("sig"), S.parent_signature(k, n).alias("parent"))


@query(sql("SELECT doc_id, style, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) AS k FROM (SELECT doc_id, style, count(*) AS n, min(ord) AS o FROM candidates WHERE kind IN (5, 6, 7, 11) GROUP BY ALL)) WHERE k = 1 AND n > 1", "candidates"))
def keyword_cliques(spark, d):
    return assembly.keyword_clique(inputs.candidates(spark, d))


@query(sql("SELECT c.doc_id, c.ord, max(x.ord) AS anchor FROM candidates c LEFT JOIN (SELECT doc_id, ord FROM candidates WHERE kind = 8) x ON x.doc_id = c.doc_id AND x.ord <= c.ord GROUP BY ALL", "candidates"))
def partitioned_candidates(spark, d):
    c = inputs.candidates(spark, d)
    return assembly.partitioned(c, c.where("kind = 8")).select("doc_id", "ord", "anchor")


@query(sql("SELECT doc_id, style, count(*) AS n, count(DISTINCT page) AS pages FROM candidates WHERE len(numbering) = 0 GROUP BY ALL HAVING count(*) >= 3", "candidates"))
def recurring_styles(spark, d):
    return assembly.recurring_styles(inputs.candidates(spark, d))


@query()
def detected_outline(spark, d):
    """Each choice depends on those before it; tested on made outlines."""
    return assembly.sections(assembly.assembled(inputs.candidates(spark, d)), inputs.doc_pages(spark, d))


@query()
def detected_gates(spark, d):
    return assembly.gates(assembly.assembled(inputs.candidates(spark, d)), inputs.doc_pages(spark, d))


@query()
def bookmarked_trees(spark, d):
    """Bookmarks merged into detected outlines, both made; placement depends on what was placed before; tested on made trees."""
    return merging.of_outlines(assembly.assembling(inputs.candidates(spark, d)), inputs.made_bookmarks(spark, d), inputs.doc_pages(spark, d))


# Structure retrieval


@query(sql("SELECT doc_id, string_agg(markdown, chr(10) || chr(10) ORDER BY page) AS text FROM page_text GROUP BY doc_id", "lines", "page_text"))
def raw_texts(spark, d):
    return retrieval.page_texts(inputs.page_text(spark, d), "raw")


@query(sql(", t AS (SELECT n.doc_id, n.ord, string_agg(p.markdown, chr(10) ORDER BY p.page) AS t FROM nodes n JOIN page_text p ON p.doc_id = n.doc_id AND p.page BETWEEN start_page AND end_page GROUP BY ALL) SELECT n.doc_id, n.ord, n.title, n.level, n.start_page AS page_index, md5(coalesce(t, '')) AS digest FROM nodes n LEFT JOIN t ON t.doc_id = n.doc_id AND t.ord = n.ord", *TREE, "lines", "page_text"))
def flattened_nodes(spark, d):
    return retrieval.flattened(nodes_of(spark, d), inputs.page_text(spark, d)).select("doc_id", "ord", "title", "level", "page_index", F.md5("text").alias("digest"))


@query()
def structure_chunks(spark, d):
    """Parts of 300 characters; a node too large is split inside; tested against a version by definition."""
    return retrieval.structure_parts(nodes_of(spark, d), 300)


@query()
def reader_trees(spark, d):
    return retrieval.reader_trees(nodes_of(spark, d))


@query(sql("SELECT doc_id, length('[' || string_agg('{\"title\": \"' || title || '\", \"page\": ' || start_page || '}', ', ' ORDER BY ord) || ']') AS n FROM nodes GROUP BY doc_id", *TREE))
def serialized_lengths(spark, d):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", "title", "start_page"))), lambda x: F.struct(x["title"].alias("title"), x["start_page"].alias("page")))
    return nodes_of(spark, d).groupBy("doc_id").agg(F.to_json(rows).alias("j")).select("doc_id", S.serialized_length("j").alias("n"))


# Scalars


NUMBERS = ("", "  42 ", "-7.5e2", "+.5", "5.", "0x1F", "0o17", "0b101", "Infinity", "-Infinity", "１２", "1_000", "abc", "0x", "1e", "--1")
PREFIXES = ("1. Scope", "12) Terms", "IV. Methods", "A. Notes", "a) note", "v. small", "[3] cited", "( 7 ) seven", "3", "3-phase", "3-4", "123. long", "Introduction", "IX", "2: two", "h. last", "j. none")


def picked(spark, d, texts):
    return table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("o_custkey") % len(texts) + 1).cast("int")).alias("t"))


@query("WITH v AS (SELECT unnest([0.0, 42.0, -750.0, 0.5, 5.0, 31.0, 15.0, 5.0, 1e300, -1e300, 12.0, NULL, NULL, NULL, NULL, NULL]::DOUBLE[]) AS x, unnest(range(16)) AS i), w AS (SELECT unnest([NULL, 42, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 1000, NULL, NULL, NULL, NULL]) AS whole, unnest(range(16)) AS i) SELECT o_orderkey, x AS number, whole::BIGINT AS whole FROM orders JOIN v ON o_custkey % 16 = v.i JOIN w USING (i)")
def numbers_of_texts(spark, d):
    """Infinite values are shown as ±1e300, and what is no number as null."""
    x = S.to_number(F.col("t"))
    return picked(spark, d, NUMBERS).select("o_orderkey", F.when(~F.isnan(x), F.greatest(F.lit(-1e300), F.least(F.lit(1e300), x))).alias("number"), S.to_int(F.col("t")).cast("long").alias("whole"))


@query("WITH v AS (SELECT unnest(['1', '12', 'IV', 'A', 'a', 'v', '3', '7', '3', '3', NULL, NULL, NULL, 'IX', '2', 'h', NULL]) AS text, unnest([1, 1, 2, 3, 3, 2, 1, 1, 1, 1, 0, 0, 0, 2, 1, 3, 0]) AS kind, unnest(range(17)) AS i) SELECT o_orderkey, kind, text FROM orders JOIN v ON o_custkey % 17 = i")
def numbering_prefixes(spark, d):
    return picked(spark, d, PREFIXES).select("o_orderkey", S.numbering_prefix(F.col("t")).alias("p")).select("o_orderkey", "p.kind", "p.text")


# Layout


@query()
def page_lines(spark, d):
    """Each join depends on those before it; tested on made pages, and that no span is lost."""
    return layout.page_lines(inputs.spans(spark, d))


@query()
def page_paragraphs(spark, d):
    return layout.page_paragraphs(inputs.spans(spark, d))


# Screening


@query(sql(", n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS n FROM candidates) SELECT doc_id, ord FROM n x WHERE n < 20 AND CASE WHEN kind IN (2, 4) THEN EXISTS (SELECT 1 FROM n y WHERE y.doc_id = x.doc_id AND y.kind = x.kind AND y.ord <= x.ord AND y.numbering[1] = 1) WHEN kind = 1 THEN (SELECT count(*) FROM n y WHERE y.doc_id = x.doc_id AND y.page = x.page AND y.kind = 1 AND len(y.numbering) = 1) < 5 AND NOT ((NOT EXISTS (SELECT 1 FROM n y WHERE y.doc_id = x.doc_id AND y.kind = 1 AND y.page < x.page) AND (SELECT min(y.numbering[1]) FROM n y WHERE y.doc_id = x.doc_id AND y.page = x.page AND y.kind = 1) > 1 AND len(numbering) <= 1) OR numbering[1] > 3 * page) ELSE true END", "candidates"))
def filtered_candidates(spark, d):
    return screening.page_filter(inputs.candidates(spark, d).withColumn("plain", F.lit(True))).select("doc_id", "ord")


@query(sql(", p AS (SELECT doc_id, page, sum(length(markdown))::DOUBLE AS weight FROM page_text GROUP BY ALL), s AS (SELECT doc_id, median(weight) AS m, count(*) AS n FROM p GROUP BY doc_id) SELECT doc_id, page, (page <= 1 AND weight < 0.5 * least(m, 5000.0)) OR (page < 1 + least(15.0, n / 5) AND weight < 0.8 * 0.5 * least(m, 5000.0)) AS cover FROM p JOIN s USING (doc_id)", "lines", "page_text"))
def cover_pages(spark, d):
    weights = inputs.page_text(spark, d).select("doc_id", "page", F.length("markdown").cast("double").alias("weight"), F.lit(False).alias("captions"))
    return screening.cover_pages(weights)


@query(sql(""", n AS (SELECT *, (top - bottom) AS h FROM spans), p AS (SELECT a.doc_id, a.page, a.ix, b.ix AS other, a.bottom - b.top AS gap FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.page = b.page AND a.ix <> b.ix AND floor(b."left" / 5) <= floor(a."right" / 5) AND floor(a."left" / 5) <= floor(b."right" / 5) AND (b.top < a.top OR (b.top = a.top AND (b.bottom < a.bottom OR (b.bottom = a.bottom AND b.ix > a.ix)))) AND b.bold),
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, ix ORDER BY top DESC, bottom DESC, other) AS k FROM (SELECT p.*, s.top, s.bottom FROM p JOIN spans s ON s.doc_id = p.doc_id AND s.page = p.page AND s.ix = p.other)) SELECT doc_id, page, count(*) AS n FROM (SELECT DISTINCT doc_id, page, ix FROM o) GROUP BY ALL""", "spans"))
def blocks_over_body(spark, d):
    """How many spans of a page have a bold one somewhere below that shares an x bucket."""
    s = inputs.spans(spark, d).withColumn("body", F.col("bold"))
    return screening.neighbours(s, 700.0).where("body_below is not null").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))


@query(sql(r", x AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ln, l_partkey % 40 AS v FROM lineitem), y AS (SELECT *, lag(v) OVER (PARTITION BY doc_id ORDER BY ln) AS p FROM x), z AS (SELECT *, max(CASE WHEN v < 1 OR p > v THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) AS stopped FROM y) SELECT doc_id, coalesce(min(v) FILTER (WHERE stopped = 0), 0)::INT AS first, coalesce(max(v) FILTER (WHERE stopped = 0), 0)::INT AS last, count(*) FILTER (WHERE stopped = 0) AS length, max(stopped) = 0 AS increasing FROM z GROUP BY doc_id", "doc_pages"))
def number_columns(spark, d):
    li = inputs.order_lines(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("block"), F.col("n").alias("ln"), (F.col("l_partkey") % 40).cast("string").alias("text"))
    return screening.number_columns(li).select("doc_id", "first", "last", "length", "increasing")


from quire.plans import figure_queries, glyph_queries, gutter_queries, heading_queries, margin_queries, reply_queries, source_queries  # noqa: E402

for more in (figure_queries, glyph_queries, gutter_queries, heading_queries, margin_queries, reply_queries, source_queries):
    QUERIES.update(more.QUERIES)
    ORACLES.update(more.ORACLES)
