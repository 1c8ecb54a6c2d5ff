"""Secret scans: two character Markov models, of random strings and of ordinary identifiers (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import bounded_sample, fresh, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A shorter run cannot pass, and runs are maximal, so the lengths stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: What the models judge: runs of these characters, of so many at least.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Rows of documents from which ordinary words are taken; random strings and made identifiers of each form.
SAMPLE_ROWS, RANDOM_ROWS, MADE_ROWS = 2000, 3000, 3000
#: A candidate is a secret from this log-likelihood ratio (natural logarithm) on.
THRESHOLD = 15.0
#: Labelled ordinary identifiers, and forms of such with numbers: {h} is a UUID, {d} a digit, {n} a number of one to nine digits, {y} a year, {m} and {e} a month and day, {w} one of WORDS.
IDENTIFIERS = "getUserName setDefaultValue max_connections_per_host default-log-level createConnectionPool isAuthenticated parse_config_file http_request_timeout user-agent-string DatabaseConnectionFactory read_only_replica_count EXPONENTIAL_BACKOFF_LIMIT CONTENT_TYPE_HEADER application/json src/main/resources/config static/images/background node_modules/package-lock index_of_last_element shuffle_partition_count first-name last-name BillingAddressValidator toLowerCaseString num_worker_threads".split()
FORMS = ("{h}", "{h}", "{y}-{m}-{e}T{m}", "{y}/{m}/{e}/{w}/index", "build-{y}{m}{e}-{n}", "src/main/java/com/{w}/v{d}/{w}", "https/{w}/org/{y}/{m}/{e}/{w}", "release-v{d}-rc{d}-{w}", "order_{n}_{w}", "img_{y}{m}{e}_{n}", "{w}{d}_{w}{d}_{w}", "lib{w}-{d}-{d}-{n}-linux-x86_64", "{w}-service-{d}d{d}c-{n}", "MODEL_{n}_REVISION_{d}", "{n}-{n}-{n}", "{w}Utf8ToBase64Encoder{d}")
WORDS = ("example", "service", "report", "customer", "index", "payment", "account", "archive", "system", "project", "library", "network", "monitor", "content", "session", "storage")


def made_identifiers(spark: SparkSession, rows: int = MADE_ROWS, seed: str = "") -> DataFrame:
    """token: ordinary identifiers with numbers in them, of FORMS, filled in from hashes."""
    h = F.sha2(F.concat(F.lit(f"name{seed}"), F.col("id").cast("string")), 256)
    word = lambda at: F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.conv(F.substring(h, at, 1), 16, 10).cast("int") + 1))
    number = lambda at, digits: F.lpad((F.conv(F.substring(h, at, 8), 16, 10).cast("long") % 10**digits).cast("string"), digits, "0")
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    out = F.element_at(F.array(*[F.lit(x) for x in FORMS]), (F.col("id") % len(FORMS) + 1).cast("int"))
    size = F.conv(F.substring(h, 60, 1), 16, 10).cast("int") % 9 + 1
    put = (("{h}", uuid), ("{y}", F.concat(F.lit("20"), number(30, 2))), ("{m}", F.lpad((number(33, 3).cast("int") % 12 + 1).cast("string"), 2, "0")), ("{e}", F.lpad((number(37, 3).cast("int") % 28 + 1).cast("string"), 2, "0")), ("{n}", F.substring(number(41, 9), F.lit(1), size)))
    for mark, value in put:
        out = F.replace(out, F.lit(mark), value)
    for at in (51, 52, 53):  # each mark of a word or digit its own
        out = F.regexp_replace(F.regexp_replace(out, r"^([^{]*)\{w\}", F.concat(F.lit("$1"), word(at))), r"^([^{]*)\{d\}", F.concat(F.lit("$1"), number(at, 1)))
        out = F.regexp_replace(F.regexp_replace(out, r"^([^{]*)\{d\}", F.concat(F.lit("$1"), number(at + 4, 1))), r"^([^{]*)\{w\}", F.concat(F.lit("$1"), word(at + 4)))
    return spark.range(rows).select(out.alias("token"))


def made_secrets(spark: SparkSession, rows: int = RANDOM_ROWS, seed: str = "") -> DataFrame:
    """token: random strings in base 64, hexadecimal, capitals with digits, and with underscores."""
    digest = F.sha2(F.concat(F.lit(f"sample{seed}"), F.col("id").cast("string")), 256)
    base64 = F.rtrim(F.translate(F.base64(F.unhex(digest)), "=", " "))
    return spark.range(rows).select(F.explode(F.array(base64, digest, F.upper(F.regexp_replace(base64, "[+/]", "")), F.regexp_replace(base64, "[+/]", "_"))).alias("token"))


def labelled_samples(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """token, secret, weight: random strings; the words of about SAMPLE_ROWS documents, identifiers, and made identifiers with numbers.

    The made identifiers weigh as much as all words, whose many letters would else say that no digit follows one.
    """
    words = bounded_sample(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", SAMPLE_ROWS)
    words = words.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![^\s])[A-Za-z_-]{3,}(?![^\s.,;])"), F.lit(0))).alias("token"), F.lit("word").alias("kind"))
    names = spark.createDataFrame([(x, "word") for x in IDENTIFIERS for _ in range(50)], "token string, kind string")
    made = made_identifiers(spark).withColumn("kind", F.lit("made"))
    ordinary = words.unionByName(names).unionByName(made).groupBy("token", "kind").agg(F.count(F.lit(1)).alias("n"))
    size = {r["kind"]: r["chars"] for r in ordinary.groupBy("kind").agg(F.sum(F.length("token") * F.col("n")).alias("chars")).collect()}
    more = max(1.0, size.get("word", 0) / max(1, size["made"]))
    ordinary = ordinary.select("token", F.lit(False).alias("secret"), (F.col("n") * F.when(F.col("kind") == "made", F.lit(more)).otherwise(1.0)).alias("weight"))
    return made_secrets(spark).select("token", F.lit(True).alias("secret"), F.lit(1.0).alias("weight")).unionByName(ordinary)


def codes(token):
    return F.transform(F.split(token, ""), lambda c: F.when(c == "", F.lit(-1)).otherwise(F.instr(F.lit(ALPHABET), c)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio (secret against ordinary) of each pair of neighbouring characters, as a table by code of the first and the second.

    Half a count is added to each pair. What is collected is at most a row for each pair of characters and label.
    """
    size = len(ALPHABET) + 1
    c = F.filter(codes(F.col("token")), lambda x: x >= 0)
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.element_at("c", i) * size + F.element_at("c", i + 1))
    counts = samples.where("length(token) > 1").select("secret", "weight", c.alias("c")).where("size(c) > 1").select("secret", "weight", F.explode(pairs).alias("pair")).groupBy("secret", "pair").agg(F.sum("weight").alias("count")).collect()
    table = {label: [0.5] * (size * size) for label in (True, False)}
    for r in counts:
        table[r["secret"]][r["pair"]] += r["count"]
    totals = {k: [sum(v[a * size : (a + 1) * size]) for a in range(size)] for k, v in table.items()}
    return [math.log(table[True][i] / totals[True][i // size]) - math.log(table[False][i] / totals[False][i // size]) for i in range(size * size)]


def ratio(token, model: list[float]):
    """Log-likelihood ratio of a token under the trained models."""
    size, zero = len(ALPHABET) + 1, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    cells = F.array(*[F.lit(x) for x in model])

    def step(acc, x):
        worth = F.when((x < 0) | (acc["last"] < 0), F.lit(0.0)).otherwise(F.element_at(cells, F.greatest(acc["last"], F.lit(0)) * size + F.greatest(x, F.lit(0)) + 1))
        return F.struct(F.when(x < 0, acc["last"]).otherwise(x).alias("last"), (acc["sum"] + worth).alias("sum"))

    return F.aggregate(codes(token), zero, step, lambda acc: acc["sum"])


SPAN = "array<struct<start:bigint,kind:int,end:bigint,token:string>>"


def spans(text, pattern: str, kind: int, may):
    """start, kind, end (code points) and text of the pattern's matches: the matches lie between the pieces that splitting leaves."""
    none = F.expr(f"cast(array() as {SPAN})")
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def step(acc, p):
        at = acc["at"] + F.length(p["gap"])
        end = at + F.coalesce(F.length(p["hit"]), F.lit(0))
        span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["hit"].alias("token"))
        return F.struct(end.alias("at"), F.when(p["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    return F.when(may, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def told(spans):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def apart(runs, base):
    """The runs that overlap no base span. Both are in order of start, so a sweep over all of them needs the furthest end so far and the run that is still open."""
    every = F.array_sort(F.concat(base, runs))
    none = F.expr(f"cast(array() as {SPAN})")
    zero = F.struct(F.lit(-1).cast("long").alias("reach"), none.alias("open"), none.alias("out"))

    def step(acc, s):
        random = s["kind"] == 3
        # Runs do not overlap one another, so a run that is still open is kept by the next, and by a base span that starts behind it.
        kept = F.when((F.size(acc["open"]) > 0) & (random | (s["start"] >= F.element_at(acc["open"], 1)["end"])), acc["open"]).otherwise(none)
        opened = F.when(random & (s["start"] >= acc["reach"]), F.array(s)).otherwise(none)
        return F.struct(F.when(random, acc["reach"]).otherwise(F.greatest(acc["reach"], s["end"])).alias("reach"), opened.alias("open"), F.concat(acc["out"], kept).alias("out"))

    return F.aggregate(every, zero, step, lambda acc: F.concat(acc["out"], acc["open"]))


def find_secrets(docs: DataFrame, model: list[float], text_col: str = "text", names: tuple[str, str] = ("_base", "_added")) -> DataFrame:
    """docs with two more columns, named `names`, arrays of (start, kind, end, token) by start and kind.

    The first: values assigned to telling names, access keys, long hexadecimal runs. The second: other runs of 20 key characters or
    more (of whatever kinds) which the models find likelier random than ordinary by THRESHOLD, not overlapping a base span. A null
    text counts as empty; texts of any length are read whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    named = (text.contains(":") | text.contains("=")) & (low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("key"))
    assign = F.filter(spans(text, ASSIGN, 0, named), lambda s: F.length(F.regexp_extract(s["token"], ASSIGN, 2)) >= 6)
    base = F.array_sort(F.concat(assign, spans(text, ACCESS, 1, text.contains("AKIA")), spans(text, HEX, 2, text.rlike(HEX))))
    runs = F.filter(spans(text, CANDIDATE, 3, text.rlike(CANDIDATE)), lambda s: ratio(s["token"], model) >= THRESHOLD)
    # Added runs are cut by one fold over base spans and runs in order: a run goes if a base span reaches into it from either side.
    docs = docs.withColumns({names[0]: base, "_runs": runs})
    return docs.withColumn(names[1], F.when(F.size("_runs") > 0, apart(F.col("_runs"), F.col(names[0]))).otherwise(F.col("_runs"))).drop("_runs")


def secret_spans(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, for each row of docs.

    Null and repeated ids are rows like others; a null or empty text has no span and the hash of the empty string; an empty table
    gives an empty result; other columns are not read. Rows are taken one by one and nothing is shuffled.
    """
    found = find_secrets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    of = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")  # noqa: E731  (a lambda of two names would get the index as its second)
    count = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return found.select("doc_id", *count, F.sha2(told(F.col("_base")), 256).alias("base_sha256"), told(F.array_sort(F.concat("_base", "_added"))).alias("spans"), F.size("_added").cast("long").alias("n_random"))


def redacted(docs: DataFrame, model: list[float], text_col: str = "text", put: str = "[secret]") -> DataFrame:
    """docs with each secret's characters replaced by `put`; overlapping spans are replaced as one. Other columns stay as they are."""
    names = fresh(docs, "_base"), fresh(docs, "_added")
    found = find_secrets(docs, model, text_col, names)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        kept = F.when(s["start"] >= acc["at"], F.concat(F.expr("''"), F.substring(F.col(text_col), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(put))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], kept).alias("out"))

    clean = F.aggregate(F.array_sort(F.concat(*names)), zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"].cast("int") + 1, F.length(F.col(text_col)))))
    return found.withColumn(text_col, F.when(F.size(names[0]) + F.size(names[1]) > 0, clean).otherwise(F.col(text_col))).drop(*names)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_spans(docs, train(labelled_samples(spark, docs)))
