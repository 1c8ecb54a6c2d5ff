"""Document fingerprints by SpotSigs: chains of content words after common-word anchors (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import saved

#: Common words: anchors start chains, and no common word stands in a chain. Fixed values, by language.
ANCHORS = ("the", "is", "was", "that", "les", "est", "dans", "une", "die", "das", "ist", "und", "los", "es", "una", "con")
COMMON = ANCHORS + ("a", "of", "and", "to", "in", "it", "for", "on", "with", "as", "be", "by", "are", "this", "at", "from", "or", "an", "de", "la", "le", "et", "en", "des", "un", "du", "que", "pour", "par", "avec", "qui", "pas", "sur", "au", "ou", "der", "den", "von", "zu", "sich", "mit", "auf", "für", "im", "nicht", "dem", "ein", "eine", "als", "el", "y", "las", "se", "del", "por", "no", "su", "para", "al", "lo")
#: Content words in a chain.
CHAIN = 2
#: A pair whose set sizes keep its likeness below this is 0 without being compared.
LEAST = 0.02
#: Documents of a block in which ids are put in order, about.
BLOCK_ROWS = 50_000


def signatures(text):
    """Sorted distinct signatures of a text, 64-bit hashes.

    A signature is the hash of an anchor and the CHAIN content words that follow it, common words left out. Anchors are the words
    ANCHORS and the starts of text, line and sentence, so texts without any common word have chains too. A text with less than
    CHAIN content words after each anchor has one signature, of its words (or, without words, of itself); an empty text has none.
    So equal texts have equal signatures, and an edit changes only the signatures around it. The whole text is read, however long.
    """
    anchors, others = "|".join(ANCHORS) + "|\x02", "|".join(w for w in COMMON if w not in ANCHORS)
    chain = F.lit(rf"(?<= )(?=(\x01[^ ]++ {'(?:\x01[^ ]++ )*+[^ ]++ ' * CHAIN}))")
    none = F.expr("cast(array() as array<string>)")

    def of(words):
        whole = F.when(text == "", none).otherwise(F.array(F.concat(F.lit("="), F.when(F.trim(F.translate(words, "\x02", "")) == "", text).otherwise(words))))
        # Other common words go, and anchors get a mark, so that chains are found and cleared of anchors by plain patterns.
        marked = F.regexp_replace(F.regexp_replace(words, rf"(?<= )(?:(?:{others}) )++", ""), rf"(?<= )(?=(?:{anchors}) )", "\x01")
        return let(F.regexp_extract_all(marked, chain, F.lit(1)), lambda c: F.when(F.size(c) > 0, c).otherwise(whole))

    # Characters beyond ASCII count as letters; what ends a sentence or line becomes an anchor.
    plain = F.regexp_replace(F.translate(F.lower(text), ".!?\n", "\x02\x02\x02\x02"), r"[^a-z0-9\x02\x{80}-\x{10ffff}]+", " ")
    words = F.regexp_replace(F.concat(F.lit("\x02"), F.rtrim(plain), F.lit(" ")), r" *\x02[\x02 ]*", " \x02 ")
    return F.array_sort(F.array_distinct(F.transform(let(words, of), lambda c: F.xxhash64(F.regexp_replace(c, r"(?<= )\x01[^ ]++ ", "")))))


def let(value, body):
    """body of the value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def length_part(n, least: float):
    """Partition of a set by its length: sets that can be alike by `least` lie in one partition or in neighbouring ones."""
    return F.when(n == 0, -2).otherwise(F.floor(F.log(n.cast("double")) / math.log(1 / least) + 1e-9).cast("int"))


def likeness(a, b, least: float = LEAST):
    """Jaccard likeness of two signature sets; 1 for two empty ones.

    0, without comparing them, where their length partitions, and inside those their lengths, keep it below `least`; exact elsewhere.
    """
    n, m = F.size(a), F.size(b)
    far = (F.abs(length_part(n, least) - length_part(m, least)) > 1) | (F.least(n, m) < F.lit(least) * F.greatest(n, m))
    both = F.size(F.array_intersect(a, b))
    return F.when((n == 0) & (m == 0), 1.0).when(far, 0.0).otherwise(let(both, lambda k: k / (n + m - k)))


def following(ids: DataFrame) -> DataFrame:
    """key, next for each distinct key of ids (one column of type long): the next key in ascending order, null last; after the last, the first.

    Keys are dealt into blocks by range, put in order inside their block, and the blocks are linked by their first keys (one row a block).
    """
    some = ids.where("key is not null").distinct()
    n, null = some.count(), not ids.where("key is null").isEmpty()
    blocked = saved(some.repartitionByRange(max(16, n // BLOCK_ROWS), "key").withColumn("block", F.spark_partition_id()), "blocks")
    firsts = blocked.groupBy("block").agg(F.min("key").alias("first"))
    last = F.lit(None).cast("long") if null else F.min("first").over(Window.partitionBy())
    firsts = firsts.withColumn("after", F.coalesce(F.lead("first").over(Window.orderBy("block")), last))
    inside = blocked.withColumn("next", F.lead("key").over(Window.partitionBy("block").orderBy("key")))
    out = inside.join(F.broadcast(firsts), "block").select("key", F.coalesce("next", "after").alias("next"))
    return out.unionByName(firsts.agg(F.min("first").alias("next")).select(F.lit(None).cast("long").alias("key"), "next")) if null else out


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures for each row of docs.

    A fingerprint is the text's signatures, ascending, 16 hexadecimal digits each. The edited text has its last floor(n_chars / 4)
    code points replaced by the first as many of the next document (or all of it). Documents are in ascending order of id, null last;
    after the last comes the first, which may be the document itself. Of rows with one id, each is followed by that row of the next
    id whose head (the code points needed) is smallest, then whose signatures are. Texts of any length are read whole. A null text
    counts as empty. An empty table gives an empty result; other columns are not read.

    A text's signatures are computed once. Texts and signatures are shuffled by id once, an exchange that both joins read; beside
    that only the heads of next documents travel, once. A hot id is split as any skewed join.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sizes = saved(docs.groupBy("key").agg(F.max(F.floor(F.length("text") / 4)).alias("need")), "sizes")
    wanted = following(sizes.select("key")).alias("f").join(sizes.alias("s"), F.col("f.key").eqNullSafe(F.col("s.key")))
    wanted = saved(wanted.select(F.col("f.next").alias("at"), F.col("f.key").alias("before"), "need"), "wanted")
    # An id as two columns that are never null, so that grouping and joining are dealt out alike.
    pair = lambda c, a, b: (F.coalesce(c, F.lit(0).cast("long")).alias(a), F.isnull(c).alias(b))
    signed = docs.select(*pair(F.col("key"), "k", "none"), "text").withColumn("own", signatures(F.col("text")))
    wanted = wanted.select(*pair(F.col("at"), "k", "none"), *pair(F.col("before"), "b", "bnone"), "need")
    heads = signed.join(wanted, ["k", "none"]).select(F.col("b").alias("k"), F.col("bnone").alias("none"), F.struct(F.expr("substring(text, 1, cast(need as int))").alias("head"), F.col("own").alias("next")).alias("h"))
    heads = heads.groupBy("k", "none").agg(F.min("h").alias("h"))
    rows = signed.join(heads, ["k", "none"]).select(F.when(~F.col("none"), F.col("k")).alias("key"), "text", "own", "h", F.length("text").alias("n"))
    quarter = "cast(floor(n / 4) as int)"
    rows = rows.select(F.col("key").alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "own", F.col("h.next").alias("next"), F.expr(f"concat(substring(text, 1, n - {quarter}), substring(h.head, 1, {quarter}))").alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next", signatures(F.col("edited")).alias("theirs"))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")
    return rows.select("doc_id", "n_chars", "edited_sha256", told("own").alias("fingerprint"), told("theirs").alias("edited_fingerprint"), likeness(F.col("own"), F.col("theirs")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"), F.size("own").cast("long").alias("n_signatures"))


def op3(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
