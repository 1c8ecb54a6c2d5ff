"""Spelling variant grouping: rolling-hash deletion keys, dealt by radix, sorted, and verified on strings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow, dropped, freed, saved, table

#: Letters of a run; a word has at least LETTERS code points and OCCURRENCES occurrences.
RUN, LETTERS, OCCURRENCES = "[A-Za-z\\u00C0-\\u00FF]+", 6, 5
#: A near word this many times as frequent is a word's form.
TIMES = 5
#: Fixed value: one run in so many, by hash of document and run, loses a letter.
NOISE = 199
#: Keys are dealt to so many ranges by their high bits, which tasks share.
RADIX = 1 << 12
#: Words of more letters travel without their strings, which are joined again to verify pairs.
LONG = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str, text_col: str, noise: int | None) -> DataFrame:
    """word: each letter run of the texts with A-Z in lower case; with noise, a run whose crc32 of `<id>:<run>` noise divides loses the code point at that hash modulo its length."""
    out = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    if noise is None:
        return out.select(F.col("run").alias("word"))
    h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return out.select("run", h.alias("h")).select(F.when(F.col("h") % noise == 0, less).otherwise(F.col("run")).alias("word"))


def deletion_keys(words: list[str]):
    """For every word its own key and that of each deletion, as arrays: number of the word, deleted position (-1 for none), 64-bit key, and whether the position is the last of a run of equal letters.

    A key is the polynomial of the letters modulo 2**64, of odd base: prefix sums of letter * base**position, and the suffix's sum times
    the inverse of the base, give all deletions of all words at once. A last multiplication spreads keys over the high bits.
    """
    import numpy as np

    size = np.array([len(w) for w in words], dtype=np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(len(letters)) - begin[word]
    base = 0x9E3779B97F4A7C15
    inverse = np.uint64(pow(base, -1, 1 << 64))
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(size.max(initial=0)), base, dtype=np.uint64)]), dtype=np.uint64)
    terms = (letters + np.uint64(0x1F3)) * powers[at]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    whole = sums[begin[1:]] - sums[begin[:-1]]
    prefix = sums[:-1] - sums[begin[:-1]][word]
    suffix = (whole[word] - prefix - terms) * inverse
    last = np.ones(len(letters), dtype=bool)
    last[:-1] = (letters[1:] != letters[:-1]) | (word[1:] != word[:-1])
    key = np.concatenate([whole, prefix + suffix])
    key = key ^ (key >> np.uint64(31))
    key = key * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate([np.arange(len(words)), word]), np.concatenate([np.full(len(words), -1), at]), key, np.concatenate([np.ones(len(words), dtype=bool), last])


#: Rows of one table of a task's keys; a key's rows are never cut apart.
FOUND = "word string, n_near long, near_n long, near string"


def met(keys, ats, lasts, words: list[str], ns) -> list[tuple]:
    """(word, near words here, largest n among them, smallest such word) of rows that share keys, sorted by key.

    No pairs are listed. Words that lost a letter at one place and are equal then differ by a replacement there, and by nothing else, so
    a word's near words of this kind are its group less itself. A word equal to what a longer word is without a letter (of a run of equal
    letters the last) is near to it by a deletion. Equal keys of unequal strings are taken apart.
    """
    import numpy as np

    out = []
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    for i in np.flatnonzero(np.diff(cuts) > 1):
        strings: dict = {}
        for r in range(cuts[i], cuts[i + 1]):
            w, at = words[r], int(ats[r])
            strings.setdefault(w if at < 0 else w[:at] + w[at + 1 :], []).append((at, bool(lasts[r]), -int(ns[r]), w))
        for group in strings.values():
            if len(group) < 2:
                continue
            own = [g for g in group if g[0] < 0]
            places: dict = {}
            for g in group:
                if g[0] >= 0:
                    places.setdefault(g[0], []).append(g)
            for same in places.values():
                first, second = (sorted(same, key=lambda g: g[2:]) + [None])[:2]
                if second:
                    for g in same:
                        best = second if g is first else first
                        out.append((g[3], len(same) - 1, -best[2], best[3]))
            longer = [g for g in group if g[0] >= 0 and g[1]]
            if own and longer:
                best = min(longer, key=lambda g: g[2:])
                out.append((own[0][3], len(longer), -best[2], best[3]))
                out.extend((g[3], 1, -own[0][2], own[0][3]) for g in longer)
    return out


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near_n, near: the number of near words of each word that has any, and the most frequent one (ties: the smallest). words: distinct word, n."""

    def keyed(batches):
        import numpy as np

        for b in batches:
            for part in range(0, b.num_rows, 4096):
                c = b.slice(part, 4096)
                number, at, key, last = deletion_keys(c.column(0).to_pylist())
                take = pa.array(number)
                yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(64 - RADIX.bit_length() + 1)).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(last), c.column(0).take(take), c.column(1).take(take)], names=["radix", "key", "at", "last", "word", "n"])

    def compared(batches):
        """Rows come sorted by key; the last key of a batch waits for the next one."""
        import numpy as np

        held = None
        for b in batches_and_end(batches):
            t = b if held is None else held if b is None else pa.concat_batches([held, b])
            if t is None or not t.num_rows:
                continue
            keys = t.column(1).to_numpy()
            cut = t.num_rows if b is None else int(np.searchsorted(keys, keys[-1]))
            held, t = t.slice(cut), t.slice(0, cut)
            rows = met(t.column(1).to_numpy(), t.column(2).to_numpy(), t.column(3).to_numpy(zero_copy_only=False), t.column(4).to_pylist(), t.column(5).to_numpy())
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["word", "n_near", "near_n", "near"])

    keys = arrow(words.where(F.length("word") <= LONG).select("word", "n"), keyed, "radix int, key long, at int, last boolean, word string, n long")
    found = arrow(keys.repartition("radix").sortWithinPartitions("key"), compared, FOUND)
    long = words.where(F.length("word") >= LONG)
    if not long.where(F.length("word") > LONG).isEmpty():
        found = found.unionByName(near_long_words(long))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best")["n"]).alias("near_n"), F.col("best")["word"].alias("near"))


def near_long_words(words: DataFrame) -> DataFrame:
    """The like of near words one of which has more than LONG letters: pairs by keys alone, each verified on its strings."""

    def keyed(batches):
        import numpy as np

        for b in batches:
            for i, w in zip(b.column(0).to_pylist(), b.column(1)):
                key = np.unique(deletion_keys([w.as_py()])[2].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i)), pa.array(key)], names=["id", "key"])

    words = words.select(F.xxhash64("word").alias("id"), "word", "n")
    keys = arrow(words.select("id", "word"), keyed, "id long, key long")
    pairs = keys.join(keys.withColumnRenamed("id", "other"), "key").where("id <> other").select("id", "other").distinct()
    both = pairs.join(words, "id").join(words.select(F.col("id").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n")), "other")
    both = both.where(f"greatest(length(word), length(near)) > {LONG}").select("word", "near", "near_n")

    def verified(batches):
        for b in batches:
            yield b.filter(pa.array([one_edit(x.as_py(), y.as_py()) for x, y in zip(b.column(0), b.column(1))], pa.bool_()))

    return arrow(both, verified, "word string, near string, near_n long").select("word", F.lit(1).cast("long").alias("n_near"), "near_n", "near")


def one_edit(a: str, b: str) -> bool:
    """Whether two strings differ by one inserted, deleted or replaced letter: what follows their common beginning, found by halving, is compared."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return a != b and (a[low + 1 :] == b[low + 1 :] or a[low + 1 :] == b[low:] or a[low:] == b[low + 1 :])


def batches_and_end(batches):
    yield from batches
    yield None


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = None, letters: int = LETTERS, least: int = OCCURRENCES) -> DataFrame:
    """word, form, root, n, n_near, form_n for each distinct word of at least `letters` code points and `least` occurrences.

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near word of largest n
    (ties: the smallest) if that is TIMES its own n at least, else null; root is the last of the forms that follow from it.
    Null and empty texts have no words; null ids count as empty ones for the noise, and repeated rows count each time. Other columns
    are not read; an empty table gives no row. Texts and words of any length are taken whole. Occurrences are combined before the
    shuffle, so a frequent word is one row a task; a key holds one word for each letter and place at most, so none is large. A chain
    of forms grows TIMES-fold at each step, so a few doublings reach all roots.
    """
    spark = docs.sparkSession
    words = runs(docs, id_col, text_col, noise).where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    words = saved(words, "words")
    freed(spark)
    out = words.join(near_words(words), "word", "left").withColumn("near_n", F.when(F.col("near_n") >= TIMES * F.col("n"), F.col("near_n")))
    out = saved(out.select("word", F.when(F.col("near_n").isNotNull(), F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("near_n").alias("form_n")), "forms")
    dropped(spark, words)
    to = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # a root's own form is null, so a round that moves nothing is the last
        to = saved(to, "roots")
        further = to.join(to.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        if further.where("next is not null").isEmpty():
            break
        to = further.select("word", F.coalesce("next", "root").alias("root"))
    return out.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"), noise=NOISE)
