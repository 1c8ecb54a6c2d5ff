"""Language ID: scripts narrow the candidates, then Viterbi over word scores labels spans of mixed-language text."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quire.llm.common import arrow, bounded_sample, fresh, remainder, shipped, table

#: A run of letters is a word; a longer one than this is cut into successive pieces, each of which is a word.
LONGEST = 40
WORDS = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")
#: Labelled documents the model is fitted on, about; the model's size: words it keeps, the most frequent ones of each language, the least count of one, and trigrams.
SAMPLE_ROWS, MOST_WORDS, LEAST, MOST_LETTERS = 8000, 30_000, 3, 1_000_000
#: What a change of language costs in a text, in nats; weight of the word table against the character model; what a word in a script that a language does not use costs it.
SWITCH, TABLE_WEIGHT, FOREIGN = 12.0, 0.5, 30.0
#: A script counts as one of a language if so much of the language's letters are in it.
SCRIPT_SHARE = 0.001
#: First code points of ranges, and the scripts that start there ("" for none of these).
SCRIPTS = ((0, "latin"), (0x250, ""), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, ""), (0x900, "devanagari"), (0x980, ""), (0xE00, "thai"), (0xE80, ""), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, ""), (0x20000, "han"), (0x30000, ""))


class _Scripts(dict):
    """Script by character; a character is looked up among the ranges once."""

    def __missing__(self, c: str) -> str:
        at = ord(c)
        self[c] = name = next(name for first, name in reversed(SCRIPTS) if at >= first)
        return name


script = _Scripts().__getitem__


def scripts(word: str) -> set[str]:
    return {"latin"} if word.isascii() else set(map(script, word))


def lower(text: str) -> str:
    """Lower case of the same length, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n of columns lang and text; long runs of letters count by their pieces."""

    def run(batches):
        for b in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                found.setdefault(lang, Counter()).update(WORDS.findall(lower(text.as_py() or "")))
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    return arrow(docs.select("lang", F.col("text").cast("string").alias("text")), run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Word scores by language: a table of frequent words mixed with a character trigram model."""

    def __init__(self, counts: list[tuple[str, str, int]], letters: list[tuple[str, str, str, int]]):
        """counts: (lang, word, n) of frequent words. letters: (lang, two characters before, character, n) over all words."""
        import math

        self.langs = sorted({x[0] for x in letters})
        at = {x: i for i, x in enumerate(self.langs)}
        total, self.trigram, context = [1] * len(at), {}, {}
        scripts = [Counter() for _ in at]
        for lang, two, c, n in letters:
            context.setdefault(two, [0] * len(at))[at[lang]] += n
            total[at[lang]] += n if c == "\n" else 0
            if c != "\n":
                scripts[at[lang]][script(c)] += n
        for lang, two, c, n in letters:
            self.trigram.setdefault(two + c, [0] * len(at))[at[lang]] = n
        for gram, ns in self.trigram.items():
            self.trigram[gram] = [math.log((n + 0.1) / (m + 10.0)) for n, m in zip(ns, context[gram[:2]])]
        self.unseen = {two: [math.log(0.1 / (m + 10.0)) for m in ns] for two, ns in context.items()}
        self.nothing = [math.log(0.01)] * len(at)
        self.words: dict[str, list[float]] = {}
        for lang, w, n in counts:
            self.words.setdefault(w, [0.0] * len(at))[at[lang]] = n / total[at[lang]]
        self.allowed = [{s for s, n in c.items() if n >= SCRIPT_SHARE * sum(c.values())} for c in scripts]

    def score(self, word: str) -> list[float]:
        import math

        used = scripts(word)
        fit = [used <= ok for ok in self.allowed]
        if fit.count(True) == 1:  # the script alone tells
            return [0.0 if ok else -FOREIGN for ok in fit]
        sums = [math.log(1 - TABLE_WEIGHT)] * len(self.langs)
        marked = f"\n\n{word}\n"
        for i in range(len(marked) - 2):
            gram = marked[i : i + 3]
            sums = [a + b for a, b in zip(sums, self.trigram.get(gram) or self.unseen.get(gram[:2]) or self.nothing)]
        if seen := self.words.get(word):
            sums = [math.log(math.exp(s) + TABLE_WEIGHT * p) for s, p in zip(sums, seen)]
        if not any(fit):  # letters of several scripts: no language is likelier for them
            return [max(s - max(sums), -FOREIGN) - FOREIGN for s in sums]
        best = max(s for s, ok in zip(sums, fit) if ok)
        return [max(s - best, -FOREIGN) if ok else -FOREIGN for s, ok in zip(sums, fit)]


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from columns doc_id, text and lang (not null); None if no row has a word. It is fitted on about `rows` rows at most."""
    counts = word_counts(bounded_sample(labelled, "doc_id", rows)).cache()
    two = F.concat(F.lit("\n\n"), F.col("word"), F.lit("\n"))
    letters = counts.select("lang", "n", two.alias("w")).select("lang", "n", "w", F.explode(F.sequence(F.lit(1), F.length("w") - 2)).alias("i"))
    letters = letters.groupBy("lang", F.expr("substring(w, i, 2)").alias("two"), F.expr("substring(w, i + 2, 1)").alias("c")).agg(F.sum("n").alias("n"))
    letters = [tuple(r) for r in letters.orderBy(F.desc("n"), "lang", "two", "c").limit(MOST_LETTERS).collect()]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))  # over the words of a bounded sample
    words = [tuple(r) for r in counts.where(F.col("n") >= LEAST).withColumn("k", rank).where(F.col("k") <= MOST_WORDS).select("lang", "word", "n").collect()]
    counts.unpersist()
    return Model(words, letters) if letters else None


def labeller(model: Model | None, most: int = 300_000):
    """A function from a text to (lang, score, spans): spans are (lang, start, end) in code points. It keeps the scores of `most` words at once."""
    import numpy as np

    if model is None:
        return lambda text: ("und", 0.0, [])
    langs, at = model.langs, {}
    rows = np.zeros((1024, len(langs)))

    def row(word: str) -> int:
        nonlocal rows
        if (i := at.get(word)) is None:
            if len(at) == len(rows):
                rows = np.concatenate([rows, np.zeros_like(rows)])
            i = at[word] = len(at)
            rows[i] = model.score(word)
        return i

    def path(scores) -> list[int]:
        """The best labels: a change costs SWITCH."""
        now, back = list(scores[0]), []
        for s in scores[1:].tolist():
            top = max(range(len(now)), key=now.__getitem__)
            best = now[top] - SWITCH
            came = [i if v >= best else top for i, v in enumerate(now)]
            now = [max(v, best) + x for v, x in zip(now, s)]
            back.append(came)
        out = [max(range(len(now)), key=now.__getitem__)]
        for came in reversed(back):
            out.append(came[out[-1]])
        return out[::-1]

    def label(text: str):
        words = WORDS.findall(low := lower(text))
        if not any(c.isalpha() for w in words for c in w):  # other numerals are not letters
            return "und", 0.0, []
        if len(at) > most:
            at.clear()
        scores = rows_of(words)
        sums = scores.sum(0)
        best = int(sums.argmax())
        gains = np.concatenate([np.zeros((1, len(langs))), (scores - scores[:, best : best + 1]).cumsum(0)])
        # A path that uses the best label has as many changes as stretches of others, at least. One that never uses it has one change
        # less than stretches, the first of which starts the text and the last of which ends it.
        if (gains - np.minimum.accumulate(gains, 0)).max() <= SWITCH and gains.max() + (gains[-1] - gains).max() <= SWITCH:
            share, spans = 1.0, [(langs[best], 0, len(text))]
        else:
            labels, letters, spans = path(scores), [0] * len(langs), []
            for m, x in zip(WORDS.finditer(low), labels):
                letters[x] += m.end() - m.start()
                if spans and spans[-1][0] == langs[x]:
                    spans[-1] = (langs[x], spans[-1][1], m.end())
                else:
                    spans.append((langs[x], m.start(), m.end()))
            best = max(range(len(langs)), key=letters.__getitem__)
            share, sums = letters[best] / sum(letters), scores[np.array(labels) == best].sum(0)
        return langs[best], float(share / np.exp(np.minimum(sums - sums[best], 50)).sum()), spans

    def rows_of(words):
        found = [row(w) for w in words]  # may grow the table
        return rows[found]

    return label


def labelled(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "_p") -> DataFrame:
    """docs with the column `name`, a struct of lang, score and spans of the text. The model is bounded, so it is broadcast."""
    state = shipped(docs.sparkSession, model, labeller)

    def run(batches):
        label = state()
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.string())])
        for b in batches:
            found = [label(t.as_py() or "") for t in b.column(b.num_columns - 1)]
            told = pa.array([{"lang": lang, "score": score, "spans": ",".join(f"{x}:{s}:{e}" for x, s, e in spans)} for lang, score, spans in found], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], told], names=[*b.schema.names[:-1], name])

    out = StructType([*docs.schema.fields, StructField(name, StructType([StructField("lang", StringType()), StructField("score", DoubleType()), StructField("spans", StringType())]))])
    return arrow(docs.withColumn(fresh(docs, "_text"), F.col(text_col).cast("string")), run, out)


def fitted(docs: DataFrame) -> Model | None:
    """The model fitted as the query asks: on documents whose crc32(doc_id) mod 4 is not 2. None if nothing can be learned."""
    return train(docs.where("lang is not null and text is not null").where(remainder("doc_id", 4) != 2).select("doc_id", "text", "lang"))


def has_letters(c):
    """Whether a text has a letter; this needs no model."""
    return F.coalesce(F.col(c), F.lit("")).rlike(r"\p{L}")


def languages(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans for each row of docs.

    Word scores are log-likelihoods of a frequent-word table mixed with character trigrams. The scripts of a word's letters rule
    out the languages that do not use them. A run of more than LONGEST letters is judged piece by piece, in fitting too, so all of its
    letters count and the language may change inside it; trigrams do not reach across the cut. lang_pred is the language with most letters on the Viterbi path; score is its share of letters times its
    posterior over the words of its spans. A null text or one without letters is `und` with score 0, and so is all if nothing was learned.
    Ties go to the language that is first by code point. Null and repeated ids are rows like others; an empty table gives an empty
    result; other columns are not read. Texts of any length are read whole, so
    memory is that of the longest text and its words. Rows are taken one by one and nothing is shuffled.
    """
    got = labelled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return got.select("doc_id", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"), F.col("_p.spans").alias("spans"))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages(docs, fitted(docs)).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "spans")
