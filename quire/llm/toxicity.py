"""Toxicity: a trie of abusive terms run as a Levenshtein automaton over words, and context windows that tell quotation from abuse."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow, bounded_sample, remainder, shipped, table

#: Labelled documents the model is fitted on, about; candidates for terms and terms of the learned lexicon at most.
SAMPLE_ROWS, MOST_CANDIDATES, MOST_TERMS = 12_000, 100_000, 2000
#: A term needs so many different pairs of neighbours in toxic documents, and so many times the share of words it has in the others.
LEAST_CONTEXTS, LEAST_RATIO = 12, 8.0
#: Letters of a stem.
STEMS = range(4, 9)
#: A document is predicted toxic from this score on.
CUT = 0.5
#: Words to either side of a term that are looked at.
WINDOW = 6

#: Words, with the marks that stand in for letters inside them.
TOKEN = re.compile(r"[\w@$](?:[\w@$*!]*[\w@$])?")
PLAIN = re.compile(r"[^\W\d_]+")
#: Figures and marks that stand in for letters.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
#: Opening and closing quotation marks.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "»": "«", "‹": "›"}
#: Words that report speech or speak of a word, and words that address someone.
REPORTING = frozenset("said says say wrote writes quoted quote quotes quoting called calls word words term terms reported reports alleged testified stated recalled insult insults slur slurs meaning means defined definition".split())
ADDRESS = frozenset("you your youre u ur he she they these those this such a an what".split())


class Automaton:
    """The Levenshtein automaton of all terms at once: the trie's nodes with the edits spent so far, made deterministic state by state as words are read.

    terms: {term: whether it is a whole word}. A word may differ from a whole word by no edit if that has fewer than five letters, by
    one if it has up to eight, else by two; a stem must begin the word as it is.
    """

    def __init__(self, terms: dict, most: int = 50_000):
        self.child, self.term, self.most = [{}], [None], most
        for t in sorted(terms):
            node = 0
            for c in t:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                node = self.child[node][c]
            self.term[node] = t
        self.own = [edits(t) if t and terms[t] else 0 for t in self.term]
        self.allowed = list(self.own)  # edits of any term at or below a node
        for node in range(len(self.child) - 1, -1, -1):
            self.allowed[node] = max([self.own[node], *(self.allowed[k] for k in self.child[node].values())])
        self.fresh()

    def fresh(self) -> None:
        start = self.closed({0: 0})
        self.states, self.number, self.next = [start], {start: 0}, [{}]

    def closed(self, at: dict) -> tuple:
        """The positions with those that leaving out letters of a term reaches, least edits first."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            if e > at.get(node, 99):
                continue
            for k in self.child[node].values():
                if e + 1 <= self.allowed[k] and e + 1 < at.get(k, 99):
                    at[k] = e + 1
                    todo.append((k, e + 1))
        return tuple(sorted(at.items()))

    def step(self, state: int, letter: str) -> int:
        """The state after a letter, -1 if no term can be reached any more."""
        after: dict = {}

        def put(node: int, e: int) -> None:
            if e <= self.allowed[node] and e < after.get(node, 99):
                after[node] = e

        for node, e in self.states[state]:
            put(node, e + 1)  # a letter too many
            for c, k in self.child[node].items():
                put(k, e if c == letter else e + 1)
        out = -1
        if after:
            key = self.closed(after)
            out = self.number.setdefault(key, len(self.states))
            if out == len(self.states):
                self.states.append(key)
                self.next.append({})
        self.next[state][letter] = out
        return out

    def find(self, word: str):
        """(term, edits) of the longest term that begins word as it is, else of the whole word nearest to it, the first in code-point order of several, or None."""
        if len(self.states) > self.most:
            self.fresh()
        state, stem = 0, None
        for c in word:
            to = self.next[state].get(c)
            state = self.step(state, c) if to is None else to
            if state < 0:
                break
            stem = next((self.term[n] for n, e in self.states[state] if not e and self.term[n]), stem)
        if stem:
            return stem, 0
        ends = [(e, self.term[n]) for n, e in self.states[state] if self.term[n] and e <= self.own[n]] if state >= 0 else []
        return min(ends)[::-1] if ends else None


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) <= 8 else 2


def folded(word: str) -> str:
    """Figures and marks read as letters; a letter repeated three times or more counts twice."""
    return re.sub(r"(.)\1{2,}", r"\1\1", word.translate(LOOKALIKE))


def quoted_spans(text: str, most: int = 400) -> list[tuple[int, int]]:
    """Spans of `most` characters at most between a mark and the next one that closes it, on one line."""
    spans, opened = [], None
    for m in re.finditer(r'["“”„«»‹›\n]', text):
        c = m[0]
        if opened and c == QUOTES[opened[0]] and m.start() - opened[1] <= most:
            spans.append((opened[1], m.start()))
            opened = None
        elif c == "\n":
            opened = None
        elif c in QUOTES:
            opened = (c, m.start())
    return spans


class Model:
    """terms: {term: (weight, whether it is a whole word)}. ordinary: words near a term that are no misspelling of it. curve: weights of the logistic score."""

    def __init__(self, terms: dict, ordinary: frozenset = frozenset(), curve: tuple = (0.0, 0.0, 0.0)):
        self.terms, self.ordinary, self.curve = terms, ordinary, curve

    def score(self, features: tuple) -> float:
        import math

        z = sum(a * b for a, b in zip(self.curve, (*features, 1.0)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


class Reader:
    """Finds a model's terms in texts. Words once judged are remembered, `most` of them at once."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self.automaton = Automaton({t: whole for t, (_, whole) in model.terms.items()})
        outer = self

        class Seen(dict):
            def __missing__(self, word: str):
                self[word] = out = outer.judge(word)
                return out

        self.seen = Seen()

    def judge(self, word: str):
        """(term, edits) or None. Where a word as it is begins with no term, it is read without look-alikes and long repeats."""
        if len(word) > 60:
            return None
        found = self.automaton.find(word)
        if found is None or found[1]:
            plain = folded(word)
            again = self.automaton.find(plain) if plain != word else None
            found = min((x for x in (found, again) if x), key=lambda x: x[1], default=None)
        return None if found and found[1] and word in self.model.ordinary else found

    def hits(self, text: str) -> list[tuple]:
        """(start, end, term, edits, abuse) of each term found; abuse from 0 (quotation) to 1."""
        low = text.lower()
        if len(low) != len(text):  # lower case of another length: letter by letter
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if len(self.seen) > self.most:
            self.seen.clear()
        seen = self.seen
        bad = {w for w in set(TOKEN.findall(low)) if seen[w]}
        if not bad:
            return []
        tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(low)]
        quotes, out, q = quoted_spans(low), [], 0
        for i, (start, end, w) in enumerate(tokens):
            if w not in bad:
                continue
            while q < len(quotes) and quotes[q][1] <= start:
                q += 1
            inside = q < len(quotes) and quotes[q][0] < start
            near = [t[2] for t in tokens[max(0, i - WINDOW) : i]] + [t[2] for t in tokens[i + 1 : i + 1 + WINDOW]]
            reports = sum(t in REPORTING for t in near)
            addresses = any(t in ADDRESS for t in near[-WINDOW - 3 : -WINDOW] or near[:3])
            abuse = 1.0 - 0.5 * inside - 0.35 * min(1, reports) - 0.15 * (inside and reports > 0) + 0.1 * addresses
            term, e = seen[w]
            out.append((start, end, term, e, round(min(1.0, max(0.0, abuse)), 3)))
        return out

    def features(self, text: str, hits: list[tuple]) -> tuple[float, float]:
        """The logarithms of the evidence (weights of the terms found, less where quoted, half for each edit) and of that in a hundred words. Repeats of a passage count once."""
        import math

        if not hits:
            return 0.0, 0.0
        once = {(text[max(0, s - 20) : e + 20], s - max(0, s - 20)): self.model.terms[term][0] * abuse * 0.5**k for s, e, term, k, abuse in hits}
        total = sum(once.values())
        return math.log1p(total), math.log1p(100 * total / max(10, text.count(" ") + text.count("\n") + 1))


def candidates(word: str):
    """The stems of a word and the word itself, told from a stem by a blank after it."""
    if len(word) >= STEMS[0]:
        yield from (word[:n] for n in STEMS if n <= len(word))
    yield word + " "


def lexicon(sample: DataFrame) -> dict:
    """{term: (weight, whether it is a whole word)} of a bounded sample of columns text and label.

    A candidate (a word, or the first letters of words) is counted once for each different pair of neighbours in toxic documents, so
    words of copied passages do not count; LEAST_CONTEXTS of them make a term if its share of all words is LEAST_RATIO times
    that in the other documents. Of stems that begin one another the one with most weight times neighbours stays, ties to the longer;
    a word that begins with a stem is a term only if the stem is that word. Weights are logarithms of the ratio, 1 for the largest.
    """
    import math
    from collections import Counter

    spark = sample.sparkSession

    def around(batches):
        for b in batches:
            pairs = set()
            for text in b.column(0):
                found = PLAIN.findall((text.as_py() or "").lower())
                for i, w in enumerate(found):
                    if 3 <= len(w) <= 40:
                        near = hash_of(f"{found[i - 1] if i else ''} {w} {found[i + 1] if i + 1 < len(found) else ''}")
                        pairs.update((c, near) for c in candidates(w))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int64())], names=["term", "near"])

    near = arrow(sample.where("label = 1").select("text"), around, "term string, near long")
    toxic = near.distinct().groupBy("term").count().where(F.col("count") >= LEAST_CONTEXTS).orderBy(F.desc("count"), "term").limit(MOST_CANDIDATES)
    toxic = {r["term"]: r["count"] for r in toxic.collect()}
    sent = shipped(spark, frozenset(toxic))

    def elsewhere(batches):
        among, found, words = sent(), Counter(), [0, 0]
        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist()):
                of = PLAIN.findall((text.as_py() or "").lower())
                words[y] += len(of)
                if not y:
                    found.update(c for w in of for c in candidates(w) if c in among)
        found.update({"\n0": words[0], "\n1": words[1]})
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    other = arrow(sample.select("text", "label"), elsewhere, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    other = {r["term"]: r["n"] for r in other.collect()}
    words = [max(1, other.get(f"\n{y}", 0)) for y in (0, 1)]
    ratio = {t: math.log((n + 0.5) / words[1]) - math.log((other.get(t, 0) + 0.5) / words[0]) for t, n in toxic.items()}
    good = {t: (r - math.log(LEAST_RATIO)) * toxic[t] for t, r in ratio.items() if r >= math.log(LEAST_RATIO)}
    stems = {t for t in good if not t.endswith(" ")}
    best = set()
    for t in sorted(stems, key=lambda t: (-good[t], -len(t), t)):
        if not any(t.startswith(k) or k.startswith(t) for k in best):
            best.add(t)
    whole = {t[:-1] for t in good if t.endswith(" ")}
    chosen = best | {w for w in whole if not any(w[:n] in best for n in STEMS)}
    chosen = sorted(chosen, key=lambda t: (-good.get(t, good.get(t + " ")), t))[:MOST_TERMS]
    of = {t: max(ratio.get(t, 0.0), ratio.get(t + " ", 0.0)) for t in chosen}
    top = max(of.values(), default=1.0)
    return {t: (of[t] / top, t in whole) for t in chosen}


def hash_of(s: str) -> int:
    import zlib

    b = s.encode()
    return zlib.crc32(b) << 31 | zlib.crc32(b[::-1]) >> 1


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from columns doc_id, text and label (0 or 1), fitted on about `rows` rows at most. Two numbers and the label of each row of the sample are collected, and the words near a term that documents of label 0 hold."""
    sample = bounded_sample(labelled, "doc_id", rows).selectExpr("text", "cast(label as int) AS label").cache()
    model = Model(lexicon(sample))
    sent = shipped(sample.sparkSession, model, Reader)

    def near(batches):
        reader, found = sent(), set()
        for b in batches:
            for text in b.column(0):
                found.update(w for w in TOKEN.findall((text.as_py() or "").lower()) if (x := reader.seen[w]) and x[1])
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    words = arrow(sample.where("label = 0").select("text"), near, "word string").groupBy("word").count().orderBy(F.desc("count"), "word").limit(MOST_CANDIDATES)
    model.ordinary = frozenset(r["word"] for r in words.collect())
    sent_again = shipped(sample.sparkSession, model, Reader)

    def run(batches):
        reader = sent_again()
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(0)]
            found = [reader.features(t, reader.hits(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), b.column(1)], names=["a", "b", "label"])

    got = sorted(tuple(r) for r in arrow(sample, run, "a double, b double, label int").collect())
    sample.unpersist()
    model.curve = logistic([r[:2] for r in got], [r[2] for r in got])
    return model


def logistic(x: list[tuple], y: list[int], ridge: float = 0.1) -> tuple:
    """Weights of a logistic score over rows x and 1, by damped Newton steps with a ridge. With one label only, that label's score; without rows 0.5."""
    import numpy as np

    if not y or min(y) == max(y):
        return (0.0, 0.0, 0.0 if not y else 5.0 if y[0] else -5.0)
    v, y = np.column_stack([np.array(x), np.ones(len(y))]), np.array(y, dtype=float)
    w = np.zeros(v.shape[1])

    def loss(w):
        z = v @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge / 2 * w @ w)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(v @ w, -500, 500)))
        step = np.linalg.solve((v.T * (p * (1 - p))) @ v + ridge * np.eye(len(w)), v.T @ (y - p) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return tuple(float(k) for k in w)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 from CUT on), n_terms and spans for each row of docs.

    Words of the whole text, in lower case and with figures and marks read as letters, run through the automaton of the lexicon's
    trie; spans are those found, term:start:end:edits:abuse by start (code points, end exclusive), where abuse is lower between
    quotation marks and near reporting words. A null text counts as empty and, like one without terms, gets the score of no evidence.
    Null and repeated ids are rows like others; an empty table gives an empty result; with one label only all get that label. Of
    terms equally near the first in code-point order is taken. Other columns are not read. The model is bounded, so it is broadcast;
    nothing is shuffled.
    """
    sent = shipped(docs.sparkSession, model, Reader)

    def run(batches):
        reader = sent()
        for b in batches:
            found = [reader.hits(t.as_py() or "") for t in b.column(1)]
            scores = [reader.model.score(reader.features(t.as_py() or "", h)) for t, h in zip(b.column(1), found)]
            spans = [",".join(f"{term}:{s}:{e}:{k}:{abuse}" for s, e, term, k, abuse in h) for h in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([len(h) for h in found], pa.int64()), pa.array(spans, pa.string())], names=["doc_id", "score", "n_terms", "spans"])

    got = arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, score double, n_terms long, spans string")
    return got.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op11(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where("toxic is not null and doc_id is not null").where(remainder("doc_id", 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    chosen = bounded_sample(labels, "doc_id", SAMPLE_ROWS)
    model = train(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    return toxicity(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_terms", "spans")
