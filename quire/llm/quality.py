"""Quality classifier: naive Bayes support vectors trained by dual coordinate descent."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow, bounded_sample, remainder, shipped, table

TOKENS = re.compile(r"[^\W\d_]+|[\d_]+|\n|[^\w\s]{1,3}")
#: Labelled documents the model is fitted on, about; hashed features; frequent words that stay words (others become their shape).
SAMPLE_ROWS, FEATURES, COMMON = 6000, 1 << 18, 500
#: A document is predicted to be of label 1 from this score on.
CUT = 0.3


def shape(token: str) -> str:
    if token.isalpha():
        kind = "u" if token.isupper() and len(token) > 1 else "t" if token[0].isupper() else "l"
        return kind + ("1" if len(token) < 4 else "2" if len(token) < 8 else "3" if len(token) < 14 else "4")
    return "0" if token[0].isalnum() or token[0] == "_" else token


def extractor(common: list[str], most: int = 300_000):
    """A function from a text to its features: sorted distinct hashes of the 1- and 2-grams of its words and marks as they are (in lower case), and of the 1- to 3-grams of frequent words and the shapes of the others."""
    import zlib

    import numpy as np

    words = frozenset(common)

    class Codes(dict):
        def __missing__(self, token: str) -> int:
            plain = zlib.crc32((token if token in words else shape(token)).encode())
            self[token] = out = plain << 32 | zlib.crc32(b"=" + token.lower().encode())
            return out

    codes = Codes()
    a, b, c, low = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xFFFFFFFF)

    def grams(x, longest: int):
        mixed = [x * a]
        for _ in range(longest - 1):
            last = mixed[-1]
            if len(last) > 1:
                mixed.append((last[:-1] ^ (last[:-1] >> np.uint64(29))) * b + x[len(x) - len(last) + 1 :] * c)
        return mixed

    def features(text: str):
        if len(codes) > most:
            codes.clear()
        tokens = TOKENS.findall(text)
        both = np.fromiter(map(codes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        mixed = grams(both >> np.uint64(32), 3) + grams((both & low) ^ low << np.uint64(8), 2)
        return np.unique(np.concatenate(mixed) >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int32)

    return features


def descend(rows: list, y, costs, size: int, rounds: int = 20):
    """Weights of the linear hinge-loss model by dual coordinate descent. rows: (indices, values)."""
    import numpy as np

    w, alpha, order = np.zeros(size), np.zeros(len(rows)), np.random.default_rng(1)
    norms = [float(v @ v) for _, v in rows]
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            if not norms[i]:
                continue
            new = min(max(alpha[i] - (y[i] * float(w[at] @ v) - 1) / norms[i], 0.0), costs[i])
            if d := new - alpha[i]:
                w[at] += d * y[i] * v
                alpha[i], moved = new, max(moved, abs(d))
        if moved < 1e-4:
            break
    return w


class Model:
    def __init__(self, common: list[str], samples: list, labels: list[int]):
        import numpy as np

        self.common, y = common, np.where(np.array(labels) == 1, 1.0, -1.0)
        if len(set(labels)) < 2:  # nothing to tell apart
            self.weights, self.slope, self.middle = np.zeros(FEATURES), 0.0, 0.0
            self.only = float(labels[0]) if labels else 0.5
            return
        self.only = None
        folds, margins = np.arange(len(samples)) % 3, np.zeros(len(samples))
        for k in range(3):
            w = self.fit([s for s, f in zip(samples, folds) if f != k], y[folds != k])
            margins[folds == k] = [self.of(w, s) for s, f in zip(samples, folds) if f == k]
        self.weights = self.fit(samples, y)
        # The cut with the best mean of both classes' recall, over margins of documents that were not fitted on.
        order = np.argsort(margins)
        m, good = margins[order], y[order] > 0
        recall = (~good).cumsum() / max(1, (~good).sum()) + 1 - good.cumsum() / max(1, good.sum())
        best = np.flatnonzero(recall >= recall.max() - 1e-12)
        i, j = best[0], best[-1]
        self.middle = float((m[i] + m[min(j + 1, len(m) - 1)]) / 2)
        self.slope = float(4 / max(1e-6, np.std(margins)))

    def fit(self, samples: list, y):
        """Weights per feature: the hinge-loss model's times the class log-count ratio."""
        import numpy as np

        counts = {c: np.bincount(np.concatenate([s for s, t in zip(samples, y) if t == c] or [np.zeros(0, np.int32)]), minlength=FEATURES) + 1.0 for c in (1.0, -1.0)}
        ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
        rows = [(s, ratio[s] / max(1e-9, np.linalg.norm(ratio[s]))) for s in samples]
        share = max(1, (y > 0).sum()), max(1, (y < 0).sum())
        costs = [len(y) / 2 / (share[0] if t > 0 else share[1]) for t in y]
        return np.stack([descend(rows, y, costs, FEATURES), ratio])

    @staticmethod
    def of(w, features) -> float:
        import numpy as np

        r = w[1][features]
        n = float(np.linalg.norm(r))
        return float(w[0][features] @ r) / n if n else 0.0

    def score(self, features) -> float:
        """CUT at the best cut, rising with the margin."""
        import math

        if self.only is not None:
            return self.only
        z = self.slope * (self.of(self.weights, features) - self.middle) + math.log(CUT / (1 - CUT))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from columns doc_id, text and label (0 or 1), fitted on about `rows` rows at most; the sample's features are collected."""
    sample = bounded_sample(labelled, "doc_id", rows).select("doc_id", "text", "label").cache()
    common = sample.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}]+"), F.lit(0)))).alias("w")).groupBy("w").count()
    common = [r["w"] for r in common.orderBy(F.desc("count"), "w").limit(COMMON).collect()]

    def run(batches):
        features = extractor(common)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t.as_py() or "").tobytes() for t in b.column(1)], pa.binary()), b.column(2)], names=["doc_id", "f", "label"])

    import numpy as np

    got = sorted((r["doc_id"], bytes(r["f"]), r["label"]) for r in arrow(sample.selectExpr("doc_id", "text", "cast(label as int) label"), run, "doc_id long, f binary, label int").collect())
    sample.unpersist()
    return Model(common, [np.frombuffer(f, dtype=np.int32) for _, f, _ in got], [label for *_, label in got])


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (1 from CUT on) for each row of docs.

    Features are hashed indicators of n-grams of the whole text, over words and over frequent words and shapes, scaled by class log-count ratios and brought
    to unit length. A null text counts as empty: it has no feature and gets the score of margin 0. Null and repeated ids are rows
    like others; an empty table gives an empty result; with one label only, all get that label. Other columns are not read. The
    model is bounded, so it is broadcast; rows are taken one by one, texts of any
    length whole, and nothing is shuffled. Of equally good cuts the middle of the first and the last is taken.
    """
    sent = shipped(docs.sparkSession, model, lambda m: (extractor(m.common), m))

    def run(batches):
        features, model = sent()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(features(t.as_py() or "")) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    got = arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, score double")
    return got.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where("quality is not null and doc_id is not null").where(remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    chosen = bounded_sample(labels, "doc_id", SAMPLE_ROWS)
    model = train(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    return quality(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
