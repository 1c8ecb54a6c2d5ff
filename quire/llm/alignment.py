"""Cross-tokenizer alignment: where tokens of two tokenizers end together, their links, and how often the corpus links two ids."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import arrow, freed, saved, shipped, table, worker_state

#: The most frequent pairs of ids, so many at most, are broadcast with their counts; all others are joined.
HEAD = 1 << 18
#: Salts of the first stage that adds up pairs; distinct pairs a task holds before it passes them on.
SALTS, HELD = 16, 1 << 20
#: Texts of so many code points in all are aligned in one vector step.
STEP = 1 << 18


class Tokens:
    """The two tokenizers: ids of texts, and the bytes of each id."""

    def __init__(self, byte_path: str | None = None, ranks_path: str | None = None, piece_path: str | None = None):
        import base64

        import numpy as np
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        from quire.llm.packing import piecewise

        byte_path, ranks_path = byte_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.special = [t.content for t in self.a.get_added_tokens_decoder().values()]
        self.fast = piecewise(byte_path, ranks_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path or public_tokenizers.path("piece_bpe_32k.model"))
        with open(ranks_path, "rb") as f:
            ranks = {int(n): base64.b64decode(t) for t, n in map(bytes.split, f)}
        top = max(ranks, default=0)
        self.a_bytes = [ranks.get(i, b"") for i in range(max(top + 1, self.a.get_vocab_size()))]
        for t, i in self.a.get_vocab(with_added_tokens=True).items():
            if i not in ranks:
                self.a_bytes[i] = t.encode()
        self.b_bytes = [self.piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in v], dtype=np.int64) for v in (self.a_bytes, self.b_bytes))
        shown = max(len(self.a_bytes), len(self.b_bytes))
        # Decimal ids with what follows them: another of the group, the group's other side, the next group.
        self.shown = np.array([f"{i}{mark}" for mark in ",|;" for i in range(shown)], dtype=object)
        self.count = shown

    def piece(self, i: int) -> bytes:
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def ids(self, texts: list[str]):
        """For each text the ids of both, as arrays, or None where the bytes of either are not those of a blank and the text."""
        import numpy as np

        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1) if texts else []):
            whole = " " + text
            if any(s in whole for s in self.special):
                a = np.array(self.a.encode(whole, add_special_tokens=False).ids, dtype=np.int64)
            else:
                a = np.frombuffer(self.fast(whole), dtype="<u4").astype(np.int64)
            raw = whole.encode("utf-8", "surrogatepass")
            same = b"".join(map(self.b_bytes.__getitem__, b)) == raw and b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw
            out.append((a, np.array(b, dtype=np.int64)) if same else None)
        return out


def aligned(a, b, a_size, b_size):
    """Groups and links of token arrays whose bytes are the same: ends of all tokens by cumsum, common cuts, group numbers by searchsorted, links by repeats.

    A link is a pair of tokens that end at one cut. Tokens of no bytes end where others do, so a cut may have several on either side.
    Returns (number of groups, group of each a, group of each b, group of each link, a of each link, b of each link).
    """
    import numpy as np

    ends_a, ends_b = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    cuts = np.intersect1d(ends_a, ends_b)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    first_a, first_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    many_a, many_b = np.searchsorted(ends_a, cuts, "right") - first_a, np.searchsorted(ends_b, cuts, "right") - first_b
    links = many_a * many_b
    cut = np.repeat(np.arange(len(cuts)), links)
    nth = np.arange(len(cut)) - np.repeat(np.cumsum(links) - links, links)
    return len(cuts), group_a, group_b, cut, a[first_a[cut] + nth // many_b[cut]], b[first_b[cut] + nth % many_b[cut]]


def aligner(tokens: Tokens):
    """A function from texts to rows (n_a, n_b, n_groups, n_links, groups, codes, times): groups as text, linked pairs of ids as distinct codes and how often each.

    Texts of one step are laid end to end, so one pass of array operations aligns them all: a text's end is always a common cut.
    """
    import numpy as np

    none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))

    def rows(texts: list[str]) -> list[tuple]:
        found = tokens.ids(texts)
        good = [i for i, x in enumerate(found) if x is not None and texts[i]]
        if len(good) > 1 and any((tokens.a_size[x] == 0).any() or (tokens.b_size[y] == 0).any() for x, y in (found[i] for i in good)):
            return [rows([t])[0] for t in texts]  # a token of no bytes might end where the text before does
        out = [none] * len(texts)
        if not good:
            return out
        a, b = (np.concatenate([found[i][k] for i in good]) for k in (0, 1))
        groups, group_a, group_b, cut, link_a, link_b = aligned(a, b, tokens.a_size, tokens.b_size)
        bound = [np.concatenate([[0], np.cumsum([len(found[i][k]) for i in good])]) for k in (0, 1)]
        group_at = np.concatenate([[0], group_a[bound[0][1:] - 1] + 1])  # each text ends with a cut
        links_at = np.searchsorted(cut, group_at)
        # The ids in order of group and side, each with the mark that follows it.
        side = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(side, kind="stable")
        ids, side = np.concatenate([a, b])[order], side[order]
        mark = np.full(len(side), 2)
        mark[:-1] = np.where(side[1:] == side[:-1], 0, np.where(side[:-1] % 2 == 0, 1, 2))
        shown = tokens.shown[mark * tokens.count + ids]
        code = link_a * len(tokens.b_bytes) + link_b
        for k, i in enumerate(good):
            lo, hi = bound[0][k] + bound[1][k], bound[0][k + 1] + bound[1][k + 1]
            codes, times = np.unique(code[links_at[k] : links_at[k + 1]], return_counts=True)
            out[i] = (int(bound[0][k + 1] - bound[0][k]), int(bound[1][k + 1] - bound[1][k]), int(group_at[k + 1] - group_at[k]), int(links_at[k + 1] - links_at[k]), "".join(shown[lo:hi].tolist())[:-1], codes, times.astype(np.int32))
        return out

    return rows


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False, paths: tuple = (None, None, None)) -> DataFrame:
    """A row for each document, in a table of the shared folder: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, row (a number of its own), codes and times (distinct linked pairs as binary integers, a * size of B's vocabulary + b, and how often each), and with keep_groups the groups.

    A encodes a blank and the text, B the text, both without special tokens. Byte offsets where tokens of both end cut them into
    groups; a link is a pair of tokens that end at one cut. A text that is null, empty or whose tokens' bytes differ from it has no
    tokens: zeros, '' and no pairs. Null and repeated ids and repeated rows are rows like others; an empty table gives no row; other
    columns are not read. Texts of any length are aligned whole. paths: of A's tokenizer, of its ranks, of B's model.
    """
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, codes binary, times binary" + (", groups string" if keep_groups else "")

    def run(batches):
        import hashlib

        import numpy as np
        from pyspark import TaskContext

        def build():
            tokens = Tokens(*paths)
            return aligner(tokens), np.dtype("<u4" if len(tokens.a_bytes) * len(tokens.b_bytes) < 1 << 32 else "<u8")

        rows, kind = worker_state(("align", paths), build)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            texts, found, at = [t.as_py() or "" for t in b.column(1)], [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= STEP):
                    size += len(texts[end])
                    end += 1
                found.extend((*r[:4], hashlib.sha256(r[4].encode()).hexdigest() if r[4] else "", r[5].astype(kind).tobytes(), r[6].astype("<i4").tobytes(), *([r[4]] if keep_groups else [])) for r in rows(texts[at:end]))
                at = end
            c = list(zip(*found)) or [[]] * (7 + keep_groups)
            numbers = [pa.array(x, pa.int64()) for x in c[:4]]
            yield pa.RecordBatch.from_arrays([b.column(0), *numbers, pa.array(c[4], pa.string()), pa.array(range(row, row + len(found)), pa.int64()), pa.array(c[5], pa.binary()), pa.array(c[6], pa.binary()), *([pa.array(c[7], pa.string())] if keep_groups else [])], names=[f.split()[0] for f in schema.split(", ")])
            row += len(found)

    return saved(arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema), "aligned")


def width(spark: SparkSession, paths: tuple = (None, None, None)) -> tuple[int, str]:
    """The size of B's vocabulary, which codes are read with, and the kind of their integers."""
    tokens = Tokens(*paths)
    return len(tokens.b_bytes), "<u4" if len(tokens.a_bytes) * len(tokens.b_bytes) < 1 << 32 else "<u8"


def flat(codes, times, kind: str):
    """The codes and times of a batch's binary columns end to end, and the number of its row for each."""
    import numpy as np

    parts = [np.frombuffer(c.as_py() or b"", dtype=kind).astype(np.int64) for c in codes]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(t.as_py() or b"", dtype="<i4").astype(np.int64) for t in times)]), row


def pair_counts(rows: DataFrame, paths: tuple = (None, None, None)) -> DataFrame:
    """code, a, b, n (links of the pair in all rows) and best (whether no pair of this b has more), from what align() gives.

    A task adds up its pairs first; then they are added up by pair and salt, then by pair, so the pairs of a blank or a full stop
    do not meet in one task. There is one row for each id of B at most to be broadcast.
    """
    size, kind = width(rows.sparkSession, paths)

    def run(batches):
        import numpy as np

        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

        def summed():
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.zeros(len(codes), np.int64)
            np.add.at(n, at, np.concatenate([t for _, t in held]))
            return codes, n

        def batch(codes, n):
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

        for b in batches:
            codes, times, _ = flat(b.column(0), b.column(1), kind)
            held.append((codes, times))
            if sum(len(c) for c, _ in held) > 2 * HELD:
                held = [summed()]
                if len(held[0][0]) > HELD:
                    yield batch(*held.pop())
                    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        yield batch(*summed())

    pairs = arrow(rows.select("codes", "times"), run, "code long, n long").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    pairs = pairs.groupBy("code", "salt").agg(F.sum("n").alias("n")).groupBy("code").agg(F.sum("n").alias("n"))
    pairs = saved(pairs.select("code", F.floor(F.col("code") / size).cast("int").alias("a"), (F.col("code") % size).cast("int").alias("b"), "n"), "pairs")
    most = pairs.groupBy(F.col("b").alias("of")).agg(F.max("n").alias("most"))
    return pairs.join(F.broadcast(most), F.col("b") == F.col("of")).select("code", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def linked(rows: DataFrame, pairs: DataFrame, paths: tuple = (None, None, None)) -> DataFrame:
    """row, n_best (links whose pair is the most frequent of its b, ties included) and count_sum (the pairs' counts over links) for each row of align().

    The HEAD most frequent pairs are broadcast and looked up in the rows; the others are joined by pair, which none of them has often,
    and added up by row. So no row of a frequent pair is shuffled, and every pair counts.
    """
    import numpy as np

    spark, (_, kind) = rows.sparkSession, width(rows.sparkSession, paths)
    head = pairs.orderBy(F.desc("n"), "code").limit(HEAD).select("code", "n", "best").toArrow().sort_by("code")
    sent = shipped(spark, tuple(head.column(i).to_numpy() for i in range(3)))

    def run(batches):
        codes_of, n_of, best_of = sent()
        for b in batches:
            codes, times, row = flat(b.column(1), b.column(2), kind)
            at = np.searchsorted(codes_of, codes)
            at[at == len(codes_of)] = 0
            known = codes_of[at] == codes if len(codes_of) else np.zeros(len(codes), dtype=bool)
            best, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(best, row[known], (times * best_of[at])[known] if len(codes_of) else [])
            np.add.at(total, row[known], (times * n_of[at])[known] if len(codes_of) else [])
            rest = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=b.num_rows))]).astype(np.int32)), pa.array(x[~known])) for x in (codes, times)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best), pa.array(total), *rest], names=["row", "n_best", "count_sum", "codes", "times"])

    found = saved(arrow(rows.select("row", "codes", "times"), run, "row long, n_best long, count_sum long, codes array<long>, times array<long>"), "looked_up")
    rest = found.where(F.size("codes") > 0)
    sums = found.select("row", "n_best", "count_sum")
    if rest.isEmpty():
        return sums
    rest = rest.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.times").alias("times"))
    rest = rest.join(pairs.select("code", "n", "best"), "code").select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return sums.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def op13(spark, sf_dir: str) -> DataFrame:
    rows = align(table(spark, sf_dir, "documents"))
    freed(spark)
    sums = linked(rows, pair_counts(rows))
    return rows.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
