"""Packing tokenised documents into sequences: bounded-space online packing."""

from __future__ import annotations

import sys
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow, saved, worker_state

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: One partition in so many shares a task of the last merge, which reads one unfilled window of each.
MERGED = 128


#: Characters of white space in a row from which a text goes to the tokenizer: the regular expression of the ranks keeps a state for each.
BLANKS = 4096


def piecewise(tokenizer_path: str | None = None, ranks_path: str | None = None):
    """A function from a text to its ids as little-endian unsigned 32-bit bytes: those of the tokenizer in tokenizer_path.

    ranks_path holds the same vocabulary as ranks, from which the same ids come in a fraction of the time and without a store of
    pieces: texts have too many different ones for a store of bounded size. A text with a special token, or with BLANKS characters of
    white space in a row, goes to the tokenizer itself, which is made for the first such text.
    """
    import base64
    import json
    import re
    from array import array
    from functools import cache

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    whole = cache(lambda: Tokenizer.from_file(path))
    with open(path, encoding="utf-8") as f:
        special = re.compile("|".join(re.escape(x["content"]) for x in json.load(f)["added_tokens"]) or "(?!)")
    blanks = re.compile(rf"\s{{{BLANKS}}}")
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def packed(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def ids(text: str) -> bytes:
        # A run of BLANKS characters reaches one of these places.
        long = any(map(str.isspace, text[BLANKS - 1 :: BLANKS])) and blanks.search(text)
        return packed(whole().encode(text, add_special_tokens=False).ids if long or special.search(text) else core.encode_ordinary(text))

    return ids


class Windows:
    """Open windows, at most `most`; a full one is emitted, and so is the fullest when nothing fits."""

    def __init__(self, size: int, most: int, first: int):
        self.size, self.most, self.next, self.open, self.out = size, most, first, [], []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next, at, None))
            at += n
        self.next += 1

    def add(self, doc, ids: bytes, start: int, total: int) -> None:
        n = len(ids) // 4
        while n >= self.size:
            self.emit([(doc, start, ids[: self.size * 4], total)])
            ids, start, n = ids[self.size * 4 :], start + self.size, n - self.size
        while n:
            best = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.most:
                self.open.append(best := [self.size, []])
            cut = n
            if best is None:  # the fullest goes, topped up with the head of this document
                best = min(self.open, key=lambda w: w[0])
                cut = best[0]
            best[1].append((doc, start, ids[: cut * 4], total))
            best[0] -= cut
            ids, start, n = ids[cut * 4 :], start + cut, n - cut
            if not best[0]:
                self.emit(best[1])
                self.open = [w for w in self.open if w is not best]

    def merge(self) -> list[tuple]:
        """Pours the open windows into one another; the pieces of the one that stays unfilled."""
        pieces = [p for w in sorted(self.open, key=lambda w: w[0]) for p in w[1]]
        self.open, self.most = [], 1
        for doc, start, ids, total in pieces:
            self.add(doc, ids, start, total)
        return self.open[0][1] if self.open else []


FIELDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(FIELDS), FIELDS)], schema=FIELDS)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, windows: int = 32, end_id: int = 0, tokenizer_path: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and `end_id`. A partition keeps `windows` open windows of `size` ids: a document's whole windows go out
    as they are; its rest goes to the window that it fits best; if it fits none, the fullest is topped up with its head and goes
    out. At a partition's end the open windows are poured into one another, which leaves one unfilled at most; those of MERGED
    partitions are poured together in one task, and the last is cut at powers of two, which need no padding. So no sequence is padded.
    A null text is an empty one, whose only id is `end_id`; null and repeated ids are documents like others; an empty table gives no
    row; other columns are not read. Texts of any length are tokenised whole; of windows that fit equally well the one opened first is
    taken. The pieces are written to the shared folder once, so both parts of the result are of one run.
    """

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids_of = worker_state(("pack", tokenizer_path), lambda: piecewise(tokenizer_path))
        held, end = Windows(size, windows, part << 36), end_id.to_bytes(4, "little")
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = ids_of(text.as_py() or "") + end
                held.add(doc, ids, 0, len(ids) // 4)
                if len(held.out) > 20_000:
                    yield as_batch(held.out)
                    held.out = []
        last = held.merge()
        yield as_batch(held.out + [(doc, start, len(ids) // 4, None, total, part, i, ids) for i, (doc, start, ids, total) in enumerate(last)])

    def merged(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        held = Windows(size, 1, (1 << 62) + (key[0].as_py() << 36))
        for r in got.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
            held.add(r["doc_id"], r["ids"], r["start"], r["doc_tokens"])
        last = held.merge()
        n, bound, now = sum(len(x[2]) // 4 for x in last), size, []
        for doc, start, ids, total in last:
            while ids:
                while not now and bound > n:
                    bound //= 2
                cut = min(len(ids) // 4, bound - sum(len(x[2]) // 4 for x in now))
                now.append((doc, start, ids[: cut * 4], total))
                ids, start = ids[cut * 4 :], start + cut
                if sum(len(x[2]) // 4 for x in now) == bound:
                    held.emit(now)
                    n, now = n - bound, []
        return pa.Table.from_batches([as_batch(held.out)])

    out = saved(arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SCHEMA + ", ids binary"), "pieces")
    rest = out.where("ids is not null").groupBy(F.floor(F.col("sequence_id") / MERGED).cast("long").alias("part")).applyInArrow(merged, SCHEMA + ", ids binary")
    return out.where("ids is null").drop("ids").union(rest.drop("ids"))


def op10(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
