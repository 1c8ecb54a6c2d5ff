"""Suffix-array dedup: Burrows-Wheeler transforms of candidate passages, and interval expansion bounded by the least length.

Strings of `length` bytes that two documents share have the same smallest hash of a GRAM-byte piece. Neighbouring windows with one
such hash (its key) form a passage, and a bucket gets all passages of its keys, so it owns all copies of the strings in them:
which of them are repeated is decided inside a bucket, by its transform alone. Keys seen in one document only are left out first.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow, freed, saved

#: Bytes of the pieces whose hashes deal out passages; bytes of text for a bucket of passages, and for a group of documents, about.
GRAM, BUCKET_BYTES, GROUP_BYTES = 20, 1 << 20, 4 << 20
#: Windows of a text handled at once; keys held before they are sent.
SLICE, HELD = 1 << 22, 1 << 19


def hashed(ids, groups: int):
    """pmod(xxhash64(id), groups) of an array of longs, as Spark computes it."""
    import numpy as np

    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = (np.uint64(42 + 8) + p5) ^ (turned(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    h = turned(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64) % groups


def passages(data, length: int):
    """(start, end, key) arrays: the passages of the bytes `data`, each a run of windows of `length` bytes with one key."""
    import numpy as np

    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

    def mixed(x):
        x = (x ^ (x >> np.uint64(30))) * b
        x = (x ^ (x >> np.uint64(27))) * c
        return x ^ (x >> np.uint64(31))

    letters = mixed(np.arange(1, 257, dtype=np.uint64) * a)
    joined = lambda x, y: (x ^ (x >> np.uint64(29))) * b + y

    def pieces(h, size: int):
        """Hashes of `size` successive symbols, from those of one: halves are joined."""
        done, powers = None, {1: h}
        while 2 * max(powers) <= size:
            p = max(powers)
            powers[2 * p] = joined(powers[p][:-p], powers[p][p:])
        n, at = len(h) - size + 1, 0
        for p in sorted(powers, reverse=True):
            if size - at >= p:
                part = powers[p][at : at + n]
                done, at = part if done is None else joined(done, part), at + p
        return done

    starts, ends, keys = [], [], []
    gram = min(GRAM, length)
    for at in range(0, len(data) - length + 1, SLICE):
        part = data[at : at + SLICE + length - 1]
        low, width, span = mixed(pieces(letters[part], gram)), 1, length - gram + 1
        while 2 * width <= span:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        if width < span:
            low = np.minimum(low[: len(low) - span + width], low[span - width :])
        cuts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1, [len(low)]])
        starts.append(cuts[:-1] + at)
        ends.append(cuts[1:] + at + length - 1)
        keys.append(mixed(low[cuts[:-1]] * a))
    return (np.concatenate(starts), np.concatenate(ends), np.concatenate(keys)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def suffix_order(symbols, least: int):
    """Positions of the suffixes of `symbols` (one byte each, 0 parts the passages), ordered by their first `least` symbols at least.

    Ranks of as many symbols as fit in 63 bits are joined in threes, then in overlapping pairs. Suffixes are told apart up to a 0 only:
    what is equal so far keeps one order from there on.
    """
    import numpy as np

    n, bits = len(symbols), int(symbols.max()).bit_length()
    h = min(least, 63 // bits)
    key, alive = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for d in range(h):
        key <<= bits
        key[: n - d] |= symbols[d:] * alive[: n - d]
        alive[: n - d] &= symbols[d:] > 0
    order, rank = np.argsort(key), np.empty(n, dtype=np.int64)
    alone = ~alive[order]  # ends at a 0
    while True:
        sorted_key = key[order]
        new = np.zeros(n, dtype=np.int64)
        np.cumsum((sorted_key[1:] != sorted_key[:-1]) | alone[1:], out=new[1:])
        rank[order] = new
        if h >= least or new[-1] == n - 1:
            return order
        alone = np.zeros(n, dtype=bool)
        ahead = [h, 2 * h] if n < 1 << 21 and 3 * h <= least else [min(h, least - h)]
        key = rank.copy()
        for d in ahead:
            key *= n + 1
            key[: n - d] += rank[d:] + 1
        order = np.argsort(key)
        h += ahead[-1]


def shared_prefixes(symbols, order, least: int):
    """Whether each suffix in order shares fewer than `least` symbols with the one before it; 0 parts the passages and is shared with none.

    Backward extension on the transform, breadth first: an interval of the suffixes that start with a string is extended by each
    symbol that stands before it. An extension whose right end is new fixes the common prefix there, so prefixes come out by
    increasing length and each once; what none has fixed at length least - 1 shares `least` symbols or more.
    """
    import numpy as np

    n = len(symbols)
    before, first = symbols[order - 1], symbols[order]
    to = np.empty(n, dtype=np.int32)
    to[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)  # of bytes, so counted and not compared
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = (first[1:] != first[:-1]) | (first[1:] == 0)
    fixed = np.zeros(n + 1, dtype=bool)
    fixed[0] = fixed[n] = True
    ends = np.flatnonzero(edge).astype(np.int32)
    lo, hi, inside = ends[:-1], ends[1:], before > 0
    owners, stamped = np.full(n + 1, -1, dtype=np.int32), 0
    for _ in range(1, least):
        new = ~fixed[hi]
        lo, hi = lo[new], hi[new]
        if not len(lo):
            break
        fixed[hi] = True
        width = hi - lo
        passed = np.cumsum(width, dtype=np.int64)  # at most n
        at = np.arange(passed[-1], dtype=np.int32) + np.repeat((lo - (passed - width)).astype(np.int32), width)
        keep = inside[at]
        owner = np.repeat(np.arange(stamped, stamped + len(lo), dtype=np.int32), width)[keep]
        at, stamped = to[at[keep]], stamped + len(lo)
        # Extensions of one interval by one symbol stand side by side.
        owners[at] = owner
        lo = np.sort(at[edge[at] | (owners[at - 1] != owner)])
        hi = np.sort(at[edge[at + 1] | (owners[at + 1] != owner)]) + 1
    fixed[hi] = True
    return fixed[:n]


def repeated(chunks: list[bytes], smallest, length: int):
    """For the windows of each passage, end to end, the smallest document with the same string; and where each passage's windows start. smallest: each passage's smallest document."""
    import numpy as np

    sizes = np.array([len(c) for c in chunks], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    joined = np.frombuffer(b"\0".join(chunks) + b"\0", dtype=np.uint8)
    used = np.bincount(joined, minlength=256) > 0
    used[0] |= (joined == 0).sum() > len(chunks)
    dense = np.cumsum(used)
    if dense[-1] < 256:
        symbols = dense.astype(np.uint8)[joined]
    else:  # all 256 bytes: one symbol more than a byte holds
        symbols = joined.astype(np.int16) + 1
    symbols[ends] = 0
    order = suffix_order(symbols, length)
    group = np.cumsum(shared_prefixes(symbols, order, length)) - 1
    whole = np.ones(len(symbols), dtype=bool)
    for d in range(length):  # windows that reach a passage's end
        whole[np.maximum(ends - d, starts)] = False
    owner = np.repeat(np.arange(len(chunks)), sizes + 1)
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    picked = whole[order]
    # Groups stand side by side in order, so each one's least is a reduction over its stretch.
    some, value = group[picked], smallest[owner[order[picked]]]
    if len(some):
        cuts = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
        least[some[cuts]] = np.minimum.reduceat(value, cuts)
    out = np.empty(len(symbols), dtype=np.int64)
    out[order] = least[group]
    return out, starts


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    Texts are their UTF-8 bytes. Each byte in a string of `length` bytes that also starts in a document of smaller id is removed;
    strings are judged on the input. n_spans counts maximal removed runs; kept_sha256 is the hash of the rest. A null text counts as
    empty. Rows of one id are documents that remove nothing from one another; a null id neither loses nor removes bytes. An empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = max(64, total // BUCKET_BYTES), max(16, total // GROUP_BYTES)
    least = length

    def keys(batches):
        import numpy as np

        held: list = []

        def told():
            key, doc = np.concatenate([k for k, _ in held]), np.concatenate([d for _, d in held])
            bucket, low = (key >> np.uint64(32)) % np.uint64(buckets), key.astype(np.uint32)
            order = np.lexsort((doc, bucket))
            bucket, low, doc = bucket[order], low[order], doc[order]
            cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
            rows = [(int(bucket[i]), low[i:j].tobytes(), np.diff(doc[i:j], prepend=0).tobytes()) for i, j in zip(cuts, cuts[1:])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "keys", "docs"])

        size = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = text.as_buffer()
                if doc is None or len(data) < least:
                    continue
                k = np.unique(passages(np.frombuffer(data, dtype=np.uint8), least)[2])
                held.append((k, np.full(len(k), doc, dtype=np.int64)))
                size += len(k)
                if size >= HELD:
                    yield told()
                    size = 0
        if size:
            yield told()

    def group_of(doc):
        return hashed(doc, groups)

    def shared(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        import numpy as np

        low = np.concatenate([np.frombuffer(x, np.uint32) for x in got["keys"].to_pylist()])
        doc = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in got["docs"].to_pylist()])
        order = np.lexsort((doc, low))
        low, doc = low[order], doc[order]
        cuts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        lasts = np.concatenate([cuts[1:], [len(low)]]) - 1
        keep = np.repeat(doc[cuts] != doc[lasts], lasts - cuts + 1)
        low, group = low[keep].astype(np.int64), group_of(doc[keep])
        both = np.unique(group << 32 | low)
        group, low = both >> 32, (both & 0xFFFFFFFF).astype(np.uint32)
        cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]]) if len(group) else [0]
        return pa.table({"grp": pa.array([int(group[i]) for i in cuts[:-1]], pa.int64()), "bucket": pa.array([key[0].as_py()] * (len(cuts) - 1), pa.int64()), "keys": pa.array([low[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())})

    def numbered(got: pa.Table):
        """(doc, number among rows of its id, bytes) in order."""
        rows, last, n = sorted(((d, t) for d, t in zip(got["doc_id"].to_pylist(), got["text"].cast(pa.binary()).to_pylist()) if d is not None), key=lambda x: (x[0], x[1])), None, 0
        for doc, data in rows:
            n = n + 1 if doc == last else 0
            last = doc
            yield doc, n, data

    def cut_out(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        import numpy as np

        rows: dict[int, list] = {}
        known = np.sort(np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(k, np.uint32).astype(np.uint64) for b, k in zip(wanted["bucket"].to_pylist(), wanted["keys"].to_pylist())] or [np.zeros(0, np.uint64)]))
        for doc, number, data in numbered(texts) if len(known) else ():
            if len(data) < least:
                continue
            start, end, key = passages(np.frombuffer(data, dtype=np.uint8), least)
            bucket = (key >> np.uint64(32)) % np.uint64(buckets)
            full = (bucket << np.uint64(32)) | key.astype(np.uint32)
            hit = known[np.minimum(known.searchsorted(full), len(known) - 1)] == full
            for s, e, b in zip(start[hit].tolist(), end[hit].tolist(), bucket[hit].tolist()):
                rows.setdefault(b, []).append((data[s:e], doc, number, s))
        out = []
        for b, found in rows.items():
            at: dict[bytes, int] = {}
            ix = [at.setdefault(c, len(at)) for c, *_ in found]
            out.append((b, np.array([len(c) for c in at], np.uint32).tobytes(), b"".join(at), np.array(ix, np.uint32).tobytes(), np.array([x[1] for x in found], np.int64).tobytes(), np.array([x[2] for x in found], np.uint32).tobytes(), np.array([x[3] for x in found], np.uint32).tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, (pa.int64(), *[pa.binary()] * 6))], names=["bucket", "sizes", "chunks", "ix", "docs", "numbers", "starts"])

    def judged(got: pa.Table) -> pa.Table:
        import numpy as np

        at: dict[bytes, int] = {}
        occ: list = [[], [], [], []]
        for r in got.to_pylist():
            sizes, ends = np.frombuffer(r["sizes"], np.uint32), None
            ends = np.cumsum(sizes.astype(np.int64)).tolist()
            ids = np.array([at.setdefault(r["chunks"][e - s : e], len(at)) for s, e in zip(sizes.tolist(), ends)], np.int64)
            for x, y in zip(occ, (ids[np.frombuffer(r["ix"], np.uint32)], np.frombuffer(r["docs"], np.int64), np.frombuffer(r["numbers"], np.uint32), np.frombuffer(r["starts"], np.uint32).astype(np.int64))):
                x.append(y)
        chunk, doc, number, start = (np.concatenate(x) for x in occ)
        chunks = list(at)
        size = np.array([len(c) for c in chunks], np.int64)
        smallest = np.full(len(chunks), np.iinfo(np.int64).max)
        np.minimum.at(smallest, chunk, doc)
        known, base = repeated(chunks, smallest, least)
        windows = size - least + 1
        spans = [[], [], [], []]

        def put(d, n, s, e):
            for x, y in zip(spans, (d, n, s, e)):
                x.append(y)

        # Where a passage's windows were all first seen in one document, its later copies go as a whole.
        owner = np.repeat(np.arange(len(chunks)), windows)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        first = known[base[owner] + inner]
        later = doc > smallest[chunk]
        put(doc[later], number[later], start[later], start[later] + size[chunk[later]])
        partly = first < smallest[owner]
        runs = np.flatnonzero(partly & np.concatenate([[True], ~partly[:-1] | (owner[1:] != owner[:-1])])), np.flatnonzero(partly & np.concatenate([~partly[1:] | (owner[1:] != owner[:-1]), [True]]))
        of = {}
        for i, j in zip(*(x.tolist() for x in runs)):
            of.setdefault(int(owner[i]), []).append((int(inner[i]), int(inner[j]) + least))
        if of:
            for k in np.flatnonzero(~later & np.isin(chunk, np.fromiter(of, np.int64))):
                for s, e in of[int(chunk[k])]:
                    put(doc[k : k + 1], number[k : k + 1], start[k : k + 1] + s, start[k : k + 1] + e)
        d, n, s, e = (np.concatenate(x) for x in spans)
        group = group_of(d)
        order = np.lexsort((s, d, group))
        d, n, s, e, group = d[order], n[order], s[order], e[order], group[order]
        cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]]) if len(group) else [0]
        parts = list(zip(cuts, cuts[1:]))
        return pa.table({"grp": pa.array([int(group[i]) for i, _ in parts], pa.int64()), **{k: pa.array([x[i:j].astype(t).tobytes() for i, j in parts], pa.binary()) for k, x, t in (("docs", d, np.int64), ("numbers", n, np.uint32), ("starts", s, np.uint32), ("ends", e, np.uint32))}})

    def kept(texts: pa.Table, gone: pa.Table) -> pa.Table:
        import numpy as np

        of: dict = {}
        for r in gone.to_pylist():
            for d, n, s, e in zip(np.frombuffer(r["docs"], np.int64).tolist(), np.frombuffer(r["numbers"], np.uint32).tolist(), np.frombuffer(r["starts"], np.uint32).tolist(), np.frombuffer(r["ends"], np.uint32).tolist()):
                of.setdefault((d, n), []).append((s, e))
        rows = [(None, len(t), 0, 0, hashlib.sha256(t).hexdigest()) for d, t in zip(texts["doc_id"].to_pylist(), texts["text"].cast(pa.binary()).to_pylist()) if d is None]
        for doc, number, data in numbered(texts):
            runs: list = []
            for s, e in sorted(of.get((doc, number), ())):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            digest, at = hashlib.sha256(), 0
            for s, e in runs:
                digest.update(data[at:s])
                at = e
            digest.update(data[at:])
            rows.append((doc, len(data), sum(e - s for s, e in runs), len(runs), digest.hexdigest()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    by_bucket = arrow(docs, keys, "bucket long, keys binary, docs binary").groupBy("bucket")
    wanted = saved(by_bucket.applyInArrow(shared, "grp long, bucket long, keys binary"), "keys")
    del by_bucket
    freed(spark)
    group = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))  # null ids meet nothing, so any group will do
    texts = docs.withColumn("grp", F.pmod(group, F.lit(groups)).cast("long"))
    found = texts.groupBy("grp").cogroup(wanted.groupBy("grp")).applyInArrow(cut_out, "bucket long, sizes binary, chunks binary, ix binary, docs binary, numbers binary, starts binary")
    spans = saved(found.groupBy("bucket").applyInArrow(judged, "grp long, docs binary, numbers binary, starts binary, ends binary"), "spans")
    del found
    freed(spark)
    return texts.groupBy("grp").cogroup(spans.groupBy("grp")).applyInArrow(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5(spark, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
