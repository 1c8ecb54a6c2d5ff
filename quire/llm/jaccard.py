"""N-gram Jaccard join with set-relation skipping.

Index level: each distinct set puts its prefix (rarest n-grams first) into index lists with their positions; a list is read in order
of set size, entries too small are skipped as a block, and an entry is skipped where the positions leave too little to share.
Answer level: in a list, a set is compared with a leader first. Sets found similar to a leader share its class, so their links among
one another need no comparison; what a set has in common with its leader bounds what it can share with the leader's other sets. Then
rounds: in each list, each class that is left proposes one pair, the likeliest that the bounds leave open, so a round never has more
pairs than entries; links join classes, and pairs within a class need no answer. After ROUNDS rounds what is still open is compared
pair by pair. Pairs are compared by their texts.
"""

from __future__ import annotations

from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow, dropped, freed, only_ids, parted, saved, worker_state
from quire.llm.graph import components

#: N-grams known as frequent, at most; they go last in the order of rarity. The order decides speed only, never what links.
MOST_FREQUENT = 200_000
#: Bits of a set's bitmap, at least.
FEWEST_BITS = 256
#: Entries of a list that are compared without arrays.
SHORT = 24
#: Rounds in which a class proposes one pair a list, before all that is open is compared. They decide speed only.
ROUNDS = 3
#: Documents counted together; an n-gram counts as frequent among them from so many documents on, or so large a share.
BATCH_DOCS, LEAST_DOCS, LEAST_SHARE = 1000, 4, 0.004


def shingler(k: int, most: int = 150_000):
    """A function from a text to its sorted distinct 64-bit hashes of k words; fewer words make one hash, none none."""
    import numpy as np
    import xxhash

    class Kept(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = out = xxhash.xxh3_64_intdigest(word)
            return out

    kept = Kept()
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

    def shingles(text: str):
        if len(kept) > most:
            kept.clear()
        words = text.encode("utf-8", "surrogatepass").lower().split()  # both know ASCII only
        h = np.fromiter(map(kept.__getitem__, words), dtype=np.uint64, count=len(words))
        w = min(k, len(h))
        if not w:
            return h
        out = h[: len(h) - w + 1] * a + np.uint64(w)
        for j in range(1, w):
            out = ((out ^ (out >> np.uint64(29))) * b + h[j : len(h) - w + 1 + j]) * c
        return np.unique(out ^ (out >> np.uint64(32)))

    return shingles


def frequent(docs: DataFrame, k: int) -> list[tuple[int, int]]:
    """(hash, documents) of the n-grams found frequent in batches of all documents, MOST_FREQUENT at most."""

    def run(batches):
        import numpy as np

        shingles, held, n = worker_state(("shingler", k), lambda: shingler(k)), [], 0

        def told():
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= max(LEAST_DOCS, LEAST_SHARE * n)
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["h", "n"])

        for b in batches:
            for text in b.column(0):
                held.append(shingles(text.as_py() or ""))
                n += 1
                if n == BATCH_DOCS:
                    yield told()
                    held, n = [], 0
        if held:
            yield told()

    rows = arrow(docs.select("text"), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()
    return [(r["h"], r["n"]) for r in rows]


def sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n (set size), digest and bits (a bitmap) of the set, prefix (hashes in order of rarity) for each row of doc_id and text."""
    import numpy as np

    often = sorted(frequent(docs, k))
    hashes = np.array([h for h, _ in often], dtype=np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((np.sort(hashes.view(np.uint64)), np.array([n for _, n in often], dtype=np.int64)[np.argsort(hashes.view(np.uint64))]))

    def run(batches):
        import hashlib

        shingles, (known, counts) = worker_state(("shingler", k), lambda: shingler(k)), sent.value
        for b in batches:
            rows = []
            for text in b.column(1):
                s = shingles(text.as_py() or "")
                n = len(s)
                digest, bits = (hashlib.blake2b(s.tobytes(), digest_size=16).digest(), parity(s, n)) if n else (None, None)
                if n and len(known):
                    at = np.minimum(known.searchsorted(s), len(known) - 1)
                    hit = known[at] == s
                    if hit.any():
                        s = np.concatenate([s[~hit], s[hit][np.argsort(counts[at[hit]], kind="stable")]])
                rows.append((n, digest, bits, s[: n - -(-percent * n // 100) + 1].view(np.int64) if n else s.view(np.int64)))
            offsets = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(offsets, np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), prefix], names=["doc_id", "n", "digest", "bits", "prefix"])

    return arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, digest binary, bits binary, prefix array<long>")


def parity(s, n: int):
    """A bitmap of the set s: the parity of the hashes that fall on each bit. Its bits are the power of two from n on, FEWEST_BITS at least.

    Sets differ in at least as many elements as their bitmaps in bits, and a bitmap folds to half its bits by exclusive or.
    """
    import numpy as np

    size = max(FEWEST_BITS, 1 << (n - 1).bit_length())
    odd = np.bincount((s % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def by_list(batches, row):
    """Calls row(columns) for each index list of two or more entries in batches sorted by their first column; yields what it returns."""
    import numpy as np

    held = None
    for b in chain(batches, [None]):
        if b is not None:
            new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if held is None or not len(held[0]):
            continue
        cuts = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
        ends = [*cuts, len(held[0])] if b is None else cuts
        if not len(ends):
            continue
        starts = np.concatenate([[0], ends[:-1]]).astype(int)
        sizes = np.asarray(ends) - starts
        for i in np.flatnonzero(sizes > 1):
            if (out := row([c[starts[i] : ends[i]] for c in held])) is not None:
                yield out
        held = [c[ends[-1] :] for c in held]


def need(n, m, percent: int):
    """The least intersection of sets of n and m with which 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def index_lists(reps: DataFrame, percent: int) -> DataFrame:
    """token, doc, n, pos, leader, more: the entries of lists that two or more sets share; leader is the entry that each is compared with first, perhaps itself.

    more: whether sizes, positions and leaders leave the entry another to be compared with than its leader. A list of two has none. It
    is true throughout a list of more than SHORT entries, where the pairs are not gone through.
    """

    def run(batches):
        out, size = [], 0

        def more(n, doc, pos, leader):
            left = [len(n) > SHORT] * len(n)
            for i, ni in enumerate(n if 2 < len(n) <= SHORT else ()):
                for j in range(i + 1, len(n)):
                    if 100 * ni < percent * n[j]:
                        break
                    if leader[j] != doc[i] and leader[i] != doc[j] and min(ni - pos[i], n[j] - pos[j]) >= need(ni, n[j], percent):
                        left[i] = left[j] = True
            return left

        def lead(cols):
            _, n, doc, pos = (c.tolist() for c in cols)
            leaders, first, found = [], 0, []
            for m, d, p in zip(n, doc, pos):
                while first < len(leaders) and 100 * leaders[first][0] < percent * m:  # a block that is too small for all that follow
                    first += 1
                for nl, dl, pl in leaders[first:]:
                    if 1 + min(nl - pl, m - p) - 1 >= need(nl, m, percent):
                        found.append(dl)
                        break
                else:
                    leaders.append((m, d, p))
                    found.append(d)
            return [cols[0], cols[2], cols[1], cols[3], found, more(n, doc, pos, found)]

        import numpy as np

        def batch():
            cols = [np.concatenate([np.asarray(x[i]) for x in out]) for i in range(6)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["token", "doc", "n", "pos", "leader", "more"])

        for got in by_list(batches, lead):
            out.append(got)
            size += len(got[4])
            if size > 50_000:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    entries = reps.select("doc_id", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "n", F.col("doc_id").alias("doc"), F.col("pos").cast("long").alias("pos"))
    return arrow(entries.repartition("token").sortWithinPartitions("token", "n", "doc"), run, "token long, doc long, n long, pos long, leader long, more boolean")


def open_pairs(lists: DataFrame, percent: int, every: bool) -> DataFrame:
    """token, a, b: pairs of sets of different classes that share a list and whose sizes, positions, common leader and bitmaps leave open whether they link.

    every: all such pairs; otherwise the one of each class in a list whose bitmaps differ least for their sizes, so there are no more
    rows than entries, and none only where none is open. lists: token, n, doc, pos, leader, shared (with the leader; null if not
    known), component, bits, met (sets it was compared with before, in vain). Sizes of linked sets are less than a factor of two
    apart, so one bitmap is folded once at most.
    """

    def run(batches):
        import numpy as np

        out, size = [], 0

        def few(token, n, doc, pos, leader, shared, comp, bits, met):
            """Of a short list, where arrays cost more than they save."""
            found, best, words = [], {}, {}

            def word(i, width):
                if i not in words:
                    words[i] = int.from_bytes(bits[i], "little")
                x, w = words[i], len(bits[i])
                while w > width:
                    w //= 2
                    x = (x >> (8 * w)) ^ (x & ((1 << (8 * w)) - 1))
                return x

            for i, ni in enumerate(n):
                for j in range(i + 1, len(n)):
                    nj = n[j]
                    if 100 * ni < percent * nj:
                        break
                    wanted = -(-percent * (ni + nj) // (100 + percent))
                    if comp[i] == comp[j] or min(ni - pos[i], nj - pos[j]) < wanted or leader[j] == doc[i] or leader[i] == doc[j]:
                        continue
                    if leader[i] == leader[j] and shared[i] >= 0 and shared[j] >= 0 and min(shared[j] + ni - shared[i], shared[i] + nj - shared[j]) < wanted:
                        continue
                    if met[i] is not None and doc[j] in met[i]:
                        continue
                    width = min(len(bits[i]), len(bits[j]))
                    slack = ni + nj - (word(i, width) ^ word(j, width)).bit_count() - 2 * wanted
                    if slack < 0:
                        continue
                    if every:
                        found.append((doc[i], doc[j]))
                    else:
                        for c in (comp[i], comp[j]):
                            if slack / (ni + nj) > best.get(c, (-1.0,))[0]:
                                best[c] = (slack / (ni + nj), doc[i], doc[j])
            if not every:
                found = sorted({x[1:] for x in best.values()})
            return (np.full(len(found), token[0]), *(np.array(x) for x in zip(*found))) if found else None

        def pairs(cols):
            comp = cols[6]
            if (comp == comp[0]).all():
                return None
            if len(comp) <= SHORT:
                return few(*(c.tolist() for c in cols))
            token, n, doc, pos, leader, shared, comp, bits, met = cols
            a, b = [], []
            size = np.array([len(x) for x in bits])
            words = [np.frombuffer(x, np.uint64) for x in bits]
            own, half = {}, {}
            for w in np.unique(size):
                at = np.flatnonzero(size == w)  # consecutive, as sizes rise
                own[w] = at[0], np.stack([words[i] for i in at])
                half[w // 2] = at[0], own[w][1][:, : w // 16] ^ own[w][1][:, w // 16 :]

            def differing(i, j):
                out = np.zeros(len(j), dtype=np.int64)
                for same, (first, rows) in ((size[j] == size[i], own[size[i]]), (size[j] == 2 * size[i], half.get(size[i], (0, None)))):
                    if same.any():
                        out[same] = np.bitwise_count(rows[j[same] - first] ^ words[i]).sum(1)
                return out

            ends = np.searchsorted(n, 100 * n // percent, side="right")
            of = np.unique(comp, return_inverse=True)[1]
            best = np.full(of.max() + 1, -1.0)
            best_i, best_j = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
            for i in range(len(n)):
                j = np.arange(i + 1, ends[i])
                j = j[of[j] != of[i]]
                if not len(j):
                    continue
                wanted = need(n[i], n[j], percent)
                ok = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= wanted
                same = (leader[j] == leader[i]) & (shared[i] >= 0) & (shared[j] >= 0)
                ok &= ~same | (np.minimum(shared[j] + n[i] - shared[i], shared[i] + n[j] - shared[j]) >= wanted)
                ok &= (leader[j] != doc[i]) & (leader[i] != doc[j])  # compared before
                if met[i] is not None and len(met[i]):
                    ok &= ~np.isin(doc[j], met[i])
                j, wanted = j[ok], wanted[ok]
                slack = n[i] + n[j] - differing(i, j) - 2 * wanted
                j, slack = j[slack >= 0], slack[slack >= 0] / (n[i] + n[j][slack >= 0])
                if not len(j):
                    continue
                if every:
                    a.append(np.full(len(j), doc[i]))
                    b.append(doc[j])
                    continue
                order = np.argsort(slack, kind="stable")  # the last of a class is its largest
                j, slack = j[order], slack[order]
                more = slack > best[of[j]]
                best[of[j[more]]], best_i[of[j[more]]], best_j[of[j[more]]] = slack[more], i, j[more]
                if slack[-1] > best[of[i]]:
                    best[of[i]], best_i[of[i]], best_j[of[i]] = slack[-1], i, j[-1]
            if not every:
                found = np.unique(np.stack([best_i[best >= 0], best_j[best >= 0]]), axis=1)
                a, b = ([doc[found[0]]], [doc[found[1]]]) if found.shape[1] else ([], [])
            return (np.full(sum(map(len, a)), token[0]), np.concatenate(a), np.concatenate(b)) if a else None

        def batch():
            tokens, a, b = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (tokens, np.minimum(a, b), np.maximum(a, b))], names=["token", "a", "b"])

        for got in by_list(batches, pairs):
            out.append(got)
            size += len(got[0])
            if size > 100_000:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    cols = lists.select("token", "n", "doc", "pos", "leader", F.coalesce("shared", F.lit(-1).cast("long")).alias("shared"), "component", "bits", "met")
    return arrow(cols.repartition("token").sortWithinPartitions("token", "n", "doc"), run, "token long, a long, b long")


def alike(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may link by their bitmaps, which differ in no more bits than the sets in elements. bitmaps: doc, n, bits."""

    def run(batches):
        for b in batches:
            a, c, n, m, x, y = (col.to_pylist() for col in b.columns)
            kept = []
            for i in range(len(a)):
                u, v, width, other = int.from_bytes(x[i], "little"), int.from_bytes(y[i], "little"), len(x[i]), len(y[i])
                if width < other:
                    u, v, width, other = v, u, other, width
                while width > other:
                    width //= 2
                    u = (u >> (8 * width)) ^ (u & ((1 << (8 * width)) - 1))
                kept.append(n[i] + m[i] - (u ^ v).bit_count() >= 2 * need(n[i], m[i], percent))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    ids = pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct())
    known = only_ids(bitmaps.select("doc", "n", "bits"), "doc", ids)
    side = lambda c: known.select(F.col("doc").alias(c), F.col("n").alias(f"{c}n"), F.col("bits").alias(f"{c}m"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "an", "bn", "am", "bm")
    return arrow(both, run, "a long, b long")


def compared(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b, shared, linked for pairs (a, b) of ids; docs has doc_id and text; rows that repeat an id each give an answer. Texts travel, as they are shorter than their sets."""

    def run(batches):
        import numpy as np

        shingles = worker_state(("shingler", k), lambda: shingler(k))
        last, theirs = None, None
        for b in batches:
            rows = []
            for a, c, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if c != last:
                    last, theirs = c, shingles(y.as_py())
                mine = shingles(x.as_py())
                both = len(np.intersect1d(mine, theirs, assume_unique=True))
                rows.append((a, c, both, 100 * both >= percent * (len(mine) + len(theirs) - both)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "shared", "linked"])

    ids = pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct())
    texts = only_ids(docs.select(F.col("doc_id").alias("id"), "text"), "id", ids)
    left = pairs.join(texts.withColumnRenamed("text", "x"), pairs["a"] == texts["id"]).select("a", "b", "x")
    both = left.join(texts.withColumnRenamed("text", "y"), left["b"] == texts["id"]).select("a", "b", "x", "y")
    return arrow(both, run, "a long, b long, shared long, linked boolean")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs, exact up to collisions of 64-bit hashes.

    A set: distinct k-word shingles of the text with A-Z lower-cased, words parted by ASCII white space; fewer words make one shingle.
    Two ids link when 100 * intersection >= percent * union; component_id is the smallest id reachable. Null and empty texts, or ones
    without words, have no shingles and link with nothing, and so does a null id, whose component is null. Rows of one id are one
    vertex: with several texts for an id, its set for linking is the smallest text's. An empty table gives an empty
    result; other columns are not read. Texts of any length are read whole, and ties of size or rarity are broken by id and hash. Equal sets are merged before anything else, so copies cost one row each.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = saved(sets(docs, k, percent), "sets")
    every = saved(made.select("doc_id", "n", "digest"), "every")
    known, texts = made.where("digest is not null and doc_id is not null"), docs.where("doc_id is not null and text is not null")
    several = every.where("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    if not (several := saved(several, "several")).isEmpty():
        texts = texts.join(several, "doc_id", "anti").union(texts.join(several, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))
        known = saved(sets(texts, k, percent), "sets").where("digest is not null")
    narrow = known.select("doc_id", "digest")
    first = saved(narrow.groupBy("digest").agg(F.min("doc_id").alias("rep")), "first")
    same = saved(narrow.join(first, "digest").select("doc_id", "rep").dropDuplicates(["doc_id"]), "same")
    # Most sets are the only ones of their kind and id and stay where they are; the others are shuffled to leave one row each.
    aside = saved(same.where("doc_id <> rep").select("doc_id").union(narrow.groupBy("doc_id").count().where("count > 1").select("doc_id")), "aside")
    alone, others = parted(known.select("doc_id", "n", "bits", "prefix"), "doc_id", aside)
    reps = saved(alone.union(others.join(same.where("doc_id = rep").select("doc_id"), "doc_id").select(alone.columns).dropDuplicates(["doc_id"])), "reps")
    for done in (made, known, first, aside):
        dropped(spark, done)
    lists, bitmaps = saved(index_lists(reps, percent), "lists"), saved(reps.select(F.col("doc_id").alias("doc"), "n", "bits"), "bitmaps")
    dropped(spark, reps)
    freed(spark)

    def answered(pairs: DataFrame, likely: DataFrame) -> DataFrame:
        """a, b, shared, linked: the pairs with their answers; those that are not among the likely ones have no shared."""
        got = saved(compared(likely, texts, k, percent).groupBy("a", "b").agg(F.max("shared").alias("shared"), F.max("linked").alias("linked")), "compared")
        out = saved(pairs.join(got, ["a", "b"], "left").select("a", "b", "shared", F.coalesce("linked", F.lit(False)).alias("linked")), "answers")
        for done in (likely, got, pairs):
            dropped(spark, done)
        return out

    pairs = saved(lists.where("doc <> leader").select(F.col("doc").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    answers = answered(pairs, saved(alike(pairs, bitmaps, percent), "alike"))
    # An entry that only its leader could link with has no part in the rounds.
    last, lists = lists, saved(lists.where("more").drop("more"), "lists")
    dropped(spark, last)
    freed(spark)
    # What is known of a set by now: its bitmap, what it shares with its leaders, its class, and whom it was compared with in vain.
    led = answers.where("shared is not null").groupBy(F.col("a").alias("doc")).agg(F.map_from_entries(F.collect_list(F.struct("b", "shared"))).alias("led"))
    facts = saved(bitmaps.select("doc", "bits").join(led, "doc", "left"), "facts")
    dropped(spark, bitmaps)
    comp, vain = components(answers.where("linked").select("a", "b")), None
    for number in range(ROUNDS + 1):
        about = facts.join(comp, F.col("doc") == F.col("id"), "left").select("doc", "bits", "led", F.coalesce("component", "doc").alias("component"))
        if vain is None:
            about = about.withColumn("met", F.lit(None).cast("array<long>"))
        else:
            both = vain.union(vain.select("b", "a")).toDF("doc", "other").groupBy("doc").agg(F.collect_set("other").alias("met"))
            about = about.join(both, "doc", "left")
        with_facts = lists.join(about, "doc").withColumn("shared", F.when(F.col("doc") == F.col("leader"), F.col("n")).otherwise(F.element_at("led", F.col("leader"))))
        proposed = saved(open_pairs(with_facts, percent, number == ROUNDS), "open")
        if proposed.isEmpty():
            break
        pairs = saved(proposed.select("a", "b").distinct(), "pairs")
        answers = answered(pairs, pairs)
        new = answers.where("linked").select("a", "b")
        comp = components(comp.where("id <> component").select("id", "component").union(new))
        if number < ROUNDS:
            refused = answers.where("not linked").select("a", "b")
            vain = saved(refused if vain is None else vain.union(refused), "vain")
            # A list with nothing open has nothing later.
            last, lists = lists, saved(lists.join(proposed.select("token").distinct(), "token", "left_semi"), "lists")
            dropped(spark, last)
        freed(spark)
    for done in (lists, facts):
        dropped(spark, done)
    out = same.join(comp, F.col("rep") == F.col("id"), "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    out = every.select(F.col("doc_id"), F.col("n").alias("n_shingles")).join(out, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op9(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
