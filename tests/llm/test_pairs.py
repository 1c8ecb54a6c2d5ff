"""Operators on pairs of documents or vectors, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import xxhash
from pyspark.sql import functions as F

from quire.llm import embeddings, fingerprints, graph, jaccard, suffixes


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def near_texts(prose):
    """Copies, near copies with chains of edits, a passage that many share, short and odd texts."""
    r, rows = random.Random(1), []
    for g in range(12):
        words = prose(g, 30 + 12 * g).split()
        for _ in range(9):
            rows.append(" ".join(words))
            words = list(words)
            words[r.randrange(len(words))] = r.choice(["zz", "yy", "xx"])
    shared = prose(99, 40)
    rows += [prose(200 + i, 10 + i) + " " + shared for i in range(40)]
    rows += ["", None, "one", "ONE", "one two", "one two three four", "\x1cone two\x85", "a " * 3000, "a " * 2000]
    return [(7 * i % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard_classes(documents, prose, k, percent):
    rows = near_texts(prose)
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= percent * len(sets[a] | sets[b])]
    assert len(links) > 100
    want = roots(sets, links)
    got = {r["doc_id"]: r for r in jaccard.near_classes(documents(rows), k=k, percent=percent).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_jaccard_odd_rows(documents):
    got = jaccard.near_classes(documents([(1, "a b c d e"), (1, "v w x y z"), (2, "v w x y z"), (3, "a b c d e"), (None, "a b c d e"), (None, None), (4, "q"), (4, "q")])).collect()
    found = Counter((r["doc_id"], r["component_id"]) for r in got)
    assert found == {(1, 1): 2, (3, 1): 1, (2, 2): 1, (None, None): 2, (4, 4): 2}
    assert jaccard.near_classes(documents([])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


@pytest.mark.parametrize("tile", [7, 512])
def test_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16))
    rows = [(3 * i, [float(x) for x in (centres[i % 12] + r.normal(size=16) * (0.05 + 0.02 * (i % 17))).astype(np.float32)], i % 3) for i in range(150)]
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(5)] + [(1100, rows[0][1], None), (1101, None, 0), (1102, [0.0] * 16, 0), (1103, [float("nan")] * 16, 0), (1104, [], 0), (1105, [1.0, None], 0), (1106, [-0.0, 1.0], 0), (1107, [0.0, 2.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS dim", "2 AS class", "3 AS copies")
    ok = {i: (np.array(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] / np.linalg.norm(ok[a][0]) / np.linalg.norm(ok[b][0]) >= 0.93]
    want, n = roots([x[0] for x in rows if x[0] is not None], links), Counter(x for ab in links for x in ab)
    got = {x["vec_id"]: x for x in embeddings.near_vectors(df).collect()}
    assert len(links) > 100 and len(got) == len(rows)
    for i, w in want.items():
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], w, w == i)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_very_long_vectors(spark, monkeypatch):
    """Lengths beyond those that get axes are compared all the same."""
    monkeypatch.setattr(embeddings, "MOST_DIM", 4)
    rows = [(i, [float(i % 3 == k) + 0.01 * (i % 2) for k in range(6)], 0) for i in range(9)] + [(10 + i, [1.0, float(i)], 0) for i in range(2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**{i: (2, i % 3) for i in range(9)}, 10: (0, 10), 11: (0, 11)}


def test_fingerprints(documents, prose):
    rows = [(5 * i, " ".join(random.Random(i).choice(["the", "is", "est", "und", "of", "de", *prose(i, 30).split()]) for _ in range(3 * i)) + "é😀") for i in range(40)] + [(1001, ""), (1002, None), (1003, "..."), (1004, "one two"), (1005, "one two")]
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(documents(rows)).collect()}

    def signatures(t):
        low = "\x02" + re.sub(r"[.!?\n]", "\x02", t.lower())
        w = [x[0] if x[0] == "\x02" else x for x in re.findall(r"\x02(?:[^a-z0-9\u0080-\U0010ffff])*|[a-z0-9\u0080-\U0010ffff]+", low)]
        anchor = lambda x: x == "\x02" or x in fingerprints.ANCHORS
        kept = [x for x in w if anchor(x) or x not in fingerprints.COMMON]
        out = {" ".join(["\x01" + x, *c]) + " " for i, x in enumerate(kept) if anchor(x) for c in [[y for y in kept[i + 1 :] if not anchor(y)][:2]] if len(c) == 2}
        words = " " + " ".join(w) + " "
        return {xxhash.xxh64_intdigest(c.encode(), seed=42) for c in out or ({"=" + (words if words.replace("\x02", "").strip() else t)} if t else ())}

    told = lambda x: "".join(f"{h:016x}" for h in sorted(x, key=lambda h: h - (h >> 63 << 64)))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, b, c = signatures(t), signatures(edited), signatures(after)
        x = got[i]
        assert (x["n_chars"], x["edited_sha256"], x["fingerprint"], x["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), told(a), told(b)), i
        assert x["near_edited"] == pytest.approx(like(a, b)) and x["near_next"] == pytest.approx(like(a, c))
    few = fingerprints.edited_fingerprints(documents([(None, "the one two three"), (3, "x"), (3, "x")])).collect()
    assert Counter(r["doc_id"] for r in few) == {None: 1, 3: 2}
    assert fingerprints.edited_fingerprints(documents([(1, "abcdefgh")])).first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprints.edited_fingerprints(documents([])).count() == 0


def test_length_partitions_prune_only_what_cannot_be_alike(spark):
    sizes = [0, 1, 2, 3, 7, 9, 10, 11, 49, 50, 51, 99, 100, 101, 2500, 2501]
    rows = [(n, m, list(range(n)), list(range(m))) for n in sizes for m in sizes]
    df = spark.createDataFrame(rows, "n int, m int, a array<long>, b array<long>")
    for least in (0.02, 0.1, 0.8):
        got = df.select("n", "m", fingerprints.likeness(F.col("a"), F.col("b"), least).alias("x"), fingerprints.length_part(F.col("n"), least).alias("p"), fingerprints.length_part(F.col("m"), least).alias("q")).collect()
        for r in got:
            want = min(r["n"], r["m"]) / max(r["n"], r["m"]) if r["n"] or r["m"] else 1.0
            assert r["x"] == pytest.approx(want if want >= least else 0.0)
            assert want < least or abs(r["p"] - r["q"]) <= 1
        assert any(abs(r["p"] - r["q"]) > 1 for r in got)


def test_exchange_of_texts_is_shared(spark, documents, prose):
    many = documents([(i, prose(i, 20)) for i in range(300)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = fingerprints.edited_fingerprints(many)
        assert len(out.collect()) == 300 and "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def removed(rows, n):
    """(doc_id, text) to the result by definition."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            if d is not None:
                first[b[p : p + n]] = min(first.get(b[p : p + n], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if d is not None and first[b[p : p + n]] < d:
                gone[p : p + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (q and gone[q - 1]) for q, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffixes(documents, prose):
    r = random.Random(4)
    passages = [prose(1000 + i, 25) for i in range(6)]
    rows = [(3 * i, " ".join(r.choice([*passages, prose(i, 8), prose(i + 1, 8)]) for _ in range(r.randint(1, 6)))) for i in range(80)]
    rows += [(9, rows[0][1]), (9, rows[1][1]), (None, rows[2][1]), (None, None), (500, ""), (501, "a" * 300), (502, "a" * 120), (503, "ab" * 100), (504, "ba" * 60), (505, "é😀" * 40), (506, "😀é" * 40), (507, "x" * 49), (508, "x" * 49), (509, passages[0][:50]), (510, passages[0][1:51] + "!")]
    got = sorted((tuple(x) for x in suffixes.removals(documents(rows, 3)).collect()), key=str)
    assert got == removed(rows, 50)
    assert suffixes.removals(documents([])).count() == 0


def test_interval_expansion_finds_the_common_prefixes():
    r = random.Random(6)
    for least in (3, 8, 20):
        chunks = ["".join(r.choice("ab") for _ in range(r.randint(least, 30))).encode() for _ in range(12)]
        symbols = np.array([x for c in chunks for x in [*(b - 96 for b in c), 0]], np.uint8)
        order = suffixes.suffix_order(symbols, least)
        got = suffixes.shared_prefixes(symbols, order, least)
        for i in range(1, len(order)):
            a, b = symbols[order[i - 1] :].tolist(), symbols[order[i] :].tolist()
            lcp = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y or not x), min(len(a), len(b)))
            assert got[i] == (lcp < least)


def test_all_bytes_and_wide_alphabets():
    r = random.Random(8)
    for kinds in (2, 100, 256):
        chunks = list({bytes(r.randrange(kinds) for _ in range(5)) + bytes(range(kinds))[:40] + bytes(r.randrange(kinds) for _ in range(r.randint(0, 5))) for _ in range(30)})
        docs, n = np.array([r.randrange(9) for _ in chunks]), 6
        got, starts = suffixes.repeated(chunks, docs, n)
        first = {}
        for c, d in zip(chunks, docs):
            for p in range(len(c) - n + 1):
                first[c[p : p + n]] = min(first.get(c[p : p + n], d), d)
        for c, s in zip(chunks, starts):
            assert got[s : s + len(c) - n + 1].tolist() == [first[c[p : p + n]] for p in range(len(c) - n + 1)]


def test_ids_are_dealt_as_in_spark(spark):
    ids = [0, 1, -1, 16, 64, 1 << 40, -(1 << 63), (1 << 63) - 1, *range(0, 6400, 64)]
    want = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("pmod(xxhash64(i), 16)").collect()]
    assert suffixes.hashed(np.array(ids, np.int64), 16).tolist() == want and len(set(want[8:])) > 10


def test_many_rows_of_one_id_and_a_passage_in_all_documents(documents, prose):
    """More rows of one id than 16 bits count, ids in steps of 64, and one passage everywhere."""
    common = prose(77, 30)
    rows = [(1, "short")] * 70_000 + [(64 * i, f"{prose(i, 6)} {common} {prose(i + 500, 6)}") for i in range(1, 60)] + [(1, common), (1, common)]
    got = {(r["doc_id"], r["n_removed"]) for r in suffixes.removals(documents(rows, 4)).collect()}
    want = {(d, x) for d, _, x, *_ in removed([x for x in rows if x[1] != "short"], 50)}
    assert got == want | {(1, 0)} and len({x for _, x in want}) > 1


def test_passages_own_their_windows(prose):
    where = defaultdict(set)
    for seed in range(3):
        data = (prose(seed, 60) + " " + prose(50, 40)).encode()
        start, end, key = suffixes.passages(np.frombuffer(data, np.uint8), 50)
        windows = []
        for s, e, k in zip(start.tolist(), end.tolist(), key.tolist()):
            for p in range(s, e - 49):
                windows.append(p)
                where[data[p : p + 50]].add(k)
        assert windows == list(range(len(data) - 49))
    assert all(len(k) == 1 for k in where.values())
