"""The pipeline's stages, each judged on its own input."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F
from quire.llm import common, jaccard, queries

D = "/root/testdata/sf0.001"


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 14))


def test_stages(spark, documents, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang", "source").collect()][:90]
    rows += [(9001, rows[0][1], "en", "s"), (9002, None, None, "s"), (9003, "123", "en", "s"), (None, rows[1][1] + " tail", "en", "s"), (9004, rows[2][1] + ' password = "hunter2222"', "en", "s")]
    docs, seen = documents(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    ids = lambda name: Counter(r["doc_id"] for r in seen[name])
    every = Counter(r[0] for r in rows)
    assert ids("language ID") == every - Counter([9002, 9003])

    sets = defaultdict(set)
    for r in seen["language ID"]:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"].translate({c: c + 32 for c in range(65, 91)}))
        sets[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    up = {i: i for i in sets if i is not None}
    root = lambda x: x if up[x] == x else root(up[x])
    for a in up:
        for b in up:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert set(ids("near copies")) == {i for i in up if root(i) == i} | {None}

    before = {r["doc_id"]: r for r in seen["near copies"]}
    assert ids("secrets") == ids("near copies")
    for r in seen["secrets"]:
        assert not re.search(r"(?i:password|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"])
        if "[secret]" not in r["text"]:
            assert r == before[r["doc_id"]]
        else:
            assert r["n_chars"] == len(r["text"])
    assert set(ids("mixing")) <= set(ids("secrets")) and max(ids("mixing").values()) <= 2
    words = sum(len(r["text"].split()) for r in seen["mixing"])
    assert abs(words / sum(len(r["text"].split()) for r in seen["secrets"]) - 1.5) < 0.25
    pieces = defaultdict(int)
    for r in seen["packing"]:
        pieces[r["doc_id"]] += r["length"]
    assert set(pieces) == set(ids("mixing"))
    assert all(pieces[r["doc_id"]] == ids("mixing")[r["doc_id"]] * r["doc_tokens"] for r in seen["packing"])


def test_empty_table(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
    assert docs.count() == 0


def test_nothing_learned_drops_no_text_with_letters(spark, documents):
    rows = [(1, "the words of a text"), (2, None), (3, ""), (4, "123 … 4_5"), (5, "ж"), (None, "no id")]
    got = corpus_pipeline.identified(spark, documents(rows), D)
    assert {r["doc_id"] for r in got.collect()} == {1, 5, None} and got.columns == documents(rows).columns


def test_rows_of_one_id_take_their_own_copies(spark, documents):
    """Rows without an id and rows that share one are mixed one by one: as many words as the mix takes, no row more than twice."""
    rows = [(None, " ".join(["w"] * n), "en", "a") for n in (3, 3, 40, 7)] + [(5, " ".join(["v"] * n), "en", "a") for n in (11, 2)] + [(i, "x y z", "en", "b") for i in range(10, 60)] + [(None, None, None, None)]
    docs = documents(rows)
    from quire.llm import mixing

    want = Counter()
    for r in mixing.mix(docs).collect():
        want[(r["doc_id"], r["size"])] += r["copies"]
    got = Counter((r["doc_id"], len(r["text"].split())) for r in corpus_pipeline.mixed(spark, docs, D).collect())
    assert got == +want
    most = Counter((i, len((t or "").split())) for i, t, *_ in rows)
    assert all(got[k] <= 2 * most[k] for k in got)


def test_helper_columns_leave_columns_of_the_same_names(spark, documents):
    odd = ["_p", "_text", "_before", "_base", "_added", "_copies", "_copy", "_size", "_nth", "_of"]
    docs = documents([(i, f"some words of text {i} and password = hunter{i}22x", "en", "s") for i in range(8)]).selectExpr("*", *[f"'{c}' AS {c}" for c in odd])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, D)
        assert docs.columns[-len(odd) :] == odd
    assert docs.count() > 0 and all(r[c] == c for r in docs.collect() for c in odd)


def shuffled(spark) -> int:
    """Bytes written to shuffle files so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def noise(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(f"{r.getrandbits(64):x}" for _ in range(words))


def unbroadcast(spark, run):
    """run(), in a session in which no table is small enough to be broadcast of Spark's own accord, and the bytes it shuffled."""
    before, key = shuffled(spark), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        return run(), shuffled(spark) - before
    finally:
        spark.conf.unset(key)


def test_mixing_shuffles_few_texts(spark, documents, tmp_path):
    """Most rows are told their copies by the bitmap; ids that share a slot, null and repeated ids get theirs too."""
    rows = [(i, noise(i, 250), "en", "abc"[i % 3]) for i in range(300)] + [(i + common.VALUE_SLOTS, noise(1000 + i, 30), "en", "abc"[i % 3]) for i in range(9)]
    rows += [(None, noise(2000, 20), "en", "a"), (None, noise(2001, 30), "en", "b"), (7, noise(2002, 40), "en", "b"), (8, None, "en", "b")]
    documents(rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    from quire.llm import mixing

    want = Counter()
    for r in mixing.mix(docs).collect():
        want[(r["doc_id"], r["size"])] += r["copies"]
    out, moved = unbroadcast(spark, lambda: corpus_pipeline.mixed(spark, docs, D).collect())
    assert Counter((r["doc_id"], len((r["text"] or "").split())) for r in out) == +want
    assert moved < 0.2 * sum(len(r[1] or "") for r in rows)


def test_near_copies_shuffles_few_texts_and_leaves_few_files(spark, documents, tmp_path):
    rows = [(i, noise(i, 250)) for i in range(200)] + [(500 + i, noise(i, 249)) for i in range(5)] + [(None, noise(3, 250)), (3, noise(3, 250))]
    documents(rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    here = Path(common.shared_dir(spark).removeprefix("file:").replace("//", "/"))
    held = lambda: sum(p.stat().st_size for p in here.rglob("*.parquet"))
    before = held()
    out, moved = unbroadcast(spark, lambda: corpus_pipeline.one_of_each(spark, docs, D).collect())
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows if r[0] is None or r[0] < 500)
    texts = sum(len(t) for _, t in rows)
    assert moved < 0.75 * texts and held() - before < 0.2 * texts


def test_parts_by_bitmaps(spark):
    """What parted() and told_by_slot() hand on: every row once, null ids, repeated ids, ids that share a slot and odd values included."""
    n = common.VALUE_SLOTS
    rows = [(i, i % 3) for i in range(40)] + [(3 + n, 1), (4 + n, 1), (5 - n, 2), (60, 7), (61, None), (62, 1), (62, 2), (None, 1)]
    df = spark.createDataFrame(rows, "id long, v int")
    told, rest = common.told_by_slot(df.withColumn("_map0", F.lit("x")), "id", df, "got", range(3))
    assert all(r["got"] == r["v"] and r["_map0"] == "x" for r in told.collect()) and told.count() > 35
    assert Counter(told.select("id", "v").collect()) + Counter(rest.select("id", "v").collect()) == Counter(rows)
    assert {r["id"] for r in rest.collect()} == {3, 3 + n, 60, 61, 62, None}
    sure, may = common.parted(df, "id", df.where("id < 10").select("id"))
    assert Counter(sure.collect()) + Counter(may.collect()) == Counter(rows)
    assert not {r["id"] for r in sure.collect()} & set(range(10)) and may.count() < 20


def test_bitmaps_leave_every_link(spark, documents, prose):
    """alike() keeps each pair that links, of sets of unlike sizes too, and few of the others."""
    words = [prose(i, 200 + 30 * i).split() for i in range(8)]
    rows = [(100 * i + j, " ".join(w[: len(w) - 12 * j])) for i, w in enumerate(words) for j in range(6)]
    made = jaccard.sets(documents(rows), 5, 80).selectExpr("doc_id AS doc", "n", "bits")
    ids = spark.createDataFrame([(a, b) for a, _ in rows for b, _ in rows if a < b], "a long, b long")
    kept = {tuple(r) for r in jaccard.alike(ids, made, 80).collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links and links <= kept and len(kept) < 1.5 * len(links)
