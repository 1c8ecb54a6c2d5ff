"""Embedding near-dedup: PCA-ordered tiled comparison with suffix-norm bounds."""

from __future__ import annotations

import hashlib
import math
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import arrow, saved
from quire.llm.graph import components

#: Vectors of a tile, about; bins of the leading coordinate by which tiles are cut; dimensions after which pairs are dropped.
TILE, BINS, STEPS = 512, 64, (8, 16, 32, 64, 128, 256, 512, 1024)
#: Lengths of vectors that get principal axes: the most frequent ones, up to so many components. Others keep their own axes, which changes no result.
MOST_KINDS, MOST_DIM = 8, 2048
#: Slack for rounding in the bounds; what passes them is judged on the vectors themselves.
SLACK = 1e-9


def classes_of(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, class (a hash of label and vector; null for vectors that link with nothing), vec (doubles) of columns id, label, vec."""

    def run(batches):
        import numpy as np

        for b in batches:
            rows = []
            for at, (i, label) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                raw, key, v = b.column(2)[at].as_py(), None, None
                if i is not None and label is not None and raw and None not in raw:
                    v = np.array(raw, dtype=np.float64) + 0.0  # one zero
                    if np.isfinite(v).all() and v.any():
                        key = int.from_bytes(hashlib.blake2b(f"{label}:".encode() + v.tobytes(), digest_size=8).digest(), "little", signed=True)
                rows.append((i, label, len(raw or ()), key, v.tobytes() if key is not None else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["vec_id", "label", "dim", "class", "vec"])

    return arrow(vectors, run, "vec_id long, label string, dim long, class long, vec binary")


def bases(classes: DataFrame) -> dict:
    """Principal axes by length of the MOST_KINDS most frequent lengths up to MOST_DIM, of the second moments of the unit vectors; a matrix for each comes to the driver."""
    import numpy as np

    kinds = [r["dim"] for r in classes.where(F.col("dim") <= MOST_DIM).groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MOST_KINDS).collect()]
    classes = classes.where(F.col("dim").isin(kinds)) if kinds else classes.limit(0)

    def run(batches):
        sums: dict = {}
        for b in batches:
            for d, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums.setdefault(d, []).append(np.frombuffer(v))
            for d, vs in list(sums.items()):
                if isinstance(vs, list):
                    u = np.array(vs)
                    u /= np.linalg.norm(u, axis=1, keepdims=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(np.arange(d * d)), pa.array((u.T @ u).ravel())], names=["dim", "i", "x"])
            sums = {}

    got = arrow(classes.select("dim", "vec"), run, "dim long, i long, x double").groupBy("dim", "i").agg(F.sum("x").alias("x")).collect()
    out: dict = {}
    for r in got:
        out.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[divmod(r["i"], r["dim"])] = r["x"]
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for d, m in out.items()}


def linked_pairs(a, b, basis, threshold: float):
    """Indices (i, j) of rows of a and b whose cosine is at least the threshold.

    Leading dimensions are accumulated first; a pair is dropped once what it has so far and the product of the norms of what is left
    cannot reach the threshold. The rest are judged by the cosine of the vectors themselves.
    """
    import numpy as np

    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ua, ub = a / na[:, None], b / nb[:, None]
    if basis is not None:
        ua, ub = ua @ basis, ub @ basis
    d = a.shape[1]
    steps = [s for s in STEPS if s < d] + [d]
    left = lambda u, s: np.sqrt(np.maximum(0.0, (u[:, s:] ** 2).sum(1)))
    ra, rb = {s: left(ua, s) for s in steps}, {s: left(ub, s) for s in steps}
    found = []
    for at in range(0, len(a), 128):
        s = steps[0]
        sums = ua[at : at + 128, :s] @ ub[:, :s].T
        i, j = np.nonzero(sums + ra[s][at : at + 128, None] * rb[s] >= threshold - SLACK)
        so_far = sums[i, j]
        i += at
        for last, s in zip(steps, steps[1:]):
            if not len(i):
                break
            so_far = so_far + np.einsum("ij,ij->i", ua[i, last:s], ub[j, last:s])
            ok = so_far + ra[s][i] * rb[s][j] >= threshold - SLACK
            i, j, so_far = i[ok], j[ok], so_far[ok]
        if len(i):
            ok = np.einsum("ij,ij->i", a[i], b[j]) / (na[i] * nb[j]) >= threshold
            found.append((i[ok], j[ok]))
    return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (np.zeros(0, int), np.zeros(0, int))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors.

    Rows of one label link when the cosine of their vectors, in double precision, is at least the threshold. A null label or id, and
    a vector that is null, empty, zero or holds null or non-finite components, links with nothing (a null id has a null component
    and is not kept); vectors of different lengths do not link. Repeated ids are rows of their own. An empty table gives an empty
    result; other columns are not read. A cosine at the threshold links; of ids that reach one another the smallest names them all. Equal vectors of a label are one class, which is compared once.

    Classes of a label are cut into tiles of about TILE by their leading principal coordinate. Two tiles are compared, in a task, if
    their ranges of it lie near enough for the threshold. A comparison returns a count for each class, and a forest of links, never
    pairs, so what is shuffled grows with the tiles' pairs and not with links.
    """
    spark = vectors.sparkSession
    rows = saved(classes_of(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))), "vectors")
    classes = saved(rows.where("class is not null").groupBy("class", "label", "dim").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")), "classes")
    sent, gap, key = spark.sparkContext.broadcast(bases(classes)), math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6, uuid.uuid4().hex

    @F.pandas_udf("double")
    def leading(dims: pd.Series, vecs: pd.Series) -> pd.Series:
        import numpy as np

        first = {d: m[:, 0] for d, m in sent.value.items()}
        lead = lambda d, v: float((first[d] @ v if d in first else v[0]) / np.linalg.norm(v))
        return pd.Series([lead(d, np.frombuffer(x)) for d, x in zip(dims, vecs)], dtype="float64")

    placed = saved(classes.withColumn("lead", leading("dim", "vec")).withColumn("bin", F.least(F.lit(BINS - 1), F.floor((F.col("lead") + 1) * BINS / 2).cast("int"))), "placed")
    bins = placed.groupBy("label", "dim", "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("ahead", F.sum("n").over(Window.partitionBy("label", "dim").orderBy("bin")) - F.col("n"))
    tiled = placed.join(bins, ["label", "dim", "bin"]).withColumn("tile", F.floor((F.col("ahead") + F.pmod(F.xxhash64("class"), F.col("n"))) / TILE))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        return pd.DataFrame({"label": group.label[:1], "dim": group.dim[:1], "tile": group.tile[:1], "lo": [group.lead.min()], "hi": [group.lead.max()], "ids": [group["class"].to_numpy(np.int64).tobytes()], "copies": [group.copies.to_numpy(np.int64).tobytes()], "vecs": [b"".join(group.vec)]})

    tiles = saved(tiled.select("label", "dim", "tile", "lead", "class", "copies", "vec").groupBy("label", "dim", "tile").applyInPandas(packed, "label string, dim long, tile long, lo double, hi double, ids binary, copies binary, vecs binary"), "tiles")
    x, y = tiles.alias("x"), tiles.select("label", "dim", "tile", "lo", "hi").alias("y")
    near = [F.col("x.label") == F.col("y.label"), F.col("x.dim") == F.col("y.dim"), F.col("x.tile") <= F.col("y.tile"), F.col("y.lo") - F.col("x.hi") <= gap, F.col("x.lo") - F.col("y.hi") <= gap]
    pairs = tiles.select("label", "dim", "tile", "lo", "hi").alias("x").join(y, near).select(F.col("x.label").alias("label"), F.col("x.dim").alias("dim"), F.col("x.tile").alias("s"), F.col("y.tile").alias("t"))
    halves = lambda p: tiles.select("label", "dim", F.col("tile").alias(p), *[F.col(c).alias(p + c) for c in ("ids", "copies", "vecs")])
    both = pairs.join(halves("s"), ["label", "dim", "s"]).join(halves("t"), ["label", "dim", "t"]).select("dim", "s", "t", "sids", "scopies", "svecs", "tids", "tcopies", "tvecs")

    def run(batches):
        import numpy as np

        for b in batches:
            for at in range(b.num_rows):
                d, s, t, sids, scopies, svecs, tids, tcopies, tvecs = (c[at].as_py() for c in b.columns)
                ids, copies = [np.frombuffer(v, np.int64) for v in (sids, tids)], [np.frombuffer(v, np.int64) for v in (scopies, tcopies)]
                u, v = np.frombuffer(svecs).reshape(-1, d), np.frombuffer(tvecs).reshape(-1, d)
                i, j = linked_pairs(u, v, sent.value.get(d), threshold)
                if s == t:
                    i, j = i[i < j], j[i < j]
                elif len(i):
                    j = j + len(u)
                node, many = (ids[0], copies[0]) if s == t else (np.concatenate(ids), np.concatenate(copies))
                links = np.bincount(i, many[j], len(node)) + np.bincount(j, many[i], len(node))
                root = np.arange(len(node))
                while len(i):
                    new = root.copy()
                    np.minimum.at(new, i, root[j])
                    np.minimum.at(new, j, root[i])
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(node[root[some]])], names=["class", "links", "root"])

    found = saved(arrow(both, run, "class long, links long, root long"), "links")
    comp = components(found.select("class", "root"))
    links = classes.join(found.groupBy("class").agg(F.sum("links").alias("links")), "class", "left").join(comp, F.col("class") == F.col("id"), "left").select("class", "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("comp"))
    links = links.join(links.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select("class", "n_links", "component_id")
    out = rows.select("vec_id", "class").join(links, "class", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
