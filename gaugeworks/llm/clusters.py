"""Nearest centroids by a progressive search over Walsh-Hadamard coefficients, and rounds of centroid clustering.

The transform is exact on integers and multiplies squared distances by DIMS. Coefficients are taken from coarse to fine (by
sign changes); as soon as a centroid's sum so far exceeds the whole sum of a rival, it is strictly worse and left. What
remains is finished over all coefficients, so distances and ties are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import stored

DIMS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components beyond this (once scaled) are left out as infinite ones are: their squared distances, times DIMS, would not fit in a long.
LIMIT = 1 << 24
#: Where a step of the search ends, in coefficients.
STEPS = (4, 8, 16, 32, 64)
#: Vectors compared at once; bounds a task's memory.
BLOCK = 4096


def transform_matrix() -> np.ndarray:
    """The Walsh-Hadamard matrix with rows ordered by their sign changes: coarse ones first. It is its own inverse, times DIMS, when transposed."""
    i = np.arange(DIMS)
    signs = np.array([[1 - 2 * (bin(a & b).count("1") & 1) for b in i] for a in i], np.int64)
    return signs[np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1), kind="stable")]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of coefficients the number of the nearest centroid (the smallest of equals), the squared distance times DIMS, and how many terms were summed."""
    rows, k = len(vectors), len(centroids)
    part = np.zeros((rows, k), np.int64)
    alive = np.ones((rows, k), bool)
    bound = np.full(rows, np.iinfo(np.int64).max)
    start = terms = 0
    for end in STEPS:
        at, of = np.nonzero(alive)
        gap = vectors[at, start:end] - centroids[of, start:end]
        part[at, of] += np.einsum("ij,ij->i", gap, gap)
        terms += len(at) * (end - start)
        start = end
        if end < DIMS:
            # the whole distance of the best so far bounds the least one; what already exceeds it can't even be equal
            best = np.argmin(np.where(alive, part, np.iinfo(np.int64).max), axis=1)
            rest = vectors[:, end:] - centroids[best, end:]
            bound = np.minimum(bound, part[np.arange(rows), best] + np.einsum("ij,ij->i", rest, rest))
            alive &= part <= bound[:, None]
    found = np.argmin(np.where(alive, part, np.iinfo(np.int64).max), axis=1)
    return found, part[np.arange(rows), found], terms


def _coefficients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matrix = transform_matrix().T.astype(np.float64)
    for batch in batches:
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
        w = np.rint(flat.astype(np.float64) @ matrix).astype("<i4")  # sums of 64 numbers up to 2 ** 24: exact
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in w], pa.binary())], ["vec_id", "w"])


def _search(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            cut = batch.slice(a, BLOCK)
            w = np.frombuffer(b"".join(cut.column(1).to_pylist()), "<i4").reshape(-1, DIMS).astype(np.int64)
            found, far, _ = nearest(w, centroids)
            yield cut.column(0), w, found, far // DIMS


def _sums(centroids: np.ndarray):
    """One row for each centroid and task: how many vectors it has, and the sums of their coefficients."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for _, w, found, _ in _search(batches, centroids):
            for c in np.unique(found):
                mine = found == c
                total[c] += w[mine].sum(axis=0)
                count[c] += mine.sum()
        has = np.flatnonzero(count)
        columns = [pa.array(has, pa.int32()), pa.array(count[has]), pa.array(total[has].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, found, far in _search(batches, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def _kept(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, q``: vectors of DIMS finite components within LIMIT, as scaled integers."""
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(F.when(F.abs(x.cast("double")) <= LIMIT / SCALE, SCALE * x.cast("double"))))
    good: Column = (F.size(vector_col) == DIMS) & F.forall("q", lambda x: x.isNotNull())
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col), scaled.alias("q")).where(good).select("vec_id", "q")


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of every usable vector after ``rounds`` rounds, and the centroids.

    Vectors whose size isn't DIMS, or with a null, NaN or infinite component, or one beyond LIMIT, are left out. Centroids
    start as the k vectors whose ids hash lowest (null ids last; repeated ids by their components); fewer vectors make
    fewer centroids, none make none. Rows that repeat count each.

    Vectors are transformed once and stored. A round sends k centroids out and k sums a task back, whatever the input's
    size or how many vectors are equal.
    """
    kept = _kept(vectors, id_col, vector_col)
    matrix = transform_matrix()
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    coded = stored(kept.mapInArrow(_coefficients, "vec_id long, w binary"), "coefficients")
    first = kept.orderBy(order.asc_nulls_last(), "q").limit(k).select("q").collect()
    centroids = [list(r["q"]) for r in first]
    for _ in range(rounds if centroids else 0):
        now = np.array(centroids, np.int64) @ matrix.T
        parts = coded.mapInArrow(_sums(now), "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("j", "x"))
        summed = parts.groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        sums: dict[int, dict[int, tuple[int, int]]] = {}
        for r in summed.collect():
            sums.setdefault(r["cluster"], {})[r["j"]] = int(r["x"]), r["n"]
        for c, found in sums.items():
            # back from coefficients to components, DIMS times too large, in whole numbers of any size
            centroids[c] = [sum(s * found[j][0] for j, s in enumerate(signs)) // (DIMS * found[0][1]) for signs in matrix.T.tolist()]
    now = np.array(centroids, np.int64).reshape(-1, DIMS) @ matrix.T
    return coded.mapInArrow(_assigned(now), "vec_id long, cluster int, distance long"), centroids


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """Every usable vector's cluster. An inertia that doesn't fit in a long is null."""
    found, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = stored(found, "assigned")
    inertia = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    named = spark.createDataFrame([(c, ",".join(map(str, x))) for c, x in enumerate(centroids)], "cluster int, listed string")
    each = inertia.join(F.broadcast(named), "cluster").select("cluster", "cluster_inertia", F.sha2(F.col("listed").cast("binary"), 256).alias("centroid_sha256"))
    whole = inertia.agg(F.try_sum("cluster_inertia").alias("inertia"))
    return found.join(F.broadcast(each), "cluster").crossJoin(F.broadcast(whole)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    near = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    assign = lambda r: f"a{r} AS MATERIALIZED (SELECT rid, cluster, d FROM (SELECT v.rid, c.cluster, {near} AS d, row_number() OVER (PARTITION BY v.rid ORDER BY {near}, c.cluster) AS k FROM v, c{r} c) WHERE k = 1)"
    parts = [assign(0)]
    for r in range(1, ROUNDS + 1):
        sums = f"SELECT cluster, list(m ORDER BY j) AS q FROM (SELECT cluster, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS m FROM (SELECT cluster, unnest(q) AS x, unnest(range({DIMS})) AS j FROM a{r - 1} JOIN v USING (rid)) GROUP BY cluster, j) GROUP BY cluster"
        parts.append(f"c{r} AS MATERIALIZED (SELECT c.cluster, coalesce(n.q, c.q) AS q FROM c{r - 1} c LEFT JOIN ({sums}) n USING (cluster))")
        parts.append(assign(r))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x::DOUBLE) > {LIMIT // SCALE})) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, q)::INT - 1 AS cluster, q FROM v ORDER BY cluster LIMIT {CENTROIDS}),
{", ".join(parts)},
i AS (SELECT cluster, sum(d)::BIGINT AS cluster_inertia FROM a{ROUNDS} GROUP BY cluster)
SELECT vec_id, cluster, d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a{ROUNDS}) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (rid) JOIN i USING (cluster) JOIN c{ROUNDS} c USING (cluster)
"""


SQL = _sql()
