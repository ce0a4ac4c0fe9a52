"""Centroid clustering with the threshold algorithm.

Components are scaled to integers, so that distances, sums and centroids are exact and no order of addition matters.
The nearest centroid of a vector is searched as in a database of sorted lists: for every dimension the centroids lie in
the order of their value there, and each list is walked outward from the vector's own value, one centroid a step.  A
centroid met for the first time gets its exact distance.  A centroid met in no list yet is in every dimension at least
as far as that list's frontier; so the walk stops when the sum of the squared frontier distances strictly exceeds the best
exact distance (strictly: a centroid as near but with a smaller number may still come).

A round is one pass over the vectors: tasks walk blocks of vectors with NumPy and hand on one row of sums for each
centroid, which Spark adds up; the driver sees as many rows as there are centroids.

Defined cases: vectors that are null, have another number of components, or a null or non-finite one are left out;
scaled components beyond 2**27 count as 2**27 (likewise below), so that a squared distance fits a long; repeated rows
are vectors of their own; a vector without an id is clustered but starts no centroid before those with one; fewer
vectors than centroids give as many centroids as vectors; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

CELLS = 1 << 19  # numbers of one working array
_FAR = np.int64(1) << np.int64(28)  # beyond any distance in one dimension
_LIMIT = 1 << 27


def whole_vectors(vectors: DataFrame, size: int = 64, scale: int = 256, column: str = "embedding") -> DataFrame:
    """(vec_id, q): the usable vectors with components floor(scale * x)."""
    x = F.col(column)
    usable = (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(float(_LIMIT))), F.lit(float(-_LIMIT)))).cast("int"))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("q"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance) of each row, and how many exact distances it took."""
    k, dims = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable").T  # (dims, k): the sorted lists
    value = np.take_along_axis(centroids.T, order, axis=1)
    cluster, distance, asked = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    right = np.stack([np.searchsorted(value[d], x[:, d]) for d in range(dims)], axis=1) if len(x) else np.zeros((0, dims), np.int64)
    left = right - 1
    found = np.full((len(x), k), np.iinfo(np.int64).max)
    seen = np.zeros((len(x), k), bool)
    rows, dim = np.arange(len(x)), np.arange(dims)
    while len(rows):
        here = x[rows]
        down = np.where(left >= 0, here - value[dim, np.maximum(left, 0)], _FAR)
        up = np.where(right < k, value[dim, np.minimum(right, k - 1)] - here, _FAR)
        lower = down <= up
        met = order[dim, np.where(lower, left, np.minimum(right, k - 1))]
        frontier = np.minimum(down, up)
        left, right = left - lower, right + ~lower
        before = seen.copy()
        seen[np.arange(len(rows))[:, None], met] = True
        row, centroid = np.nonzero(seen & ~before)
        for at in range(0, len(row), CELLS // dims + 1):
            part = slice(at, at + CELLS // dims + 1)
            found[row[part], centroid[part]] = ((here[row[part]] - centroids[centroid[part]]) ** 2).sum(axis=1)
        asked += len(row)
        best = found.min(axis=1)
        done = ((frontier**2).sum(axis=1) > best) | seen.all(axis=1)
        cluster[rows[done]], distance[rows[done]] = found[done].argmin(axis=1), best[done]
        stay = ~done
        rows, left, right, found, seen = rows[stay], left[stay], right[stay], found[stay], seen[stay]
    return cluster, distance, asked


def _blocks(batches, centroids: np.ndarray):
    """Runs of rows with their nearest centroids; a run fits the working arrays."""
    size = centroids.shape[1]
    step = max(1, CELLS // (size + len(centroids)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            rows = batch.slice(at, step)
            x = rows.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
            yield rows, x, *nearest(x, centroids)[:2]


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of vectors (vec_id, q)."""
    def task(batches):
        for rows, _, cluster, distance in _blocks(batches, centroids):
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "q").mapInArrow(task, "vec_id bigint, cluster int, distance bigint")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of their vectors, empty ones stay."""
    k, size = centroids.shape

    def task(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for _, x, cluster, _ in _blocks(batches, centroids):
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, x)
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used])] + [pa.array(total[used, d]) for d in range(size)],
                                             ["cluster", "n"] + [f"s{d}" for d in range(size)])

    sums = ["n"] + [f"s{d}" for d in range(size)]
    parts = vectors.select("q").mapInArrow(task, "cluster int, " + ", ".join(f"{c} bigint" for c in sums))
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in sums]).collect():  # k rows
        out[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(size)]
    return out


def seeds(vectors: DataFrame, k: int = 40, seed: int = 2) -> np.ndarray:
    """The k vectors with the smallest hash of their id, in the order of the hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(key.alias("key"), "q").orderBy(F.asc_nulls_last("key"), "q").limit(k).collect()
    return np.array([r["q"] for r in first], np.int64)


def fit(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> np.ndarray:
    """(k, size) integer centroids of vectors (vec_id, q), which are read rounds + 1 times: pass a stored table."""
    centroids = seeds(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    return centroids


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, scale: int = 256, column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    spark = vectors.sparkSession
    whole = stored(whole_vectors(vectors, size, scale, column))
    centroids = fit(whole, k, rounds, seed)
    if not len(centroids):
        centroids = np.zeros((1, size), np.int64)  # no vector will ask
    placed = stored(assign(whole, centroids))
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # at most k rows
    top = 2**63 - 1
    everything = min(top, sum(int(r["d"]) for r in sums))
    facts = [(r["cluster"], min(top, int(r["d"])), everything, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in sums]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def comparison_sql(k: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, scale: int = 256) -> str:
    """The same by brute force."""
    parts = [f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
             f"""c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, q) - 1 AS INTEGER) AS cluster, q FROM (
  SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, q FROM kept ORDER BY h, q LIMIT {k}))""",
             f"comp AS (SELECT r, unnest(q) AS x, unnest(range({size})) AS i FROM kept)"]
    for n in range(rounds + 1):
        parts.append(f"""e{n} AS (SELECT cluster, unnest(q) AS y, unnest(range({size})) AS i FROM c{n})""")
        parts.append(f"""a{n} AS (SELECT r, arg_min(cluster, d * 1000 + cluster) AS cluster, min(d) AS distance FROM (
  SELECT r, cluster, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM comp JOIN e{n} USING (i) GROUP BY r, cluster) GROUP BY r)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
  SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN comp USING (r) GROUP BY cluster, i) GROUP BY cluster
  UNION ALL SELECT cluster, q FROM c{n} WHERE cluster NOT IN (SELECT cluster FROM a{n}))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (cluster)"""
