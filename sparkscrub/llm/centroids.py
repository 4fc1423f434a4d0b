"""Centroids of integer vectors by scalar lookup tables.

Components are turned into integers floor(levels * x), of which few different ones occur. In every round a task tabulates, for each dimension,
each integer that occurs in its batch and each centroid, the squared difference; the distances of a vector are then 64 gathers from
these tables and their sum, in NumPy, without a multiplication per vector. Only sums and counts per cluster leave a task (k rows of one
sum per dimension); the driver holds the k centroids and nothing that grows with the table. All numbers are exact integers.

Vectors that are null, have another number of components or hold a null or non-finite one are left out. Integers beyond +-2^27 (components beyond
524,288 with 256 levels) count as that limit, so that every distance fits a long. Starting vectors are those with the smallest SHA-256 of
'seed:id'; rows that repeat an id are ordered by their components, and rows without an id come last. Fewer vectors than `k` give as many
centroids; an empty table gives an empty result. Rows that repeat an id are vectors of their own. No other columns are read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Integers are held between these bounds: (2 * 2^27)^2 * 64 is below 2^63.
LIMIT = 1 << 27
#: Vectors whose distances are worked out at once, and the range of integers up to which a plain array maps them to table rows.
ROWS, SPAN = 4096, 1 << 16


def integers(vectors: DataFrame, dim: int = 64, levels: int = 256, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that can be used, as integers."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    fine = (F.size(column) == dim) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    scaled = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * levels, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    return vectors.filter(fine).select(F.col(id_column).alias("vec_id"), scaled.alias("v"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every row of x; ties go to the smaller number."""
    sums = np.zeros((len(x), len(centroids)), dtype=np.int64)
    for d in range(x.shape[1]):
        column = x[:, d]
        low, span = int(column.min()), int(column.max()) - int(column.min()) + 1
        if span <= SPAN:
            present = np.zeros(span, dtype=bool)
            present[column - low] = True
            occurring = np.flatnonzero(present)
            code_of = np.zeros(span, dtype=np.int64)
            code_of[occurring] = np.arange(len(occurring))
            occurring, code = occurring + low, code_of[column - low]
        else:
            occurring, code = np.unique(column, return_inverse=True)
        table = occurring.astype(np.int64)[:, None] - centroids[None, :, d]
        sums += (table * table)[code]
    return sums.argmin(axis=1), sums.min(axis=1)


def _batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _matrix(part, dim)


def _sums(centroids: np.ndarray):
    """Per cluster the number of vectors of a task and their sum by dimension."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, x in _batches(batches, dim):
            cluster, _ = nearest(x, centroids)
            count += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            heads = np.flatnonzero(np.r_[True, np.diff(cluster[order]) != 0])
            total[cluster[order][heads]] += np.add.reduceat(x[order].astype(np.int64), heads, axis=0)
        met = np.flatnonzero(count)
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(met.repeat(dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(met)), pa.int32()),
                                              pa.array(count[met].repeat(dim)), pa.array(total[met].ravel())], names=["cluster", "d", "n", "total"])

    return run


def _assigned(centroids: np.ndarray):
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _batches(batches, dim):
            cluster, distance = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def fit(points: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> np.ndarray:
    """The k x dim integer centroids of (vec_id, v)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = points.select("v", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).select("v").collect()
    if not start:
        return np.zeros((0, 0), np.int64)
    centroids = np.array([r["v"] for r in start], dtype=np.int64)
    wide = "decimal(38,0)"
    for _ in range(rounds):
        parts = points.mapInArrow(_sums(centroids), "cluster int, d int, n long, total long")
        sums = parts.groupBy("cluster", "d").agg(F.sum(F.col("total").cast(wide)).alias("total"), F.sum("n").alias("n"))  # k * dim rows
        following = centroids.copy()
        for row in sums.collect():
            following[row["cluster"], row["d"]] = int(row["total"]) // row["n"]
        centroids = following
    return centroids


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, levels: int = 256) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that can be used."""
    spark = vectors.sparkSession
    points = stored(integers(vectors, dim, levels), "vectors")
    centroids = fit(points, k, rounds, seed)
    if not len(centroids):
        return points.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    assigned = stored(points.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    most = (1 << 63) - 1
    rows = [(c, min(inertia.get(c, 0), most), min(sum(inertia.values()), most), digest[c]) for c in range(len(centroids))]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, levels: int = 256) -> str:
    """The same in DuckDB: one pair of steps per round."""
    steps = [f"""p AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor({levels} * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dim})""",
             "x AS MATERIALIZED (SELECT r, d, v[d] AS x FROM p, (SELECT unnest(range(1, 65)) AS d))".replace("65", str(dim + 1)),
             f"""s AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS k FROM p QUALIFY k < {k})""",
             "c0 AS MATERIALIZED (SELECT k, d, x AS c FROM s JOIN x USING (r))"]
    for n in range(rounds + 1):
        steps.append(f"""d{n} AS (SELECT r, k, sum((x - c) * (x - c)) AS dist FROM x JOIN c{n} USING (d) GROUP BY ALL),
a{n} AS MATERIALIZED (SELECT r, k, dist FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, k) = 1)""")
        if n < rounds:
            steps.append(f"""m{n} AS (SELECT k, d, sum(x) AS total, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (SELECT k, d, CASE WHEN m.n IS NULL THEN c ELSE (total - ((total % m.n) + m.n) % m.n) // m.n END AS c FROM c{n} LEFT JOIN m{n} m USING (k, d))""")
    last = rounds
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(k AS INT) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(dist) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{last} JOIN p USING (r) JOIN (SELECT k, sha256(string_agg(CAST(c AS BIGINT)::VARCHAR, ',' ORDER BY d)) AS h FROM c{last} GROUP BY k) USING (k)"""
