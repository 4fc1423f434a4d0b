import hashlib
import math
import random

import numpy as np
import pytest

from sparkscrub.llm import centroids


def brute(vectors, k, rounds, dim, levels=256, seed=2):
    """[(id, cluster, distance)], centroids; all integers of any size."""
    limit = centroids.LIMIT
    kept = [(i, [math.floor(max(min(levels * c, limit), -limit)) for c in v]) for i, v in vectors if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((i, d.index(min(d)), min(d), v))
        return out

    for _ in range(rounds):
        rows = assign()
        for c in range(len(centres)):
            own = [r[3] for r in rows if r[1] == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own)]
    return [r[:3] for r in assign()], centres


def made(n, dim, spread, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, spread) for _ in range(dim)]) for i in range(n)]
    rows += [(900, [0.5] * dim), (900, [0.5] * dim), (900, [-0.25] * dim), (None, [0.1] * dim)]  # repeats, ties, no id
    rows += [(901, None), (902, []), (903, [0.1] * (dim - 1)), (904, [None] + [0.1] * (dim - 1)), (905, [math.nan] + [0.1] * (dim - 1)), (906, [math.inf] * dim), (907, [-0.0] * dim)]
    return rows


@pytest.mark.parametrize("spread", [0.2, 400.0])  # few and many different integers
def test_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(centroids, "ROWS", 37)
    vectors = made(300, 8, spread)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, cluster int, v int").repartition(6)
    rows = centroids.clusters(df, k=9, rounds=3, dim=8).collect()
    want, centres = brute(vectors, 9, 3, 8)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in rows), key=key) == sorted(want, key=key)
    sums = {c: sum(r[2] for r in want if r[1] == c) for c in range(9)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    assert all(r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums.values()) and r.centroid_sha256 == digest[r.cluster] for r in rows)


def test_few_none_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.clusters(spark.createDataFrame([], schema)).collect() == []
    assert centroids.clusters(spark.createDataFrame([(1, None)], schema)).collect() == []
    vectors = [(1, [1e30] * 64), (2, [-1e30] * 64), (3, [0.0] * 64)]
    rows = {r.vec_id: r for r in centroids.clusters(spark.createDataFrame(vectors, schema)).collect()}
    assert len(rows) == 3 and all(r.distance == 0 for r in rows.values())
    two = centroids.clusters(spark.createDataFrame(vectors, schema), k=1, rounds=0).collect()
    assert max(r.distance for r in two) in (64 * (2 * centroids.LIMIT) ** 2, 64 * centroids.LIMIT ** 2)


def test_ties_go_to_the_smaller_number():
    cluster, distance = centroids.nearest(np.array([[0, 0], [3, 3]], dtype=np.int32), np.array([[1, 0], [-1, 0], [3, 3]]))
    assert cluster.tolist() == [0, 2] and distance.tolist() == [1, 0]
