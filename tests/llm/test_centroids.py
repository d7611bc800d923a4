import hashlib
import math

import numpy as np
import pytest

from noctua.llm import centroids
from noctua.llm.centroids import Scan


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, id string, q int")


def plain(rows, clusters, rounds, seed="2"):
    """Whole-number k-means as the contract words it."""
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:clusters]
    cent = [q for _, q in start]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cent))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        cent = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(cent)]
    last = [(i, *near(q)) for i, q in kept]
    return sorted((i if i is not None else -1, j, d, sum(e for _, e, k in last if k == j), sum(e for _, e, _ in last),
                   hashlib.sha256(",".join(map(str, cent[j])).encode()).hexdigest()) for i, d, j in last)


BAD = [(900, None), (901, [None] + [0.5] * 7), (902, [float("nan")] * 8), (903, [float("inf")] + [0.1] * 7), (904, []), (905, [0.5] * 7), (906, [1e300] + [0.0] * 7)]


def run(spark, rows, **kw):
    got = centroids.cluster(frame(spark, [(*r, 5, "x", 1) for r in rows]), dim=8, **kw).collect()
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got)


def test_clustering_equals_plain_rounds(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((160, 8)) + rng.integers(-2, 3, (160, 1))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [rows[3]] * 60 + [(None, rows[5][1]), (7, rows[9][1])] + [(400 + i, [0.25] * 8) for i in range(20)] + [(500, [-3e4] * 8)]
    assert run(spark, rows + BAD, clusters=9, rounds=4) == plain(rows, 9, 4)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5] * 8), (2, [0.5] * 8), (3, [-0.01] * 8)]
    assert run(spark, rows, clusters=9, rounds=2) == plain(rows, 9, 2)
    assert run(spark, BAD, clusters=9, rounds=2) == [] and run(spark, [], clusters=9, rounds=2) == []


@pytest.mark.parametrize("shift", [0, 2**26])
def test_search_is_exact_and_avoids_distances(shift):
    rng = np.random.default_rng(4)
    centres = rng.integers(-400, 400, (64, 64)) + rng.integers(-3000, 3000, (64, 1)) + shift
    x = centres[rng.integers(0, 64, 3000)] + rng.integers(-60, 60, (3000, 64))
    x[:50] = (centres[:50] + centres[1:51]) // 2
    who, d, computed = Scan(np.vstack([centres, centres[:4]])).nearest(x)
    far = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (d == far.min(axis=1)).all() and (who == far.argmin(axis=1)).all()
    assert computed.mean() < 68 / 4          # most distances are avoided on spread-out clusters
