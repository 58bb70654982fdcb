"""Yinyang k-means against plain k-means in Python's integers."""

import hashlib
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF

from framewright.llm import centroids
from framewright.llm.centroids import Yinyang
from framewright.llm.queries import op13_centroid_clusters


def plainly(rows, rule):
    """``{id: (cluster, distance)}`` and the centroids; ids are unique."""
    kept = {}
    for i, v in rows:
        if v is not None and len(v) == rule.dims and all(x is not None and math.isfinite(x) for x in v):
            kept[i] = [math.floor(rule.scale * float(x)) for x in v]
    first = sorted(kept, key=lambda i: hashlib.sha256(f"{rule.seed}:{i}".encode()).hexdigest())[: rule.k]
    middle = [kept[i] for i in first]
    for r in range(rule.rounds + 1):
        of = {i: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(middle)) for i, v in kept.items()}
        if r < rule.rounds:
            for n in range(len(middle)):
                mine = [kept[i] for i in kept if of[i][1] == n]
                if mine:
                    middle[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return {i: (n, d) for i, (d, n) in of.items()}, middle


def held(spark, rows, rule):
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, own int")
    got = {r.vec_id: r for r in rule.clusters(docs).collect()}
    want, middle = plainly(rows, rule)
    assert {i: (r.cluster, r.distance) for i, r in got.items()} == want
    sums = {n: sum(d for m, d in want.values() if m == n) for n, _ in want.values()}
    for r in got.values():
        assert (r.cluster_inertia, r.inertia) == (sums[r.cluster], sum(sums.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, middle[r.cluster])).encode()).hexdigest()


def test_whole_table_equals_plain_k_means(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet")
    want, middle = plainly(list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist(), strict=True)), Yinyang())
    got = {r.vec_id: (r.cluster, r.distance) for r in op13_centroid_clusters(spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_ties_copies_and_empty_clusters(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(0, 3, 2)]) for i in range(150)]  # few places: many ties and copies of centroids
    held(spark, rows, Yinyang(dims=2, k=8, rounds=4, scale=1.0, n_groups=3))


def test_vectors_that_are_left_out(spark):
    good = [(i, [i * 0.3, -i * 0.7, 1.0]) for i in range(5)]
    bad = [(10, None), (11, []), (12, [1.0, 2.0]), (13, [1.0, None, 2.0]), (14, [float("nan"), 0.0, 0.0]), (15, [float("inf"), 0.0, 0.0]), (16, [-float("inf"), 0.0, 0.0])]
    held(spark, good + bad, Yinyang(dims=3, k=16, rounds=3))
    rule = Yinyang(dims=3)
    docs = spark.createDataFrame(bad, "vec_id long, embedding array<double>")
    assert rule.clusters(docs).count() == rule.clusters(docs.limit(0)).count() == 0
    big = spark.createDataFrame([(1, [1e30, 0.0, 0.0]), (None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.distance) for r in rule.clusters(big).collect()] == [(None, 0)] * 2


def test_bounds_save_distances_and_change_nothing():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c * 100, 9, (400, 6)) for c in range(8)]).astype(np.int64)
    middle = x[rng.choice(len(x), 24, replace=False)]
    groups = centroids.grouped(middle, 5)
    own, upper, lower, _ = centroids.first_assignment(x, middle, groups)
    saved = []
    for _ in range(12):
        after = np.stack([x[own == c].sum(0) // max(1, (own == c).sum()) if (own == c).any() else middle[c] for c in range(len(middle))])
        moved = np.sqrt(((after - middle) ** 2).sum(1).astype(float)) * (1 + centroids.SLACK)
        middle = after
        own, upper, lower, scanned = centroids.next_assignment(x, own, upper, lower, middle, groups, moved)
        d = centroids.squared(x, middle)
        assert (own == d.argmin(1)).all()
        saved.append(scanned / d.size)
        root = np.sqrt(d.astype(float))
        assert (upper >= root[np.arange(len(x)), own] * (1 - 1e-9)).all()
        root[np.arange(len(x)), own] = np.inf
        for g in range(groups.max() + 1):
            assert (lower[:, g] <= root[:, groups == g].min(1) * (1 + 1e-9)).all()
    assert saved[-1] < 0.2 and saved[0] < 0.9


def test_groups_are_dense():
    same = np.zeros((5, 3), dtype=np.int64)
    assert set(centroids.grouped(same, 4)) == {0}
    assert len(centroids.grouped(np.zeros((0, 3), dtype=np.int64), 4)) == 0
