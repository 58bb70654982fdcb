"""Numpy kernels against brute force and closed forms."""

from itertools import permutations

import numpy as np
import pytest

from framewright.functions import kernels as k


def box(x=0.0, y=0.0, z=0.0, length=4.0, width=2.0, height=1.5, yaw=0.0):
    c, s = np.cos(yaw), np.sin(yaw)
    out = []
    for up in (-0.5, 0.5):
        for sx, sy in ((1, 1), (1, -1), (-1, -1), (-1, 1)):
            dx, dy = sx * length / 2, sy * width / 2
            out.append((x + dx * c - dy * s, y + dx * s + dy * c, z + up * height))
    return np.array(out)


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        (box(), box(), 1.0),
        (box(), box(x=2), 1 / 3),
        (box(), box(x=4), 0.0),
        (box(), box(x=10), 0.0),
        (box(), box(z=1.5), 0.0),
        (box(), box(z=0.75), 1 / 3),
        (box(length=2, width=2), box(length=2, width=2, yaw=np.pi / 2), 1.0),
        (box(length=2, width=2), box(length=2, width=2, yaw=np.pi / 4), 8 * (np.sqrt(2) - 1) / (8 - 8 * (np.sqrt(2) - 1))),
    ],
)
def test_iou(a, b, expected):
    assert k.iou_3d(a, b) == pytest.approx(expected, abs=1e-9)


def test_iou_against_sampled_area():
    rng = np.random.default_rng(0)
    for _ in range(5):
        a, b = box(yaw=rng.uniform(0, 3)), box(*rng.uniform(-1, 1, 2), yaw=rng.uniform(0, 3))
        p = rng.uniform(-4, 4, (200_000, 2))
        inside = lambda ring: np.all([(q[0] - o[0]) * (p[:, 1] - o[1]) - (q[1] - o[1]) * (p[:, 0] - o[0]) >= 0 for o, q in zip(ring, np.roll(ring, -1, axis=0), strict=True)], axis=0)
        in_a, in_b = inside(k.ring_of(a)), inside(k.ring_of(b))
        assert k.iou_3d(a, b) == pytest.approx((in_a & in_b).sum() / max(1, (in_a | in_b).sum()), abs=0.02)


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 4), (2, 5)):
        cost = rng.integers(0, 20, (n, m)).astype(float)
        got = sum(cost[r, c] for r, c in k.assign(cost))
        small, large = (cost, m) if n <= m else (cost.T, n)
        assert got == min(sum(small[r, c] for r, c in enumerate(p)) for p in permutations(range(large), len(small)))


def test_assignment_without_feasible_pairs():
    assert len(k.assign(np.full((2, 3), 1e9))) == 2


def brute_dbscan(p, eps, least):
    near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= least
    labels, n = np.full(len(p), -1), 0
    for s in range(len(p)):
        if core[s] and labels[s] < 0:
            stack, labels[s] = [s], n
            while stack:
                q = stack.pop()
                for j in np.flatnonzero(near[q]):
                    if labels[j] < 0:
                        labels[j] = n
                        if core[j]:
                            stack.append(j)
            n += 1
    return labels


def test_dbscan():
    rng = np.random.default_rng(2)
    for n in (0, 3, 60, 200):
        p = rng.uniform(0, 6, (n, 3))
        if n < 4:
            assert (k.dbscan(p, 0.9, 4) == -1).all()
        else:
            assert (k.dbscan(p, 0.9, 4) == brute_dbscan(p, 0.9, 4)).all()


def test_icp_recovers_a_shift():
    p = np.random.default_rng(3).uniform(0, 2, (80, 3))
    moved, close = k.icp(p + [0.05, 0.02, 0], p)
    assert close.all() and np.abs(moved - p).max() < 1e-6


def test_traverse_reaches_negative_cells():
    assert k.traverse(np.zeros(3), np.array([-0.9, 0.0, 0.0]), 0.5) == [(0, 0, 0), (-1, 0, 0), (-2, 0, 0)]


def test_traverse_has_no_cap():
    way = k.traverse(np.zeros(3), np.array([3000.0, 4000.0, -5000.0]), 0.5)
    assert len(way) > 20_000 and way[-1] == (6000, 8000, -10000)
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(way, way[1:], strict=False))


def test_many_groups_at_once_equal_one_by_one():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 40, 30)
    group = np.repeat(np.arange(30), size)
    points = rng.normal(size=(len(group), 3)) * 4
    points[::53] = np.nan
    together = k.dbscan(points, 2.0, 3, group)
    assert (together == np.concatenate([k.dbscan(points[group == g], 2.0, 3) for g in range(30)])).all() and together.max() > 0

    points = rng.normal(size=(len(group), 3)) * 3
    target = rng.normal(size=(20 * 30, 3)) * 3
    first, wide = np.arange(30) * 20, rng.integers(3, 21, 30)
    moved, close, near = k.icp_of(points, group, target, first, wide, 2.0)
    for g in range(30):
        alone, within = k.icp(points[group == g], target[first[g] : first[g] + wide[g]], 2.0)
        assert np.allclose(moved[group == g], alone) and (close[group == g] == within).all()
        assert (near[group == g] - first[g] == k.nearest(alone, target[first[g] : first[g] + wide[g]])[1]).all()
    assert (k.nearest_of(points, target, first[group], wide[group], most=7)[1] == k.nearest_of(points, target, first[group], wide[group])[1]).all()
