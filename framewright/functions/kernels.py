"""Numpy kernels for what no plan expresses: polygon clipping, matching, clustering, alignment, traversal."""

from __future__ import annotations

import numpy as np


def ring_of(corners: np.ndarray) -> np.ndarray:
    """The corners seen from above, by angle about their mean."""
    flat = corners[:, :2]
    angle = np.arctan2(*(flat - flat.mean(axis=0)).T[::-1])
    return flat[np.argsort(angle, kind="stable")]


def ring_area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring.T
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def clip_convex(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a convex ring inside another, both counter-clockwise: one half-plane after another."""
    out = subject
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        edge = b - a
        if not edge.any() or not len(out):
            continue
        side = edge[0] * (out[:, 1] - a[1]) - edge[1] * (out[:, 0] - a[0])
        kept: list[np.ndarray] = []
        for k in range(len(out)):
            p, q, sp, sq = out[k - 1], out[k], side[k - 1], side[k]
            if (sp < 0) != (sq < 0):
                kept.append(p + (q - p) * (sp / (sp - sq)))
            if sq >= 0:
                kept.append(q)
        out = np.array(kept).reshape(-1, 2)
    return out


def iou_3d(a: np.ndarray, b: np.ndarray) -> float:
    """Shared area from above times shared height, over the union; 0 without either."""
    ring_a, ring_b = ring_of(a), ring_of(b)
    if (ring_a.max(axis=0) <= ring_b.min(axis=0)).any() or (ring_b.max(axis=0) <= ring_a.min(axis=0)).any():
        return 0.0
    area = ring_area(clip_convex(ring_a, ring_b))
    height = min(a[:, 2].max(), b[:, 2].max()) - max(a[:, 2].min(), b[:, 2].min())
    if area <= 0 or height <= 0:
        return 0.0
    volume = lambda ring, c: ring_area(ring) * float(np.ptp(c[:, 2]))
    union = volume(ring_a, a) + volume(ring_b, b) - area * height
    return float(area * height / union) if union > 0 else 0.0


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """A one-to-one assignment of least total cost: shortest augmenting paths with potentials."""
    n, m = cost.shape
    if n > m:
        return sorted((r, c) for c, r in assign(cost.T))
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[col] = True
            here = owner[col]
            gap = cost[here - 1] - u[here] - v[1:]
            open_cols = ~used[1:]
            better = open_cols & (gap < least[1:])
            least[1:][better] = gap[better]
            way[1:][better] = col
            step_to = int(np.argmin(np.where(open_cols, least[1:], np.inf))) + 1
            delta = least[step_to]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            col = step_to
            if owner[col] == 0:
                break
        while col:
            owner[col] = owner[way[col]]
            col = way[col]
    return sorted((int(owner[c]) - 1, c - 1) for c in range(1, m + 1) if owner[c])


def neighbours_within(points: np.ndarray, eps: float, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All ordered pairs (i, j), i itself included, at most ``eps`` apart and of one group, by way of a cell grid.
    Points that are not finite have no pairs."""
    rows = np.flatnonzero(np.isfinite(points).all(axis=1))
    points = points[rows]
    group = np.zeros(len(rows), dtype=np.int64) if group is None else group[rows]
    n, dims = points.shape
    if not n:
        return rows, rows
    cell = np.floor(points / eps).astype(np.int64)
    cell -= cell.min(axis=0) - 1
    size = cell.max(axis=0) + 2
    stride = np.cumprod(np.append(1, size))
    key = cell @ stride[:-1] + group * stride[-1]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    left, right = [], []
    for shift in np.stack(np.meshgrid(*[[-1, 0, 1]] * dims, indexing="ij"), -1).reshape(-1, dims):
        want = key + int(shift @ stride[:-1])
        a, b = np.searchsorted(sorted_key, want, "left"), np.searchsorted(sorted_key, want, "right")
        i = np.repeat(np.arange(n), b - a)
        j = order[np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())]
        near = (((points[i] - points[j]) ** 2).sum(axis=1) <= eps * eps) & (group[i] == group[j])
        left.append(rows[i[near]])
        right.append(rows[j[near]])
    return np.concatenate(left), np.concatenate(right)


def dbscan(points: np.ndarray, eps: float, least: int, group: np.ndarray | None = None) -> np.ndarray:
    """Cluster numbers in order of their first core point, -1 for noise; a border point goes to the
    cluster of least number that reaches it.  Points of several groups are clustered at once and numbered by
    group; ``group`` has ascending numbers."""
    n = len(points)
    labels = np.full(n, -1)
    if n < least:
        return labels
    i, j = neighbours_within(np.asarray(points, dtype=float), eps, group)
    core = np.bincount(i, minlength=n) >= least
    root = np.arange(n)
    both = core[i] & core[j]
    a, b = i[both], j[both]
    while True:  # the least neighbour's root, then pointer jumping
        low = root.copy()
        np.minimum.at(low, a, root[b])
        low = np.minimum(low, low[low])
        if (low == root).all():
            break
        root = low
    heads = np.unique(root[core])
    number = np.full(n, -1)
    number[heads] = np.arange(len(heads))
    if group is not None:
        number[heads] -= np.searchsorted(group[heads], group[heads], "left")
    labels[core] = number[root[core]]
    reach = core[i] & ~core[j]
    border = np.full(n, n)
    np.minimum.at(border, j[reach], labels[i[reach]])
    edge = ~core & (border < n)
    labels[edge] = border[edge]
    return labels


def rigid_fit(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift of least squared distance between paired points."""
    a, b = source.mean(axis=0), target.mean(axis=0)
    u, _, vt = np.linalg.svd((source - a).T @ (target - b))
    flip = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1])
    r = vt.T @ flip @ u.T
    return r, b - r @ a


def rigid_fits(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`rigid_fit` of many pairs of as many points."""
    a, b = source.mean(axis=1), target.mean(axis=1)
    u, _, vt = np.linalg.svd((source - a[:, None]).transpose(0, 2, 1) @ (target - b[:, None]))
    u, v = u.transpose(0, 2, 1), vt.transpose(0, 2, 1)
    flip = np.tile(np.eye(3), (len(v), 1, 1))
    side = np.sign(np.linalg.det(v @ u))
    flip[:, 2, 2] = np.where(side == 0, 1, side)
    r = v @ flip @ u
    return r, b - (r @ a[:, :, None])[:, :, 0]


def nearest(source: np.ndarray, target: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Distance to and number of the nearest target of every source point."""
    best, which = np.empty(len(source)), np.empty(len(source), dtype=int)
    for k in range(0, len(source), block):
        d = ((source[k : k + block, None] - target[None]) ** 2).sum(axis=2)
        which[k : k + block] = d.argmin(axis=1)
        best[k : k + block] = np.sqrt(d.min(axis=1))
    return best, which


def icp(source: np.ndarray, target: np.ndarray, reach: float = 0.5, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Point-to-point alignment: source points after alignment, and which have a partner within reach."""
    moved, before = source.copy(), np.inf
    for _ in range(rounds):
        d, k = nearest(moved, target)
        close = d <= reach
        if close.sum() < 3:
            break
        r, t = rigid_fit(moved[close], target[k[close]])
        moved = moved @ r.T + t
        now = float((d[close] ** 2).mean())
        if abs(before - now) < 1e-9:
            break
        before = now
    d, _ = nearest(moved, target)
    return moved, d <= reach


def nearest_of(source: np.ndarray, target: np.ndarray, first: np.ndarray, size: np.ndarray, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Distance to and row of each source point's nearest target among its own: ``size`` rows from ``first`` on.
    About ``most`` pairs are held at a time."""
    best, which = np.empty(len(source)), np.empty(len(source), dtype=np.int64)
    done = np.cumsum(size)
    k = 0
    while k < len(source):
        end = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + most, "right")))
        n = size[k:end]
        starts = np.cumsum(n) - n
        j = np.repeat(first[k:end] - starts, n) + np.arange(int(n.sum()))
        d = ((np.repeat(source[k:end], n, axis=0) - target[j]) ** 2).sum(axis=1)
        low = np.minimum.reduceat(d, starts)
        at = np.flatnonzero(d == np.repeat(low, n))
        which[k:end] = j[at[np.searchsorted(at, starts)]]
        best[k:end] = np.sqrt(low)
        k = end
    return best, which


def icp_of(source: np.ndarray, owner: np.ndarray, target: np.ndarray, first: np.ndarray, size: np.ndarray, reach: float = 0.5, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`icp` of many small clouds at once: cloud ``owner`` of a source point, in ascending order, goes to
    ``size`` target rows from ``first`` on.  Also the target row nearest to each point in the end."""
    moved, m = source.copy(), len(first)
    wide = np.bincount(owner, minlength=m)
    begin = np.cumsum(wide) - wide
    before, active = np.full(m, np.inf), np.ones(m, dtype=bool)
    for _ in range(rounds):
        rows = np.flatnonzero(active[owner])
        if not len(rows):
            break
        d, k = nearest_of(moved[rows], target, first[owner[rows]], size[owner[rows]])
        close = d <= reach
        n = np.bincount(owner[rows[close]], minlength=m)
        active &= n >= 3
        pairs = np.cumsum(n) - n
        p, q, d = moved[rows[close]], target[k[close]], d[close]
        r, t, now = np.zeros((m, 3, 3)), np.zeros((m, 3)), np.full(m, np.inf)
        for count in np.unique(n[active]):
            some = np.flatnonzero(active & (n == count))
            at = pairs[some][:, None] + np.arange(count)
            r[some], t[some] = rigid_fits(p[at], q[at])
            now[some] = (d[at] ** 2).mean(axis=1)
        for count in np.unique(wide[active]):
            some = np.flatnonzero(active & (wide == count))
            at = begin[some][:, None] + np.arange(count)
            moved[at] = moved[at] @ r[some].transpose(0, 2, 1) + t[some][:, None]
        with np.errstate(invalid="ignore"):
            active &= ~(np.abs(before - now) < 1e-9)
        before = now
    d, k = nearest_of(moved, target, first[owner], size[owner])
    return moved, d <= reach, k


def traverse(start: np.ndarray, end: np.ndarray, size: float) -> list[tuple[int, int, int]]:
    """Voxels that the segment passes in order; on equal distances z steps before y before x.

    There are as many steps as cells lie between both ends along the axes.
    """
    here = np.floor(start / size).astype(int)
    last = np.floor(end / size).astype(int)
    way = end - start
    step = np.sign(way).astype(int)
    ahead = (step > 0).astype(int)

    def crossing(axis: int) -> float:
        """Where on the way the next side of a cell is met: from the cell's number, so errors don't add up."""
        return ((here[axis] + ahead[axis]) * size - start[axis]) / way[axis] if here[axis] != last[axis] else np.inf

    at = np.array([crossing(axis) for axis in range(3)])
    out = [tuple(here.tolist())]
    for _ in range(int(np.abs(last - here).sum())):
        axis = 2 - int(np.argmin(at[::-1]))
        here = here.copy()
        here[axis] += step[axis]
        at[axis] = crossing(axis)
        out.append(tuple(here.tolist()))
    return out
