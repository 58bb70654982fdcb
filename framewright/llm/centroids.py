"""Yinyang k-means on integer vectors: exact assignments with few distances.

Components become integers ``floor(scale * x)``, so that distances, sums and means are exact and the same under any
partitioning.  Centroids are put into groups once.  Every vector keeps an upper bound of its distance to its own
centroid and one lower bound per group of the distance to all others there.  After a round the bounds give way by how far
the centroids moved; a vector whose upper bound lies below all its lower bounds stays where it is (global filter),
otherwise its own distance is computed anew and only the groups whose lower bound does not lie above it are
scanned (group filter).  Bounds are widened by more than their rounding, so that no assignment, ties included,
differs from that of plain k-means.

A round is one pass over a stored table of vectors and bounds, without a shuffle; tasks add up exact sums by centroid, and these meet in a tree.
The driver holds the centroids (``k`` vectors) and one summed table.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out, as
are those with an integer component of ``LARGEST`` or more, whose distances would not fit a long.  Repeated
rows count each; first centroids come by ascending hash of the id, then by components; a null id is hashed as the
text ``null``.  With fewer vectors than ``k`` there are as many centroids as vectors; an empty table gives an
empty result.  A sum of distances that does not fit a long is null.  Equal distances go to the smaller number, and a centroid without vectors stays.  Other columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.reduce import task_number, tree_sum
from framewright.llm.scratch import discard, materialize

LARGEST = 1 << 26
#: Wider than the rounding of a square root of at most 2**63 and of a few additions.
SLACK = 1e-12
#: Vectors that a task handles at once.
BLOCK = 4096


def quantised(vector: Column, dims: int, scale: float) -> Column:
    """The integer components, or null for a vector that is left out."""
    wide = vector.cast("array<double>")
    whole = F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(float(scale))) >= F.lit(float(LARGEST))))
    return F.when((F.size(wide) == dims) & ~bad, whole.cast("array<int>"))


@dataclass
class Model:
    """``centroids`` is ``k`` by ``dims``; ``groups`` gives each its group; ``scanned`` counts vector-centroid distances by pass."""

    centroids: np.ndarray
    groups: np.ndarray
    scanned: list[int]

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in self.centroids]


def grouped(centroids: np.ndarray, n_groups: int, rounds: int = 5) -> np.ndarray:
    """Groups of near centroids, numbered densely; a plain k-means over ``k`` points, done once."""
    k = len(centroids)
    n_groups = max(1, min(n_groups, k))
    points = centroids.astype(np.float64)
    middle = points[np.linspace(0, k - 1, n_groups).astype(int)] if k else points
    of = np.zeros(k, dtype=np.int64)
    for _ in range(rounds):
        if not k:
            break
        of = ((points[:, None] - middle[None]) ** 2).sum(-1).argmin(1)
        middle = np.stack([points[of == g].mean(0) if (of == g).any() else middle[g] for g in range(n_groups)])
    return np.unique(of, return_inverse=True)[1]


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by centroids."""
    out = np.empty((len(vectors), len(centroids)), dtype=np.int64)
    for j, c in enumerate(centroids):
        gap = vectors - c
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def first_assignment(x: np.ndarray, centroids: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``own, upper, lower, scanned`` from all distances."""
    d = squared(x, centroids)
    own = d.argmin(1)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, own].astype(np.float64)) * (1 + SLACK)
    others = np.sqrt(d.astype(np.float64)) * (1 - SLACK)
    others[rows, own] = np.inf
    lower = np.stack([others[:, groups == g].min(1) for g in range(groups.max() + 1)], axis=1)
    return own, upper, lower, d.size


def next_assignment(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, groups: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the centroids moved by ``moved``, from the bounds kept."""
    n_groups = groups.max() + 1
    drift = np.array([moved[groups == g].max() for g in range(n_groups)])
    upper = (upper + moved[own]) * (1 + SLACK)
    lower = np.maximum((lower - drift) * (1 - SLACK) - SLACK, 0.0)
    own, scanned = own.copy(), 0
    open_rows = np.flatnonzero(upper >= lower.min(1))  # a tie is not decided by bounds
    if not len(open_rows):
        return own, upper, lower, scanned
    gap = x[open_rows] - centroids[own[open_rows]]
    best = np.einsum("ij,ij->i", gap, gap)
    scanned += len(open_rows)
    upper[open_rows] = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    keep = upper[open_rows] >= lower[open_rows].min(1)
    open_rows, best = open_rows[keep], best[keep]
    if not len(open_rows):
        return own, upper, lower, scanned
    was = own[open_rows]
    now, was_at = was.copy(), np.sqrt(best.astype(np.float64)) * (1 - SLACK)
    scan = upper[open_rows][:, None] >= lower[open_rows]
    seen: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for g in range(n_groups):
        at = np.flatnonzero(scan[:, g])
        if not len(at):
            continue
        members = np.flatnonzero(groups == g)
        d = squared(x[open_rows[at]], centroids[members])
        scanned += d.size
        seen[g] = at, members, d
        j = d.argmin(1)
        near, number = d[np.arange(len(at)), j], members[j]
        better = (near < best[at]) | (near == best[at]) & (number < now[at])
        best[at[better]], now[at[better]] = near[better], number[better]
    for g, (at, members, d) in seen.items():  # bounds over all members but the row's own, as it is now
        far = np.sqrt(d.astype(np.float64)) * (1 - SLACK)
        far[members[None] == now[at][:, None]] = np.inf
        lower[open_rows[at], g] = far.min(1)
    left = np.flatnonzero(now != was)  # the centroid that a row has left counts in its group, scanned or not
    rows = open_rows[left]
    lower[rows, groups[was[left]]] = np.minimum(lower[rows, groups[was[left]]], was_at[left])
    own[open_rows], upper[open_rows] = now, np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    return own, upper, lower, scanned


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, dims).astype(np.int64)


@dataclass(frozen=True)
class Yinyang:
    dims: int = 64
    k: int = 16
    rounds: int = 3
    scale: float = 64.0
    seed: int = 1
    n_groups: int = 4

    def vectors(self, table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        """``id, vector``: the kept vectors as little-endian 32-bit integers."""
        dims = self.dims

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = batch.column("parts").flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([row.tobytes() for row in flat], pa.binary())], ["id", "vector"])

        kept = table.select(F.col(id_col).alias("id"), quantised(F.col(vector_col), dims, self.scale).alias("parts")).filter(F.col("parts").isNotNull())
        return kept.mapInArrow(pack, f"id {table.schema[id_col].dataType.simpleString()}, vector binary")

    def first_centroids(self, vectors: DataFrame) -> np.ndarray:
        order = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
        rows = vectors.orderBy(order, F.hex("vector")).limit(self.k).select("vector").collect()
        return np.frombuffer(b"".join(bytes(r[0]) for r in rows), dtype="<i4").reshape(-1, self.dims).astype(np.int64)

    def _pass(self, state: DataFrame, centroids: np.ndarray, groups: np.ndarray, moved: np.ndarray | None) -> DataFrame:
        """The table with assignments and bounds for ``centroids``; ``part, sums`` once a task, with all other columns null."""
        dims, k = self.dims, len(centroids)
        schema = f"id {state.schema['id'].dataType.simpleString()}, vector binary, own int, distance long, bounds binary, part long, sums binary"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, dims + 1), dtype=np.int64)
            scanned, kind = 0, None
            for batch in batches:
                kind = batch.column("id").type
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    x = _matrix(part.column("vector"), dims)
                    if moved is None:
                        own, upper, lower, n = first_assignment(x, centroids, groups)
                    else:
                        bounds = np.frombuffer(b"".join(part.column("bounds").to_pylist()), dtype="<f8").reshape(len(x), -1)
                        own, upper, lower, n = next_assignment(x, part.column("own").to_numpy(), bounds[:, 0].copy(), bounds[:, 1:].copy(), centroids, groups, moved)
                    scanned += n
                    gap = x - centroids[own]
                    for c in np.unique(own):
                        total[c, :dims] += x[own == c].sum(0)
                    total[:, dims] += np.bincount(own, minlength=k)
                    packed = [row.tobytes() for row in np.column_stack([upper, lower]).astype("<f8")]
                    none = pa.nulls(len(x))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("vector"), pa.array(own, pa.int32()), pa.array(np.einsum("ij,ij->i", gap, gap)), pa.array(packed, pa.binary()), none.cast(pa.int64()), none.cast(pa.binary())],
                        ["id", "vector", "own", "distance", "bounds", "part", "sums"],
                    )
            if kind is not None:
                sums = np.append(total.ravel(), scanned).astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([task_number()], pa.int64()), pa.array([sums], pa.binary())],
                    ["id", "vector", "own", "distance", "bounds", "part", "sums"],
                )

        return state.mapInArrow(run, schema)

    def fit_assign(self, table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[Model, DataFrame]:
        """The model and ``id, own, distance`` of every kept vector, from a stored table."""
        state = materialize(self.vectors(table, id_col, vector_col), "vectors")
        centroids = self.first_centroids(state)
        groups = grouped(centroids, self.n_groups)
        model = Model(centroids, groups, [])
        if not len(centroids):
            return model, state.select("id", F.lit(None).cast("int").alias("own"), F.lit(None).cast("long").alias("distance"))
        moved = None
        for _ in range(self.rounds + 1):
            before, made = state, materialize(self._pass(state, model.centroids, groups, moved), "assigned")
            discard(before)
            parts = made.filter(F.col("sums").isNotNull()).select("part", F.col("sums").alias("vector"))
            total = tree_sum(parts)
            state = made.filter(F.col("sums").isNull())
            model.scanned.append(int(total[-1]))
            if len(model.scanned) > self.rounds:
                break
            table_sums = total[:-1].reshape(len(centroids), -1)
            counts = table_sums[:, -1:]
            after = np.where(counts > 0, table_sums[:, :-1] // np.maximum(counts, 1), model.centroids)
            step = (after - model.centroids).astype(np.float64)
            moved = np.sqrt((step * step).sum(1)) * (1 + SLACK)
            model.centroids = after
        return model, state.select("id", "own", "distance")

    def clusters(self, table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector."""
        model, assigned = self.fit_assign(table, id_col, vector_col)
        spark = table.sparkSession
        digests = spark.createDataFrame(list(enumerate(model.digests())), "own int, centroid_sha256 string")
        sums = assigned.groupBy("own").agg(F.try_sum("distance").alias("cluster_inertia"))  # k rows at most
        whole = sums.agg(F.try_sum("cluster_inertia").alias("inertia"))
        per_cluster = sums.join(F.broadcast(digests), "own").join(F.broadcast(whole), F.lit(True))
        return assigned.join(F.broadcast(per_cluster), "own").select(F.col("id").alias(id_col), F.col("own").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(rule: Yinyang = Yinyang(), table: str = "embeddings", id_col: str = "vec_id", vector_col: str = "embedding") -> str:
    """Plain k-means for DuckDB: all distances in every round."""
    gap = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        f"v AS MATERIALIZED (SELECT {id_col} AS id, list_transform({vector_col}, lambda e: floor({rule.scale}::DOUBLE * e::DOUBLE)::BIGINT) AS x FROM {table}"
        f" WHERE len({vector_col}) = {rule.dims} AND len(list_filter({vector_col}, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS n, x FROM (SELECT x, sha256('{rule.seed}:' || id) AS h FROM v ORDER BY h LIMIT {rule.k}))",
    ]
    for r in range(rule.rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT id, x, n, d FROM (SELECT v.id, v.x, c.n, {gap} AS d, row_number() OVER (PARTITION BY v.id ORDER BY {gap}, c.n) AS k FROM v, c{r} c) WHERE k = 1)")
        if r < rule.rounds:
            steps.append(
                f"m{r} AS (SELECT n, list(s ORDER BY i) AS x FROM (SELECT n, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS s FROM a{r}, range(1, {rule.dims + 1}) t(i) GROUP BY n, i) GROUP BY n)"
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (n))")
    last = rule.rounds
    return (
        "WITH "
        + ",\n".join(steps)
        + f"\nSELECT a.id AS {id_col}, a.n AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.n))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,"
        + f" sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{last} a JOIN c{last} c USING (n)"
    )
