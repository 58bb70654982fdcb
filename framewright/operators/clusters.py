"""Clustering per frame and what follows one cluster through a scene's frames.

Points are clustered once, in their own frame.  Only cluster summaries travel through time: a rigid move
of a frame keeps its clusters, so later frames re-pose centres, not points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framewright.functions import geometry as g
from framewright.functions.kernels import dbscan, icp_of, nearest_of
from framewright.operators.grouped import map_groups


def cluster_points(points: DataFrame, frame: str, key: str, eps: float, least: int, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """``points`` with a ``cluster`` number per frame, -1 for noise; points are visited in order of ``key``."""
    schema = points.select("*", F.lit(0).cast("int").alias("cluster")).schema
    kind = points.schema[frame].dataType
    parts = {f"_key{k}": F.col(frame)[f.name] for k, f in enumerate(kind.fields)} if isinstance(kind, StructType) else {}

    def run(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        found = dbscan(_floats(rows, axes), eps, least, _numbers(rows, starts))
        return rows.select(points_columns).append_column("cluster", pa.array(found.astype("int32"))).combine_chunks().to_batches()[0]

    points_columns = points.columns
    return map_groups(points.withColumns(parts), [*parts] or [frame], [F.asc_nulls_last(key)], run, schema)


def _floats(rows: pa.Table, names: tuple[str, ...] | str) -> np.ndarray:
    return np.column_stack([pc.cast(rows.column(c), pa.float64()).to_numpy() for c in names])


def _numbers(rows: pa.Table, starts: np.ndarray) -> np.ndarray:
    """The number of every row's group."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))


def centres(clustered: DataFrame, frame: str) -> DataFrame:
    return clustered.filter("cluster >= 0").groupBy(frame, "cluster").agg(F.count("*").alias("n_points"), *(F.avg(a).alias(a) for a in "xyz"))


def ego_filter(points: DataFrame, front: float, rear: float, side: float) -> DataFrame:
    """Without the sensor's own vehicle."""
    return points.filter(~((F.col("y") <= front) & (F.col("y") >= -rear) & (F.abs(F.col("x")) <= side)))


def level(points: DataFrame, pose: str) -> DataFrame:
    """Points moved by a row-major 4x4 pose column."""
    moved = g.affine(F.col(pose), F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double"))
    return points.withColumn("_m", moved).withColumns({a: F.col(f"_m.{a}") for a in "xyz"}).drop("_m")


def chains(summaries: DataFrame, scene: str, index: str, window: int, tolerance: float, least_points: int) -> DataFrame:
    """For each cluster of each frame its way back through up to ``window - 1`` earlier frames.

    From frame to frame the nearest centre strictly within ``tolerance`` is taken; the chain ends at a miss
    or at a cluster of fewer than ``least_points`` points.  ``chain`` is newest first, the cluster included.
    A scene's summaries are small, tens to hundreds of frames with a few clusters each.
    """
    schema = f"{scene} string, {index} int, cluster int, chain array<struct<idx: int, cluster: int, x: double, y: double, z: double>>"

    def run(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        at, number, points = (rows.column(c).to_numpy() for c in (index, "cluster", "n_points"))
        xyz, group, n = _floats(rows, "xyz"), _numbers(rows, starts), rows.num_rows
        low, span = int(at.min()), int(at.max()) - int(at.min()) + window + 1
        key = group * span + at - low + window  # a scene's frames never meet the next scene's
        frames, first, size = np.unique(key, return_index=True, return_counts=True)
        here, rest = xyz.copy(), np.arange(n)
        links = [(rest, rest)]
        for back in range(1, window):
            k = np.minimum(np.searchsorted(frames, key[rest] - back), len(frames) - 1)
            there = frames[k] == key[rest] - back
            rest, k = rest[there], k[there]
            if not len(rest):
                break
            d, best = nearest_of(here[rest], xyz, first[k], size[k])
            kept = (d < tolerance) & (points[best] >= least_points)
            rest, best = rest[kept], best[kept]
            here[rest] = xyz[best]
            links.append((rest, best))
        own, member = (np.concatenate(c) for c in zip(*links, strict=True))
        order = np.argsort(own, kind="stable")  # newest first
        member = member[order]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(at[member].astype("int32")), pa.array(number[member].astype("int32")), *(pa.array(c) for c in np.ascontiguousarray(xyz[member].T))], names=["idx", "cluster", *"xyz"])
        made = [rows.column(c).combine_chunks() for c in (scene, index, "cluster")]
        return pa.RecordBatch.from_arrays([*made, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[scene, index, "cluster", "chain"])

    rows = summaries.select(F.col(scene).cast("string").alias(scene), F.col(index).cast("int").alias(index), F.col("cluster").cast("int").alias("cluster"), "n_points", "x", "y", "z")
    return map_groups(rows.filter(F.col(index).isNotNull()), [scene], [index, "cluster"], run, schema)


def radial_jitter(chained: DataFrame, least_frames: int = 2, first_differences: bool = False) -> DataFrame:
    """Deviation of a chain's range about a straight line over time, or of its first differences, in built-in
    functions; null if short."""
    r = F.transform("chain", lambda c: g.radius(c.x, c.y, c.z))
    t = F.transform("chain", lambda c: c.idx.cast("double"))
    n = F.size("chain")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n
    with_means = chained.withColumns({"_r": r, "_t": t}).withColumns({"_mr": mean(F.col("_r")), "_mt": mean(F.col("_t"))})
    product = lambda a, ma, b, mb: F.aggregate(F.zip_with(a, b, lambda u, v: (u - ma) * (v - mb)), F.lit(0.0), lambda s, v: s + v) / n
    vr = product(F.col("_r"), F.col("_mr"), F.col("_r"), F.col("_mr"))
    vt = product(F.col("_t"), F.col("_mt"), F.col("_t"), F.col("_mt"))
    c = product(F.col("_r"), F.col("_mr"), F.col("_t"), F.col("_mt"))
    sigma = F.sqrt(F.greatest(vr - F.coalesce(F.try_divide(c * c, vt), F.lit(0.0)), F.lit(0.0)))
    if first_differences:
        steps = F.zip_with(F.slice("_r", 2, F.size("_r")), F.slice("_r", F.lit(1), F.size("_r") - 1), lambda a, b: b - a)
        mean_step = (F.element_at("_r", 1) - F.element_at("_r", -1)) / (n - 1)
        sigma = F.sqrt(F.aggregate(steps, F.lit(0.0), lambda s, v: s + (v - mean_step) * (v - mean_step)) / (n - 1))
    return with_means.withColumn("sigma_centroid", F.when(n > least_frames, sigma)).withColumn("n_frames_associated", n).drop("_r", "_t", "_mr", "_mt")


def aligned_sigma(clustered: DataFrame, chained: DataFrame, scene: str, index: str, reach: float = 0.5, least_points: int = 10) -> DataFrame:
    """Pooled deviation of range residuals after aligning each past cluster of a chain to the newest one.

    One group is one chain: the points of one cluster over at most the window's frames; a call aligns many
    chains at once.  Ranges are taken from ``origin``, if the chains have one.
    """
    origin = [F.col(f"origin.{a}") if "origin" in chained.columns else F.lit(0.0) for a in "xyz"]
    steps = chained.select(scene, index, "cluster", *(o.alias(f"_o{a}") for a, o in zip("xyz", origin, strict=True)), F.explode("chain").alias("c")).select(scene, index, "cluster", "_ox", "_oy", "_oz", F.col("c.idx").alias("_at"), F.col("c.cluster").alias("_past"))
    pts = clustered.select(F.col(scene).cast("string").alias("_s"), F.col(index).cast("int").alias("_i"), F.col("cluster").alias("_c"), *(F.col(a).cast("double").alias(a) for a in "xyz"))
    rows = steps.join(pts, (steps[scene] == pts["_s"]) & (steps["_at"] == pts["_i"]) & (steps["_past"] == pts["_c"])).withColumns({a: F.col(a) - F.col(f"_o{a}") for a in "xyz"})
    schema = f"{scene} string, {index} int, cluster int, sigma_point double"

    def run(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        now, at, xyz, group = rows.column(index).to_numpy(), rows.column("_at").to_numpy(), _floats(rows, "xyz"), _numbers(rows, starts)
        steps = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (at[1:] != at[:-1])]))
        size, owner = np.diff(np.append(steps, len(at))), group[steps]
        first, wide = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        newest = at[steps] == now[steps]
        first[owner[newest]], wide[owner[newest]] = steps[newest], size[newest]
        tried = np.flatnonzero((at[steps] < now[steps]) & (size >= least_points) & (wide[owner] >= least_points))
        n, whose = size[tried], owner[tried]
        source = np.repeat(steps[tried] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        step = np.repeat(np.arange(len(tried)), n)
        moved, close, near = icp_of(xyz[source], step, xyz, first[whose], wide[whose], reach)
        close &= (np.bincount(step[close], minlength=len(tried)) >= 3)[step]
        residual = np.sqrt((moved[close] ** 2).sum(axis=1)) - np.sqrt((xyz[near[close]] ** 2).sum(axis=1))
        chain = whose[step[close]]
        ends = np.cumsum(np.bincount(chain, minlength=len(starts)))
        sigma = [float(r.std()) if len(r) else None for r in np.split(residual, ends[:-1])]
        heads = rows.select([scene, index, "cluster"]).take(pa.array(starts)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in heads.columns), pa.array(sigma, pa.float64())], names=[scene, index, "cluster", "sigma_point"])

    return map_groups(rows.select(scene, index, "cluster", "_at", "x", "y", "z"), [scene, index, "cluster"], ["_at", "x", "y", "z"], run, schema)
