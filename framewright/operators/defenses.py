"""Single-frame and temporal detectors of manipulated clouds, composed of the engine's operators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions import geometry as g
from framewright.functions.kernels import dbscan, traverse
from framewright.functions.numeric import ratio, uniform
from framewright.operators.clusters import aligned_sigma, centres, chains, cluster_points, ego_filter, level, radial_jitter
from framewright.operators.grouped import map_groups
from framewright.operators.spatial import empty_cells, neighbour_counts


def coin_flip(frames: DataFrame, frame: str, share: float = 0.5, seed: int = 0) -> DataFrame:
    return frames.select(frame, (uniform(seed, F.col(frame)) < share).alias("detected"), F.lit(0.5).alias("confidence"))


def void_region(points: DataFrame, frame: str, x: tuple[float, float] = (0.0, 30.0), y: tuple[float, float] = (-5.0, 5.0), ground: float = -1.73, delta: float = 0.2, stride: float = 0.6, eps: float = 0.8, least: int = 5, top_eps: float = 0.5, top_least: int = 10) -> DataFrame:
    """Objects in front of ground that no beam reaches: empty ground cells are clustered, the pyramids from
    the sensor to them are searched for points above the ground, and those are clustered."""
    floor = points.filter(F.abs(F.col("z") - ground) <= delta)
    holes = empty_cells(floor, frame, x, y, stride).withColumns({"x": x[0] + (F.col("ix") + 0.5) * stride, "y": y[0] + (F.col("iy") + 0.5) * stride, "z": F.lit(ground)})
    voids = cluster_points(holes.withColumn("key", F.col("ix") * 100_000 + F.col("iy")), frame, "key", eps, least, ("x", "y"))
    base = centres(voids, frame).select(frame, F.col("cluster").alias("void"), F.struct("x", "y", "z").alias("base"))
    above = points.filter(F.col("z") > ground + delta)
    origin = g.point(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    inside = g.in_pyramid(F.col("x"), F.col("y"), F.col("z"), origin, F.col("base"), stride)
    suspects = above.join(base, frame).filter(inside).select(*above.columns).distinct()
    found = cluster_points(suspects, frame, "point_idx", top_eps, top_least).filter("cluster >= 0")
    counted = found.groupBy(frame).agg(F.count_distinct("cluster").alias("obstacles"))
    return _verdict(points, counted, frame, F.col("obstacles") > 0, "obstacles")


def shadow_volume(points: DataFrame, frame: str, x: tuple[float, float] = (0.0, 30.0), y: tuple[float, float] = (-5.0, 5.0), ground: float = -1.73, delta: float = 0.2, stride: float = 0.6, eps: float = 0.8, least: int = 5, most: float = 15.0, voxel: float = 0.3, ceiling: float = 0.0, object_eps: float = 0.5, object_least: int = 10) -> DataFrame:
    """Per frame the voids and the greatest volume of one's pyramid that no object shades, in cubic metres.

    A void is a cluster of ground cells without a point; its pyramids, from the sensor to its cells, are
    filled with voxels up to ``ceiling``.  Objects are clusters above the ground; the clustering is this
    engine's own.  One group is one frame's void cells and object boxes, both bounded by the region; a call
    handles many frames.
    """
    floor = points.filter(F.abs(F.col("z") - ground) <= delta)
    holes = empty_cells(floor, frame, x, y, stride).withColumns({"x": x[0] + (F.col("ix") + 0.5) * stride, "y": y[0] + (F.col("iy") + 0.5) * stride})
    voids = cluster_points(holes.withColumn("key", F.col("ix") * 100_000 + F.col("iy")), frame, "key", eps, least, ("x", "y")).filter("cluster >= 0")
    objects = cluster_points(points.filter(F.col("z") > ground + delta), frame, "point_idx", object_eps, object_least).filter("cluster >= 0")
    bounds = objects.groupBy(frame, "cluster").agg(*(f(a).cast("double").alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    limits = [f"{n}_{a}" for n in ("lo", "hi") for a in "xyz"]
    none = F.lit(None).cast("double")
    rows = voids.select(F.col(frame).cast("string").alias(frame), "cluster", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *(none.alias(c) for c in limits))
    rows = rows.unionByName(bounds.select(F.col(frame).cast("string").alias(frame), "cluster", none.alias("x"), none.alias("y"), *limits))
    half = voxel / 2
    axes = [np.arange(x[0] + half, x[1], voxel), np.arange(y[0] + half, y[1], voxel), np.arange(ground + half, ceiling, voxel)]

    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        centre = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)
        beams: dict[tuple[float, float], np.ndarray] = {}  # a cell's pyramid is the same in every frame
        void = ~np.isnan(table.column("x").to_numpy())
        spots, cluster = np.column_stack([table.column(c).to_numpy() for c in "xy"]), table.column("cluster").to_numpy()
        boxes = np.column_stack([table.column(c).to_numpy() for c in limits])
        out = []
        for rows in np.split(np.arange(table.num_rows), starts[1:]):
            cells, solid = rows[void[rows]], rows[~void[rows]]
            out.append(_unshaded(centre, spots[cells], cluster[cells], ground, stride, boxes[solid], beams) * voxel**3)
        heads = table.column(frame).take(pa.array(starts)).combine_chunks()
        return pa.RecordBatch.from_arrays([heads, pa.array([len(v) for v in out], pa.int32()), pa.array([float(v.max(initial=0.0)) for v in out])], names=[frame, "voids", "residual"])

    found = map_groups(rows, [frame], ["cluster", "x", "y"], run, f"{frame} string, voids int, residual double")
    typed = found.withColumn(frame, F.col(frame).cast(points.schema[frame].dataType))
    return _verdict(points, typed, frame, F.col("residual") > most, "voids", "residual")


def _unshaded(centre: np.ndarray, cells: np.ndarray, cluster: np.ndarray, ground: float, side: float, boxes: np.ndarray, beams: dict[tuple[float, float], np.ndarray]) -> np.ndarray:
    """Per cluster of cells how many voxel centres lie in their pyramids and behind no box; ``beams`` keeps what
    lies in each cell's pyramid, at most as many cells as the region has."""
    free = np.ones(len(centre), dtype=bool)
    still = np.abs(centre) <= 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        for box in boxes:
            at = np.sort(box.reshape(2, 1, 3) / centre, axis=0)  # where the ray to a centre enters and leaves each slab
            outside = (box[:3] > 0) | (box[3:] < 0)
            enter = np.where(still, -np.inf, at[0]).max(axis=1)
            leave = np.where(still, np.where(outside, -np.inf, np.inf), at[1]).min(axis=1)
            free &= ~((enter <= leave) & (leave > 0) & (enter < 1))
    out = []
    for k in np.unique(cluster):
        inside = np.zeros(len(centre), dtype=bool)
        for spot in map(tuple, cells[cluster == k].tolist()):
            if spot not in beams:
                beams[spot] = _beam(centre, spot, ground, side)
            inside |= beams[spot]
        out.append((inside & free).sum())
    return np.array(out, dtype=float)


def _beam(centre: np.ndarray, spot: tuple[float, float], ground: float, side: float) -> np.ndarray:
    way = np.array([*spot, ground])
    far = np.linalg.norm(way)
    if far < 1e-6:
        return np.zeros(len(centre), dtype=bool)
    way /= far
    up = np.array([1.0, 0.0, 0.0]) if abs(way[2]) > 0.999 else np.array([0.0, 0.0, 1.0])
    u = np.cross(up, way)
    u /= np.linalg.norm(u)
    along = centre @ way
    width = side / 2 * along / far
    return (along > 0) & (along < far) & (np.abs(centre @ u) < width) & (np.abs(centre @ np.cross(way, u)) < width)


def penetration(points: DataFrame, boxes: DataFrame, frame: str) -> DataFrame:
    """Per box: shares of its beams that end in front, inside and behind.  ``boxes`` has frame, idx and box."""
    hit = points.join(boxes, frame).withColumn("side", g.ray_class(F.col("x"), F.col("y"), F.col("z"), F.col("box"))).filter("side <> 'miss'")
    agg = hit.groupBy(frame, "idx").agg(F.count_if(F.col("side") == "behind").alias("behind"), F.count_if(F.col("side") == "in").alias("inside"), F.count_if(F.col("side") == "front").alias("front"))
    return agg.withColumn("lpd", ratio(F.col("behind"), F.col("behind") + F.col("inside")))


def free_space(points: DataFrame, boxes: DataFrame, frame: str, voxel: float = 0.25) -> DataFrame:
    """Per box: the share of its voxels that beams pass without ending there.  One group is one box's points."""
    schema = f"{frame} string, idx int, free double"
    kind = points.schema[frame].dataType
    rows = points.join(boxes, frame).withColumn("side", g.ray_class(F.col("x"), F.col("y"), F.col("z"), F.col("box"))).filter("side in ('in', 'behind')")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        b = group["box"].iloc[0]
        half = math.hypot(b["length"], b["width"]) / 2
        lo = np.floor(np.array([b["x"] - half, b["y"] - half, b["z"] - b["height"] / 2]) / voxel)
        hi = np.floor(np.array([b["x"] + half, b["y"] + half, b["z"] + b["height"] / 2]) / voxel)
        passed, ended = set(), set()
        for p in group[["x", "y", "z"]].to_numpy(dtype=float):
            way = traverse(np.zeros(3), p, voxel)
            passed.update(v for v in way[:-1] if (v >= lo).all() and (v <= hi).all())
            ended.add(way[-1])
        cells = float(np.prod(hi - lo + 1))
        return pd.DataFrame([(group[frame].iloc[0], group["idx"].iloc[0], len(passed - ended) / cells)], columns=[frame, "idx", "free"])

    found = rows.select(F.col(frame).cast("string").alias(frame), "idx", "box", "x", "y", "z").groupBy(frame, "idx").applyInPandas(run, schema)
    return found.withColumn(frame, F.col(frame).cast(kind))


def hierarchy(points: DataFrame, boxes: DataFrame, frame: str, a: float = 0.50, b: float = 0.30, a2: float = 0.10, b2: float = 0.05, eps: float = 0.05, voxel: float = 0.25) -> DataFrame:
    """The cheap penetration test decides clear cases; only boxes in the band between go to voxels."""
    first = penetration(points, boxes, frame)
    unclear = first.filter(F.col("lpd").between(b2 - eps if b2 > eps else b2, a2 + eps)).select(frame, "idx")
    second = free_space(points, boxes.join(unclear, [frame, "idx"], "left_semi"), frame, voxel)
    judged = first.join(second, [frame, "idx"], "left").withColumn("adversarial", F.when(F.col("free").isNotNull(), F.col("free") >= (a + b) / 2).otherwise(F.col("lpd") > a2 + eps))
    return _verdict(points, judged.groupBy(frame).agg(F.count_if("adversarial").alias("adversarial")), frame, F.col("adversarial") > 0, "adversarial")


def jitter_verdicts(points: DataFrame, scene: str, index: str, window: int = 12, least_history: int = 5, eps: float = 0.7, least: int = 20, tolerance: float = 1.92, limit: float = 0.3, ego: tuple[float, float, float] = (2.0, 2.0, 1.4), ground: float = 0.1, point_limit: float = 0.08, both: bool = False, pose: str | None = None, first_differences: bool = False, axes: tuple[str, ...] = ("x", "y", "z"), least_past: int = 2) -> DataFrame:
    """Clusters whose range jitters about a straight line (or between frames, with ``first_differences``), or
    whose points do about their aligned past, by frame; with ``both`` only clusters of either kind at once.
    Frames too early have no verdict.

    ``pose`` names a row-major 4x4 column that takes a frame's points to the world.  Points are clustered in
    their own frame, followed in the world, and their ranges taken from where the newest frame's sensor was.
    Past frames without a pose are skipped; the newest must have one.  Clusters may be found on some ``axes`` only.
    """
    clean = ego_filter(points, *ego).filter(F.col("z") > ground)
    keyed = clean.withColumn("_frame", F.struct(scene, index))
    clustered = cluster_points(keyed, "_frame", "point_idx", eps, least, axes).withColumns({scene: F.col(f"_frame.{scene}").cast("string"), index: F.col(f"_frame.{index}").cast("int")})
    origins = None
    if pose:
        clustered = level(clustered.filter(F.col(pose).isNotNull()), pose)
        origins = clustered.groupBy(scene, index).agg(F.first(g.point(*(F.get(pose, F.lit(k)) for k in (3, 7, 11)))).alias("origin"))
    summary = clustered.filter("cluster >= 0").groupBy(scene, index, "cluster").agg(F.count("*").alias("n_points"), *(F.avg(a).cast("double").alias(a) for a in "xyz"))
    chained = chains(summary, scene, index, window, tolerance, 10)
    if origins is not None:
        chained = chained.join(origins, [scene, index]).withColumn("chain", F.transform("chain", lambda c: F.struct(c.idx.alias("idx"), c.cluster.alias("cluster"), *((c[a] - F.col(f"origin.{a}")).alias(a) for a in "xyz"))))
    tested = radial_jitter(chained, least_past, first_differences).filter("sigma_centroid is not null")
    tested = tested.join(aligned_sigma(clustered.filter("cluster >= 0"), tested, scene, index), [scene, index, "cluster"], "left")
    centre, point = F.col("sigma_centroid") > limit, F.coalesce(F.col("sigma_point") > point_limit, F.lit(False))
    per_frame = tested.groupBy(scene, index).agg(F.count("*").alias("tested"), F.count_if(centre & point if both else centre | point).alias("flagged"))
    frames = points.select(F.col(scene).cast("string").alias(scene), F.col(index).cast("int").alias(index)).distinct()
    out = frames.join(per_frame, [scene, index], "left").na.fill(0, ["tested", "flagged"])
    return out.select(scene, index, "tested", "flagged", F.when(F.col(index) >= least_history, F.col("flagged") > 0).alias("detected"), ratio(F.col("flagged"), F.col("tested")).alias("confidence"))


def grid_coherence(points: DataFrame, frame: str, theta: float = math.pi / 2 - 1.9, step_theta: float = 0.04, phi: tuple[float, float] = (-0.5, 0.5), step_phi: float = 0.02, least: int = 35, reach: float = 0.25, most: int = 5, ground: float = -1.84) -> DataFrame:
    """Dense groups in angular cells that hold ground and no ground alike: more than ``most`` in either way."""
    s = points.withColumn("s", g.spherical(F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double"))).filter((F.col("s.r") > 0) & F.col("s.phi").between(*phi) & (F.col("s.theta") >= abs(theta)))
    cells = s.withColumns({"it": F.floor(F.col("s.theta") / step_theta).cast("int"), "ip": F.floor((F.col("s.phi") - phi[0]) / step_phi).cast("int"), "low": F.col("z") <= ground})
    kinds = cells.groupBy(frame, "it", "ip").agg(F.bool_or("low").alias("has_ground"), F.bool_or(~F.col("low")).alias("has_object"))
    dense = neighbour_counts(cells.filter(~F.col("low")), frame, "point_idx", reach).filter(F.col("neighbours") >= least)
    groups = cells.join(dense.select(frame, "point_idx"), [frame, "point_idx"], "left_semi").select(frame, "it", "ip").distinct().join(kinds, [frame, "it", "ip"])
    counted = groups.groupBy(frame).agg(F.count_if("has_ground").alias("both"), F.count_if(~F.col("has_ground")).alias("neither"))
    return _verdict(points, counted, frame, (F.col("both") > most) | (F.col("neither") > most), "both", "neither")


def recentred(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Chain steps (``k`` back from the newest, centre x, y, z) with ``shift``: how far a constant velocity,
    fitted to the chain's centres, carries each step's cluster to the newest."""
    chain = W.partitionBy(*keys)
    slope = lambda a: F.coalesce(F.regr_slope(F.col(a), -F.col("k").cast("double")).over(chain), F.lit(0.0))
    return steps.withColumn("shift", g.point(*(slope(a) * F.col("k") for a in "xyz")))


def transport(clustered: DataFrame, chained: DataFrame, scene: str, index: str, floor: float = 1e-4, quantiles: int = 64) -> DataFrame:
    """``scene, index, cluster, n_past, rho``: of consecutive shapes of a chain, moved together by a fitted
    velocity, the median ratio of squared transport along the newest centre's ray to that across it.

    Shapes are compared by evenly spaced quantiles of their projections; one group is one cluster's points.
    """
    head = [scene, index, "cluster"]
    opened = chained.select(*head, F.posexplode("chain").alias("k", "c")).select(*head, "k", F.col("c.idx").alias("_at"), F.col("c.cluster").alias("_past"), "c.x", "c.y", "c.z")
    steps = recentred(opened, head).withColumn("ray", F.first(F.when(F.col("k") == 0, g.unit_ray(F.col("x"), F.col("y"), F.col("z"))), ignorenulls=True).over(W.partitionBy(*head)))
    steps = steps.drop("x", "y", "z")
    pts = clustered.select(F.col(scene).cast("string").alias("_s"), F.col(index).cast("int").alias("_i"), F.col("cluster").alias("_c"), *(F.col(a).cast("double").alias(a) for a in "xyz"))
    rows = steps.join(pts, (F.col(scene) == F.col("_s")) & (F.col("_at") == F.col("_i")) & (F.col("_past") == F.col("_c")))
    rows = rows.withColumn("p", g.point(*(F.col(a) + F.col(f"shift.{a}") for a in "xyz"))).withColumn("axes", g.basis(F.col("ray"), 0.9))
    shares = F.array(*(F.lit((j + 0.5) / quantiles) for j in range(quantiles)))
    sides = {"r": F.col("ray"), "u": F.col("axes.u"), "v": F.col("axes.v")}
    shapes = rows.groupBy(*head, "k").agg(*(F.percentile(g.dot(F.col("p"), axis), shares).alias(f"q{n}") for n, axis in sides.items()))
    by_step = W.partitionBy(*head).orderBy("k")
    gap = lambda q: F.aggregate(F.zip_with(q, F.lag(q).over(by_step), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / quantiles
    pairs = shapes.withColumns({f"w{n}": gap(F.col(f"q{n}")) for n in sides}).filter("k > 0")
    return pairs.groupBy(*head).agg(F.count("*").alias("n_past"), F.median(F.col("wr") / (F.col("wu") + F.col("wv") + floor)).alias("rho"))


def transport_verdicts(points: DataFrame, scene: str, index: str, window: int = 6, ground: float = -1.65, eps: float = 0.7, least: int = 10, tolerance: float = 1.0, limit: float = 5.0, least_past: int = 2, least_points: int = 10, **options) -> DataFrame:
    """Per frame the clusters tested, flagged for a transport ratio above ``limit``, and the greatest ratio."""
    clean = ego_filter(points, 3.0, 2.0, 1.4).filter(F.col("z") > ground).withColumn("_frame", F.struct(scene, index))
    clustered = cluster_points(clean, "_frame", "point_idx", eps, least).filter("cluster >= 0").withColumns({scene: F.col(f"_frame.{scene}").cast("string"), index: F.col(f"_frame.{index}").cast("int")})
    summary = clustered.groupBy(scene, index, "cluster").agg(F.count("*").alias("n_points"), *(F.avg(a).cast("double").alias(a) for a in "xyz"))
    chained = chains(summary, scene, index, window, tolerance, least_points).join(summary.filter(F.col("n_points") >= least_points).select(scene, index, "cluster"), [scene, index, "cluster"])
    tested = transport(clustered, chained.filter(F.size("chain") > least_past), scene, index, **options)
    per_frame = tested.groupBy(scene, index).agg(F.count("*").alias("tested"), F.count_if(F.col("rho") > limit).alias("flagged"), F.max("rho").alias("rho"))
    frames = points.select(F.col(scene).cast("string").alias(scene), F.col(index).cast("int").alias(index)).distinct()
    out = frames.join(per_frame, [scene, index], "left").na.fill(0, ["tested", "flagged"])
    return out.select(scene, index, "tested", "flagged", "rho", (F.col("flagged") > 0).alias("detected"), ratio(F.col("flagged"), F.col("tested")).alias("confidence"))


def _verdict(points: DataFrame, counted: DataFrame, frame: str, rule: F.Column, *columns: str) -> DataFrame:
    """One row per frame; frames without findings are not detected."""
    return points.select(frame).distinct().join(counted, frame, "left").na.fill(0, list(columns)).withColumn("detected", rule)


__all__ = ["coin_flip", "void_region", "shadow_volume", "penetration", "free_space", "hierarchy", "jitter_verdicts", "grid_coherence", "transport_verdicts", "dbscan"]
