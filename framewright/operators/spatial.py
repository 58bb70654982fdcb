"""Range and nearest-neighbour joins on cell keys, grids and voxels.

A range predicate alone would plan as a nested loop.  Here both sides get integer cells, an equi-join on
(frame, cell) finds candidates, and the exact predicate decides.  Boxes are put into every cell that they
touch, so a pair is found once per point: a point has one cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import geometry as g
from framewright.functions.numeric import wrap_angle


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def cells_between(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(cell(lo, size), cell(hi, size))


def with_cells(points: DataFrame, size: float, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    return points.withColumns({f"_c{a}": cell(F.col(a), size) for a in axes})


def boxes_in_cells(boxes: DataFrame, size: float, axes: tuple[str, ...] = ("x", "y"), lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Each box once for every cell that its bounds touch."""
    out = boxes
    for a in axes:
        out = out.withColumn(f"_c{a}", F.explode(cells_between(F.col(lo)[a], F.col(hi)[a], size)))
    return out


def points_in_boxes(points: DataFrame, boxes: DataFrame, frame: str, predicate: Column, size: float = 4.0, axes: tuple[str, ...] = ("x", "y"), how: str = "inner") -> DataFrame:
    """``points`` (frame, x, y, z, ...) joined with ``boxes`` (frame, lo, hi, ...) where ``predicate`` holds.

    ``how`` may be inner, left_semi or left_anti.
    """
    keys = [frame, *(f"_c{a}" for a in axes)]
    right = boxes_in_cells(boxes, size, axes)
    renamed = right.select(*(F.col(k).alias(f"_b_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    left = with_cells(points, size, axes)
    for k in keys:
        same = same & (left[k] == renamed[f"_b_{k}"])
    return left.join(renamed, same & predicate, how).drop(*(f"_b_{k}" for k in keys), *keys[1:])


def first_box(points: DataFrame, boxes: DataFrame, frame: str, point_key: list[str], order: str, predicate: Column, size: float = 4.0) -> DataFrame:
    """Each point with its first box by ``order``; boxes that get no point keep no number, the others are
    numbered densely within their frame."""
    from pyspark.sql import Window as W

    hit = points_in_boxes(points, boxes, frame, predicate, size)
    first = hit.groupBy(frame, *point_key).agg(F.min(order).alias(order))
    return first.withColumn("cluster", F.dense_rank().over(W.partitionBy(frame).orderBy(order)) - 1)


def neighbour_counts(points: DataFrame, frame: str, key: str, eps: float) -> DataFrame:
    """How many other points of the frame lie within ``eps``: each point meets 27 cells."""
    shift = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    own = points.select(frame, F.col(key).alias("_k"), *("x y z".split()), *(cell(F.col(a), eps).alias(f"_c{a}") for a in "xyz"))
    spread = own
    for a in "xyz":
        spread = spread.withColumn(f"_s{a}", F.explode(shift)).withColumn(f"_c{a}", F.col(f"_c{a}") + F.col(f"_s{a}")).drop(f"_s{a}")
    other = own.select(F.col(frame).alias("_f2"), F.col("_k").alias("_k2"), *(F.col(a).alias(f"{a}2") for a in "xyz"), *(F.col(f"_c{a}").alias(f"_d{a}") for a in "xyz"))
    same = (spread[frame] == other["_f2"]) & (F.col("_cx") == F.col("_dx")) & (F.col("_cy") == F.col("_dy")) & (F.col("_cz") == F.col("_dz"))
    near = (F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2) + F.pow(F.col("z") - F.col("z2"), 2)) <= eps * eps
    pairs = spread.join(other, same & near & (F.col("_k") != F.col("_k2")))
    found = pairs.groupBy(frame, F.col("_k").alias(key)).agg(F.count("*").alias("neighbours"))
    return points.select(frame, key).join(found, [frame, key], "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))


def outside_angle(points: DataFrame, others: DataFrame, tolerance: float) -> DataFrame:
    """The points without a beam of ``others`` strictly nearer than ``tolerance`` in azimuth and elevation;
    ``others`` is one small cloud, for all frames the same."""
    beam = g.beam(F.col("x"), F.col("y"), F.col("z"))
    shift = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    o = others.select(beam.alias("_o")).withColumn("_sa", F.explode(shift)).withColumn("_se", F.explode(shift))
    o = o.select("_o", (cell(F.col("_o.az"), tolerance) + F.col("_sa")).alias("_a"), (cell(F.col("_o.el"), tolerance) + F.col("_se")).alias("_e"))
    p = points.withColumn("_p", beam).withColumns({"_ca": cell(F.col("_p.az"), tolerance), "_ce": cell(F.col("_p.el"), tolerance)})
    near = F.hypot(F.col("_p.az") - F.col("_o.az"), F.col("_p.el") - F.col("_o.el")) < tolerance
    return p.join(F.broadcast(o), (F.col("_ca") == F.col("_a")) & (F.col("_ce") == F.col("_e")) & near, "left_anti").select(*points.columns)


def nearest_in_frame(left: DataFrame, right: DataFrame, frame: str, key: str, target: str) -> DataFrame:
    """For each row of ``left`` the nearest of its frame's ``right`` rows; the least ``target`` among equals.
    Both sides are cluster summaries, a handful per frame."""
    r = right.select(F.col(frame).alias("_f"), F.col(target), *(F.col(a).alias(f"{a}2") for a in "xyz"))
    d = g.radius(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"), F.col("z") - F.col("z2"))
    pairs = left.join(r, left[frame] == r["_f"]).withColumn("distance", d)
    return pairs.groupBy(frame, key).agg(F.min(F.struct("distance", target)).alias("_n")).select(frame, key, F.col(f"_n.{target}").alias(target), F.col("_n.distance").alias("distance"))


def gate_counts(flagged: DataFrame, phantoms: DataFrame, frame: str, gate: float) -> DataFrame:
    """Per frame: flagged within the gate of a phantom (tp), flagged elsewhere (fp), phantoms uncovered (fn)."""
    f = nearest_in_frame(flagged, phantoms, frame, "key", "target")
    p = nearest_in_frame(phantoms.withColumnRenamed("target", "key"), flagged.withColumnRenamed("key", "target"), frame, "key", "target")
    near_f = flagged.join(f.select(frame, "key", "distance"), [frame, "key"], "left").groupBy(frame).agg(F.count_if(F.coalesce(F.col("distance") <= gate, F.lit(False))).alias("tp"), F.count("*").alias("n"))
    near_p = phantoms.select(frame, F.col("target").alias("key")).join(p.select(frame, "key", "distance"), [frame, "key"], "left").groupBy(frame).agg(F.count_if(~F.coalesce(F.col("distance") <= gate, F.lit(False))).alias("fn"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return near_f.join(near_p, frame, "full").select(frame, zero(F.col("tp")).alias("tp"), (zero(F.col("n")) - zero(F.col("tp"))).alias("fp"), zero(F.col("fn")).alias("fn"))


def voxels(points: DataFrame, frame: str, size: tuple[float, float, float], lo: tuple[float, float, float] | None = None, hi: tuple[float, float, float] | None = None) -> DataFrame:
    """Distinct occupied voxels, in single precision as sensors store points; ``lo`` and ``hi`` bound them
    openly, and indices start at the lower bound's."""
    p = points
    if lo is not None and hi is not None:
        for a, low, high in zip("xyz", lo, hi, strict=True):
            p = p.filter((F.col(a) > low) & (F.col(a) < high))
    index = lambda v, s: F.floor(v.cast("float") / F.lit(s).cast("float")).cast("int")
    first = {a: index(F.lit(lo[k]), size[k]) if lo is not None else F.lit(0) for k, a in enumerate("xyz")}
    return p.select(frame, *((index(F.col(a), size[k]) - first[a]).alias(f"i{a}") for k, a in enumerate("xyz"))).distinct()


def empty_cells(points: DataFrame, frame: str, x: tuple[float, float], y: tuple[float, float], stride: float) -> DataFrame:
    """Ground cells of a half-open region that hold no point of their frame."""
    inside = points.filter((F.col("x") >= x[0]) & (F.col("x") < x[1]) & (F.col("y") >= y[0]) & (F.col("y") < y[1]))
    full = inside.select(frame, F.floor((F.col("x") - x[0]) / stride).cast("int").alias("ix"), F.floor((F.col("y") - y[0]) / stride).cast("int").alias("iy")).distinct()
    nx, ny = round((x[1] - x[0]) / stride), round((y[1] - y[0]) / stride)
    grid = points.select(frame).distinct().withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    return grid.join(full, [frame, "ix", "iy"], "left_anti")


def cluster_stats(points: DataFrame, by: list[str]) -> DataFrame:
    """Centre, bounds, extent and size."""
    aggs = [x for a in "xyz" for x in (F.avg(a).alias(f"c{a}"), F.min(a).alias(f"min_{a}"), F.max(a).alias(f"max_{a}"), (F.max(a) - F.min(a)).alias(f"size_{a}"))]
    return points.groupBy(*by).agg(F.count("*").alias("n_points"), *aggs)


def cloud_difference(left: DataFrame, right: DataFrame, frame: str, scale: float = 1000.0) -> DataFrame:
    """Points of ``left`` that ``right`` does not have after rounding to 1/scale."""
    keys = lambda df: df.withColumns({f"_r{a}": F.round(F.col(a) * scale).cast("long") for a in "xyz"})
    return keys(left).join(keys(right).select(frame, "_rx", "_ry", "_rz"), [frame, "_rx", "_ry", "_rz"], "left_anti").drop("_rx", "_ry", "_rz")


def cloud_intersection(left: DataFrame, right: DataFrame, frame: str, scale: float = 1000.0) -> DataFrame:
    """Points of ``left`` that ``right`` has too after rounding to 1/scale."""
    keys = lambda df: df.withColumns({f"_r{a}": F.round(F.col(a) * scale).cast("long") for a in "xyz"})
    return keys(left).join(keys(right).select(frame, "_rx", "_ry", "_rz"), [frame, "_rx", "_ry", "_rz"], "left_semi").drop("_rx", "_ry", "_rz")


def sorted_voxels(cells: DataFrame, frame: str) -> DataFrame:
    """Voxels by their indices; every task sorts a range of frames and cells."""
    return cells.orderBy(frame, "ix", "iy", "iz")


def cluster_labels(clustered: DataFrame, boxes: DataFrame, frame: str) -> DataFrame:
    """``frame, cluster, labels``: for every cluster the boxes that hold any of its points, in order."""
    inside = g.in_box(F.col("x"), F.col("y"), F.col("z"), F.col("lo"), F.col("hi"))
    found = points_in_boxes(clustered.filter("cluster >= 0"), boxes.select(frame, F.col("idx").alias("label"), "lo", "hi"), frame, inside)
    some = found.groupBy(frame, "cluster").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    every = clustered.filter("cluster >= 0").select(frame, "cluster").distinct()
    none = F.array().cast(some.schema["labels"].dataType)
    return every.join(some, [frame, "cluster"], "left").withColumn("labels", F.coalesce("labels", none))


def bearing_pairs(left: DataFrame, right: DataFrame, frame: str, most_deg: float = 20.0, reach: float = 10.0) -> DataFrame:
    """``frame, a, b`` of rows (``idx, x, y``) of one frame that are seen under bearings less than ``most_deg`` apart
    and lie less than ``reach`` apart."""
    shift = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    a = left.select(frame, F.col("idx").alias("a"), "x", "y", cell(F.col("x"), reach).alias("_cx"), cell(F.col("y"), reach).alias("_cy"))
    b = right.select(F.col(frame).alias("_f"), F.col("idx").alias("b"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.explode(shift).alias("_sx"))
    b = b.withColumn("_sy", F.explode(shift)).withColumns({"_dx": cell(F.col("_x"), reach) + F.col("_sx"), "_dy": cell(F.col("_y"), reach) + F.col("_sy")})
    turn = F.abs(wrap_angle(F.atan2("y", "x") - F.atan2("_y", "_x")))
    near = (F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) < reach) & (turn < math.radians(most_deg))
    return a.join(b, (F.col(frame) == F.col("_f")) & (F.col("_cx") == F.col("_dx")) & (F.col("_cy") == F.col("_dy")) & near).select(frame, "a", "b")


def pillars(points: DataFrame, frame: str, key: str, size: float, most: int, seed: int = 0) -> DataFrame:
    """Up to ``most`` points of each pillar, chosen by hash, with their offsets from the pillar's mean."""
    from pyspark.sql import Window as W

    from framewright.functions.numeric import uniform

    placed = with_cells(points, size).withColumnsRenamed({"_cx": "px", "_cy": "py"})
    pillar = W.partitionBy(frame, "px", "py")
    mean = {f"d{a}": F.col(a) - F.avg(a).over(pillar) for a in "xyz"}
    return placed.withColumns(mean).withColumn("_n", F.row_number().over(pillar.orderBy(uniform(seed, F.col(frame), F.col(key)), key))).filter(F.col("_n") <= most).drop("_n")
