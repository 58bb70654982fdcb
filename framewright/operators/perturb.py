"""Seeded changes of point clouds.  All randomness is a hash of seed and row, so results do not depend on
partitioning, order or what ran before."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions import geometry as g
from framewright.functions.numeric import normal, uniform, wrap_angle
from framewright.operators.spatial import outside_angle


@dataclass(frozen=True)
class Noise:
    """Distance noise of a spoofing device: kind, standard deviation, share of points kept, and the deviations
    of a point's and of a frame's common shift."""

    kind: str
    spread: float
    keep: float
    inner: float = 0.10
    inter: float = 0.35


# Noise of known sensors.
PRESETS = {
    "worst_case": Noise("none", 0.0, 1.0),
    "worst_case_high_error": Noise("none", 0.0, 1.0, 0.30, 0.70),
    "vlp16": Noise("none", 0.0, 0.985),
    "vlp32c": Noise("none", 0.0, 0.829),
    "os1_32": Noise("uniform", 0.333, 0.438),
    "helios": Noise("gaussian", 0.015, 0.194),
    "horizon": Noise("uniform", 0.260, 0.799),
    "l515": Noise("gaussian", 0.075, 0.001),
    "xt32": Noise("none", 0.0, 0.021),
}


def sample_points(points: DataFrame, by: list[str], key: str, n: F.Column, seed: int) -> DataFrame:
    """``n`` rows of each group without replacement, the ones of least hash."""
    chance = uniform(seed, *(F.col(c) for c in by), F.col(key))
    return points.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(chance, key))).filter(F.col("_n") <= n).drop("_n")


def inject_noise(points: DataFrame, frame: str, key: str, noise: Noise, seed: int) -> DataFrame:
    """Keeps a share of each frame's points, one at least, and moves them along their rays."""
    size = F.count("*").over(W.partitionBy(frame))
    chance = F.row_number().over(W.partitionBy(frame).orderBy(uniform(seed, F.lit("keep"), F.col(frame), F.col(key)), key))
    kept = points.withColumns({"_size": size, "_n": chance}).filter(F.col("_n") <= F.greatest(F.lit(1), F.bround(F.col("_size") * noise.keep))).drop("_size", "_n")
    own = {"none": F.lit(0.0), "uniform": (2 * uniform(seed, F.lit("own"), F.col(frame), F.col(key)) - 1) * (noise.spread * math.sqrt(3)), "gaussian": normal(seed, F.lit("own"), F.col(frame), F.col(key)) * noise.spread}[noise.kind]
    shift = own + normal(seed, F.lit("inner"), F.col(frame), F.col(key)) * noise.inner + normal(seed, F.lit("inter"), F.col(frame)) * noise.inter
    ray = g.unit_ray(F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double"))
    return kept.withColumns({"_ray": ray, "_shift": shift}).withColumns({a: F.col(a) + F.col("_shift") * F.col(f"_ray.{a}") for a in "xyz"}).drop("_ray", "_shift")


def remove_objects(points: DataFrame, boxes: DataFrame, frame: str, budget: int = 200, cone_deg: float = 10.0, extra: tuple[float, float] = (2.5, 2.5), seed: int = 0, noise: Noise | None = None, targets: list[str] | None = None) -> DataFrame:
    """Object removal: points of each box within a cone about its azimuth, ``budget`` at most, move outward.

    Boxes (``frame, order, lo, hi, x, y``, and ``type`` if only ``targets`` count) are taken in order, and a
    moved point can be taken again by a later box, so a frame's boxes run in one function; a group is one
    frame.  With ``noise`` only its share of each box's moved points comes back, one at least, moved further
    along their rays; the frame's common shift is the same for all boxes.
    """
    if targets is not None:
        boxes = boxes.filter(F.col("type").isin(targets))
    schema = points.select("*", F.lit(0).cast("int").alias("n_moved")).schema
    columns = points.columns
    half = math.radians(cone_deg)

    def run(p: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame(columns=[*columns, "n_moved"])
        p = p.sort_values("point_idx", kind="stable").reset_index(drop=True)
        xyz = p[["x", "y", "z"]].to_numpy(dtype=float)
        moved, gone = np.zeros(len(p), dtype="int32"), np.zeros(len(p), dtype=bool)
        common = np.random.default_rng([seed, *str(p[frame].iloc[0]).encode()]).normal(0.0, noise.inter) if noise else 0.0
        for r in b.sort_values("order").itertuples() if len(b) else ():
            lo, hi = np.array([r.lo["x"], r.lo["y"], r.lo["z"]]), np.array([r.hi["x"], r.hi["y"], r.hi["z"]])
            inside = ((xyz >= lo) & (xyz <= hi)).all(axis=1)
            turn = np.mod(np.arctan2(xyz[:, 1], xyz[:, 0]) - math.atan2(r.y, r.x) + math.pi, 2 * math.pi) - math.pi
            found = np.flatnonzero(inside & (np.abs(turn) <= half) & ~gone)
            rng = np.random.default_rng([seed, int(r.order), *str(p[frame].iloc[0]).encode()])
            if len(found) > budget:
                found = np.sort(rng.choice(found, budget, replace=False))
            xyz[found] += _rays(xyz[found]) * rng.uniform(*extra, (len(found), 1))
            moved[found] += 1
            if noise and len(found):
                back = np.sort(rng.choice(found, max(1, round(len(found) * noise.keep)), replace=False))
                gone[np.setdiff1d(found, back)] = True
                xyz[back] += _rays(xyz[back]) * (common + _shifts(noise, len(back), rng))[:, None]
        p[["x", "y", "z"]] = xyz.astype(p["x"].dtype)
        return p.assign(n_moved=moved).loc[~gone, [*columns, "n_moved"]]

    return points.groupBy(frame).cogroup(boxes.groupBy(frame)).applyInPandas(run, schema)


def _rays(xyz: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(xyz, axis=1, keepdims=True)
    return xyz / np.where(norm == 0, 1, norm)


def _shifts(noise: Noise, n: int, rng: np.random.Generator) -> np.ndarray:
    own = {"none": lambda: np.zeros(n), "uniform": lambda: rng.uniform(-1, 1, n) * noise.spread * math.sqrt(3), "gaussian": lambda: rng.normal(0, noise.spread, n)}[noise.kind]()
    return own + rng.normal(0, noise.inner, n)


def remove_objects_at_once(points: DataFrame, boxes: DataFrame, frame: str, cone_deg: float, extra: tuple[float, float], seed: int) -> DataFrame:
    """The planned variant: which points move is read off the original cloud, in built-in functions."""
    from framewright.operators.spatial import points_in_boxes

    turned = F.abs(wrap_angle(F.atan2(F.col("y"), F.col("x")) - F.col("box_az"))) <= math.radians(cone_deg)
    inside = g.in_box(F.col("x"), F.col("y"), F.col("z"), F.col("lo"), F.col("hi"))
    hit = points_in_boxes(points, boxes.withColumn("box_az", F.atan2("by", "bx")), frame, inside & turned).groupBy(frame, "point_idx").agg(F.min("order").alias("order"))
    away = F.lit(extra[0]) + (extra[1] - extra[0]) * uniform(seed, F.col(frame), F.col("point_idx"))
    ray = g.unit_ray(F.col("x"), F.col("y"), F.col("z"))
    return points.join(hit, [frame, "point_idx"], "left").withColumn("_ray", ray).withColumns({a: F.when(F.col("order").isNotNull(), F.col(a) + away * F.col(f"_ray.{a}")).otherwise(F.col(a)) for a in "xyz"}).drop("_ray")


def inject_ghost(points: DataFrame, ghost: DataFrame, frame: str, tolerance: float = 0.015) -> DataFrame:
    """Adds a ghost cloud to every frame and drops the points whose beams it blocks.

    ``ghost`` (x, y, z, intensity) is one object's scan, a few thousand points.  It is the same in every frame,
    so only its own beams are broadcast, never a frame's copy of them.
    """
    order = F.struct(*(f(c) for c in "xyz" for f in (F.isnull, F.col)))  # nulls last
    numbered = ghost.agg(F.array_sort(F.collect_list(F.struct(order.alias("_o"), F.struct(*ghost.columns).alias("_g")))).alias("_a")).select(F.posexplode("_a").alias("_n", "_e")).select("_n", "_e._g.*")
    added = points.select(frame).distinct().crossJoin(F.broadcast(numbered)).withColumn("point_idx", (F.col("_n") + 1 + (1 << 24)).cast("int")).drop("_n")
    kept = outside_angle(points, ghost, tolerance).withColumn("injected", F.lit(False))
    shared = [c for c in points.columns if c in added.columns]
    extra = added.select(*(F.col(c) if c in shared else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns)).withColumn("injected", F.lit(True))
    return kept.unionByName(extra)


def swap_sweeps(frames: DataFrame, replacements: DataFrame, path: str) -> DataFrame:
    """Clouds of the same base name from another folder; a frame without one is an error."""
    base = lambda c: F.regexp_extract(c, r"[^/]+$", 0)
    other = replacements.select(base(F.col(path)).alias("_base"), F.col(path).alias("_path"))
    joined = frames.withColumn("_base", base(F.col(path))).join(other, "_base", "left")
    found = F.when(F.col("_path").isNull(), F.raise_error(F.concat(F.lit("no replacement for "), F.col("_base")))).otherwise(F.col("_path"))
    return joined.withColumn(path, found).drop("_base", "_path")


def frame_attacks(frames: DataFrame, frame: str, share: float, seed: int) -> DataFrame:
    return frames.withColumn("is_attacked", uniform(seed, F.col(frame)) < share)


def demote_no_ops(frames: DataFrame, attacked: str, removed: str) -> DataFrame:
    """A frame from which the attack removed nothing is not attacked."""
    total = F.aggregate(F.coalesce(F.col(removed), F.array().cast("array<int>")), F.lit(0), lambda s, x: s + x)
    return frames.withColumn(attacked, F.col(attacked) & (total > 0))


def labels_from_predictions(predictions: DataFrame, least_score: float) -> DataFrame:
    """Predictions as labels; the fields that only annotators give are null."""
    return predictions.filter(F.col("score") >= least_score).drop("score").withColumns({"truncated": F.lit(None).cast("double"), "occluded": F.lit(None).cast("int"), "alpha": F.lit(None).cast("double")})
