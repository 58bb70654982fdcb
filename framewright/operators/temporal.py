"""Operators over a scene's ordered frames: windows keyed by scene, so each scene is one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_scene(scene: str, *order: str) -> W:
    return W.partitionBy(scene).orderBy(*order)


def frame_index(df: DataFrame, scene: str, order: list[str], name: str = "frame_index_in_scene") -> DataFrame:
    return df.withColumn(name, F.row_number().over(in_scene(scene, *order)) - 1)


def scene_lengths(df: DataFrame, scene: str) -> DataFrame:
    return df.groupBy(scene).agg(F.count("*").alias("scene_length"))


def scene_plan(scenes: DataFrame, attack: Column, prefix: Column, least: int) -> DataFrame:
    """Per scene whether and from which frame it is attacked; scenes too short are not."""
    long_enough = F.col("scene_length") >= least
    return scenes.withColumn("attack", attack & long_enough).withColumn("attack_start_index", F.when(F.col("attack"), prefix))


def attack_onset(df: DataFrame, scene: str, frame: str, index: str, start: str) -> DataFrame:
    """The frame at which each scene's attack starts."""
    return df.filter(F.col(index) == F.col(start)).select(scene, F.col(frame).alias("attack_start_frame_id"), start)


def phase_limits(df: DataFrame, scene: str, phase: str, order: list[str], skip: int, most: int) -> DataFrame:
    """Per scene and phase, the frames after the first ``skip``, ``most`` at most."""
    rank = F.row_number().over(W.partitionBy(scene, phase).orderBy(*order))
    return df.withColumn("_rank", rank).filter((F.col("_rank") > skip) & (F.col("_rank") <= skip + most)).drop("_rank")


def history(df: DataFrame, scene: str, order: list[str], value: str, window: int, name: str = "history") -> DataFrame:
    """The values of up to ``window - 1`` frames before, oldest first; a new scene starts empty."""
    return df.withColumn(name, F.collect_list(value).over(in_scene(scene, *order).rowsBetween(-(window - 1), -1)))


def cold_start(df: DataFrame, scene: str, order: list[str], window: int, least: int, name: str = "warm") -> DataFrame:
    """Whether a frame has at least ``least`` frames of history."""
    return df.withColumn(name, F.count("*").over(in_scene(scene, *order).rowsBetween(-(window - 1), -1)) >= least)


def strides(df: DataFrame, scene: str, order: list[str], value: str, back: list[int]) -> DataFrame:
    """One column for each number of frames back."""
    w = in_scene(scene, *order)
    return df.withColumns({f"{value}_back_{k}": F.lag(value, k).over(w) for k in back})


def recent(df: DataFrame, scene: str, seconds: str, value: str, span: float, most: int, name: str = "recent") -> DataFrame:
    """Values of earlier frames within ``span`` seconds, newest first, ``most`` at most."""
    micros = F.round(F.col(seconds) * 1_000_000).cast("long")  # range frames take whole numbers
    band = W.partitionBy(scene).orderBy(micros).rangeBetween(-round(span * 1_000_000), 0)
    pairs = F.collect_list(F.struct(F.col(seconds).alias("t"), F.col(value).alias("v"))).over(band)
    earlier = F.filter(pairs, lambda p: p.t < F.col(seconds))
    return df.withColumn(name, F.transform(F.slice(F.sort_array(earlier, asc=False), 1, most), lambda p: p.v))


def detrended_std(df: DataFrame, scene: str, x: str, y: str) -> DataFrame:
    """Population deviation of the residual of a straight-line fit, from sums alone: no second pass."""
    agg = df.groupBy(scene).agg(F.var_pop(y).alias("vy"), F.var_pop(x).alias("vx"), F.covar_pop(x, y).alias("c"), F.count("*").alias("n"))
    left = F.col("vy") - F.coalesce(F.try_divide(F.col("c") * F.col("c"), F.col("vx")), F.lit(0.0))
    return agg.select(scene, F.col("n"), F.sqrt(F.greatest(left, F.lit(0.0))).alias("sigma"))


def difference_std(df: DataFrame, scene: str, order: list[str], value: str) -> DataFrame:
    """Population deviation of first differences."""
    step = F.col(value) - F.lag(value).over(in_scene(scene, *order))
    return df.withColumn("_d", step).groupBy(scene).agg(F.stddev_pop("_d").alias("sigma"), F.count("_d").alias("n"))


def running_sum(df: DataFrame, scene: str, order: list[str], value: str, name: str = "total") -> DataFrame:
    return df.withColumn(name, F.sum(value).over(in_scene(scene, *order).rowsBetween(W.unboundedPreceding, 0)))


def cadence(df: DataFrame, scene: str, seconds: str, sweeps: int) -> DataFrame:
    """Spacing of frames: mean, median and range of gaps, rate, and the time that ``sweeps`` frames span."""
    gap = F.col(seconds) - F.lag(seconds).over(in_scene(scene, seconds))
    agg = df.withColumn("_g", gap).groupBy(scene).agg(F.avg("_g").alias("mean_gap"), F.median("_g").alias("median_gap"), F.min("_g").alias("min_gap"), F.max("_g").alias("max_gap"), F.count("_g").alias("n_gaps"))
    return agg.withColumns({"hz": F.try_divide(F.lit(1.0), F.col("median_gap")), "span": F.col("median_gap") * (sweeps - 1)})


def wasserstein_steps(df: DataFrame, scene: str, frame: str, value: str, quantiles: int = 64) -> DataFrame:
    """Root mean squared difference of evenly spaced quantiles between each frame and the one before."""
    shares = F.array(*(F.lit((k + 0.5) / quantiles) for k in range(quantiles)))
    q = df.groupBy(scene, frame).agg(F.percentile(value, shares).alias("q"))
    before = F.lag("q").over(in_scene(scene, frame))
    gap = F.zip_with("q", before, lambda a, b: (a - b) * (a - b))
    return q.withColumn("w2", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x) / quantiles)).drop("q")
