"""Parameter sweeps: values are rows, so one job evaluates them all, and resuming is an anti-join."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.metrics import binary_metrics


@dataclass(frozen=True)
class ExperimentConfig:
    """What an experiment needs; unknown keys of a mapping are ignored."""

    dataset: str = "kitti"
    attack: str | None = None
    detector: str | None = None
    defense: str | None = None
    attack_params: dict = field(default_factory=dict)
    defense_params: dict = field(default_factory=dict)
    attack_fraction: float = 0.0
    min_unattacked: int = 0
    min_attacked: int = 1
    skip_per_scene: int = 0
    max_per_scene: int | None = None
    seed: int = 0

    @classmethod
    def of(cls, values: dict) -> ExperimentConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})


#: Named operators: DataFrame functions by role and name.
REGISTRY: dict[str, dict[str, Callable]] = {"attack": {}, "detector": {}, "defense": {}}


def register(role: str, name: str) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        REGISTRY[role][name] = f
        return f

    return add


def lookup(role: str, name: str) -> Callable:
    if name not in REGISTRY[role]:
        raise KeyError(f"no {role} named {name!r}; there are {', '.join(sorted(REGISTRY[role])) or 'none'}")
    return REGISTRY[role][name]


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """The product of short lists of parameter values."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.crossJoin(one)
    return out


def sweep_thresholds(frames: DataFrame, values: DataFrame, parameter: str, score: str, actual: str) -> DataFrame:
    """Binary metrics at each threshold.  ``values`` is the sweep's axis, a handful of rows; scores are
    first counted by the number of thresholds they pass, so rows do not multiply by the axis."""
    axis = values.agg(F.sort_array(F.collect_set(parameter)).alias("_axis"))
    passed = F.size(F.filter("_axis", lambda t: F.col(score) > t))
    cells = frames.filter(F.col(score).isNotNull()).crossJoin(F.broadcast(axis)).groupBy(F.col(actual).alias("actual"), passed.alias("passed")).agg(F.count("*").alias("k"))
    ordered = axis.select(F.posexplode("_axis").alias("place", parameter))
    hit = F.col("passed") > F.col("place")
    sums = {"tp": F.col("actual") & hit, "fp": ~F.col("actual") & hit, "tn": ~F.col("actual") & ~hit, "fn": F.col("actual") & ~hit}
    from framewright.operators.metrics import with_rates

    counted = cells.crossJoin(F.broadcast(ordered)).groupBy(parameter).agg(*(F.sum(F.when(c, F.col("k")).otherwise(0)).alias(n) for n, c in sums.items()))
    return with_rates(counted)


def remaining(values: DataFrame, finished: DataFrame, parameter: str) -> DataFrame:
    """Values that have no result yet."""
    return values.join(finished.select(parameter).distinct(), parameter, "left_anti")


def tune(frames: DataFrame, values: DataFrame, parameter: str, score: str, actual: str, split: str, tune_on: str, report_on: str, objective: str = "f1") -> DataFrame:
    """The best value on one split and its metrics on another; the two must differ."""
    if tune_on == report_on:
        raise ValueError("tune and report splits must differ")
    tuned = sweep_thresholds(frames.filter(F.col(split) == tune_on), values, parameter, score, actual)
    best = tuned.orderBy(F.desc(objective), parameter).limit(1).select(parameter, F.lit(objective).alias("objective"), F.col(objective).alias("tuned"))
    held = frames.filter(F.col(split) == report_on).crossJoin(F.broadcast(best.select(parameter))).withColumn("_p", F.col(score) > F.col(parameter))
    return best.crossJoin(binary_metrics(held, actual, "_p"))
