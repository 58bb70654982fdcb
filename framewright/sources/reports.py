"""What sweeps report: flat metric rows from nested summaries, CSV and JSON files, run metadata, finished scenes."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.spatial import nearest_in_frame
from framewright.sources.results import budget_of, cluster_details, removed_objects

# The columns of each report, in order, and where a summary has them.
RATES = {"detection_f1": "f1", "detection_precision": "precision", "detection_recall": "recall", "tpr": "tpr", "fpr": "fpr"}
FIELDS = {
    "defense_effectiveness": RATES,
    "defense_effectiveness_filtered": RATES,
    "attack_success_rate": {c: c for c in ("attack_success_rate", "n_successful", "n_attacked_frames")},
    "clustering_quality": {c: c for c in ("spoofed_f1", "pred_f1", "precision", "spoofed_recall", "pred_recall")},
    "pacts_effectiveness": {f"pacts_{c}": c for c in ("f1", "precision", "recall")},
    "llm_attack_type_accuracy": {c: c for c in ("n_tp_detected", "n_correct_type", "n_incorrect_type", "type_accuracy")},
    "llm_cost_metrics": {c: c for c in (*(f"{f}_{s}" for f in ("input_tokens", "output_tokens", "thoughts_token_count") for s in ("mean", "median", "std")), "n_frames", "n_api_frames")},
}
DROPS = ("detection_rate_clean", "detection_rate_attacked", "absolute_drop", "relative_drop")
STATISTICS = ("mean", "median", "std")
KINDS = ("ap", "detection_rate", *FIELDS, "timing_metrics")


def columns_of(kind: str, classes: list[str], levels: list[str], timings: list[str]) -> dict[str, str]:
    """Column names of a report in order, with the JSON path of each in a summary."""
    quoted = lambda *keys: "$" + "".join(f"['{k}']" for k in keys)
    if kind == "ap":
        return {f"{c.lower()}_ap_{d.lower()}": quoted("attack_effectiveness", "attacked_map", c, d) for c in classes for d in levels}
    if kind == "detection_rate":
        return {("" if c == "overall" else f"{c}_") + d: quoted(kind, c, d) for c in ("overall", *classes) for d in DROPS}
    if kind == "timing_metrics":
        return {"n_frames": quoted(kind, "n_frames")} | {f"{t}_{s}": quoted(kind, t, s) for t in timings for s in STATISTICS}
    return {name: quoted(kind, key) for name, key in FIELDS[kind].items()}


def timing_names(summaries: DataFrame) -> list[str]:
    """The nested timings that any summary has; a report has a handful."""
    names = summaries.select(F.explode(F.json_object_keys(F.get_json_object("summary", "$.timing_metrics"))).alias("k"), "summary")
    nested = names.filter(F.get_json_object("summary", "$.timing_metrics").isNotNull() & (F.col("k") != "n_frames")).select("k").distinct()
    return sorted(r.k for r in nested.collect())


def metric_rows(summaries: DataFrame, parameter: str, kind: str, classes: list[str] = (), levels: list[str] = ("Easy", "Moderate", "Hard"), timings: list[str] | None = None) -> DataFrame:
    """``parameter`` and one number per column of the report, NaN where a summary has none.

    ``summaries`` has the swept value, named ``parameter``, and ``summary``, a run's nested JSON.
    """
    if kind == "timing_metrics" and timings is None:
        timings = timing_names(summaries)
    number = lambda path: F.coalesce(F.get_json_object("summary", path).try_cast("double"), F.lit(float("nan")))
    return summaries.select(parameter, *(number(path).alias(name) for name, path in columns_of(kind, list(classes), list(levels), timings or []).items()))


def write_report(rows: DataFrame, parameter: str, path: str) -> None:
    """One CSV file with a header, by the swept value; a report has one row per run."""
    rows.coalesce(1).sortWithinPartitions(parameter).write.mode("overwrite").option("header", True).csv(path)


def write_reports(summaries: DataFrame, parameter: str, tag: str, folder: str, classes: list[str], levels: list[str] = ("Easy", "Moderate", "Hard")) -> None:
    """All kinds of reports of a sweep, each in a folder of its own."""
    for kind in KINDS:
        write_report(metric_rows(summaries, parameter, kind, classes, levels), parameter, f"{folder}/sweep_{tag}_{kind}")


def curves(points: DataFrame, parameter: str, order: str) -> DataFrame:
    """``parameter, curves``: the points of each swept value's curves, in order; a curve has tens of points."""
    rest = [c for c in points.columns if c != parameter]
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*rest).alias("_point"))), lambda a, b: F.when(a["_order"] < b["_order"], -1).when(a["_order"] > b["_order"], 1).otherwise(0))
    return points.groupBy(parameter).agg(F.transform(ordered, lambda p: p["_point"]).alias("curves"))


def write_curves(points: DataFrame, parameter: str, order: str, path: str) -> None:
    curves(points, parameter, order).coalesce(1).sortWithinPartitions(parameter).write.mode("overwrite").json(path)


def summary(**metrics: DataFrame) -> DataFrame:
    """One row, a struct per metric of one row, to be written as JSON."""
    out = None
    for name, df in metrics.items():
        one = df.limit(1).select(F.struct(*df.columns).alias(name), F.lit(1).alias("_one"))
        out = one if out is None else out.join(one, "_one", "full")
    return out.drop("_one")


def run_metadata(spark: SparkSession, arguments: dict, swept: str | None = None, presets: dict | None = None, folder: str = ".") -> DataFrame:
    """One row of JSON text: the code's version and the arguments, without the swept one, presets by name."""
    named = {id(v): k for k, v in (presets or {}).items()}
    kept = {k: named.get(id(v), v) for k, v in arguments.items() if k != swept}
    version = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True)
    text = json.dumps({"git_hash": version.stdout.strip() or None, "sweep_param": swept, "args": kept}, default=str, sort_keys=True)
    return spark.createDataFrame([(text,)], "metadata string")


def by_budget(rows: DataFrame, path: str, keys: list[str] = ()) -> DataFrame:
    """Metric rows of files whose names state a budget, by that number; files without one are not kept."""
    return rows.withColumn("budget", budget_of(F.col(path))).filter("budget is not null").orderBy("budget", *keys)


def frame_lines(frames: DataFrame, verbose: bool = False) -> DataFrame:
    """Frame results as they are stored: prediction lists become counts unless ``verbose``."""
    out = frames
    for name in ("clean_predictions", "attacked_predictions"):
        if name in frames.columns and not verbose:
            out = out.withColumn(f"{name}_count", F.when(F.col(name).isNotNull(), F.size(name))).drop(name)
    return out


def spoofed_summary(frames: DataFrame, gate: float) -> DataFrame:
    """Per run: attacked objects, frames with any, clusters nearer than ``gate`` to a reinjected centre, and
    how many objects that leaves, in percent."""
    removed = removed_objects(frames)
    per_run = removed.groupBy("run").agg(F.count("*").alias("attacked_objects"), F.count_distinct("frame_id").alias("attacked_frames"))
    at = lambda c: [F.get(c, F.lit(k)).alias(a) for k, a in enumerate("xyz")]
    key = F.concat_ws("\x1f", "run", "frame_id").alias("frame")
    centres = removed.filter(F.size("reinjected_centroid") == 3).select(key, F.col("obj_idx").alias("target"), *at("reinjected_centroid"))
    found = cluster_details(frames).select(key, "run", F.col("cluster_idx").alias("key"), *at("centroid")).filter("x is not null and y is not null and z is not null")
    near = nearest_in_frame(found, centres, "frame", "key", "target").filter(F.col("distance") < gate)
    spoofed = near.groupBy(F.substring_index("frame", "\x1f", 1).alias("run")).agg(F.count("*").alias("spoofed_clusters"))
    rows = per_run.join(spoofed, "run", "left").withColumn("spoofed_clusters", F.coalesce("spoofed_clusters", F.lit(0)))
    missing = F.col("attacked_objects") - F.col("spoofed_clusters")
    return rows.withColumns({"missing": missing, "missing_percent": F.coalesce(F.try_divide(missing * 100.0, F.col("attacked_objects")), F.lit(0.0))})


# scenes that are done


def write_scenes(results: DataFrame, path: str) -> None:
    """Append results in a folder per run and scene; a folder is whole once its write is committed."""
    results.write.mode("append").partitionBy("run", "sequence_id").parquet(path)


def remaining_scenes(frames: DataFrame, finished: DataFrame) -> DataFrame:
    """Frames of the runs and scenes that have no result yet: rerunning a sweep continues it."""
    return frames.join(finished.select("run", "sequence_id").distinct(), ["run", "sequence_id"], "left_anti")


# clouds


def read_ghost(spark: SparkSession, path: str) -> DataFrame:
    """``x, y, z, intensity`` of an array file of one object's scan; another shape is an error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                cloud = np.load(BytesIO(content), allow_pickle=False)
                if cloud.ndim != 2 or cloud.shape[1] != 4:
                    raise ValueError(f"{name}: four columns are expected, the shape is {cloud.shape}")
                yield pd.DataFrame(cloud.astype("float32"), columns=["x", "y", "z", "intensity"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "x float, y float, z float, intensity float")
