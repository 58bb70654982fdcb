"""Result files: JSON lines of frames, caches, sweeps and metric tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAMES = "frame_id string, sequence_id string, frame_index_in_scene int, scene_length int, attack_start_index int, attack_start_frame_id string, is_attacked boolean, attack_successful boolean, clean_predictions_count int, attacked_predictions_count int, attack_metadata string, defense_result struct<is_attack_detected: boolean, confidence: double, metadata: string>"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """All ``*_frames.jsonl`` under ``path`` with their run folder; free-form metadata stays JSON text."""
    raw = spark.read.schema(FRAMES).option("recursiveFileLookup", True).option("pathGlobFilter", "*_frames.jsonl").json(path)
    return raw.withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def write_frames(frames: DataFrame, path: str) -> None:
    frames.write.mode("overwrite").json(path)


def cluster_details(frames: DataFrame) -> DataFrame:
    """One row per cluster of each frame's verdict; sigmas are null where a cluster was skipped."""
    kind = "array<struct<centroid: array<double>, n_points_cur: int, n_frames_associated: int, sigma_centroid: double, sigma_point: double, flagged_centroid: boolean, flagged_point: boolean, flagged: boolean, skipped: string>>"
    detail = F.from_json(F.get_json_object("defense_result.metadata", "$.cluster_details"), kind)
    return frames.select("run", "frame_id", "is_attacked", F.posexplode(detail).alias("cluster_idx", "c")).select("run", "frame_id", "is_attacked", "cluster_idx", "c.*")


def removed_objects(frames: DataFrame) -> DataFrame:
    kind = "array<struct<label_type: string, n_removed: int, reinjected_centroid: array<double>>>"
    return frames.select("run", "frame_id", F.posexplode(F.from_json(F.get_json_object("attack_metadata", "$.removed_per_obj"), kind)).alias("obj_idx", "o")).select("run", "frame_id", "obj_idx", "o.*")


def config_hash(config: dict) -> str:
    """Twelve hex digits of the canonical JSON of a configuration."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:12]


def split_hits(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows found in the cache with its values, rows still to compute)."""
    return wanted.join(cache, keys, "inner"), wanted.join(cache.select(*keys), keys, "left_anti")


def cache_summary(cache: DataFrame, attacked: str, cloud: str, predictions: str) -> DataFrame:
    return cache.agg(F.count("*").alias("n"), F.count_if(attacked).alias("attacked"), F.count(cloud).alias("with_cloud"), F.count(predictions).alias("with_predictions"))


def dot_path(json_text: Column, path: str) -> Column:
    """A nested value by its dotted path, as text."""
    return F.get_json_object(json_text, "$." + path)


def sort_nulls_last(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """By several keys, each rising or falling; null is last either way."""
    return df.orderBy(*(F.desc_nulls_last(k) if falling else F.asc_nulls_last(k) for k, falling in keys))


def scalar_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted paths of all leaves of a schema."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        out += scalar_paths(f.dataType, name + ".") if isinstance(f.dataType, T.StructType) else [name]
    return out


def prune(df: DataFrame, path: str) -> DataFrame:
    """Without a nested field."""
    head, _, rest = path.partition(".")
    return df.withColumn(head, F.col(head).dropFields(rest)) if rest else df.drop(head)


def metric_row(summary: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Flat columns from nested numbers; what is missing is NaN."""
    return summary.select(*(F.coalesce(F.col(p).cast("double"), F.lit(float("nan"))).alias(n) for n, p in paths.items()))


def unpivot_ap(df: DataFrame, keys: list[str]) -> DataFrame:
    """``<class>_ap_<level>`` columns as rows."""
    columns = [c for c in df.columns if c not in keys and c.rsplit("_ap_", 1)[-1] in ("easy", "moderate", "hard")]
    long = df.unpivot(keys, columns, "metric", "ap")
    return long.select(*keys, F.regexp_extract("metric", r"^(.+)_ap_(easy|moderate|hard)$", 1).alias("class"), F.regexp_extract("metric", r"^(.+)_ap_(easy|moderate|hard)$", 2).alias("level"), "ap")


def budget_of(path: Column) -> Column:
    """The attack budget that a file's name states."""
    return F.regexp_extract(path, r"budget[_-]?(\d+)", 1).try_cast("int")


def even_sample(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """``n`` rows evenly spaced over an order of at most a report's size."""
    total = df.count()
    places = sorted({round(k * (total - 1) / max(1, n - 1)) for k in range(min(n, total))})
    return df.withColumn("_n", F.row_number().over(W.orderBy(*order)) - 1).filter(F.col("_n").isin(places)).drop("_n")
