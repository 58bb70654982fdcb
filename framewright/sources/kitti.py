"""Text files of the KITTI layout: labels, calibrations, split lists, and the joined dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.sources.pointcloud import stem

LABEL_FIELDS = [("type", "string"), ("truncated", "double"), ("occluded", "int"), ("alpha", "double"), ("x1", "double"), ("y1", "double"), ("x2", "double"), ("y2", "double"), ("height", "double"), ("width", "double"), ("length", "double"), ("x", "double"), ("y", "double"), ("z", "double"), ("rotation_y", "double")]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file's stem and number, in file order: a file is read whole, it is small text."""
    files = spark.read.option("wholetext", True).text(path).select(stem(F.input_file_name()).alias("frame_id"), "value")
    return files.select("frame_id", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).filter(F.trim("line") != "")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """15 fields per line, blank lines skipped, further fields (scores) ignored."""
    parts = F.split(F.trim("line"), r"\s+")
    fields = [parts[k].cast(t).alias(n) for k, (n, t) in enumerate(LABEL_FIELDS)]
    numbered = F.row_number().over(_by_line()) - 1
    return _lines(spark, path).withColumn("label_idx", numbered).select("frame_id", "label_idx", *fields)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_labels`, with the score as the sixteenth field; lines without all sixteen numbers are skipped."""
    parts = F.split(F.trim("line"), r"\s+")
    fields = [F.try_element_at(parts, F.lit(k + 1)).try_cast(t).alias(n) for k, (n, t) in enumerate([*LABEL_FIELDS, ("score", "double")])]
    whole = _lines(spark, path).select("frame_id", "line_no", *fields)
    needed = [n for n, _ in LABEL_FIELDS if n not in ("truncated", "occluded")] + ["score"]
    kept = whole.filter(" and ".join(f"{n} is not null" for n in needed))
    return kept.withColumn("idx", F.row_number().over(_by_line()) - 1).drop("line_no")


def _by_line():
    from pyspark.sql import Window as W

    return W.partitionBy("frame_id").orderBy("line_no")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """``key: values`` lines as one row per frame; lines without a colon are skipped; P2 may be missing."""
    lines = _lines(spark, path).filter(F.col("line").contains(":"))
    pair = lines.select("frame_id", F.trim(F.substring_index("line", ":", 1)).alias("key"), F.transform(F.split(F.trim(F.regexp_replace("line", "^[^:]*:", "")), r"\s+"), lambda v: v.cast("double")).alias("values"))
    pick = lambda *names: F.first(F.when(F.col("key").isin(*names), F.col("values")), ignorenulls=True)
    return pair.groupBy("frame_id").agg(pick("R0_rect", "R_rect").alias("r0_rect"), pick("Tr_velo_to_cam", "Tr_velo_cam").alias("tr_velo_to_cam"), pick("P2").alias("p2"))


def read_split(spark: SparkSession, path: str, head: int | None = None) -> DataFrame:
    """Frame ids of a split list in file order, the first ``head`` of them."""
    lines = _lines(spark, path).select("line_no", F.trim("line").alias("frame_id"))
    return (lines.orderBy("line_no").limit(head) if head is not None else lines).select("frame_id", "line_no")


def dataset(points: DataFrame, labels: DataFrame, calibration: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One row per frame that has points: counts and its calibration; ``wanted`` limits the ids first."""
    p = points if wanted is None else points.join(wanted.select("frame_id"), "frame_id", "left_semi")
    frames = p.groupBy("frame_id").agg(F.count("*").alias("n_points"))
    counts = labels.groupBy("frame_id").agg(F.count("*").alias("n_labels"))
    return frames.join(counts, "frame_id", "left").join(calibration, "frame_id", "left").na.fill(0, ["n_labels"])


def image_size(spark: SparkSession, path: str) -> DataFrame:
    """Height and width from PNG headers, null for what is no PNG."""
    head = F.substring("content", 1, 24)
    whole = spark.read.format("binaryFile").load(path).select(stem(F.col("path")).alias("frame_id"), F.hex(head).alias("h"))
    number = lambda at: F.conv(F.substring("h", at, 8), 16, 10).cast("int")
    png = F.col("h").startswith("89504E470D0A1A0A")
    return whole.select("frame_id", F.when(png, number(41)).alias("height"), F.when(png, number(33)).alias("width"))
