"""Binary point clouds: readers on Spark's binary source, a data source of our own, and a writer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

POINTS = "frame_id string, point_idx int, x float, y float, z float, intensity float"
_ARROW = pa.schema([("frame_id", pa.string()), ("point_idx", pa.int32()), *((c, pa.float32()) for c in ("x", "y", "z", "intensity"))])


def stem(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)*$", 1)


def decode(content: bytes, width: int) -> np.ndarray:
    """Rows of 32-bit floats; the first four columns are x, y, z and intensity."""
    if len(content) % (4 * width):
        raise ValueError(f"{len(content)} bytes are no whole rows of {width} floats")
    return np.frombuffer(content, dtype="<f4").reshape(-1, width)[:, :4]


def read_points(spark: SparkSession, path: str, width: int = 4) -> DataFrame:
    """All clouds under ``path`` as points; any store that Spark reads will do.  A file is one row, so
    memory in a task follows the largest file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, content in zip(batch.column("frame_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                p = decode(content, width)
                yield pa.RecordBatch.from_arrays([pa.array([frame] * len(p), pa.string()), pa.array(np.arange(len(p)), pa.int32()), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(4))], schema=_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    return files.select(stem(F.col("path")).alias("frame_id"), "content").mapInArrow(run, POINTS)


def write_points(points: DataFrame, path: str) -> None:
    """One binary row per frame: ``frame_id`` and its cloud in point order, as Parquet for any store.
    ``export_local`` turns such a table into files."""
    row = F.struct("point_idx", "x", "y", "z", "intensity")
    frames = points.groupBy("frame_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("rows")
            flat = rows.flatten()
            table = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype("<f4") for c in ("x", "y", "z", "intensity")], axis=1)
            ends = rows.offsets.to_numpy() - rows.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column("frame_id"), pa.array([table[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["frame_id", "content"])

    frames.mapInArrow(run, "frame_id string, content binary").write.mode("overwrite").parquet(path)


def export_local(spark: SparkSession, table: str, folder: str) -> int:
    """Write the clouds of a table from ``write_points`` as ``<frame>.bin`` files; one frame at a time."""
    from pathlib import Path

    count = 0
    for row in spark.read.parquet(table).toLocalIterator():
        Path(folder, f"{row['frame_id']}.bin").write_bytes(row["content"])
        count += 1
    return count


class PointCloudSource(DataSource):
    """``spark.read.format("pointcloud")`` over local ``.bin`` files; option ``width`` is 4 or 5."""

    @classmethod
    def name(cls) -> str:
        return "pointcloud"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema) -> DataSourceReader:
        return PointCloudReader(self.options)


class PointCloudReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options.get("width", 4))

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        folder = Path(self.path)
        if not folder.is_dir():
            raise FileNotFoundError(self.path)
        return [InputPartition(str(f)) for f in sorted(folder.glob("*.bin"))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pathlib import Path

        file = Path(partition.value)
        p = decode(file.read_bytes(), self.width)
        yield pa.RecordBatch.from_arrays([pa.array([file.stem] * len(p), pa.string()), pa.array(np.arange(len(p)), pa.int32()), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(4))], schema=_ARROW)
