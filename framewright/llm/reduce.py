"""Sums of fixed-length vectors over all tasks, by a tree of grouped sums.

Every task contributes one vector.  Groups hold at most ``FAN_IN`` vectors, so that no task ever
gathers more than that many, however many tasks there were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.scratch import materialize

FAN_IN = 24


def tree_sum(vectors: DataFrame, dtype: str = "<i8") -> np.ndarray | None:
    """The sum of ``vectors`` (``part long, vector binary``, parts dense from 0); None if there are none."""

    def add(group: pa.Table) -> pa.Table:
        rows = group.column("vector")
        total = np.frombuffer(rows[0].as_py(), dtype=dtype).copy()
        for row in rows[1:]:
            total += np.frombuffer(row.as_py(), dtype=dtype)
        return pa.table({"part": pa.array([group.column("part")[0].as_py() // FAN_IN], pa.int64()), "vector": pa.array([total.tobytes()], pa.binary())})

    parts = (vectors.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:  # down to one vector, so that the driver holds no more than that
        grouped = vectors.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(add, "part long, vector binary")
        vectors = materialize(grouped, "sums")
        parts = -(-parts // FAN_IN)
    row = vectors.select("vector").first()
    return None if row is None else np.frombuffer(row[0], dtype=dtype)


def task_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


Batches = Iterator[pa.RecordBatch]
