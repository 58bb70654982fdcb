"""Rows in groups: Arrow functions over whole small groups, and running sums over large ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of every group of a table that is sorted by ``keys``; null keys are equal."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for key in keys:
        column = table.column(key)
        a, b = column.slice(1), column.slice(0, max(0, table.num_rows - 1))
        same = pc.fill_null(pc.equal(a, b), False)
        same = pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.combine_chunks().to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def map_groups(df: DataFrame, keys: list[str], order: list[str | Column], run: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``run`` over batches of whole groups, with the first row of each; groups are small, one frame's boxes.

    A call handles as many groups as an Arrow batch holds, so that small groups don't pay for a call each.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            last = int(group_starts(table, keys)[-1])
            held = table.slice(last)
            if last:
                whole = table.slice(0, last)
                yield run(whole, group_starts(whole, keys))
        if held is not None:
            yield run(held, group_starts(held, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(step, schema)


def running_sums(df: DataFrame, by: str, value: str, sums: dict[str, str], width: float) -> DataFrame:
    """``df`` with the sums of columns over the rows of the same ``by`` and at least the same ``value``.

    One row per value is given.  Values are first summed in cells of ``width``, so that no task sorts more
    than one cell's values and one row per cell.
    """
    cell = F.floor(F.col(value) / width)
    cells = df.groupBy(by, cell.alias("_cell")).agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    above = W.partitionBy(by).orderBy(F.desc("_cell")).rowsBetween(W.unboundedPreceding, -1)
    before = cells.select(by, "_cell", *(F.coalesce(F.sum(f"_{n}").over(above), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = W.partitionBy(by, "_cell").orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, 0)
    joined = df.withColumn("_cell", cell).join(before, [by, "_cell"])
    return joined.withColumns({n: F.col(f"_{n}") + F.sum(c).over(inside) for n, c in sums.items()}).drop("_cell", *(f"_{n}" for n in sums))
