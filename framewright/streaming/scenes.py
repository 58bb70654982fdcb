"""Scenes as streams: state by scene, bounded history, one result for batch and stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def scene_history(frames: DataFrame, scene: str, index: str, value: str, window: int, time: str, idle: str = "1 hour", seen: str | None = None) -> DataFrame:
    """Each frame with how many values its scene's history holds, their sum and the last of them.

    With ``seen``, what the vehicle received where that differs from ``value``, the same of that history too
    (``seen_sum, seen_previous``): both histories are one state and go together.  A scene's state is its last
    ``window - 1`` values and the time of the last.  A gap of more than ``idle`` between its frames, by the
    column ``time``, begins a new history; a state that event time has left that far behind goes.  Rows later than the
    watermark are dropped.  Event time only moves with input, so a trigger over available input ends.
    Frames of a scene must arrive in order over batches; within one they are sorted.
    """
    other = seen or value
    out = f"{scene} string, {index} int, {value} double, history_size int, history_sum double, previous double" + (", seen_sum double, seen_previous double" if seen else "")
    names = [scene, index, value, "history_size", "history_sum", "previous", "seen_sum", "seen_previous"][: 8 if seen else 6]
    kept, idle_ms = window - 1, int(pd.Timedelta(idle).total_seconds() * 1000)

    def windowed(past: np.ndarray, now: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
        """Size, sum and last of the values before each of ``now``, and what is left for the next batch."""
        values = np.concatenate([past, now])
        upto = np.concatenate([[0.0], np.cumsum(values)])
        at = len(past) + np.arange(len(now))
        begin = np.maximum.accumulate(np.where(fresh, at, 0))
        size = np.minimum(at - begin, kept)
        last = np.where(size > 0, values[np.maximum(at - 1, 0)], np.nan)
        return size.astype("int32"), upto[at] - upto[at - size], last, values[max(begin[-1], len(values) - kept) :].tolist()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past, past_seen, last_ms = state.get if state.exists else ([], [], None)
        rows = pd.concat(list(batches)).sort_values("_index", kind="stable")
        ms = rows["_time"].to_numpy("datetime64[ms]").astype("int64")
        fresh = np.diff(ms, prepend=ms[0] if last_ms is None else last_ms) > idle_ms
        now = rows["_value"].to_numpy(dtype=float)
        size, total, last, left = windowed(np.array(past, dtype=float), now, fresh)
        got = {scene: key[0], index: rows["_index"].to_numpy(), value: now, "history_size": size, "history_sum": total, "previous": last}
        _, got["seen_sum"], got["seen_previous"], left_seen = windowed(np.array(past_seen, dtype=float), rows["_seen"].to_numpy(dtype=float), fresh)
        state.update((left, left_seen, int(ms[-1])))
        state.setTimeoutTimestamp(int(ms.max()) + idle_ms)
        yield pd.DataFrame(got)[names]

    keyed = frames.select(F.col(scene).cast("string").alias(scene), F.col(index).cast("int").alias("_index"), F.col(value).cast("double").alias("_value"), F.col(other).cast("double").alias("_seen"), F.col(time).cast("timestamp").alias("_time"))
    return keyed.withWatermark("_time", idle).groupBy(scene).applyInPandasWithState(step, out, "past array<double>, seen array<double>, last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def scene_history_batch(frames: DataFrame, scene: str, index: str, value: str, window: int, time: str | None = None, idle: str = "1 hour") -> DataFrame:
    """The same from a table, by window functions; with ``time`` long gaps part histories here too."""
    from pyspark.sql import Window as W

    by_index = W.partitionBy(scene).orderBy(index)
    keyed = frames.select(F.col(scene).cast("string").alias(scene), F.col(index).cast("int").alias(index), F.col(value).cast("double").alias(value), *([F.col(time).cast("timestamp").alias("_time")] if time else []))
    gap = F.unix_millis("_time") - F.lag(F.unix_millis("_time")).over(by_index) > int(pd.Timedelta(idle).total_seconds() * 1000) if time else F.lit(False)
    parted = keyed.withColumn("_gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("_run", F.sum("_gap").over(by_index.rowsBetween(W.unboundedPreceding, 0)))
    w = W.partitionBy(scene, "_run").orderBy(index)
    past = w.rowsBetween(-(window - 1), -1)
    return parted.withColumns({"history_size": F.count("*").over(past).cast("int"), "history_sum": F.coalesce(F.sum(value).over(past), F.lit(0.0)), "previous": F.lag(value).over(w)}).drop("_gap", "_run", "_time")


def windowed_counts(events: DataFrame, time: str, by: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window with a watermark.  Spark's own; the surveyed pipeline has no counterpart."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide) if slide else F.window(time, width), by).agg(F.count("*").alias("n"))
