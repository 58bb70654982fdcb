"""Operating points over grids of thresholds, their envelope, and Pareto fronts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions.numeric import ratio


#: Cells that values are counted in before any are sorted.
CELLS = 4096


def _celled(df: DataFrame, value: str) -> DataFrame:
    """``df`` with the cell of ``value`` between its least and greatest, and the number of rows."""
    span = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    cell = F.floor(F.try_divide(F.col(value) - F.col("_lo"), F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))) * CELLS)
    return df.crossJoin(F.broadcast(span)).withColumn("_cell", F.coalesce(cell, F.lit(0)).cast("int")).drop("_lo", "_hi")


def exact_quantiles(df: DataFrame, values: dict[str, str], shares: list[float]) -> DataFrame:
    """``name, place, quantile`` of several columns at once: exact, between neighbours in proportion; no rows
    without values.

    Values are counted by cell; only cells that hold a wanted rank are sorted, each by itself.
    """
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("v")) for n, c in values.items()))).alias("x")
    v = df.select(each).select("x.*").filter("v is not null")
    span = F.broadcast(v.groupBy("name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")))  # a row per column
    cell = F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))) * CELLS), F.lit(0)).cast("int")
    v = v.join(span, "name").select("name", "v", "n", cell.alias("cell"))
    counted = v.groupBy("name", "n", "cell").agg(F.count("*").alias("k"))  # at most CELLS + 1 rows a column
    before = F.sum("k").over(W.partitionBy("name").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("k")
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(s).alias("share")) for i, s in enumerate(shares)))).alias("q")
    at = (F.col("n") - 1) * F.col("q.share")
    ranks = counted.withColumn("before", before).select("name", "cell", "before", "k", "n", asked)
    ranks = ranks.select("name", "cell", "before", "k", F.col("q.place").alias("place"), (at - F.floor(at)).alias("part"), F.explode(F.array(F.floor(at), F.ceil(at))).alias("rank"))
    wanted = ranks.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("k"))).select("name", "cell", (F.col("rank") - F.col("before") + 1).alias("nth"), "place", "part")
    local = v.sparkSession.createDataFrame(wanted.toArrow())  # two rows for each share of each column
    places = local.select("name", "cell").distinct()
    placed = v.join(F.broadcast(places), ["name", "cell"]).withColumn("nth", F.row_number().over(W.partitionBy("name", "cell").orderBy("v")).cast("long"))
    found = placed.join(F.broadcast(local), ["name", "cell", "nth"]).groupBy("name", "place", "part").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return found.select("name", "place", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile"))


def quantile_axes(df: DataFrame, n: int, axes: dict[str, tuple[str, float, float]]) -> list[DataFrame]:
    """For each axis (a name, with its column and range) ``n`` thresholds at evenly spaced exact quantiles of the
    observed values, or evenly over the range if there are none; small local tables."""
    found = exact_quantiles(df, {name: column for name, (column, _, _) in axes.items()}, [k / (n - 1) for k in range(n)])
    known = {(r["name"], r["place"]): r["quantile"] for r in found.toArrow().to_pylist()}  # n rows for each axis
    out = []
    for name, (_, low, high) in axes.items():
        rows = [(k, float(known.get((name, k), low + (high - low) * k / (n - 1)))) for k in range(n)]
        out.append(df.sparkSession.createDataFrame(pa.table({f"{name}_idx": pa.array([k for k, _ in rows], pa.int32()), f"{name}_threshold": [t for _, t in rows]})))
    return out


def roc_grid(clusters: DataFrame, frame: str, attacked: str, point: str, centroid: str, n: int = 50, condition: str = "or", frames: DataFrame | None = None) -> DataFrame:
    """True and false positive counts of every pair of thresholds.

    For "or" only each frame's greatest sigmas matter.  For "and" only its clusters that no other
    dominates in both do, but all are kept, as the condition is on one cluster.  Frames are grouped into
    threshold cells before they meet the grid, so the product is of at most n*n cells with n*n points,
    whatever the number of frames.  ``frames`` adds frames without clusters (``frame``, ``attacked``).
    """
    p_axis, c_axis = map(F.broadcast, quantile_axes(clusters, n, {"point": (point, 0.0, 0.15), "centroid": (centroid, 0.0, 1.0)}))
    p_list = p_axis.agg(F.sort_array(F.collect_list("point_threshold")).alias("_p"))
    c_list = c_axis.agg(F.sort_array(F.collect_list("centroid_threshold")).alias("_c"))
    above = lambda axis, value: F.size(F.filter(F.col(axis), lambda t: F.coalesce(F.col(value) > t, F.lit(False))))
    rows = clusters.crossJoin(F.broadcast(p_list)).crossJoin(F.broadcast(c_list)).select(frame, attacked, above("_p", point).alias("p"), above("_c", centroid).alias("c"))
    if frames is not None:
        rows = rows.unionByName(frames.select(frame, attacked, F.lit(0).alias("p"), F.lit(0).alias("c")))
    grid = p_axis.crossJoin(c_axis)
    if condition == "or":
        cells = rows.groupBy(frame, attacked).agg(F.max("p").alias("p"), F.max("c").alias("c")).groupBy(attacked, "p", "c").agg(F.count("*").alias("k"))
        hit = (F.col("p") > F.col("point_idx")) | (F.col("c") > F.col("centroid_idx"))
        totals = cells.groupBy().agg(F.sum(F.when(F.col(attacked), F.col("k")).otherwise(0)).alias("n_attacked"), F.sum(F.when(F.col(attacked), 0).otherwise(F.col("k"))).alias("n_clean"))
    elif condition == "and":
        # a frame's staircase as disjoint cells: for each number of point thresholds passed, the most
        # centroid thresholds that a cluster with at least that many passes
        best = rows.groupBy(frame, attacked, "p").agg(F.max("c").alias("c"))
        steps = best.withColumn("c", F.max("c").over(W.partitionBy(frame).orderBy(F.desc("p"))))
        steps = steps.withColumn("from_p", F.coalesce(F.lag("p").over(W.partitionBy(frame).orderBy("p")), F.lit(0)))
        cells = steps.groupBy(attacked, "from_p", "p", "c").agg(F.count("*").alias("k"))
        hit = (F.col("p") > F.col("point_idx")) & (F.col("from_p") <= F.col("point_idx")) & (F.col("c") > F.col("centroid_idx"))
        totals = rows.groupBy(frame, attacked).agg(F.lit(1).alias("one")).groupBy().agg(F.count_if(attacked).alias("n_attacked"), F.count_if(~F.col(attacked)).alias("n_clean"))
    else:
        raise ValueError(f"condition must be 'or' or 'and', not {condition!r}")
    counted = grid.join(cells, hit, "left").groupBy("point_idx", "centroid_idx", "point_threshold", "centroid_threshold").agg(
        F.coalesce(F.sum(F.when(F.col(attacked), F.col("k"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(~F.col(attacked), F.col("k"))), F.lit(0)).alias("fp")
    )
    out = counted.crossJoin(F.broadcast(totals)).withColumns({"fn": F.col("n_attacked") - F.col("tp"), "tn": F.col("n_clean") - F.col("fp")})
    return out.withColumns({"tpr": ratio(F.col("tp"), F.col("n_attacked")), "fpr": ratio(F.col("fp"), F.col("n_clean"))}).drop("n_attacked", "n_clean")


def roc_envelope(points: DataFrame) -> DataFrame:
    """The points where the best tpr so far rises, with (0, 0) and (1, 1).  The input is one row per
    grid point, so a single ordered pass over it is bounded by the grid."""
    spark = points.sparkSession
    best = points.groupBy("fpr").agg(F.max("tpr").alias("tpr"))
    running = best.withColumn("top", F.max("tpr").over(W.orderBy("fpr")))
    earlier = F.lag("top").over(W.orderBy("fpr"))
    kept = running.withColumn("earlier", earlier).filter(F.col("earlier").isNull() | (F.col("top") > F.col("earlier"))).select("fpr", F.col("top").alias("tpr"))
    ends = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "fpr double, tpr double")
    return kept.unionByName(ends).distinct()


def envelope_auc(envelope: DataFrame) -> DataFrame:
    """Trapezoids under the envelope."""
    order = W.orderBy("fpr", "tpr")
    parts = envelope.select("fpr", "tpr", F.lag("fpr").over(order).alias("f0"), F.lag("tpr").over(order).alias("t0"))
    return parts.agg(F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) / 2).alias("auc"))


def pareto_front(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows that no other row beats in one objective and equals or beats in the other.

    Only the best ``second`` for each ``first`` can be on it, and of those the ones above every row with a
    greater ``first``: above all greater cells of ``first`` and above the greater values in its own cell.
    """
    best = _celled(df.groupBy(first).agg(F.max(second).alias(second)), first)
    cells = best.groupBy("_cell").agg(F.max(second).alias("_most"))  # at most CELLS + 1 rows
    beyond = cells.select("_cell", F.max("_most").over(W.orderBy(F.desc("_cell")).rowsBetween(W.unboundedPreceding, -1)).alias("_beyond"))
    inside = F.max(second).over(W.partitionBy("_cell").orderBy(F.desc(first)).rowsBetween(W.unboundedPreceding, -1))
    ahead = F.greatest("_beyond", "_inside")
    front = best.join(F.broadcast(beyond), "_cell").withColumn("_inside", inside).filter(ahead.isNull() | (F.col(second) > ahead)).select(first, second)
    return df.join(front, [first, second], "left_semi")


def best_trial(df: DataFrame, objective: str) -> DataFrame:
    """The row with the greatest objective; all columns in order decide ties."""
    return df.orderBy(F.desc(objective), *df.columns).limit(1)
