"""Classification metrics of detectors: pure aggregations, one pass and one small shuffle each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.numeric import ratio, ratio_or_nan

RATES = ("tpr", "fpr", "accuracy", "precision", "recall", "f1")


def counts(actual: Column, predicted: Column) -> list[Column]:
    """tp, fp, tn, fn; a null actual counts as negative."""
    a = F.coalesce(actual, F.lit(False))
    return [
        F.count_if(a & predicted).alias("tp"),
        F.count_if(~a & predicted).alias("fp"),
        F.count_if(~a & ~predicted).alias("tn"),
        F.count_if(a & ~predicted).alias("fn"),
    ]


def with_rates(df: DataFrame) -> DataFrame:
    """Adds the rates to tp, fp, tn, fn; every zero denominator gives 0."""
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return df.withColumns({"tpr": recall, "fpr": ratio(fp, fp + tn), "accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)})


def binary_metrics(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and rates, over all rows or by group; rows without a verdict are left out."""
    judged = df.filter(F.col(predicted).isNotNull())
    return with_rates(judged.groupBy(*(by or [])).agg(*counts(F.col(actual), F.col(predicted))))


def filtered_metrics(df: DataFrame, attacked: str, successful: str, detected: str) -> DataFrame:
    """Only successful attacks are positives.  Failed ones are left out and counted apart; an unknown
    outcome counts as negative."""
    judged = df.filter(F.col(detected).isNotNull())
    failed = F.col(attacked) & F.col(successful).eqNullSafe(False)
    positive = F.col(attacked) & F.col(successful).eqNullSafe(True)
    hit = F.col(detected)
    agg = judged.agg(
        F.count_if(~failed & positive & hit).alias("tp"),
        F.count_if(~failed & ~positive & hit).alias("fp"),
        F.count_if(~failed & ~positive & ~hit).alias("tn"),
        F.count_if(~failed & positive & ~hit).alias("fn"),
        F.count_if(failed).alias("n_failed_attacks"),
        F.count_if(failed & hit).alias("n_failed_attacks_detected"),
    )
    return with_rates(agg).withColumn("failed_attack_detection_rate", ratio(F.col("n_failed_attacks_detected"), F.col("n_failed_attacks")))


def success_rate(df: DataFrame, successful: str) -> DataFrame:
    """Over frames with a known outcome; no row if there are none."""
    agg = df.filter(F.col(successful).isNotNull()).agg(F.count_if(successful).alias("n_successful"), F.count("*").alias("n_attacked_frames"))
    return agg.filter("n_attacked_frames > 0").withColumn("attack_success_rate", ratio(F.col("n_successful"), F.col("n_attacked_frames")))


def stratified_error_rates(df: DataFrame, stratum: str, actual: str, predicted: str, total: str = "all") -> DataFrame:
    """FPR and FNR by stratum and, from the same counts, over all; NaN without cases."""
    judged = df.filter(F.col(predicted).isNotNull()).withColumn(stratum, F.coalesce(stratum, F.lit("unknown")))
    rows = judged.rollup(stratum).agg(*counts(F.col(actual), F.col(predicted)))
    named = rows.withColumn(stratum, F.coalesce(stratum, F.lit(total)))
    return named.withColumns({"fpr": ratio_or_nan(F.col("fp"), F.col("fp") + F.col("tn")), "fnr": ratio_or_nan(F.col("fn"), F.col("fn") + F.col("tp"))})


def outcome(actual: Column, predicted: Column) -> Column:
    """tp, tn, fp or fn of one frame; a missing verdict counts as none detected."""
    p = F.coalesce(predicted, F.lit(False))
    return F.when(actual & p, "tp").when(actual, "fn").when(p, "fp").otherwise("tn")


def keyword_stratum(text: Column, keywords: dict[str, list[str]], default: str = "other") -> Column:
    """The first stratum that has a keyword in the text."""
    lower, out = F.lower(text), F.lit(default)
    for name, words in reversed(list(keywords.items())):
        out = F.when(F.coalesce(lower.rlike("|".join(words)), F.lit(False)), name).otherwise(out)
    return out


def timing_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, median, population deviation and count by key."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def map_timing_stats(df: DataFrame, timings: str) -> DataFrame:
    """The same over a map column of stage to seconds."""
    return timing_stats(df.select(F.explode(timings).alias("stage", "seconds")), "stage", "seconds")


def cost_stats(df: DataFrame, tokens: list[str], query_s: str) -> DataFrame:
    """Token totals and means; a query time above 0 means that the judge was called."""
    called = F.col(query_s) > 0
    sums = [x for t in tokens for x in (F.sum(t).alias(f"{t}_total"), F.avg(F.when(called, F.col(t))).alias(f"{t}_mean"))]
    return df.agg(F.count("*").alias("n_frames"), F.count_if(called).alias("n_api_calls"), *sums)


def type_accuracy(df: DataFrame, attacked: str, detected: str, suspected: str, true_types: str) -> DataFrame:
    """Of attacked frames that were detected with suspicions: how often one names a true type."""
    judged = df.filter(F.col(attacked) & F.col(detected) & (F.size(suspected) > 0))
    return judged.agg(F.count("*").alias("n"), F.count_if(F.arrays_overlap(suspected, true_types)).alias("correct")).withColumn("accuracy", ratio(F.col("correct"), F.col("n")))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, mean, sample deviation and range of each column, in one pass."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.column", "x.v")
    return long.groupBy("column").agg(F.count("v").alias("rows"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def histogram(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Equal bins over the observed range; the greatest value is in the last one."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.floor((F.col(value) - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0)))
    bin_no = F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).groupBy(bin_no.alias("bin")).agg(F.count("*").alias("n"))


def value_frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Cumulative share at each distinct value.  Counts come first, so the ordered running sum is over
    distinct values; ranges of values are summed before they are chained, not in one task."""
    per_value = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return running_share(per_value, value, "n")


def running_share(df: DataFrame, order: str, weight: str, cells: int = 256) -> DataFrame:
    """Running sum of ``weight`` over ``order`` as a share of the total: cells of the value range are
    summed first, so each task orders only its own cells' rows."""
    from pyspark.sql import Window as W

    span = df.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    cell = F.least(F.floor((F.col(order) - F.col("_lo")) / F.nullif((F.col("_hi") - F.col("_lo")) / cells, F.lit(0.0))), F.lit(cells - 1))
    placed = df.crossJoin(F.broadcast(span)).withColumn("_cell", F.coalesce(cell, F.lit(0)).cast("int")).drop("_lo", "_hi")
    per_cell = placed.groupBy("_cell").agg(F.sum(weight).alias("_w"))
    before = per_cell.select("_cell", (F.sum("_w").over(W.orderBy("_cell")) - F.col("_w")).alias("_before"), F.sum("_w").over(W.partitionBy()).alias("_total"))
    inside = F.sum(weight).over(W.partitionBy("_cell").orderBy(order))
    return placed.join(F.broadcast(before), "_cell").select(order, F.col(weight), ((F.col("_before") + inside) / F.col("_total")).alias("share"))


def equal_as_text(df: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows whose columns, as text, are among the wanted values; a column without any is not tested."""
    for column, values in wanted.items():
        if values:
            df = df.filter(F.col(column).cast("string").isin([str(v) for v in values]))
    return df


def by_token_prefix(df: DataFrame, tokens: DataFrame, frame: str, token: str, length: int = 16) -> DataFrame:
    """Rows whose frame begins with the first ``length`` characters of a token."""
    heads = tokens.select(F.substring(token, 1, length).alias("_head")).distinct()
    return df.withColumn("_head", F.substring(frame, 1, length)).join(heads, "_head", "left_semi").drop("_head")


def occlusion_histogram(labels: DataFrame, classes: list[str] = ("Car", "Pedestrian", "Cyclist"), levels: int = 4) -> DataFrame:
    """``type`` and how many labels of it have each occlusion; classes without labels have zeros."""
    counts = [F.count_if(F.col("occluded") == k).alias(f"occluded_{k}") for k in range(levels)]
    found = labels.filter(F.col("type").isin(list(classes))).groupBy("type").agg(*counts)
    every = labels.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, classes))).alias("type"))
    return every.join(found, "type", "left").na.fill(0)


# The least speed of each level, in metres a second.
SPEED_LEVELS = (0.0, 5.0, 20.0)


def class_weights(df: DataFrame, column: str) -> DataFrame:
    """``value, n, ratio, weight``: the share of every value, and a weight that falls with it."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("_total"))
    ratio_of = F.col("n") / F.col("_total")
    return counted.join(F.broadcast(total)).select("value", "n", ratio_of.alias("ratio"), F.exp(-ratio_of).alias("weight"))


def speed_level(speed: Column) -> Column:
    """0, 1 or 2: still and slow, moderate, fast."""
    out = F.lit(0)
    for level, least in enumerate(SPEED_LEVELS):
        out = F.when(speed >= least, F.lit(level)).otherwise(out)
    return out


def cell_motion(points: DataFrame, frame: str, size: float, seconds: float) -> DataFrame:
    """``frame, ix, iy, type, dx, dy, level`` of every occupied cell: the class of most of its points (the least
    name among equals), the mean displacement of that class's points, and the speed level of it."""
    keyed = points.withColumns({"ix": F.floor(F.col("x") / size).cast("int"), "iy": F.floor(F.col("y") / size).cast("int")})
    kinds = keyed.groupBy(frame, "ix", "iy", "type").agg(F.count("*").alias("n"), F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))
    first = kinds.groupBy(frame, "ix", "iy").agg(F.min(F.struct((-F.col("n")).alias("n"), "type", "dx", "dy")).alias("k"))
    return first.select(frame, "ix", "iy", "k.type", "k.dx", "k.dy", speed_level(F.hypot("k.dx", "k.dy") / seconds).alias("level"))
