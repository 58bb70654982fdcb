"""The registered queries of the engine's operators over the fixture views, each with its SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions import geometry as g
from framewright.functions.numeric import clip, digitize, parse_literal, ratio, wrap_angle
from framewright.operators import clusters, defenses, matching, metrics, orientation, perturb, roc, spatial, temporal
from framewright.plans import sweeps
from framewright.plans.views import Views, oracle
from framewright.sources import reports, results

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, shared: bool = True):
    """Register a function of the views, with the body of its SQL."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql) if shared else sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


RATES_SQL = """round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS tpr, round(coalesce(fp / nullif(fp + tn, 0), 0.0), 6) AS fpr,
  round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0.0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1"""
COUNTS_SQL = """count(*) FILTER ({a} AND {p}) AS tp, count(*) FILTER (NOT {a} AND {p}) AS fp, count(*) FILTER (NOT {a} AND NOT {p}) AS tn, count(*) FILTER ({a} AND NOT {p}) AS fn"""
VERDICT_COUNTS = COUNTS_SQL.format(a="is_attacked", p="detected")
RATES = metrics.RATES


# classification


@query(f"SELECT *, {RATES_SQL} FROM (SELECT {VERDICT_COUNTS} FROM v_verdict)")
def defense_metrics(v: Views) -> DataFrame:
    return rounded(metrics.binary_metrics(v.verdicts(), "is_attacked", "detected"), *RATES)


@query(f"""SELECT *, {RATES_SQL}, round(coalesce(n_failed_attacks_detected / nullif(n_failed_attacks, 0), 0.0), 6) AS failed_attack_detection_rate FROM (
  SELECT count(*) FILTER (attack_successful IS TRUE AND detected) AS tp, count(*) FILTER (NOT is_attacked AND detected) AS fp, count(*) FILTER (NOT is_attacked AND NOT detected) AS tn,
    count(*) FILTER (attack_successful IS TRUE AND NOT detected) AS fn, count(*) FILTER (attack_successful IS FALSE) AS n_failed_attacks, count(*) FILTER (attack_successful IS FALSE AND detected) AS n_failed_attacks_detected FROM v_success)""")
def defense_metrics_filtered(v: Views) -> DataFrame:
    return rounded(metrics.filtered_metrics(v.outcomes(), "is_attacked", "attack_successful", "detected"), *RATES, "failed_attack_detection_rate")


@query(f"SELECT *, {RATES_SQL} FROM (SELECT {COUNTS_SQL.format(a='actual', p='predicted')} FROM v_binary)")
def binary_metrics(v: Views) -> DataFrame:
    return rounded(metrics.binary_metrics(v.labelled(), "actual", "predicted"), *RATES)


@query("SELECT count(*) FILTER (attack_successful) AS n_successful, count(attack_successful) AS n_attacked_frames, round(count(*) FILTER (attack_successful) / count(attack_successful), 6) AS attack_success_rate FROM v_success")
def attack_success_rate(v: Views) -> DataFrame:
    return rounded(metrics.success_rate(v.outcomes(), "attack_successful"), "attack_success_rate")


@query(f"""SELECT stratum, tp, fp, tn, fn, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(fn / nullif(fn + tp, 0), 6) AS fnr FROM (
  SELECT coalesce(stratum, 'all') AS stratum, {COUNTS_SQL.format(a='actual', p='predicted')} FROM v_binary JOIN v_strata USING (doc_id) GROUP BY ROLLUP(stratum))""")
def stratified_error_rates(v: Views) -> DataFrame:
    df = v.labelled().join(v.strata(), "doc_id")
    out = metrics.stratified_error_rates(df, "stratum", "actual", "predicted")
    return out.withColumns({c: F.round(F.nanvl(c, F.lit(None).cast("double")), 6) for c in ("fpr", "fnr")})


@query(f"SELECT sequence_id, tp, fp, tn, fn, {RATES_SQL} FROM (SELECT sequence_id, {VERDICT_COUNTS} FROM v_verdict GROUP BY sequence_id)")
def per_scene_metrics(v: Views) -> DataFrame:
    return rounded(metrics.binary_metrics(v.verdicts(), "is_attacked", "detected", ["sequence_id"]), *RATES)


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN is_attacked AND detected THEN 'tp' WHEN is_attacked THEN 'fn' WHEN detected THEN 'fp' ELSE 'tn' END AS outcome FROM v_verdict) GROUP BY 1")
def outcome_class(v: Views) -> DataFrame:
    return v.verdicts().groupBy(metrics.outcome(F.col("is_attacked"), F.col("detected")).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (frame_id % 5 < 3) AS correct, round(count(*) FILTER (frame_id % 5 < 3) / count(*), 6) AS accuracy FROM v_verdict WHERE is_attacked AND detected")
def type_accuracy(v: Views) -> DataFrame:
    df = v.verdicts().withColumns({"suspected": F.when(F.col("frame_id") % 5 < 3, F.array(F.lit("ORA"), F.lit("ghost"))).otherwise(F.array(F.lit("ghost"))), "truth": F.array(F.lit("ORA"))})
    return rounded(metrics.type_accuracy(df, "is_attacked", "detected", "suspected", "truth"), "accuracy")


# scenes and windows


@query("SELECT sequence_id, count(*) AS scene_length FROM v_frames GROUP BY 1")
def scene_lengths(v: Views) -> DataFrame:
    return temporal.scene_lengths(v.frames(), "sequence_id")


@query("SELECT sequence_id, frame_id, idx FROM v_frames")
def frame_index(v: Views) -> DataFrame:
    df = v.table("events").select(F.col("user_id").alias("sequence_id"), F.col("event_id").alias("frame_id"), "ts")
    return temporal.frame_index(df, "sequence_id", ["ts", "frame_id"], "idx").select("sequence_id", "frame_id", F.col("idx").cast("long").alias("idx"))


@query("SELECT sequence_id, scene_length, attack, CAST(coalesce(attack_start_index, -1) AS BIGINT) AS attack_start_index FROM v_plan")
def scene_plan(v: Views) -> DataFrame:
    return v.plan().withColumn("attack_start_index", F.coalesce("attack_start_index", F.lit(-1)).cast("long"))


@query("SELECT sequence_id, frame_id AS attack_start_frame_id, CAST(attack_start_index AS BIGINT) AS attack_start_index FROM v_verdict WHERE idx = attack_start_index")
def attack_onset(v: Views) -> DataFrame:
    return temporal.attack_onset(v.verdicts(), "sequence_id", "frame_id", "idx", "attack_start_index").withColumn("attack_start_index", F.col("attack_start_index").cast("long"))


@query("SELECT sequence_id, frame_id, is_attacked FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id, is_attacked ORDER BY idx) AS r FROM v_verdict) WHERE r > 2 AND r <= 7")
def scene_skip_max(v: Views) -> DataFrame:
    return temporal.phase_limits(v.verdicts(), "sequence_id", "is_attacked", ["idx"], 2, 5).select("sequence_id", "frame_id", "is_attacked")


@query("""SELECT frame_id, count(*) OVER w AS n, round(coalesce(sum(x) OVER w, 0), 6) AS total, first_value(x) OVER w AS oldest FROM v_frames WINDOW w AS (PARTITION BY sequence_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def history_window(v: Views) -> DataFrame:
    df = temporal.history(v.frames(), "sequence_id", ["idx"], "x", 6)
    return df.select("frame_id", F.size("history").cast("long").alias("n"), F.round(F.aggregate("history", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.get("history", F.lit(0)).alias("oldest"))


@query("SELECT frame_id, idx >= 5 AS warm FROM v_frames")
def cold_start_gate(v: Views) -> DataFrame:
    return temporal.cold_start(v.frames(), "sequence_id", ["idx"], 12, 5).select("frame_id", "warm")


@query("SELECT frame_id, lag(x, 4) OVER w AS x_back_4, lag(x, 8) OVER w AS x_back_8, lag(x, 12) OVER w AS x_back_12 FROM v_frames WINDOW w AS (PARTITION BY sequence_id ORDER BY idx)")
def stride_history(v: Views) -> DataFrame:
    return temporal.strides(v.frames(), "sequence_id", ["idx"], "x", [4, 8, 12]).select("frame_id", "x_back_4", "x_back_8", "x_back_12")


@query("""SELECT a.frame_id, count(b.frame_id) AS n, round(coalesce(sum(b.x), 0), 6) AS total FROM v_frames a LEFT JOIN (SELECT f.frame_id AS into_id, p.frame_id, p.x FROM v_frames f JOIN v_frames p
  ON f.sequence_id = p.sequence_id AND p.secs < f.secs AND p.secs >= f.secs - 86400 AND p.idx >= f.idx - 9) b ON a.frame_id = b.into_id GROUP BY 1""")
def band_history(v: Views) -> DataFrame:
    df = temporal.recent(v.frames(), "sequence_id", "secs", "x", 86400.0, 9)
    return df.select("frame_id", F.size("recent").cast("long").alias("n"), F.round(F.aggregate("recent", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""SELECT sequence_id, n, round(stddev_pop(x - slope * idx - icept), 5) AS sigma FROM v_frames JOIN (SELECT sequence_id, regr_slope(x, idx) AS slope, regr_intercept(x, idx) AS icept, count(*) AS n FROM v_frames GROUP BY 1) USING (sequence_id) GROUP BY 1, 2""")
def ols_detrend_sigma(v: Views) -> DataFrame:
    return rounded(temporal.detrended_std(v.frames(), "sequence_id", "idx", "x"), "sigma", places=5)


@query("SELECT sequence_id, round(stddev_pop(d), 6) AS sigma, count(d) AS n FROM (SELECT sequence_id, x - lag(x) OVER (PARTITION BY sequence_id ORDER BY idx) AS d FROM v_frames) GROUP BY 1")
def first_diff_sigma(v: Views) -> DataFrame:
    return rounded(temporal.difference_std(v.frames(), "sequence_id", ["idx"], "x"), "sigma")


@query("SELECT frame_id, round(sum(x) OVER (PARTITION BY sequence_id ORDER BY idx), 4) AS total FROM v_frames")
def cumulative_sum(v: Views) -> DataFrame:
    return rounded(temporal.running_sum(v.frames(), "sequence_id", ["idx"], "x"), "total", places=4).select("frame_id", "total")


@query("""SELECT sequence_id, round(avg(d), 4) AS mean_gap, round(median(d), 4) AS median_gap, round(min(d), 4) AS min_gap, round(max(d), 4) AS max_gap, count(d) AS n_gaps, round(median(d) * 9, 3) AS span
  FROM (SELECT sequence_id, secs - lag(secs) OVER (PARTITION BY sequence_id ORDER BY secs) AS d FROM v_frames) GROUP BY 1""")
def sweep_cadence(v: Views) -> DataFrame:
    out = temporal.cadence(v.frames(), "sequence_id", "secs", 10).drop("hz")
    return rounded(rounded(out, "mean_gap", "median_gap", "min_gap", "max_gap", places=4), "span", places=3)


@query("""SELECT class, day, round(sqrt(list_sum(list_transform(list_zip(q, lag(q) OVER (PARTITION BY class ORDER BY day)), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 64), 5) AS w2 FROM (
  SELECT class, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, quantile_cont(x, list_transform(range(64), i -> (i + 0.5) / 64)) AS q FROM v_frames GROUP BY 1, 2)""".replace("list_transform(range(64), i -> (i + 0.5) / 64)", "[" + ", ".join(str((k + 0.5) / 64) for k in range(64)) + "]"))
def wasserstein_lag(v: Views) -> DataFrame:
    df = v.frames().withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rounded(temporal.wasserstein_steps(df, "class", "day", "x"), "w2", places=5)


# reports


@query("SELECT class, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std, count(x) AS n FROM v_frames GROUP BY 1")
def timing_stats(v: Views) -> DataFrame:
    df = v.frames().select(F.create_map("class", "x").alias("elapsed_s"))
    return rounded(metrics.map_timing_stats(df, "elapsed_s").withColumnRenamed("stage", "class"), "mean", "median", "std")


@query("""SELECT count(*) AS n_frames, count(*) FILTER (frame_id % 4 > 0) AS n_api_calls, CAST(sum(frame_id % 100) AS BIGINT) AS tokens_total, round(avg(frame_id % 100) FILTER (frame_id % 4 > 0), 6) AS tokens_mean FROM v_frames""")
def cost_stats(v: Views) -> DataFrame:
    df = v.frames().select((F.col("frame_id") % 100).alias("tokens"), (F.col("frame_id") % 4).alias("query_s"))
    return rounded(metrics.cost_stats(df, ["tokens"], "query_s"), "tokens_mean")


@query("""SELECT 'x' AS "column", count(x) AS rows, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, max(x) AS max FROM v_frames
  UNION ALL SELECT 'idx', count(idx), round(avg(idx), 6), round(stddev_samp(idx), 6), min(idx)::DOUBLE, max(idx)::DOUBLE FROM v_frames""")
def column_profile(v: Views) -> DataFrame:
    return rounded(metrics.column_profile(v.frames(), ["x", "idx"]), "mean", "std")


@query("""SELECT CAST(least(floor((x - lo) / ((hi - lo) / 100)), 99) AS INTEGER) AS bin, count(*) AS n FROM v_frames, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1""")
def histogram_bins(v: Views) -> DataFrame:
    return metrics.histogram(v.frames(), "x", 100)


@query("SELECT x, n, round(sum(n) OVER (ORDER BY x) / sum(n) OVER (), 6) AS share FROM (SELECT x, count(*) AS n FROM v_frames GROUP BY 1)")
def ecdf(v: Views) -> DataFrame:
    return rounded(metrics.ecdf(v.frames(), "x"), "share")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def value_frequency(v: Views) -> DataFrame:
    return metrics.value_frequency(v.table("documents"), "source")


# operating points


def _axis(n: int) -> str:
    return "[" + ", ".join(repr(k / (n - 1)) for k in range(n)) + "]"


ROC_SQL = f"""
cl AS (SELECT sequence_id AS frame, attack, x AS sp, x * (1 + idx % 3) AS sc FROM v_verdict),
pa AS (SELECT unnest(range(12)) AS point_idx, unnest(quantile_cont(sp, {_axis(12)})) AS pt FROM cl),
ca AS (SELECT unnest(range(12)) AS centroid_idx, unnest(quantile_cont(sc, {_axis(12)})) AS ct FROM cl),
fr AS (SELECT frame, attack, max(sp) AS sp, max(sc) AS sc FROM cl GROUP BY 1, 2),
roc AS (SELECT point_idx, centroid_idx, count(*) FILTER (attack AND (sp > pt OR sc > ct)) AS tp, count(*) FILTER (NOT attack AND (sp > pt OR sc > ct)) AS fp,
  count(*) FILTER (attack AND NOT (sp > pt OR sc > ct)) AS fn, count(*) FILTER (NOT attack AND NOT (sp > pt OR sc > ct)) AS tn FROM fr, pa, ca GROUP BY 1, 2),
rates AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0.0) AS tpr, coalesce(fp / nullif(fp + tn, 0), 0.0) AS fpr FROM roc),
best AS (SELECT fpr, max(tpr) AS tpr FROM rates GROUP BY 1), run AS (SELECT fpr, max(tpr) OVER (ORDER BY fpr) AS tpr FROM best),
env AS (SELECT fpr, min(fpr) OVER (PARTITION BY tpr) AS first_fpr, tpr FROM run),
envelope AS (SELECT fpr, tpr FROM env WHERE fpr = first_fpr UNION SELECT 0.0, 0.0 UNION SELECT 1.0, 1.0)
"""


def _roc(v: Views, condition: str = "or") -> DataFrame:
    df = v.verdicts().select(F.col("sequence_id").alias("frame"), "attack", F.col("x").alias("sp"), (F.col("x") * (1 + F.col("idx") % 3)).alias("sc"))
    return roc.roc_grid(df, "frame", "attack", "sp", "sc", n=12, condition=condition)


@query(f", {ROC_SQL} SELECT CAST(point_idx AS INTEGER) AS point_idx, CAST(centroid_idx AS INTEGER) AS centroid_idx, tp, fp, tn, fn, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM rates")
def roc_grid(v: Views) -> DataFrame:
    return rounded(_roc(v), "tpr", "fpr").drop("point_threshold", "centroid_threshold")


@query(f""", {ROC_SQL} SELECT CAST(point_idx AS INTEGER) AS point_idx, CAST(centroid_idx AS INTEGER) AS centroid_idx, count(*) FILTER (attack AND hit) AS tp, count(*) FILTER (NOT attack AND hit) AS fp FROM (
  SELECT point_idx, centroid_idx, frame, attack, bool_or(sp > pt AND sc > ct) AS hit FROM cl, pa, ca GROUP BY ALL) GROUP BY 1, 2""")
def roc_grid_and(v: Views) -> DataFrame:
    return _roc(v, "and").select("point_idx", "centroid_idx", "tp", "fp")


@query(f", {ROC_SQL} SELECT round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM envelope")
def roc_envelope(v: Views) -> DataFrame:
    return rounded(roc.roc_envelope(_roc(v)), "fpr", "tpr")


@query(f", {ROC_SQL} SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc FROM (SELECT fpr, tpr, lag(fpr) OVER (ORDER BY fpr, tpr) AS f0, lag(tpr) OVER (ORDER BY fpr, tpr) AS t0 FROM envelope)")
def roc_auc(v: Views) -> DataFrame:
    return rounded(roc.envelope_auc(roc.roc_envelope(_roc(v))), "auc")


@query("""SELECT o_orderkey, o_totalprice, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_totalprice >= o.o_totalprice AND p.o_custkey >= o.o_custkey AND (p.o_totalprice > o.o_totalprice OR p.o_custkey > o.o_custkey))""")
def pareto_front(v: Views) -> DataFrame:
    return roc.pareto_front(v.table("orders").select("o_orderkey", "o_totalprice", "o_custkey"), "o_totalprice", "o_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def best_trial(v: Views) -> DataFrame:
    return roc.best_trial(v.table("orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


# files, JSON, caches


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_flatten(v: Views) -> DataFrame:
    return v.table("events").select("event_id", results.dot_path(F.col("props"), "k").cast("int").alias("k"))


@query("SELECT event_id, event_type FROM events")
def json_prune(v: Views) -> DataFrame:
    nested = v.table("events").select("event_id", F.struct("event_type", "value", F.struct("props").alias("deep")).alias("m"))
    pruned = results.prune(results.prune(nested, "m.deep"), "m.value")
    return pruned.select("event_id", *(F.col(p).alias(p.rsplit(".", 1)[-1]) for p in results.scalar_paths(pruned.schema) if p != "event_id"))


@query("SELECT event_id, k FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS k FROM events) ORDER BY k DESC NULLS LAST, event_id LIMIT 200")
def nulls_last_sort(v: Views) -> DataFrame:
    df = v.table("events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("k"))
    return results.sort_nulls_last(df, [("k", True), ("event_id", False)]).limit(200)


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS k FROM events ORDER BY k DESC NULLS LAST, event_id")
def nulls_last_sort_whole(v: Views) -> DataFrame:
    df = v.table("events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("k"))
    return results.sort_nulls_last(df, [("k", True), ("event_id", False)])


@query("""SELECT event_id, CASE WHEN t IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(t, '[0-9]+') THEN 'int' WHEN regexp_full_match(t, '[0-9]+\\.[0-9]*') THEN 'float' ELSE 'str' END AS kind,
  CASE WHEN regexp_full_match(t, '[0-9]+') THEN CAST(t AS BIGINT) ELSE -1 END AS i FROM (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN CAST(event_id AS VARCHAR) || '.5' ELSE event_type END AS t FROM events)""")
def typed_literal_parse(v: Views) -> DataFrame:
    k, text = F.col("event_id") % 4, F.col("event_id").cast("string")
    t = F.when(k == 0, "true").when(k == 1, text).when(k == 2, F.concat(text, F.lit(".5"))).otherwise(F.col("event_type"))
    return v.table("events").select("event_id", parse_literal(t).alias("p")).select("event_id", "p.kind", F.coalesce("p.i", F.lit(-1)).alias("i"))


@query("""SELECT user_id, 'car' AS class, level, round(ap, 6) AS ap FROM (SELECT user_id, avg(value) AS easy, min(value) AS moderate, max(value) AS hard FROM events GROUP BY 1) UNPIVOT (ap FOR level IN (easy, moderate, hard))""")
def unpivot_ap(v: Views) -> DataFrame:
    wide = v.table("events").groupBy("user_id").agg(F.avg("value").alias("car_ap_easy"), F.min("value").alias("car_ap_moderate"), F.max("value").alias("car_ap_hard"))
    return rounded(results.unpivot_ap(wide, ["user_id"]), "ap")


CACHE_SQL = "cached AS (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 45)"


def _cache(v: Views) -> tuple[DataFrame, DataFrame]:
    cache = v.table("lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return results.split_hits(v.table("orders").select("o_orderkey", "o_totalprice"), cache, ["o_orderkey"])


@query(f", {CACHE_SQL} SELECT o_orderkey, o_totalprice FROM orders JOIN cached USING (o_orderkey)")
def cache_hits(v: Views) -> DataFrame:
    return _cache(v)[0]


@query(f", {CACHE_SQL} SELECT o_orderkey, o_totalprice FROM orders ANTI JOIN cached USING (o_orderkey)")
def cache_misses(v: Views) -> DataFrame:
    return _cache(v)[1]


@query("SELECT o_orderkey, coalesce(q, o_totalprice) AS v FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS q FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON o_orderkey = l_orderkey")
def preds_fallback(v: Views) -> DataFrame:
    attacked = v.table("lineitem").filter("l_quantity > 45").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("q"))
    o = v.table("orders").select("o_orderkey", "o_totalprice")
    return o.join(attacked, o["o_orderkey"] == attacked["l_orderkey"], "left").select("o_orderkey", F.coalesce("q", "o_totalprice").alias("v"))


@query("SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS attacked, count(*) FILTER (o_totalprice > 1000) AS with_cloud, count(*) FILTER (o_custkey % 2 = 0) AS with_predictions FROM orders")
def cache_summary(v: Views) -> DataFrame:
    o = v.table("orders").select((F.col("o_orderstatus") == "F").alias("a"), F.when(F.col("o_totalprice") > 1000, 1).alias("c"), F.when(F.col("o_custkey") % 2 == 0, 1).alias("p"))
    return results.cache_summary(o, "a", "c", "p")


# geometry


@query("SELECT frame_id, point_idx FROM v_points WHERE NOT (y <= 2.0 AND y >= -2.0 AND abs(x) <= 1.4)")
def ego_box_filter(v: Views) -> DataFrame:
    return clusters.ego_filter(v.points(), 2.0, 2.0, 1.4).select("frame_id", "point_idx")


@query("SELECT frame_id, point_idx FROM v_points WHERE abs(z - 1.73) <= 0.2")
def ground_slice(v: Views) -> DataFrame:
    return v.points().filter(F.abs(F.col("z") - 1.73) <= 0.2).select("frame_id", "point_idx")


@query("""SELECT frame_id, point_idx FROM (SELECT *, 700 * x + 600 * z AS pu, 700 * y + 180 * z AS pv FROM v_points) WHERE z > 0 AND pu / z >= 0 AND pu / z < 1200 AND pv / z >= 0 AND pv / z < 360""")
def fov_filter(v: Views) -> DataFrame:
    p = F.array(*(F.lit(float(k)) for k in (700, 0, 600, 0, 0, 700, 180, 0, 0, 0, 1, 0)))
    pixel = g.project(p, F.col("x"), F.col("y"), F.col("z"))
    return v.points().withColumn("pixel", pixel).filter(g.in_view(F.col("pixel"), F.lit(1200), F.lit(360))).select("frame_id", "point_idx")


@query("""SELECT frame_id, point_idx, round(r, 6) AS r, round(acos(z / r), 6) AS theta, round(atan2(y, x), 6) AS phi FROM (SELECT *, sqrt(x*x + y*y + z*z) AS r FROM v_points) WHERE r > 0 AND acos(z / r) BETWEEN 1.0 AND 2.0 AND atan2(y, x) BETWEEN -0.5 AND 0.5""")
def spherical_roi(v: Views) -> DataFrame:
    s = v.points().withColumn("s", g.spherical(F.col("x"), F.col("y"), F.col("z"))).filter((F.col("s.r") > 0) & F.col("s.theta").between(1.0, 2.0) & F.col("s.phi").between(-0.5, 0.5))
    return rounded(s.select("frame_id", "point_idx", "s.*"), "r", "theta", "phi")


@query("""SELECT frame_id, point_idx FROM (SELECT *, atan2(y, x) - 3.0 AS d FROM v_points) WHERE abs((d + pi()) - 2 * pi() * floor((d + pi()) / (2 * pi())) - pi()) <= radians(10)""")
def azimuth_cone(v: Views) -> DataFrame:
    return v.points().filter(F.abs(wrap_angle(F.atan2("y", "x") - 3.0)) <= g.degrees(10)).select("frame_id", "point_idx")


@query("SELECT frame_id, point_idx, round(atan2(y, x), 6) AS az, round(atan2(z, sqrt(x*x + y*y)), 6) AS el, round(x / r, 6) AS ux, round(y / r, 6) AS uy FROM (SELECT *, sqrt(x*x + y*y + z*z) AS r FROM v_points)")
def beam_angles(v: Views) -> DataFrame:
    p = v.points().withColumns({"b": g.beam(F.col("x"), F.col("y"), F.col("z")), "u": g.unit_ray(F.col("x"), F.col("y"), F.col("z"))})
    return rounded(p.select("frame_id", "point_idx", "b.az", "b.el", F.col("u.x").alias("ux"), F.col("u.y").alias("uy")), "az", "el", "ux", "uy")


@query("""SELECT box_id, CAST(k AS INTEGER) AS k, round(x + CASE WHEN k IN (0, 1, 4, 5) THEN 1 ELSE -1 END * 2 * cos(label) - CASE WHEN k IN (0, 3, 4, 7) THEN 1 ELSE -1 END * sin(label), 6) AS cx, round(z + CASE WHEN k < 4 THEN -0.75 ELSE 0.75 END, 6) AS cz FROM v_boxes, range(8) t(k)""")
def box_corners(v: Views) -> DataFrame:
    c = g.corners_yaw(*(F.col(a) for a in ("x", "y", "z", "length", "width", "height")), F.col("label").cast("double"))
    return rounded(v.boxes().select("box_id", F.posexplode(c).alias("k", "c")).select("box_id", "k", F.col("c.x").alias("cx"), F.col("c.z").alias("cz")), "cx", "cz")


@query("SELECT frame_id, point_idx, CAST(len(list_filter([-10.0, -5.0, 0.0, 5.0, 10.0], lambda e: e <= x)) AS INTEGER) AS bin, round(greatest(-5.0, least(5.0, y)), 6) AS clipped FROM v_points")
def digitize_clip(v: Views) -> DataFrame:
    return v.points().select("frame_id", "point_idx", digitize(F.col("x"), [-10.0, -5.0, 0.0, 5.0, 10.0]).alias("bin"), F.round(clip(F.col("y"), -5.0, 5.0), 6).alias("clipped"))


def _frame_boxes(v: Views) -> DataFrame:
    """Two boxes for each frame of points: its own and the next one's."""
    b = v.boxes()
    return b.withColumn("frame_id", F.explode(F.array("box_id", F.col("box_id") - 1))).filter("frame_id >= 0").withColumnRenamed("x", "bx").withColumnRenamed("y", "by").withColumnRenamed("z", "bz")


IN_AABB = "p.x BETWEEN b.x - 2 AND b.x + 2 AND p.y BETWEEN b.y - 1 AND b.y + 1 AND p.z BETWEEN b.z - 0.75 AND b.z + 0.75"
BOX_PAIR = "(p.frame_id = b.box_id OR p.frame_id = b.box_id - 1)"


def _in_aabb() -> F.Column:
    return g.in_box(F.col("x"), F.col("y"), F.col("z"), F.col("lo"), F.col("hi"))


@query(f"SELECT p.frame_id, p.point_idx, b.box_id FROM v_points p JOIN v_boxes b ON {BOX_PAIR} AND {IN_AABB}")
def points_in_aabb(v: Views) -> DataFrame:
    return spatial.points_in_boxes(v.points(), _frame_boxes(v), "frame_id", _in_aabb()).select("frame_id", "point_idx", "box_id")


@query(f"SELECT p.frame_id, p.point_idx FROM v_points p WHERE NOT EXISTS (SELECT 1 FROM v_boxes b WHERE {BOX_PAIR} AND {IN_AABB})")
def exclude_points_in_boxes(v: Views) -> DataFrame:
    return spatial.points_in_boxes(v.points(), _frame_boxes(v), "frame_id", _in_aabb(), how="left_anti").select("frame_id", "point_idx")


@query(f"""SELECT frame_id, point_idx, box_id, CAST(dense_rank() OVER (PARTITION BY frame_id ORDER BY box_id) - 1 AS INTEGER) AS cluster FROM (SELECT p.frame_id, p.point_idx, min(b.box_id) AS box_id FROM v_points p JOIN v_boxes b ON {BOX_PAIR} AND {IN_AABB} GROUP BY 1, 2)""")
def first_match_box(v: Views) -> DataFrame:
    return spatial.first_box(v.points(), _frame_boxes(v), "frame_id", ["point_idx"], "box_id", _in_aabb())


@query("""SELECT p.frame_id, p.point_idx FROM v_points p JOIN v_boxes b ON p.frame_id = b.box_id WHERE abs((p.x - b.x) * cos(label) + (p.y - b.y) * sin(label)) <= 2 AND abs((p.y - b.y) * cos(label) - (p.x - b.x) * sin(label)) <= 1 AND abs(p.z - b.z) <= 0.75""")
def points_in_obb(v: Views) -> DataFrame:
    b = v.boxes().select(F.col("box_id").alias("frame_id"), F.struct("x", "y", "z", "length", "width", "height", F.col("label").cast("double").alias("yaw")).alias("box"))
    return v.points().join(b, "frame_id").filter(g.in_oriented_box(F.col("x"), F.col("y"), F.col("z"), F.col("box"))).select("frame_id", "point_idx")


@query("""SELECT frame_id, point_idx, CASE WHEN miss OR enter > leave OR leave < 0 THEN 'miss' WHEN enter > 1 THEN 'front' WHEN leave < 1 THEN 'behind' ELSE 'in' END AS side FROM (
  SELECT p.frame_id, p.point_idx, FALSE AS miss, greatest(least((b.x-10)/p.x, (b.x+10)/p.x), least((b.y-10)/p.y, (b.y+10)/p.y), least((b.z-10)/p.z, (b.z+10)/p.z)) AS enter,
    least(greatest((b.x-10)/p.x, (b.x+10)/p.x), greatest((b.y-10)/p.y, (b.y+10)/p.y), greatest((b.z-10)/p.z, (b.z+10)/p.z)) AS leave FROM v_points p JOIN v_boxes b ON p.frame_id = b.box_id)""")
def ray_obb_class(v: Views) -> DataFrame:
    side = F.lit(20.0)
    b = v.boxes().select(F.col("box_id").alias("frame_id"), F.struct("x", "y", "z", side.alias("length"), side.alias("width"), side.alias("height"), F.lit(0.0).alias("yaw")).alias("box"))
    return v.points().join(b, "frame_id").select("frame_id", "point_idx", g.ray_class(F.col("x"), F.col("y"), F.col("z"), F.col("box")).alias("side"))


@query("""SELECT p.frame_id, p.point_idx FROM v_points p WHERE p.x > 0 AND p.x < 15 AND abs(p.y) < 6 * p.x / 15 AND abs(p.z) < 6 * p.x / 15""")
def pyramid_members(v: Views) -> DataFrame:
    origin, base = g.point(F.lit(0.0), F.lit(0.0), F.lit(0.0)), g.point(F.lit(15.0), F.lit(0.0), F.lit(0.0))
    return v.points().filter(g.in_pyramid(F.col("x"), F.col("y"), F.col("z"), origin, base, 6.0)).select("frame_id", "point_idx")


@query("""SELECT a.box_id, b.box_id AS other, round(i / (24.0 - i), 6) AS iou FROM (SELECT a.box_id AS k, b.box_id AS l, greatest(0, 4 - abs(a.x - b.x)) * greatest(0, 2 - abs(a.y - b.y)) * greatest(0, 1.5 - abs(a.z - b.z)) AS i
  FROM v_boxes a JOIN v_boxes b ON a.label = b.label AND a.box_id < b.box_id) JOIN v_boxes a ON a.box_id = k JOIN v_boxes b ON b.box_id = l WHERE i > 0""")
def iou_axis_aligned(v: Views) -> DataFrame:
    a = v.boxes().select("box_id", "label", F.struct("x", "y", "z", "length", "width", "height").alias("a"), F.col("lo"), F.col("hi"))
    size = 4.0
    cells = a.select(F.col("box_id").alias("other"), F.col("label").alias("l2"), F.col("a").alias("b"), spatial.cell(F.col("a.x"), size).alias("cx2"))
    left = a.withColumn("cx2", F.explode(F.sequence(spatial.cell(F.col("a.x"), size) - 1, spatial.cell(F.col("a.x"), size) + 1)))
    pairs = left.join(cells, (left["label"] == cells["l2"]) & (left["cx2"] == cells["cx2"]) & (F.col("box_id") < F.col("other")))
    return rounded(pairs.select("box_id", "other", g.aligned_iou(F.col("a"), F.col("b")).alias("iou")).filter("iou > 0"), "iou")


@query("""SELECT box_id, level FROM v_boxes, (VALUES ('Easy', 40, 0, 0.15), ('Moderate', 25, 1, 0.30), ('Hard', 25, 2, 0.50)) c(level, h, o, t)
  WHERE label = 9 OR (20 + label * 5 >= h AND label % 3 <= o AND label / 20.0 <= t)""")
def difficulty_filter(v: Views) -> DataFrame:
    known = F.col("label") != 9
    b = v.boxes().select("box_id", F.when(known, 20 + F.col("label") * 5).alias("h"), (F.col("label") % 3).alias("o"), (F.col("label") / 20.0).alias("t"))
    levels = F.array(*(F.when(matching.passes_difficulty(F.col("h"), F.col("o"), F.col("t"), k), F.lit(k)) for k in matching.DIFFICULTY))
    return b.select("box_id", F.explode(F.filter(levels, lambda x: x.isNotNull())).alias("level"))


# grids and neighbours


@query("""SELECT frame_id, ix, iy FROM (SELECT vec_id AS frame_id, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy FROM embeddings, range(5) a(ix), range(5) b(iy)) ANTI JOIN
  (SELECT frame_id, CAST(floor((x + 10) / 4) AS INTEGER) AS ix, CAST(floor((y + 10) / 4) AS INTEGER) AS iy FROM v_points WHERE x >= -10 AND x < 10 AND y >= -10 AND y < 10) USING (frame_id, ix, iy)""")
def occupancy_empty_cells(v: Views) -> DataFrame:
    return spatial.empty_cells(v.points(), "frame_id", (-10.0, 10.0), (-10.0, 10.0), 4.0)


@query("""SELECT DISTINCT frame_id, CAST(floor(x::FLOAT / 2.5::FLOAT) AS INTEGER) + 13 AS ix, CAST(floor(y::FLOAT / 2.5::FLOAT) AS INTEGER) + 13 AS iy, CAST(floor(z::FLOAT / 4::FLOAT) AS INTEGER) + 2 AS iz FROM v_points
  WHERE x > -32 AND x < 32 AND y > -32 AND y < 32 AND z > -8 AND z < 8""")
def voxel_occupy(v: Views) -> DataFrame:
    return spatial.voxels(v.points(), "frame_id", (2.5, 2.5, 4.0), (-32.0, -32.0, -8.0), (32.0, 32.0, 8.0))


@query("SELECT frame_id, point_idx % 4 AS cluster, count(*) AS n_points, round(avg(x), 6) AS cx, round(min(y), 6) AS min_y, round(max(z) - min(z), 6) AS size_z FROM v_points GROUP BY 1, 2")
def cluster_stats(v: Views) -> DataFrame:
    s = spatial.cluster_stats(v.points().withColumn("cluster", F.col("point_idx") % 4), ["frame_id", "cluster"])
    return rounded(s.select("frame_id", "cluster", "n_points", "cx", "min_y", "size_z"), "cx", "min_y", "size_z")


@query("""SELECT a.frame_id, a.point_idx, count(b.point_idx) AS neighbours FROM v_points a LEFT JOIN v_points b ON a.frame_id = b.frame_id AND a.point_idx <> b.point_idx AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 25 GROUP BY 1, 2""")
def radius_neighbours(v: Views) -> DataFrame:
    return spatial.neighbour_counts(v.points(), "frame_id", "point_idx", 5.0)


NEAR_SQL = """near AS (SELECT a.frame_id, a.point_idx AS key, b.point_idx AS target, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d
  FROM v_points a JOIN v_points b ON a.frame_id = b.frame_id WHERE a.point_idx < 8 AND b.point_idx >= 12)"""


def _near(v: Views) -> tuple[DataFrame, DataFrame]:
    p = v.points()
    return p.filter("point_idx < 8").withColumnRenamed("point_idx", "key"), p.filter("point_idx >= 12").withColumnRenamed("point_idx", "target")


@query(f", {NEAR_SQL} SELECT frame_id, key, arg_min(target, (d, target)) AS target, round(min(d), 6) AS distance FROM near GROUP BY 1, 2".replace("arg_min(target, (d, target))", "arg_min(target, struct_pack(d := d, t := target))"))
def nearest_spoof(v: Views) -> DataFrame:
    return rounded(spatial.nearest_in_frame(*_near(v), "frame_id", "key", "target"), "distance")


@query(f""", {NEAR_SQL} SELECT frame_id, tp, 8 - tp AS fp, fn FROM (SELECT frame_id, count(*) FILTER (d <= 8) AS tp FROM (SELECT frame_id, key, min(d) AS d FROM near GROUP BY 1, 2) GROUP BY 1)
  JOIN (SELECT frame_id, count(*) FILTER (d > 8) AS fn FROM (SELECT frame_id, target, min(d) AS d FROM near GROUP BY 1, 2) GROUP BY 1) USING (frame_id)""")
def gate_match(v: Views) -> DataFrame:
    return spatial.gate_counts(*_near(v), "frame_id", 8.0)


@query("""SELECT frame_id, bool_or(inside AND point_idx < 8) AND NOT bool_or(inside AND point_idx >= 8) AS success FROM (SELECT *, abs(x) <= 4 AND abs(y) <= 4 AND abs(z) <= 4 AS inside FROM v_points) GROUP BY 1""")
def ghost_success(v: Views) -> DataFrame:
    box = lambda c: F.struct(c.x.alias("x"), c.y.alias("y"), c.z.alias("z"), F.lit(0.0).alias("yaw"), F.lit(8.0).alias("length"), F.lit(8.0).alias("width"), F.lit(8.0).alias("height"))
    lists = v.points().groupBy("frame_id").agg(*(F.collect_list(F.when(c, F.struct("x", "y", "z"))).alias(n) for n, c in (("attacked", F.col("point_idx") < 8), ("clean", F.col("point_idx") >= 8))))
    has = lambda side: F.exists(side, lambda c: g.in_oriented_box(F.lit(0.0), F.lit(0.0), F.lit(0.0), box(c)))
    return lists.select("frame_id", (has("attacked") & ~has("clean")).alias("success"))


@query("""SELECT frame_id, point_idx FROM v_points WHERE point_idx % 5 = 0""")
def cloud_diff(v: Views) -> DataFrame:
    p = v.points()
    return spatial.cloud_difference(p, p.filter("point_idx % 5 <> 0"), "frame_id").select("frame_id", "point_idx")


@query("""
, s AS (SELECT *, sqrt(x*x + y*y + z*z) AS r, z <= -2 AS low FROM v_points),
cell AS (SELECT *, floor(acos(z / r) / 0.4) AS it, floor((atan2(y, x) + 2.0) / 0.5) AS ip FROM s WHERE r > 0 AND atan2(y, x) BETWEEN -2.0 AND 2.0 AND acos(z / r) >= 0.5),
kinds AS (SELECT frame_id, it, ip, bool_or(low) AS has_ground FROM cell GROUP BY 1, 2, 3),
tops AS (SELECT * FROM cell WHERE NOT low),
dense AS (SELECT a.frame_id, a.point_idx FROM tops a JOIN tops b ON a.frame_id = b.frame_id AND a.point_idx <> b.point_idx AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 64 GROUP BY 1, 2 HAVING count(*) >= 2),
groups AS (SELECT DISTINCT frame_id, it, ip, has_ground FROM dense JOIN cell USING (frame_id, point_idx) JOIN kinds USING (frame_id, it, ip))
SELECT frame_id, count(it) FILTER (has_ground) AS both, count(it) FILTER (NOT has_ground) AS neither, count(it) FILTER (has_ground) > 1 OR count(it) FILTER (NOT has_ground) > 1 AS detected FROM (SELECT DISTINCT frame_id FROM v_points) LEFT JOIN groups USING (frame_id) GROUP BY 1""")
def grid_coherence(v: Views) -> DataFrame:
    return defenses.grid_coherence(v.points(), "frame_id", theta=0.5, step_theta=0.4, phi=(-2.0, 2.0), step_phi=0.5, least=2, reach=8.0, most=1, ground=-2.0)


# sweeps


SWEEP_SQL = f"SELECT threshold, tp, fp, tn, fn, {RATES_SQL} FROM (SELECT threshold, count(*) FILTER (is_attacked AND x > threshold) AS tp, count(*) FILTER (NOT is_attacked AND x > threshold) AS fp, count(*) FILTER (NOT is_attacked AND x <= threshold) AS tn, count(*) FILTER (is_attacked AND x <= threshold) AS fn FROM v_verdict, (SELECT unnest([20.0, 40.0, 60.0, 80.0]) AS threshold) GROUP BY 1)"


def _axis_values(v: Views) -> DataFrame:
    return sweeps.grid(v.spark, threshold=[20.0, 40.0, 60.0, 80.0])


@query(SWEEP_SQL)
def sweep_thresholds(v: Views) -> DataFrame:
    return rounded(sweeps.sweep_thresholds(v.verdicts(), _axis_values(v), "threshold", "x", "is_attacked"), *RATES)


@query(SWEEP_SQL + " WHERE threshold IN (40.0, 80.0)")
def sweep_resume(v: Views) -> DataFrame:
    left = sweeps.remaining(_axis_values(v), sweeps.grid(v.spark, threshold=[20.0, 60.0]), "threshold")
    return rounded(sweeps.sweep_thresholds(v.verdicts(), left, "threshold", "x", "is_attacked"), *RATES)


# detection matching.  The SQL walks the predictions of a frame and class one after another.


def _detections(v: Views, turned: bool = False) -> tuple[DataFrame, DataFrame]:
    """Shifted predictions and labels, ten boxes to a frame; turned boxes have a yaw by label."""
    kind = F.concat(F.lit("class"), (F.col("label") % 3).cast("string"))
    b = v.boxes().withColumns({"frame": F.floor(F.col("box_id") / 10).cast("string"), "idx": (F.col("box_id") % 10).cast("int"), "type": kind})
    yaw = F.col("label").cast("double") if turned else F.lit(0.0)
    corners = lambda dx: g.corners_yaw(F.col("x") + dx, F.col("y"), F.col("z"), F.col("length"), F.col("width"), F.col("height"), yaw)
    base = b.select("frame", "idx", "type", "score", "x", "y", "z", "box_id", "label", "length", "width", "height")
    graded = base.withColumns({"bbox_height": F.when(F.col("box_id") % 11 > 0, 20 + F.col("box_id") * 7 % 40), "occluded": F.col("box_id") % 4, "truncated": F.col("box_id") % 6 / 10})
    return base.withColumn("corners", corners((F.col("box_id") % 5) * 0.4)), graded.withColumn("corners", corners(F.lit(0.0)))


def _half(_: str) -> float:
    return 0.5


DETECTIONS_SQL = """
gt AS (SELECT box_id, (box_id // 10)::VARCHAR AS frame, (box_id % 10)::INT AS idx, 'class' || (label % 3) AS type, score, x, y, z,
  CASE WHEN box_id % 11 > 0 THEN 20 + box_id * 7 % 40 END AS h, box_id % 4 AS o, box_id % 6 / 10 AS t FROM v_boxes),
pairs AS (SELECT a.frame, a.type, b.type AS other, a.idx AS p, b.idx AS q, i / (24 - i) AS iou FROM (SELECT k.frame, k.idx AS kp, l.idx AS lq,
    greatest(0, 4 - abs(k.x + (k.box_id % 5) * 0.4 - l.x)) * greatest(0, 2 - abs(k.y - l.y)) * greatest(0, 1.5 - abs(k.z - l.z)) AS i FROM gt k JOIN gt l USING (frame))
  JOIN gt a USING (frame) JOIN gt b USING (frame) WHERE a.idx = kp AND b.idx = lq AND i > 0),
grades AS (SELECT level, frame, type, idx, h IS NOT NULL AND NOT (h >= least_h AND o <= most_o AND t <= most_t) AS ignored FROM gt,
  (VALUES ('Easy', 40, 0, 0.15), ('Moderate', 25, 1, 0.30), ('Hard', 25, 2, 0.50), ('all', -1, 99, 99.0)) c(level, least_h, most_o, most_t))"""


def match_sql(name: str, keep: str = "true", limits: str = "0.5", levels: str = "'all'") -> str:
    """Views for greedy matching: ``{name}`` has a row per prediction, ``{name}_n`` the targets of each class."""
    by = "lim, level, frame, type"
    return f""",
{name}_turn AS (SELECT {by}, idx, score, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, idx) AS k, open, shut FROM (
  SELECT {by}, idx, score, coalesce(list(q ORDER BY iou DESC, q) FILTER (iou >= lim AND NOT ignored), []) AS open, coalesce(bool_or(iou >= lim AND ignored), false) AS shut FROM (
    SELECT lim, l.level, g.frame, g.type, g.idx, g.score, p.q, p.iou, r.ignored FROM gt g, (SELECT unnest([{limits}]) AS lim), (SELECT unnest([{levels}]) AS level) l
    LEFT JOIN pairs p ON p.frame = g.frame AND p.type = g.type AND p.other = g.type AND p.p = g.idx LEFT JOIN grades r ON r.level = l.level AND r.frame = p.frame AND r.idx = p.q WHERE {keep})
  GROUP BY {by}, idx, score)),
{name}_walk AS (SELECT {by}, k, score, open[1] AS got, shut, open[1:1] AS used FROM {name}_turn WHERE k = 1
  UNION ALL SELECT lim, level, frame, type, k, score, got, shut, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END FROM (
    SELECT t.lim, t.level, t.frame, t.type, t.k, t.score, t.shut, w.used, list_filter(t.open, lambda c: NOT list_contains(w.used, c))[1] AS got
    FROM {name}_walk w JOIN {name}_turn t ON t.lim = w.lim AND t.level = w.level AND t.frame = w.frame AND t.type = w.type AND t.k = w.k + 1)),
{name} AS (SELECT {by}, score, got IS NOT NULL AS is_tp FROM {name}_walk WHERE got IS NOT NULL OR NOT shut),
{name}_n AS (SELECT level, type, count(*) FILTER (NOT ignored) AS n_gt FROM grades GROUP BY 1, 2)"""


def detections_oracle(*parts: str) -> str:
    return oracle(f", {DETECTIONS_SQL.strip()}" + "".join(parts)).replace("WITH ", "WITH RECURSIVE ", 1)


CURVE_SQL = """,
hits AS (SELECT level, type, score, row_number() OVER (PARTITION BY level, type ORDER BY score DESC) - 1 AS r, count(*) OVER (PARTITION BY level, type) AS hits FROM m WHERE is_tp),
ranks AS (SELECT level, type, s, hits, least(hits - 1, greatest(s, ceil((s * n_gt - 60) / 40.0)))::BIGINT AS r, n_gt FROM m_n JOIN (SELECT DISTINCT level, type, hits FROM hits) USING (level, type), range(42) t(s)),
picked AS (SELECT level, type, s AS t_idx, r, n_gt FROM (SELECT *, lag(r) OVER (PARTITION BY level, type ORDER BY s) AS before FROM ranks) WHERE before IS NULL OR before < hits - 1),
cuts AS (SELECT level, type, t_idx, score AS threshold, n_gt FROM picked JOIN hits USING (level, type, r)),
counted AS (SELECT c.level, c.type, t_idx, threshold, n_gt, count(*) FILTER (is_tp) AS tp, count(*) FILTER (NOT is_tp) AS fp FROM cuts c JOIN m ON m.level = c.level AND m.type = c.type AND score >= threshold GROUP BY ALL),
curve AS (SELECT level, type, t_idx, threshold, tp, fp, n_gt, max(tp / (tp + fp + 1e-9)) OVER (PARTITION BY level, type ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS precision, tp / (n_gt + 1e-9) AS recall FROM counted)"""
LEVELS_SQL = "'Easy', 'Moderate', 'Hard', 'all'"
TABLE_SQL = """ap AS (SELECT level, type, coalesce(sum(precision) / 41, 0.0) AS ap FROM m_n LEFT JOIN curve USING (level, type) GROUP BY 1, 2),
mean AS (SELECT * FROM ap UNION ALL SELECT level, 'mAP', avg(ap) FROM ap GROUP BY 1)"""


@query(
    detections_oracle(match_sql("m"), " SELECT frame, type, lim AS limit, score, is_tp, n_gt FROM (SELECT frame, type, count(*) FILTER (NOT ignored)::INT AS n_gt FROM grades WHERE level = 'all' GROUP BY 1, 2) LEFT JOIN m USING (frame, type)"), shared=False
)
def greedy_match(v: Views) -> DataFrame:
    return matching.match(*_detections(v), "frame", _half).select("frame", "type", "limit", "score", "is_tp", "n_gt")


@query()
def greedy_match_turned(v: Views) -> DataFrame:
    return matching.match(*_detections(v, turned=True), "frame", _half).drop("level", "leads")


@query()
def iou_rotated(v: Views) -> DataFrame:
    p, q = _detections(v, turned=True)
    return rounded(matching.overlaps(p, q, "frame"), "iou")


@query(detections_oracle(match_sql("m"), CURVE_SQL, " SELECT type, round(coalesce(sum(precision) / 41, 0.0), 6) AS ap FROM m_n LEFT JOIN curve USING (level, type) WHERE level = 'all' GROUP BY 1"), shared=False)
def ap_mean41(v: Views) -> DataFrame:
    return rounded(matching.average_precision(*_detections(v), "frame", _half), "ap")


@query(detections_oracle(match_sql("m"), CURVE_SQL, " SELECT type, t_idx::INT AS t_idx, threshold, tp, fp, n_gt, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve"), shared=False)
def pr_curve(v: Views) -> DataFrame:
    return rounded(matching.precision_recall(*_detections(v), "frame", _half).drop("level"), "precision", "recall")


@query(detections_oracle(match_sql("m", levels=LEVELS_SQL), CURVE_SQL, f", {TABLE_SQL} SELECT type, level, round(ap, 6) AS ap FROM mean"), shared=False)
def map_table(v: Views) -> DataFrame:
    return rounded(matching.map_table(*_detections(v), "frame", _half), "ap")


def _degradation_sql() -> str:
    side = lambda name, keep: detections_oracle(match_sql("m", keep, levels=LEVELS_SQL), CURVE_SQL, f", {TABLE_SQL} SELECT * FROM mean")
    return f"SELECT type, level, round(c.ap, 6) AS clean, round(a.ap, 6) AS attacked, round(c.ap - a.ap, 6) AS degradation FROM ({side('c', 'true')}) c JOIN ({side('a', 'g.box_id % 3 > 0')}) a USING (type, level)"


@query(_degradation_sql(), shared=False)
def ap_degradation(v: Views) -> DataFrame:
    p, q = _detections(v)
    return rounded(matching.ap_degradation(p, p.filter("box_id % 3 > 0"), q, "frame", _half), "clean", "attacked", "degradation")


RECALL_LIMITS = [round(0.1 + 0.05 * k, 2) for k in range(17)]


@query(
    detections_oracle(match_sql("m", "g.score >= 0.2", ", ".join(map(str, RECALL_LIMITS))), " SELECT type, lim::DOUBLE AS iou, round(tp / n_gt, 6) AS recall FROM (SELECT type, lim, count(*) FILTER (is_tp) AS tp FROM m GROUP BY 1, 2) JOIN m_n USING (type) WHERE level = 'all'"), shared=False
)
def recall_vs_iou(v: Views) -> DataFrame:
    return rounded(matching.recall_vs_iou(*_detections(v), "frame", RECALL_LIMITS, 0.2), "recall")


@query(
    detections_oracle(
        match_sql("m"),
        match_sql("w", "g.box_id % 3 > 0"),
        """, f AS (SELECT frame, type, n_gt, coalesce(c, 0) AS c, coalesce(a, 0) AS a FROM (SELECT frame, type, count(*) AS n_gt FROM gt GROUP BY 1, 2) LEFT JOIN (SELECT frame, type, count(*) FILTER (is_tp) AS c FROM m GROUP BY 1, 2) USING (frame, type)
  LEFT JOIN (SELECT frame, type, count(*) FILTER (is_tp) AS a FROM w GROUP BY 1, 2) USING (frame, type))
SELECT coalesce(type, 'overall') AS type, sum(n_gt)::BIGINT AS n_gt, round(sum(c) / sum(n_gt), 6) AS clean_rate, round(sum(a) / sum(n_gt), 6) AS attacked_rate, round((sum(c) - sum(a)) / sum(n_gt), 6) AS absolute_drop,
  round(coalesce((sum(c) - sum(a)) / nullif(sum(c), 0), 0.0), 6) AS relative_drop, count(*) AS n_frames, count(DISTINCT frame) AS n_distinct_frames FROM f GROUP BY ROLLUP (type)""",
    ),
    shared=False,
)
def detection_rate(v: Views) -> DataFrame:
    p, q = _detections(v)
    return rounded(matching.detection_rate(p, p.filter("box_id % 3 > 0"), q, "frame", _half), "clean_rate", "attacked_rate", "absolute_drop", "relative_drop")


@query(
    detections_oracle(
        """ SELECT frame, bool_or(lost) AS success FROM (SELECT k.frame, NOT coalesce(bool_or(i / (24 - i) >= 0.5), false) AS lost FROM gt k LEFT JOIN (SELECT k.box_id, greatest(0, 4 - abs(k.x + (k.box_id % 5) * 0.4 - l.x - (l.box_id % 5) * 0.4)) * greatest(0, 2 - abs(k.y - l.y)) * greatest(0, 1.5 - abs(k.z - l.z)) AS i
  FROM gt k JOIN gt l USING (frame) WHERE l.box_id % 7 > 0) USING (box_id) GROUP BY k.frame, k.box_id) GROUP BY 1"""
    ),
    shared=False,
)
def removal_success(v: Views) -> DataFrame:
    p, _ = _detections(v)
    return matching.removal_success(p, p.filter("box_id % 7 > 0"), p.select("frame").distinct(), "frame", ["class0", "class1", "class2"])


# detections judged target by target.  The SQL walks the targets of a frame, once by score, once by overlap.

KINDS = ["Car", "Pedestrian", "Cyclist", "Van", "Car", "Pedestrian", "Car", "Person_sitting", "Cyclist", "DontCare"]


def _image_boxes(v: Views) -> tuple[DataFrame, DataFrame]:
    """Image boxes that crowd each other, ten to a frame; detections are moved aside and turned."""
    k = F.col("box_id")
    kind = lambda label: F.array(*map(F.lit, KINDS))[label.cast("int")]
    base = v.boxes().select("box_id", "label", F.floor(k / 10).alias("frame"), (k % 10).cast("int").alias("idx"), (F.col("x") * 0.5 + 300).alias("x1"), (F.col("y") * 0.5 + 200).alias("y1"), "score")
    sized = base.withColumns({"w": (40 + k % 3 * 4).cast("double"), "h": (21 + k * 7 % 40).cast("double"), "turn": (k % 63).cast("double") / 10 - 3})
    edges = lambda dx: [(F.col("x1") + dx).alias("x1"), "y1", (F.col("x1") + dx + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2")]
    moved = sized.select("frame", "idx", kind(F.when(k % 4 > 0, F.col("label")).otherwise(F.lit(0))).alias("type"), "score", (F.col("turn") + k % 7 * 0.1).alias("alpha"), *edges((k % 5).cast("double")))
    return moved, sized.select("frame", "idx", kind(F.col("label")).alias("type"), F.col("turn").alias("alpha"), *edges(F.lit(0.0)), (k % 4).alias("occluded"), (k % 6 / 10).alias("truncated"))


def target_walk(name: str, turns: str) -> str:
    """Views that serve targets in order: ``turns`` has, for each, the near detections, best first."""
    by = "t_idx, class, level, frame"
    return f""",
{name}_turn AS MATERIALIZED (SELECT {by}, idx, valid, open, row_number() OVER (PARTITION BY {by} ORDER BY idx) AS k FROM ({turns})),
{name} AS (SELECT {by}, idx, valid, k, open[1] AS got, [c.idx FOR c IN open[1:1]] AS used FROM {name}_turn WHERE k = 1
  UNION ALL SELECT {by}, idx, valid, k, got, CASE WHEN got IS NULL THEN used ELSE list_append(used, got.idx) END FROM (
    SELECT t.*, w.used, list_filter(t.open, lambda c: NOT list_contains(w.used, c.idx))[1] AS got
    FROM {name} w JOIN {name}_turn t ON t.t_idx = w.t_idx AND t.class = w.class AND t.level = w.level AND t.frame = w.frame AND t.k = w.k + 1))"""


TARGETS_SQL = f""",
sized AS (SELECT box_id, label, (box_id // 10)::BIGINT AS frame, (box_id % 10)::INT AS idx, x * 0.5 + 300 AS x1, y * 0.5 + 200 AS y1, (40 + box_id % 3 * 4)::DOUBLE AS w, (21 + box_id * 7 % 40)::DOUBLE AS h, (box_id % 63) / 10 - 3 AS turn, score FROM v_boxes),
goal AS (SELECT frame, idx, ({KINDS})[label + 1] AS type, turn AS alpha, x1, y1, x1 + w AS x2, y1 + h AS y2, box_id % 4 AS o, box_id % 6 / 10 AS t FROM sized),
shot AS (SELECT frame, idx, CASE WHEN box_id % 4 > 0 THEN ({KINDS})[label + 1] ELSE 'Car' END AS type, score, turn + box_id % 7 * 0.1::DOUBLE AS alpha, x1 + box_id % 5 AS x1, y1, x1 + box_id % 5 + w AS x2, y1 + h AS y2 FROM sized),
setting AS (SELECT * FROM (VALUES ('Car', 'Van', 0.7), ('Pedestrian', 'Person_sitting', 0.5), ('Cyclist', NULL, 0.5)) c(class, beside, lim), (VALUES ('Easy', 40, 0, 0.15), ('Moderate', 25, 1, 0.30), ('Hard', 25, 2, 0.50)) l(level, least, most_o, most_t)),
goals AS (SELECT class, level, frame, idx, type = class AND NOT hard AS valid FROM (SELECT *, o > most_o OR t > most_t OR y2 - y1 <= least AS hard FROM setting, goal) WHERE type = class OR type = beside),
shots AS (SELECT class, level, lim, frame, idx, score, floor(abs(y1 - y2)) < least AS low FROM setting, shot WHERE type = class OR floor(abs(y1 - y2)) < least),
shared AS (SELECT s.frame, s.idx AS p, g.idx AS q, g.type, (s.x2 - s.x1) * (s.y2 - s.y1) AS a, (g.x2 - g.x1) * (g.y2 - g.y1) AS b, greatest(0, least(s.x2, g.x2) - greatest(s.x1, g.x1)) * greatest(0, least(s.y2, g.y2) - greatest(s.y1, g.y1)) AS i FROM shot s JOIN goal g USING (frame)),
near AS MATERIALIZED (SELECT s.class, s.level, s.frame, h.q, s.idx, s.score, s.low, h.i / (h.a + h.b - h.i) AS iou FROM shots s JOIN shared h ON h.frame = s.frame AND h.p = s.idx WHERE h.i / (h.a + h.b - h.i) > s.lim)"""
TARGET_CURVE_SQL = (
    TARGETS_SQL
    + target_walk("best", "SELECT 0 AS t_idx, g.class, g.level, g.frame, g.idx, g.valid, coalesce(list({'idx': n.idx, 'low': n.low, 'score': n.score} ORDER BY n.score DESC, n.idx) FILTER (n.idx IS NOT NULL), []) AS open FROM goals g LEFT JOIN near n ON n.class = g.class AND n.level = g.level AND n.frame = g.frame AND n.q = g.idx GROUP BY ALL")
    + """,
m AS (SELECT level, class AS type, got.score AS score, true AS is_tp FROM best WHERE valid AND NOT got.low),
m_n AS (SELECT level, class AS type, count(*) FILTER (valid) AS n_gt FROM goals GROUP BY 1, 2)"""
    + CURVE_SQL[: CURVE_SQL.index(",\ncounted")]
    + target_walk("walk", "SELECT c.t_idx, g.class, g.level, g.frame, g.idx, g.valid, coalesce(list({'idx': n.idx, 'low': n.low} ORDER BY n.low, CASE WHEN n.low THEN 0.0 ELSE -n.iou END, n.idx) FILTER (n.score >= c.threshold), []) AS open FROM goals g JOIN cuts c ON c.type = g.class AND c.level = g.level LEFT JOIN near n ON n.class = g.class AND n.level = g.level AND n.frame = g.frame AND n.q = g.idx GROUP BY ALL")
    + """,
right_ones AS (SELECT level, class AS type, t_idx, count(*) FILTER (NOT got.low) AS tp, count(*) FILTER (got IS NULL) AS fn, coalesce(sum((1 + cos(g.alpha - s.alpha)) / 2) FILTER (NOT got.low), 0.0) AS similarity
  FROM walk w JOIN goal g ON g.frame = w.frame AND g.idx = w.idx LEFT JOIN shot s ON s.frame = w.frame AND s.idx = w.got.idx WHERE valid GROUP BY 1, 2, 3),
stuffed AS (SELECT DISTINCT s.class, s.level, s.frame, s.idx FROM shots s JOIN shared h ON h.frame = s.frame AND h.p = s.idx WHERE h.type = 'DontCare' AND h.i / h.a > s.lim),
taken AS (SELECT t_idx, class, level, frame, got.idx AS idx FROM walk WHERE got IS NOT NULL),
wrong_ones AS (SELECT c.level, c.type, c.t_idx, count(*) AS fp FROM cuts c JOIN shots s ON s.class = c.type AND s.level = c.level AND s.score >= c.threshold AND NOT s.low ANTI JOIN stuffed x ON x.class = s.class AND x.level = s.level AND x.frame = s.frame AND x.idx = s.idx
  ANTI JOIN taken k ON k.t_idx = c.t_idx AND k.class = s.class AND k.level = s.level AND k.frame = s.frame AND k.idx = s.idx GROUP BY 1, 2, 3),
judged AS (SELECT type, level, t_idx::INT AS t_idx, threshold, tp, coalesce(fp, 0) AS fp, fn, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, max(coalesce(tp / nullif(tp + coalesce(fp, 0), 0), 0.0)) OVER behind AS precision, max(coalesce(similarity / nullif(tp + coalesce(fp, 0), 0), 0.0)) OVER behind AS aos
  FROM cuts JOIN right_ones USING (type, level, t_idx) LEFT JOIN wrong_ones USING (type, level, t_idx) WINDOW behind AS (PARTITION BY type, level ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
)


def targets_oracle(body: str) -> str:
    return oracle(TARGET_CURVE_SQL + body).replace("WITH ", "WITH RECURSIVE ", 1)


@query(targets_oracle(" SELECT type, level, t_idx, threshold, tp, fp, fn, round(recall, 6) AS recall, round(precision, 6) AS precision, round(aos, 6) AS aos FROM judged"), shared=False)
def target_major_curve(v: Views) -> DataFrame:
    return rounded(orientation.target_curve(*_image_boxes(v), "frame"), "recall", "precision", "aos")


@query(targets_oracle(" SELECT type, level, round(coalesce(sum(precision) / 41, 0.0), 6) AS ap, round(coalesce(sum(aos) / 41, 0.0), 6) AS aos FROM (SELECT class AS type, level FROM setting WHERE class IN (SELECT type FROM shot WHERE x1 >= 0)) LEFT JOIN judged USING (type, level) GROUP BY 1, 2"), shared=False)
def orientation_table(v: Views) -> DataFrame:
    return rounded(orientation.target_table(*_image_boxes(v), "frame"), "ap", "aos")


# what SQL does not express


@query()
def hungarian_quality(v: Views) -> DataFrame:
    p, q = _detections(v, turned=True)
    centres = p.withColumn("x", F.col("x") + 0.3)
    return matching.clustering_quality(centres, q.filter("idx < 3"), q.filter("idx >= 3"), "frame")


DBSCAN_SQL = """
near AS (SELECT a.frame_id, a.point_idx AS i, b.point_idx AS j FROM v_points a JOIN v_points b USING (frame_id) WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 64),
core AS (SELECT frame_id, i FROM near GROUP BY 1, 2 HAVING count(*) >= 3),
tied AS (SELECT n.frame_id, n.i, n.j FROM near n JOIN core c ON c.frame_id = n.frame_id AND c.i = n.i JOIN core d ON d.frame_id = n.frame_id AND d.i = n.j),
reach AS (SELECT frame_id, i, j FROM tied UNION SELECT r.frame_id, r.i, t.j FROM reach r JOIN tied t ON t.frame_id = r.frame_id AND t.i = r.j),
numbered AS (SELECT frame_id, i, (dense_rank() OVER (PARTITION BY frame_id ORDER BY head) - 1)::INT AS cluster FROM (SELECT frame_id, i, min(j) AS head FROM reach GROUP BY 1, 2)),
clustered AS (SELECT p.*, coalesce(c.cluster, e.cluster, -1)::INT AS cluster FROM v_points p LEFT JOIN numbered c ON c.frame_id = p.frame_id AND c.i = p.point_idx
  LEFT JOIN (SELECT n.frame_id, n.i, min(c.cluster) AS cluster FROM near n JOIN numbered c ON c.frame_id = n.frame_id AND c.i = n.j GROUP BY 1, 2) e ON e.frame_id = p.frame_id AND e.i = p.point_idx)"""


@query(oracle(f", {DBSCAN_SQL.strip()} SELECT frame_id, point_idx, round(x, 6) AS x, cluster FROM clustered").replace("WITH ", "WITH RECURSIVE ", 1), shared=False)
def dbscan(v: Views) -> DataFrame:
    return rounded(clusters.cluster_points(v.points(), "frame_id", "point_idx", 8.0, 3).select("frame_id", "point_idx", "x", "cluster"), "x")


def _scene_points(v: Views) -> DataFrame:
    """Frames of points as scenes of twenty."""
    return v.points().withColumns({"scene": F.floor(F.col("frame_id") / 20).cast("string"), "at": (F.col("frame_id") % 20).cast("int")})


@query()
def chain_association(v: Views) -> DataFrame:
    c = clusters.cluster_points(_scene_points(v), "frame_id", "point_idx", 10.0, 3).filter("cluster >= 0")
    s = c.groupBy("scene", "at", "cluster").agg(F.count("*").alias("n_points"), *(F.avg(a).alias(a) for a in "xyz"))
    return clusters.radial_jitter(clusters.chains(s, "scene", "at", 12, 15.0, 3))


@query()
def jitter_verdicts(v: Views) -> DataFrame:
    return defenses.jitter_verdicts(_scene_points(v), "scene", "at", eps=10.0, least=3, tolerance=15.0, ground=-100.0)


SLAB = "CASE WHEN p.{a} = 0 THEN {inf} ELSE {f}((b.{a} - 10) / p.{a}, (b.{a} + 10) / p.{a}) END"
ENTER_SQL = "greatest(" + ", ".join(SLAB.format(a=a, f="least", inf="'-inf'::DOUBLE") for a in "xyz") + ")"
LEAVE_SQL = "least(" + ", ".join(SLAB.format(a=a, f="greatest", inf="'inf'::DOUBLE") for a in "xyz") + ")"


@query(f"""SELECT frame_id, 0 AS idx, count(*) FILTER (leave < 1) AS behind, count(*) FILTER (enter <= 1 AND leave >= 1) AS inside, count(*) FILTER (enter > 1) AS front,
  round(coalesce(count(*) FILTER (leave < 1) / nullif(count(*) FILTER (enter <= 1), 0), 0.0), 6) AS lpd, round(coalesce(count(*) FILTER (enter <= 1 AND leave >= 1) / nullif(count(*) FILTER (leave >= 1), 0), 0.0), 6) AS share
  FROM (SELECT p.frame_id, {ENTER_SQL} AS enter, {LEAVE_SQL} AS leave FROM v_points p JOIN v_boxes b ON b.box_id = p.frame_id) WHERE enter <= leave AND leave >= 0 GROUP BY 1""")
def penetration_ratio(v: Views) -> DataFrame:
    side = F.lit(20.0)
    b = v.boxes().select(F.col("box_id").alias("frame_id"), F.lit(0).alias("idx"), F.struct("x", "y", "z", side.alias("length"), side.alias("width"), side.alias("height"), F.lit(0.0).alias("yaw")).alias("box"))
    return rounded(defenses.penetration(v.points(), b, "frame_id").withColumn("share", ratio(F.col("inside"), F.col("inside") + F.col("front"))), "lpd", "share")


@query()
def void_region(v: Views) -> DataFrame:
    return defenses.void_region(v.points(), "frame_id", (-10.0, 10.0), (-10.0, 10.0), ground=0.0, delta=5.0, stride=4.0, eps=6.0, least=3, top_eps=10.0, top_least=2)


@query()
def inject_noise(v: Views) -> DataFrame:
    return perturb.inject_noise(v.points(), "frame_id", "point_idx", perturb.PRESETS["os1_32"], 7)


@query()
def ora_perturb(v: Views) -> DataFrame:
    boxes = _frame_boxes(v).select("frame_id", F.col("box_id").alias("order"), "lo", "hi", F.col("bx").alias("x"), F.col("by").alias("y"))
    return perturb.remove_objects(v.points(), boxes, "frame_id", seed=3)


@query("""
, beams AS (SELECT *, atan2(y, x) AS az, atan2(z, sqrt(x*x + y*y)) AS el FROM v_points),
ghost AS (SELECT * FROM beams WHERE frame_id = 0)
SELECT frame_id, point_idx, round(x, 6) AS x, round(z, 6) AS z, false AS injected FROM beams b WHERE NOT EXISTS (FROM ghost g WHERE sqrt((g.az-b.az)*(g.az-b.az) + (g.el-b.el)*(g.el-b.el)) < 0.05)
UNION ALL SELECT f.frame_id, ((1 << 24) + row_number() OVER (PARTITION BY f.frame_id ORDER BY x, y, z))::INT, round(x, 6), round(z, 6), true FROM (SELECT DISTINCT frame_id FROM v_points) f, ghost""")
def ghost_inject(v: Views) -> DataFrame:
    ghost = v.points().filter("frame_id = 0").select("x", "y", "z", "intensity")
    return rounded(perturb.inject_ghost(v.points(), ghost, "frame_id", 0.05).select("frame_id", "point_idx", "x", "z", "injected"), "x", "z")


@query()
def shadow_volume(v: Views) -> DataFrame:
    return defenses.shadow_volume(v.points(), "frame_id", (-10.0, 10.0), (-10.0, 10.0), ground=-10.0, delta=5.0, stride=4.0, eps=6.0, least=2, voxel=2.0, object_eps=10.0, object_least=2)


@query()
def transport_verdicts(v: Views) -> DataFrame:
    return rounded(defenses.transport_verdicts(_scene_points(v), "scene", "at", eps=10.0, least=3, tolerance=15.0, ground=-100.0, least_points=3), "rho")


@query()
def icp_sigma(v: Views) -> DataFrame:
    c = clusters.cluster_points(_scene_points(v), "frame_id", "point_idx", 10.0, 3).filter("cluster >= 0")
    s = c.groupBy("scene", "at", "cluster").agg(F.count("*").alias("n_points"), *(F.avg(a).alias(a) for a in "xyz"))
    return clusters.aligned_sigma(c, clusters.chains(s, "scene", "at", 6, 15.0, 3), "scene", "at", reach=5.0, least_points=3)


@query()
def carlo_verdicts(v: Views) -> DataFrame:
    side = F.lit(20.0)
    b = v.boxes().select(F.col("box_id").alias("frame_id"), F.lit(0).alias("idx"), F.struct("x", "y", "z", side.alias("length"), side.alias("width"), side.alias("height"), F.lit(0.0).alias("yaw")).alias("box"))
    return defenses.hierarchy(v.points(), b, "frame_id", voxel=2.0)


# selections, pairs and small reports


@query("""SELECT c.frame_id, c.cluster, coalesce(string_agg(DISTINCT b.box_id::VARCHAR, ',' ORDER BY b.box_id::VARCHAR), '') AS labels FROM (SELECT *, point_idx % 4 AS cluster FROM v_points) c
  LEFT JOIN v_boxes b ON b.box_id // 10 = c.frame_id // 10 AND abs(c.x - b.x) <= 6 AND abs(c.y - b.y) <= 6 AND abs(c.z - b.z) <= 6 GROUP BY 1, 2""")
def cluster_labels(v: Views) -> DataFrame:
    corner = lambda sign: F.struct(*((F.col(a) + sign * 6.0).alias(a) for a in "xyz"))
    p = v.points().withColumn("cluster", F.col("point_idx") % 4)
    first = F.floor(F.col("box_id") / 10).cast("long") * 10
    boxes = v.boxes().select(F.explode(F.sequence(first, first + 9)).alias("frame_id"), F.col("box_id").alias("idx"), corner(-1).alias("lo"), corner(1).alias("hi"))
    found = spatial.cluster_labels(p, boxes, "frame_id")
    return found.withColumn("labels", F.array_join(F.array_sort(F.col("labels").cast("array<string>")), ","))


@query("""SELECT a.frame_id, a.point_idx AS a, b.point_idx AS b FROM v_points a JOIN v_points b USING (frame_id) WHERE a.point_idx < 8 AND b.point_idx >= 8 AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) < 10
  AND least(abs(atan2(a.y, a.x) - atan2(b.y, b.x)), 2 * pi() - abs(atan2(a.y, a.x) - atan2(b.y, b.x))) < radians(20)""")
def bearing_pairs(v: Views) -> DataFrame:
    p = v.points().withColumnRenamed("point_idx", "idx")
    return spatial.bearing_pairs(p.filter("idx < 8"), p.filter("idx >= 8"), "frame_id")


@query("""SELECT frame_id, point_idx FROM v_points WHERE point_idx % 5 <> 0""")
def cloud_intersection(v: Views) -> DataFrame:
    p = v.points()
    return spatial.cloud_intersection(p, p.filter("point_idx % 5 <> 0"), "frame_id").select("frame_id", "point_idx")


@query("""SELECT *, row_number() OVER (ORDER BY frame_id, ix, iy, iz) AS place FROM (SELECT DISTINCT frame_id, floor(x::FLOAT / 2.5::FLOAT)::INT AS ix, floor(y::FLOAT / 2.5::FLOAT)::INT AS iy, floor(z::FLOAT / 4::FLOAT)::INT AS iz FROM v_points WHERE frame_id < 50)""")
def voxel_order(v: Views) -> DataFrame:
    ordered = spatial.sorted_voxels(spatial.voxels(v.points().filter("frame_id < 50"), "frame_id", (2.5, 2.5, 4.0)), "frame_id")
    # the place of a row in the sorted output: partitions ascend, and rows ascend in them
    placed = ordered.withColumn("_id", F.monotonically_increasing_id())
    return placed.withColumn("place", F.row_number().over(W.orderBy("_id"))).drop("_id")


@query("""SELECT p.frame_id, p.point_idx FROM v_points p JOIN v_boxes b ON b.box_id = p.frame_id WHERE abs((p.x - b.x - 3) * cos(0.5) + (p.y - b.y) * sin(0.5)) <= 10 AND abs((p.y - b.y) * cos(0.5) - (p.x - b.x - 3) * sin(0.5)) <= 6""")
def footprint_members(v: Views) -> DataFrame:
    turned = lambda l, w: F.struct(*(e.alias(a) for a, e in zip("xyz", (F.col("bx") + 3 + l * math.cos(0.5) - w * math.sin(0.5), F.col("by") + l * math.sin(0.5) + w * math.cos(0.5), F.lit(0.0)), strict=True)))
    b = v.boxes().select(F.col("box_id").alias("frame_id"), F.col("x").alias("bx"), F.col("y").alias("by")).withColumn("corners", F.array(turned(-10, -6), turned(10, -6), turned(10, 6), turned(-10, 6)))
    return v.points().join(b, "frame_id").filter(g.in_footprint(F.col("corners"), F.col("x"), F.col("y"))).select("frame_id", "point_idx")


@query("""SELECT frame_id, point_idx FROM v_points WHERE y >= -2 - sqrt(2 * (x*x + 4) - 2 * (x*x + 4) * cos(radians(10)))""")
def chord_members(v: Views) -> DataFrame:
    return v.points().filter(g.beyond_chord(F.col("x"), F.col("y"), F.lit(-2.0))).select("frame_id", "point_idx")


@query("""SELECT doc_id, source, lang FROM documents WHERE lang IN ('en', 'de') AND doc_id::VARCHAR IN ('1', '2', '3', '5', '8', '13', '21', '34', '55')""")
def equality_filters(v: Views) -> DataFrame:
    return metrics.equal_as_text(v.table("documents").select("doc_id", "source", "lang"), {"lang": ["en", "de"], "doc_id": [1, 2, 3, 5, 8, 13, 21, 34, 55], "source": []})


@query("""SELECT page_id, url FROM pages WHERE substr(url, 1, 16) IN (SELECT substr(url, 1, 16) FROM pages WHERE page_id % 7 = 0)""")
def token_prefix(v: Views) -> DataFrame:
    p = v.table("pages")
    return metrics.by_token_prefix(p.select("page_id", "url"), p.filter("page_id % 7 = 0").select(F.col("url").alias("token")), "url", "token")


@query("""SELECT type, count(*) FILTER (n AND o = 0) AS occluded_0, count(*) FILTER (n AND o = 1) AS occluded_1, count(*) FILTER (n AND o = 2) AS occluded_2, count(*) FILTER (n AND o = 3) AS occluded_3
  FROM (SELECT c.type, b.box_id IS NOT NULL AS n, b.box_id % 4 AS o FROM (VALUES ('class0'), ('class1'), ('none')) c(type) LEFT JOIN v_boxes b ON 'class' || (b.label % 3) = c.type) GROUP BY 1""")
def occlusion_histogram(v: Views) -> DataFrame:
    _, labels = _detections(v)
    return metrics.occlusion_histogram(labels, ["class0", "class1", "none"])


@query("""SELECT value, n, round(n / t, 6) AS ratio, round(exp(-n / t), 6) AS weight FROM (SELECT label AS value, count(*) AS n, (SELECT count(*) FROM v_boxes) AS t FROM v_boxes GROUP BY 1)""")
def class_weights(v: Views) -> DataFrame:
    return rounded(metrics.class_weights(v.boxes(), "label"), "ratio", "weight")


@query("""SELECT frame_id, ix, iy, type, round(dx, 6) AS dx, round(dy, 6) AS dy, CASE WHEN s < 5 THEN 0 WHEN s < 20 THEN 1 ELSE 2 END AS level FROM (SELECT *, sqrt(dx*dx + dy*dy) / 0.5 AS s, row_number() OVER (PARTITION BY frame_id, ix, iy ORDER BY n DESC, type) AS r FROM (
  SELECT frame_id, floor(x / 4)::INT AS ix, floor(y / 4)::INT AS iy, 'k' || (point_idx % 3) AS type, count(*) AS n, avg(z) AS dx, avg(intensity) AS dy FROM v_points GROUP BY ALL)) WHERE r = 1""")
def cell_motion(v: Views) -> DataFrame:
    p = v.points().withColumns({"type": F.concat(F.lit("k"), (F.col("point_idx") % 3).cast("string")), "dx": F.col("z"), "dy": F.col("intensity")})
    return rounded(metrics.cell_motion(p, "frame_id", 4.0, 0.5), "dx", "dy")


@query("""SELECT frame_id, point_idx, round(x*cos(0.3) - y*sin(0.3) + 2 - (1*cos(0.3) - 2*sin(0.3)) - x, 6) AS dx, round(x*sin(0.3) + y*cos(0.3) + 5 - (1*sin(0.3) + 2*cos(0.3)) - y, 6) AS dy, 1.5::DOUBLE AS dz FROM v_points""")
def displacement_vectors(v: Views) -> DataFrame:
    pose = lambda yaw, x, y, z: F.array(*map(F.lit, (math.cos(yaw), -math.sin(yaw), 0.0, x, math.sin(yaw), math.cos(yaw), 0.0, y, 0.0, 0.0, 1.0, z, 0.0, 0.0, 0.0, 1.0)))
    d = g.displacement(pose(0.4, 1.0, 2.0, 0.0), pose(0.7, 2.0, 5.0, 1.5), F.col("x"), F.col("y"), F.col("z"))
    return rounded(v.points().withColumn("d", d).select("frame_id", "point_idx", F.col("d.x").alias("dx"), F.col("d.y").alias("dy"), F.col("d.z").alias("dz")), "dx", "dy", "dz")


@query("""SELECT user_id, event_id, round(b * (m - i), 6) + 0.0 AS shift FROM (SELECT *, regr_slope(value, i::DOUBLE) OVER (PARTITION BY user_id) AS b, max(i) OVER (PARTITION BY user_id) AS m FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events))""")
def velocity_shift(v: Views) -> DataFrame:
    newest_first = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    steps = v.table("events").withColumn("k", F.row_number().over(newest_first) - 1).select("user_id", "event_id", "k", F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return rounded(defenses.recentred(steps, ["user_id"]).select("user_id", "event_id", F.col("shift.x").alias("shift")), "shift")


@query("""SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'NaN'::DOUBLE ELSE json_extract_string(props, '$.k')::DOUBLE END AS detection_f1, 'NaN'::DOUBLE AS detection_precision, 'NaN'::DOUBLE AS detection_recall, 'NaN'::DOUBLE AS tpr, 'NaN'::DOUBLE AS fpr FROM events""")
def metric_rows(v: Views) -> DataFrame:
    nested = F.concat(F.lit('{"defense_effectiveness": {"f1": '), F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), F.lit("}}"))
    return reports.metric_rows(v.table("events").select("event_id", nested.alias("summary")), "event_id", "defense_effectiveness")
