"""Fixture views: the driver's tables seen as frames, points, boxes and verdicts.  Thresholds are arbitrary
constants of the fixtures and say nothing about any detector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators import metrics, temporal


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def frames(self) -> DataFrame:
        e = self.table("events").select(F.col("user_id").alias("sequence_id"), F.col("event_id").alias("frame_id"), "ts", F.col("value").alias("x"), F.col("event_type").alias("class"))
        scene = W.partitionBy("sequence_id")
        return e.withColumns({"idx": (F.row_number().over(scene.orderBy("ts", "frame_id")) - 1).cast("long"), "scene_length": F.count("*").over(scene), "secs": F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6})

    def plan(self) -> DataFrame:
        scenes = temporal.scene_lengths(self.table("events").withColumnRenamed("user_id", "sequence_id"), "sequence_id")
        return temporal.scene_plan(scenes, F.col("sequence_id") % 2 == 0, 6 + F.col("sequence_id") % 7, 12)

    def verdicts(self) -> DataFrame:
        # a scene's plan is one small row, but scenes grow with the data: the optimiser picks the join
        joined = self.frames().join(self.plan().drop("scene_length"), "sequence_id")
        return joined.withColumns({"is_attacked": F.col("attack") & (F.col("idx") >= F.coalesce("attack_start_index", F.lit(0))), "detected": F.col("x") > 60})

    def outcomes(self) -> DataFrame:
        return self.verdicts().withColumn("attack_successful", F.when(F.col("is_attacked"), F.col("frame_id") % 3 != 0))

    def points(self) -> DataFrame:
        e = self.table("embeddings")
        rows = e.select(F.col("vec_id").alias("frame_id"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("point_idx"), "embedding")
        at = lambda k: F.col("embedding")[4 * F.col("point_idx") + k].cast("double")
        return rows.select("frame_id", "point_idx", (at(0) * 40).alias("x"), (at(1) * 40).alias("y"), (at(2) * 40).alias("z"), at(3).alias("intensity"))

    def boxes(self) -> DataFrame:
        e = self.table("embeddings")
        c = {a: F.col("embedding")[k].cast("double") * 40 for k, a in enumerate("xyz")}
        half = {"x": 2.0, "y": 1.0, "z": 0.75}
        side = lambda sign: F.struct(*((c[a] + sign * half[a]).alias(a) for a in "xyz"))
        return e.select(
            F.col("vec_id").alias("box_id"), "label", F.pmod(F.col("vec_id") * 37, F.lit(100)).cast("double").alias("score100"), *(c[a].alias(a) for a in "xyz"),
            F.lit(4.0).alias("length"), F.lit(2.0).alias("width"), F.lit(1.5).alias("height"), side(-1).alias("lo"), side(1).alias("hi"),
        ).withColumn("score", F.col("score100") / 100).drop("score100")

    def strata(self) -> DataFrame:
        d = self.table("documents").select("doc_id", "source", "lang", "text")
        return d.withColumn("stratum", metrics.keyword_stratum(F.col("text"), {"alpha": ["the "], "beta": ["que "], "gamma": ["und "]})).drop("text")

    def labelled(self) -> DataFrame:
        return self.table("labels").select("doc_id", (F.col("quality") == 1).alias("actual"), (F.col("toxic") == 0).alias("predicted"))


SQL = """
v_frames AS (SELECT user_id AS sequence_id, event_id AS frame_id, ts, value AS x, event_type AS class,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS scene_length, epoch_us(ts) / 1000000.0 AS secs FROM events),
v_plan AS (SELECT user_id AS sequence_id, count(*) AS scene_length, (user_id % 2 = 0) AND count(*) >= 12 AS attack,
  CASE WHEN (user_id % 2 = 0) AND count(*) >= 12 THEN 6 + user_id % 7 END AS attack_start_index FROM events GROUP BY user_id),
v_verdict AS (SELECT f.*, p.attack, p.attack_start_index, p.attack AND f.idx >= p.attack_start_index AS is_attacked, f.x > 60 AS detected FROM v_frames f JOIN v_plan p USING (sequence_id)),
v_success AS (SELECT *, CASE WHEN is_attacked THEN frame_id % 3 <> 0 END AS attack_successful FROM v_verdict),
v_points AS (SELECT vec_id AS frame_id, CAST(i AS INTEGER) AS point_idx, embedding[4*i+1]::DOUBLE*40 AS x, embedding[4*i+2]::DOUBLE*40 AS y, embedding[4*i+3]::DOUBLE*40 AS z, embedding[4*i+4]::DOUBLE AS intensity
  FROM embeddings, range(16) t(i)),
v_boxes AS (SELECT vec_id AS box_id, label, ((vec_id*37)%100)::DOUBLE/100 AS score, embedding[1]::DOUBLE*40 AS x, embedding[2]::DOUBLE*40 AS y, embedding[3]::DOUBLE*40 AS z, 4.0 AS length, 2.0 AS width, 1.5 AS height FROM embeddings),
v_strata AS (SELECT doc_id, source, lang, CASE WHEN lower(text) LIKE '%the %' THEN 'alpha' WHEN lower(text) LIKE '%que %' THEN 'beta' WHEN lower(text) LIKE '%und %' THEN 'gamma' ELSE 'other' END AS stratum FROM documents),
v_binary AS (SELECT doc_id, quality = 1 AS actual, toxic = 0 AS predicted FROM labels)
"""


def oracle(body: str) -> str:
    """The views, then the body; a body that starts with a comma adds views of its own."""
    return f"WITH {SQL.strip()}\n{body.strip()}"
