"""Scenes of the nuScenes layout from its metadata tables: plain joins instead of walking linked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions import geometry as g

# Annotation categories by detection class; others are not kept.
CLASSES = {
    "vehicle.car": "car", "vehicle.truck": "truck", "vehicle.bus.bendy": "bus", "vehicle.bus.rigid": "bus",
    "vehicle.motorcycle": "motorcycle", "vehicle.bicycle": "bicycle", "vehicle.trailer": "trailer",
    "vehicle.construction": "construction_vehicle", "human.pedestrian.adult": "pedestrian",
    "human.pedestrian.child": "pedestrian", "human.pedestrian.wheelchair": "pedestrian",
    "human.pedestrian.stroller": "pedestrian", "human.pedestrian.personal_mobility": "pedestrian",
    "human.pedestrian.police_officer": "pedestrian", "human.pedestrian.construction_worker": "pedestrian",
    "movable_object.barrier": "barrier", "movable_object.trafficcone": "traffic_cone",
    "movable_object.pushable_pullable": "traffic_cone", "movable_object.debris": "traffic_cone",
}


def frames(sweeps: DataFrame, samples: DataFrame, scenes: DataFrame, key_frames_only: bool = False, scene_names: list[str] | None = None) -> DataFrame:
    """``frame_id, sequence_id, ts, frame_index_in_scene, scene_length, is_keyframe`` in time order.

    ``sweeps``: token, sample_token, timestamp (microseconds), is_key_frame; ``samples``: token,
    scene_token; ``scenes``: token, name.  Scenes are limited before anything else is read for them.
    """
    picked = scenes if scene_names is None else scenes.filter(F.col("name").isin(scene_names))
    s = samples.join(picked.select(F.col("token").alias("scene_token"), F.col("name").alias("sequence_id")), "scene_token").select(F.col("token").alias("sample_token"), "sequence_id")
    rows = sweeps.join(s, "sample_token").select(F.col("token").alias("frame_id"), "sequence_id", (F.col("timestamp") / 1e6).alias("ts"), F.col("is_key_frame").alias("is_keyframe"), "sample_token")
    if key_frames_only:
        rows = rows.filter("is_keyframe")
    scene = W.partitionBy("sequence_id")
    return rows.withColumns({"frame_index_in_scene": F.row_number().over(scene.orderBy("ts", "frame_id")) - 1, "scene_length": F.count("*").over(scene)})


def labels(annotations: DataFrame, frames: DataFrame) -> DataFrame:
    """Annotations of key frames in the sensor's frame; categories without a class go.

    ``annotations``: sample_token, category, translation, size (w, l, h) and rotation (w, x, y, z) arrays;
    ``frames`` also has ``ego_pose`` and ``sensor_to_ego`` as row-major 4x4 arrays.
    """
    named = F.create_map(*(F.lit(v) for pair in CLASSES.items() for v in pair))
    known = annotations.withColumn("type", named[F.col("category")]).filter(F.col("type").isNotNull())
    t, q, s = F.col("translation"), F.col("rotation"), F.col("size")
    pose = g.quaternion_matrix(q[0], q[1], q[2], q[3], t[0], t[1], t[2])
    rows = known.join(frames.filter("is_keyframe"), "sample_token").withColumn("m", g.matmul4(g.rigid_inverse(g.matmul4(F.col("ego_pose"), F.col("sensor_to_ego"))), pose))
    m = F.col("m")
    box = {"x": m[3], "y": m[7], "z": m[11], "length": s[1], "width": s[0], "height": s[2], "yaw": g.yaw_of(m)}
    out = rows.withColumns(box).select("frame_id", "type", *box)
    return out.withColumn("corners", g.corners_yaw(*(F.col(c) for c in ("x", "y", "z", "length", "width", "height", "yaw"))))


def accumulate(frames: DataFrame, points: DataFrame, sweeps: int = 10, span: float = 0.5) -> DataFrame:
    """Points of up to ``sweeps`` frames within ``span`` seconds, moved into the newest frame, with their lag.

    Earlier frames without a pose are skipped; the frame's own points have lag 0.  Frames meet by scene and
    time cell: an earlier frame within ``span`` is in the newest one's cell or the one before.
    """
    cell = F.floor(F.col("ts") / span)
    now = frames.select(F.col("frame_id").alias("into"), "sequence_id", F.col("ts").alias("now"), F.col("ego_pose").alias("here"), cell.alias("cell"))
    past = frames.select("frame_id", F.col("sequence_id").alias("_s"), "ts", "ego_pose", F.explode(F.array(cell, cell + 1)).alias("_c"))
    pairs = now.join(past, (F.col("sequence_id") == F.col("_s")) & (F.col("cell") == F.col("_c")) & (F.col("ts") <= F.col("now")) & (F.col("ts") >= F.col("now") - span)).filter((F.col("frame_id") == F.col("into")) | (F.col("ego_pose").isNotNull() & F.col("here").isNotNull()))
    rank = F.row_number().over(W.partitionBy("into").orderBy(F.desc("ts"), "frame_id"))
    chosen = pairs.withColumn("_n", rank).filter(F.col("_n") <= sweeps)
    move = F.when(F.col("frame_id") != F.col("into"), g.matmul4(g.rigid_inverse(F.col("here")), F.col("ego_pose")))
    steps = chosen.select("into", "frame_id", move.alias("m"), (F.col("now") - F.col("ts")).alias("lag"))
    p = points.join(steps, "frame_id")
    xyz = [F.col(a).cast("double") for a in "xyz"]
    moved = F.when(F.col("m").isNull(), g.point(*xyz)).otherwise(g.affine(F.col("m"), *xyz))
    return p.withColumn("_p", moved).select(F.col("into").alias("frame_id"), F.col("frame_id").alias("from_frame"), "point_idx", *(F.col(f"_p.{a}").alias(a) for a in "xyz"), "intensity", "lag")
