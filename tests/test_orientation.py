"""Matching target by target: cases by hand, turned boxes, odd input; detection files."""

import math

import pytest

from framewright.operators import orientation
from framewright.sources import kitti

DET = "frame long, idx int, type string, score double, alpha double, x1 double, y1 double, x2 double, y2 double"
GT = "frame long, idx int, type string, alpha double, x1 double, y1 double, x2 double, y2 double, occluded int, truncated double"
ALL = {"all": (-1, 99, 99.0)}


def curve(spark, dets, gts, **options):
    options = {"levels": ALL, "limits": {"Car": 0.7}} | options
    return orientation.target_curve(spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT), "frame", **options).orderBy("t_idx").collect()


def gt(idx, type="Car", x=0.0, alpha=0.0, occluded=0, frame=1, height=50.0):
    return (frame, idx, type, alpha, x, 0.0, x + 100, height, occluded, 0.0)


def det(idx, score, x=0.0, alpha=0.0, type="Car", frame=1, height=50.0):
    return (frame, idx, type, score, alpha, x, 0.0, x + 100, height)


def test_best_score_gives_thresholds_and_greatest_overlap_counts(spark):
    # by score the shifted detection is right; at its score only it is there, at none is the other needed
    rows = curve(spark, [det(0, 0.9, x=10.0, alpha=math.pi), det(1, 0.5)], [gt(0)])
    assert [(r.threshold, r.tp, r.fp, r.fn) for r in rows] == [(0.9, 1, 0, 0)]
    assert rows[0].aos == pytest.approx(0.0)
    rows = curve(spark, [det(0, 0.9, x=10.0), det(1, 0.5, alpha=math.pi / 2), det(0, 0.4, frame=2)], [gt(0), gt(0, frame=2)])
    assert [(r.threshold, r.tp, r.fp, r.fn) for r in rows] == [(0.9, 1, 0, 1), (0.4, 2, 1, 0)]
    assert [r.aos for r in rows] == pytest.approx([1.0, 1.5 / 3])


def test_areas_neighbours_and_hidden_targets_make_nothing_wrong(spark):
    dets = [det(0, 0.9), det(1, 0.8, x=500.0), det(2, 0.7, x=1000.0), det(3, 0.6, x=1500.0), det(4, 0.95, x=2000.0)]
    gts = [gt(0), gt(1, "dontcare", 500.0), gt(2, "VAN", 1000.0), gt(3, "Car", 1500.0, occluded=3)]
    rows = curve(spark, dets, gts, levels={"some": (25, 1, 0.3)})
    assert [(r.tp, r.fp, r.fn) for r in rows] == [(1, 1, 0)]


def test_low_detections_serve_a_target_without_being_right(spark):
    # served by a detection of another class that is lower than the level's height
    rows = curve(spark, [det(0, 0.9, type="Truck", height=39.0), det(0, 0.5, frame=2)], [gt(0), gt(0, frame=2)], levels={"some": (40, 1, 0.3)})
    assert [(r.threshold, r.tp, r.fp, r.fn) for r in rows] == [(0.5, 1, 0, 0)]


def test_unknown_orientation_leaves_similarity_out(spark):
    for alpha in (None, orientation.NO_ALPHA):
        assert curve(spark, [det(0, 0.9, alpha=alpha)], [gt(0)])[0].aos is None


def test_odd_input(spark):
    assert curve(spark, [], []) == [] and curve(spark, [det(0, 0.9)], []) == [] and curve(spark, [], [gt(0)]) == []
    dets = [det(0, 0.9), det(0, 0.9), det(1, None), (1, 2, None, 0.3, 0.0, None, None, None, None), (None, 0, "Car", 0.9, 0.0, 0.0, 0.0, 100.0, 50.0)]
    gts = [gt(0), (None, 0, "car", 0.0, 0.0, 0.0, 100.0, 50.0, None, None)]
    assert [(r.tp, r.fp, r.fn) for r in curve(spark, dets, gts)] == [(2, 1, 0)] * 2  # one score serves two samples
    table = orientation.target_table(spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT), "frame")
    assert {(r.type, r.level) for r in table.collect()} == {("Car", level) for level in ("Easy", "Moderate", "Hard")}


@pytest.mark.parametrize("metric", ["ground", "space"])
def test_turned_boxes(spark, metric):
    from pyspark.sql import functions as F

    from framewright.functions import geometry as g

    def solid(df, dz):
        c = g.corners_yaw(F.lit(10.0), F.lit(5.0), F.lit(dz), F.lit(4.0), F.lit(2.0), F.lit(1.5), F.lit(0.6))
        return df.withColumn("corners", c)

    dets, gts = solid(spark.createDataFrame([det(0, 0.9)], DET), 0.6), solid(spark.createDataFrame([gt(0)], GT), 0.0)
    rows = orientation.target_curve(dets, gts, "frame", metric, {"Car": 0.7}, levels=ALL).collect()
    assert len(rows) == (1 if metric == "ground" else 0)  # 0.9 of 2.1 in height




def test_detection_files(spark, tmp_path):
    box = "Car -1 -1 0.5 1 2 3 4 1.5 1.6 4 1 2 3 0.1"
    (tmp_path / "000007.txt").write_text(f"{box} 0.75\n\n{box}\nVan 0 0 x 1 2 3 4 1 1 1 1 1 1 0 0.5\n{box} -2.5\n")
    rows = kitti.read_detections(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.frame_id, r.idx, r.type, r.score) for r in rows] == [("000007", 0, "Car", 0.75), ("000007", 1, "Car", -2.5)]
