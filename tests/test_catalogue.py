"""Every registered query of the engine: against its SQL, or that it runs and keeps its invariants."""

import pytest
from conftest import SF

from framewright.plans import catalogue


def rows(frame):
    return sorted(map(tuple, frame[sorted(frame.columns)].astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_without_sql_is_collected_whole(spark, name):
    frame = catalogue.QUERIES[name](spark, SF)
    assert frame.toPandas().columns.tolist() == frame.columns


def test_voxel_test_keeps_the_frame_type(spark):
    from framewright.operators import defenses

    box = "struct<x:double,y:double,z:double,length:double,width:double,height:double,yaw:double>"
    for kind, frame in (("long", 1), ("string", "one")):
        points = spark.createDataFrame([(frame, 10.0, 0.2, 0.2), (frame, 30.0, 0.2, 0.2)], f"frame {kind}, x double, y double, z double")
        boxes = spark.createDataFrame([(frame, 0, (10.0, 0.0, 0.0, 4.0, 4.0, 4.0, 0.0))], f"frame {kind}, idx int, box {box}")
        got = defenses.free_space(points, boxes, "frame", 1.0).collect()
        assert [(r.frame, r.idx) for r in got] == [(frame, 0)] and 0 < got[0].free < 1


def test_matches_count_every_target_once(spark):
    m = catalogue.QUERIES["greedy_match_turned"](spark, SF).toPandas()
    assert m.groupby(["frame", "type"]).n_gt.first().sum() == 500
    assert set(m.dropna().is_tp) <= {True, False}


def polygon_iou(a, b, n=200):
    """Of two boxes of equal height, by counting the points of a fine grid."""
    import numpy as np

    def inside(c, p):
        u, v = c[1] - c[0], c[3] - c[0]
        s, t = (p - c[0]) @ u / (u @ u), (p - c[0]) @ v / (v @ v)
        return (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)

    lo, hi = np.minimum(a.min(0), b.min(0)), np.maximum(a.max(0), b.max(0))
    p = np.stack(np.meshgrid(*(np.linspace(l, h, n) for l, h in zip(lo, hi, strict=True))), -1).reshape(-1, 2)
    one, two = inside(a, p), inside(b, p)
    return (one & two).sum() / (one | two).sum()


def test_turned_overlaps(spark):
    import numpy as np

    from framewright.functions import kernels
    from framewright.operators.matching import as_corners
    from framewright.plans.views import Views

    p, q = (d.toPandas() for d in catalogue._detections(Views(spark, SF), turned=True))
    pc, qc = as_corners(p.corners), as_corners(q.corners)
    got = {(r.frame, r.a_idx, r.b_idx): r.iou for r in catalogue.QUERIES["iou_rotated"](spark, SF).collect()}
    seen = 0
    for i, a in enumerate(pc):
        for j, b in enumerate(qc):
            if p.frame[i] != q.frame[j]:
                continue
            iou = got.get((p.frame[i], p.idx[i], q.idx[j]), 0.0)
            ra, rb = kernels.ring_of(a)[::2], kernels.ring_of(b)[::2]  # top and bottom coincide from above
            height = max(0.0, min(a[:, 2].max(), b[:, 2].max()) - max(a[:, 2].min(), b[:, 2].min()))
            flat = polygon_iou(ra, rb, 80) if height and (ra.max(0) > rb.min(0)).all() and (rb.max(0) > ra.min(0)).all() else 0.0
            shared = flat / (1 + flat) * 16 * height  # two areas of 8
            assert iou == pytest.approx(shared / (24 - shared), abs=0.03)
            seen += iou > 0
    assert seen == len(got) > 40


def sampled(scores, n):
    """Thresholds as the rule has them, one hit after another, in whole numbers."""
    out = []
    for k, s in enumerate(sorted(scores, reverse=True)):
        level = len(out)
        if k + 1 == len(scores) or (2 * k + 3) * 40 >= 2 * level * n:
            out.append(s)
    return out


@pytest.mark.parametrize("n_gt", [1, 7, 39, 40, 41, 100, 333])
def test_curves(spark, n_gt):
    import numpy as np

    from framewright.operators import matching

    rng = np.random.default_rng(n_gt)
    hits, misses = rng.integers(1, n_gt + 1), 60
    scores = np.round(rng.random(hits + misses), 2 if n_gt > 50 else 6).tolist()
    rows = [("f", "c", None, s, bool(k < hits), n_gt, k == 0) for k, s in enumerate(scores)]
    got = matching.curve(spark.createDataFrame(rows, "frame string, type string, level string, score double, is_tp boolean, n_gt int, leads boolean")).orderBy("t_idx").collect()
    cuts = sampled(scores[:hits], n_gt)
    assert [r.threshold for r in got] == cuts and [r.t_idx for r in got] == list(range(len(cuts))) and len(cuts) <= 41
    raw = []
    for r, cut in zip(got, cuts, strict=True):
        tp, fp = sum(s >= cut for s in scores[:hits]), sum(s >= cut for s in scores[hits:])
        assert (r.tp, r.fp, r.n_gt) == (tp, fp, n_gt)
        raw.append(tp / (tp + fp + 1e-9))
    assert [r.precision for r in got] == pytest.approx([max(raw[k:]) for k in range(len(raw))])


def test_matching_against_plain_rules(spark):
    """Random overlaps, equal scores, ignored targets and empty sides."""
    import numpy as np

    from framewright.operators import matching

    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = rng.integers(0, 7, 2)
        iou = np.where(rng.random((n, m)) < 0.6, np.round(rng.random((n, m)), 1), 0.0)
        ignored, score = rng.random(m) < 0.3, np.round(rng.random(n), 1)
        free, want = set(range(m)), {}
        for i in sorted(range(n), key=lambda i: (-score[i], i)):
            good = [j for j in range(m) if iou[i, j] >= 0.4]
            open_ = sorted((j for j in good if j in free and not ignored[j]), key=lambda j: (-iou[i, j], j))
            want[i] = 1 if open_ else -1 if any(ignored[j] for j in good) else 0
            free -= set(open_[:1])
        i, j = np.nonzero(iou)
        order = np.array(sorted(range(n), key=lambda i: (-score[i], i)), dtype=int)
        got = matching.greedy(order, i, j, iou[i, j], ignored, np.full(n, 0.4))
        assert dict(enumerate(got.tolist())) == want


def test_point_jitter_about_a_steady_centre_is_flagged(spark):
    import numpy as np
    from framewright.operators import defenses

    rng, points = np.random.default_rng(0), []
    for scene, size in (("jitter", 0.1), ("still", 0.0)):
        for at in range(6):
            shift = rng.permutation([size, -size] * 24)
            points += [(scene, at, k, 0.3 * (k % 8), 10.0 + float(shift[k]), 1.0 + 0.3 * (k // 8)) for k in range(48)]
    df = spark.createDataFrame(points, "scene string, at int, point_idx int, x double, y double, z double")
    flagged = lambda **o: {(r.scene, r.flagged > 0) for r in defenses.jitter_verdicts(df, "scene", "at", least=5, **o).collect() if r.at == 5}
    assert flagged() == {("jitter", True), ("still", False)}
    assert flagged(both=True) == {("jitter", False), ("still", False)}


def test_whole_sort_ends_with_the_nulls(spark, duck):
    got = [tuple(r) for r in catalogue.QUERIES["nulls_last_sort_whole"](spark, SF).collect()]
    assert got == duck.execute(catalogue.ORACLES["nulls_last_sort_whole"]).fetchall()
    assert len(got) > 200 and got[-1][1] is None and got[0][1] is not None


def test_noise_is_a_function_of_the_row(spark):
    from framewright.operators import perturb
    from framewright.plans.views import Views

    p = Views(spark, SF).points().filter("frame_id < 20")
    a = perturb.inject_noise(p, "frame_id", "point_idx", perturb.PRESETS["helios"], 1).toPandas()
    b = perturb.inject_noise(p.repartition(7, "x"), "frame_id", "point_idx", perturb.PRESETS["helios"], 1).toPandas()
    assert rows(a) == rows(b) and (a.groupby("frame_id").size() == 3).all()


def test_uniform_noise_has_the_stated_deviation(spark):
    from framewright.operators import perturb

    p = spark.range(20_000).selectExpr("id % 2 frame", "id point_idx", "100.0D x", "0.0D y", "0.0D z")
    still = perturb.Noise("uniform", 0.333, 1.0, 0.0, 0.0)
    x = perturb.inject_noise(p, "frame", "point_idx", still, 1).toPandas().x - 100
    assert x.std() == pytest.approx(0.333, rel=0.03) and x.abs().max() <= 0.333 * 3**0.5 and x.abs().max() > 0.55
    boxes = spark.sql("select 0L frame, 0 `order`, struct(99D as x, -1D as y, -1D as z) lo, struct(101D as x, 1D as y, 1D as z) hi, 100D x, 0D y, 'Car' type")
    args = {"frame": "frame", "budget": 1000, "extra": (2.0, 2.0), "noise": perturb.Noise("uniform", 0.333, 0.25, 0.0, 0.0)}
    got = perturb.remove_objects(p, boxes, targets=["Car"], **args).toPandas()
    moved = got[got.n_moved > 0].x - 102
    assert len(got) == 19_250 and len(moved) == 250 and moved.std() == pytest.approx(0.333, rel=0.15)
    assert perturb.remove_objects(p, boxes, targets=["Van"], **args).filter("n_moved > 0").count() == 0


def stream_of(spark, schema, tmp_path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run_to_the_end(frames, tmp_path, seen=None):
    from framewright.streaming.scenes import scene_history

    out = scene_history(frames, "sequence_id", "idx", "x", 5, "ts", idle="1000 days", seen=seen)
    q = out.writeStream.trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    from framewright.plans.views import Views
    from framewright.streaming.scenes import scene_history_batch

    f = Views(spark, SF).frames().selectExpr("sequence_id", "idx", "x", "x + 1 as received", "timestamp(ts) as ts")
    want = scene_history_batch(f, "sequence_id", "idx", "x", 5).toPandas()
    f.filter("idx < 20").coalesce(1).write.parquet(str(tmp_path / "in"))
    run_to_the_end(stream_of(spark, f.schema, tmp_path), tmp_path, seen="received")
    first = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert first.idx.max() == 19
    f.filter("idx >= 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run_to_the_end(stream_of(spark, f.schema, tmp_path), tmp_path, seen="received")  # from the checkpoint's state
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    both = got.merge(first, on=["sequence_id", "idx"], how="inner")
    assert len(both) == len(first) and len(got) == len(want)
    assert (got.seen_sum - got.history_sum).round(6).equals(got.history_size.astype(float)) and (got.seen_previous - got.previous).dropna().round(6).eq(1).all()
    assert rows(got[want.columns].round(6)) == rows(want.round(6))


def test_idle_scenes_leave_the_state(spark, tmp_path):
    import pandas as pd

    from framewright.streaming.scenes import scene_history, scene_history_batch

    days = [("a", 1), ("a", 2), ("b", 2), ("a", 9), ("b", 10), ("b", 11)]
    for k, (scene, day) in enumerate(days):
        spark.createDataFrame(pd.DataFrame({"scene": [scene], "idx": [day], "x": [1.0], "ts": [pd.Timestamp(2024, 1, day)]})).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={k}"))
    schema = "scene string, idx long, x double, ts timestamp"
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = scene_history(files, "scene", "idx", "x", 5, "ts", idle="2 days").writeStream.trigger(availableNow=True).format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    got = {(r.scene, r.idx): r.history_size for r in spark.table("idle").collect()}
    assert got == dict(zip(days, [0, 1, 0, 0, 0, 1], strict=True))
    batch = scene_history_batch(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), "scene", "idx", "x", 5, "ts", "2 days")
    assert {(r.scene, r.idx): r.history_size for r in batch.collect()} == got


def test_shadow_of_a_hole(spark):
    """A bare stretch of ground far away: its pyramids' volume is a third of base times height each, unless an object is in front."""
    import numpy as np

    from framewright.operators import defenses

    x, y = np.meshgrid(np.arange(0.3, 30, 0.6), np.arange(-4.7, 5, 0.6))
    ground = np.stack([x.ravel(), y.ravel(), np.full(x.size, -1.73)], -1)
    hole = (ground[:, 0] > 15) & (ground[:, 0] < 25) & (np.abs(ground[:, 1]) < 3)
    rows_ = [("holed", k, *map(float, p)) for k, p in enumerate(ground[~hole])]
    rows_ += [("shaded", k, *map(float, p)) for k, p in enumerate(ground[~hole])]
    rows_ += [("shaded", 10_000 + k, 4.0, float(py), float(pz)) for k, (py, pz) in enumerate((a, b) for a in np.arange(-1.2, 1.2, 0.1) for b in np.arange(-1.5, 0.0, 0.1))]
    rows_ += [("whole", k, *map(float, p)) for k, p in enumerate(ground)]
    df = spark.createDataFrame(rows_, "frame string, point_idx int, x double, y double, z double")
    got = {r.frame: r for r in defenses.shadow_volume(df, "frame").collect()}
    assert got["whole"].voids == 0 and not got["whole"].detected
    assert got["holed"].voids == 1 and got["holed"].residual > 15 and got["holed"].detected
    assert got["shaded"].residual < 0.3 * got["holed"].residual


def test_point_files_round_trip(spark, tmp_path):
    from framewright.plans.views import Views
    from framewright.sources import pointcloud

    p = Views(spark, SF).points().filter("frame_id < 3").selectExpr("cast(frame_id as string) frame_id", "point_idx", "float(x) x", "float(y) y", "float(z) z", "float(intensity) intensity")
    pointcloud.write_points(p, str(tmp_path / "table"))
    (tmp_path / "bin").mkdir()
    assert pointcloud.export_local(spark, str(tmp_path / "table"), str(tmp_path / "bin")) == 3
    spark.dataSource.register(pointcloud.PointCloudSource)
    for back in (pointcloud.read_points(spark, str(tmp_path / "bin")), spark.read.format("pointcloud").option("path", str(tmp_path / "bin")).load()):
        assert rows(back.toPandas()) == rows(p.toPandas())


def test_kitti_text(spark, tmp_path):
    from framewright.sources import kitti

    (tmp_path / "l").mkdir(), (tmp_path / "c").mkdir()
    (tmp_path / "l/000001.txt").write_text("Car 0.00 0 -1.58 587.0 173.3 614.1 200.1 1.65 1.67 3.64 -0.65 1.71 46.70 -1.59\n\n")
    (tmp_path / "c/000001.txt").write_text("P2: 1 0 0 0 0 1 0 0 0 0 1 0\nR0_rect: 1 0 0 0 1 0 0 0 1\nno colon\nTr_velo_to_cam: 1 0 0 0 0 1 0 0 0 0 1 0\n")
    label = kitti.read_labels(spark, str(tmp_path / "l")).first()
    assert (label.frame_id, label.label_idx, label.type, label.rotation_y) == ("000001", 0, "Car", -1.59)
    calib = kitti.read_calibration(spark, str(tmp_path / "c")).first()
    assert len(calib.p2) == 12 and len(calib.r0_rect) == 9 and len(calib.tr_velo_to_cam) == 12


def test_verdicts_hide_the_truth_and_fail_benign(spark):
    import json

    from framewright.operators import judges

    def answer(verdict, *levels, kind="OBJECT_HIDING"):
        rest = {"affected_region": {"bev": "left"}, "evidence": [], "alternatives_ruled_out": []}
        return json.dumps({"verdict": verdict, "suspected_attacks": [{"attack_type": kind, "confidence": c, **rest} for c in levels]})

    texts = [answer("ATTACK_SUSPECTED", "LOW", "HIGH"), answer("ATTACK_SUSPECTED", "MEDIUM"), answer("ATTACK_SUSPECTED"), answer("UNCERTAIN", "LOW"), answer("BENIGN"), answer("ATTACKED", "HIGH"), answer("ATTACK_SUSPECTED", "SURE"), answer("ATTACK_SUSPECTED", "HIGH", kind="ORA"), "?", None, '{"verdict": "BENIGN"}']
    df = spark.createDataFrame([(k, True, t) for k, t in enumerate(texts)], "id int, is_attacked boolean, answer string")
    assert "is_attacked" not in judges.judge_view(df).columns
    got = [tuple(r) for r in judges.parse_verdict(df, "answer").orderBy("id").select("detected", "error", "confidence").collect()]
    assert got == [(True, False, 1.0), (True, False, 0.66), (True, False, 0.0), (False, False, 0.33), (False, False, 0.0), *[(False, True, 0.0)] * 5, (False, False, 0.0)]
    strict = [r.detected for r in judges.parse_verdict(df, "answer", high_confidence=True).orderBy("id").collect()]
    assert strict == [False, True, *[False] * 9]


def test_judge_is_asked_what_the_cache_lacks(spark):
    from framewright.operators import judges

    frames = spark.createDataFrame([(k, f"q{k}", True) for k in range(6)], "id int, question string, is_attacked boolean")
    cache = spark.createDataFrame([(1, "cached"), (4, "cached")], "id int, answer string")
    got = {r.id: r.answer for r in judges.answers(frames, cache, ["id"], lambda q: q.upper(), "question", per_minute=1000, workers=2).collect()}
    assert got == {0: "Q0", 1: "cached", 2: "Q2", 3: "Q3", 4: "cached", 5: "Q5"}


def test_sweeps_are_gathered_within_their_span(spark):
    import numpy as np

    from framewright.sources import scenes

    rng = np.random.default_rng(4)
    frames, points = [], []
    for scene in "ab":
        for k, ts in enumerate(np.sort(rng.uniform(0, 4, 25)).tolist()):
            pose = [1.0, 0.0, 0.0, float(k), 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0] if k % 5 else None
            frames.append((f"{scene}{k}", scene, ts, pose))
            points.append((f"{scene}{k}", 0, 1.0, 2.0, 3.0, 0.5))
    f = spark.createDataFrame(frames, "frame_id string, sequence_id string, ts double, ego_pose array<double>")
    p = spark.createDataFrame(points, "frame_id string, point_idx int, x double, y double, z double, intensity double")
    got = {(r.frame_id, r.from_frame): (round(r.x, 6), round(r.lag, 6)) for r in scenes.accumulate(f, p, sweeps=3, span=0.5).collect()}
    want = {}
    for into, scene, now, here in frames:
        past = [(ts, name, pose) for name, s, ts, pose in frames if s == scene and now - 0.5 <= ts <= now and (name == into or (pose and here))]
        for ts, name, pose in sorted(past, key=lambda r: (-r[0], r[1]))[:3]:
            want[into, name] = (round(1.0 if name == into else 1.0 + pose[3] - here[3], 6), round(now - ts, 6))
    assert got == want


def test_reports(spark, tmp_path):
    import json

    from framewright.sources import reports

    runs = [{"attack_effectiveness": {"attacked_map": {"Car": {"Easy": 0.5}}}, "detection_rate": {"overall": {"absolute_drop": 0.25}}, "timing_metrics": {"n_frames": 3, "total": {"mean": 1.5}}}, {"defense_effectiveness": {"f1": 0.75, "tpr": None}}]
    s = spark.createDataFrame([(k + 1, json.dumps(r)) for k, r in enumerate(runs)], "budget int, summary string")
    reports.write_reports(s, "budget", "b", str(tmp_path), ["Car"], ["Easy", "Hard"])
    read = lambda kind: spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / f"sweep_b_{kind}")).toPandas()
    ap = read("ap")
    assert ap.columns.tolist() == ["budget", "car_ap_easy", "car_ap_hard"] and ap.car_ap_easy[0] == 0.5 and ap.iloc[1, 1:].isna().all() and ap.car_ap_hard.isna().all()
    assert read("defense_effectiveness").detection_f1[1] == 0.75 and read("detection_rate").absolute_drop[0] == 0.25
    assert read("timing_metrics").columns.tolist() == ["budget", "n_frames", "total_mean", "total_median", "total_std"]
    assert len(reports.KINDS) == 10
    lines = spark.createDataFrame([(1, 0.9, 0.1), (1, 0.1, 0.8), (2, 0.5, 0.5)], "budget int, recall double, precision double")
    got = [json.loads(r.value) for r in spark.createDataFrame([(r,) for r in reports.curves(lines, "budget", "recall").toJSON().collect()], "value string").collect()]
    assert sorted((g["budget"], [p["recall"] for p in g["curves"]]) for g in got) == [(1, [0.1, 0.9]), (2, [0.5])]
    whole = reports.summary(a=spark.range(3).selectExpr("count(*) as n"), b=spark.range(2).selectExpr("max(id) as m")).first()
    assert (whole.a.n, whole.b.m) == (3, 1)
    meta = json.loads(reports.run_metadata(spark, {"budget": 3, "noise": runs, "seed": 1}, "budget", {"preset": runs}).first()[0])
    assert meta["args"] == {"noise": "preset", "seed": 1} and meta["sweep_param"] == "budget"
    named = spark.createDataFrame([("x/ap_budget_20.csv", 1), ("x/ap_budget_100.csv", 2), ("x/none.csv", 3)], "path string, v int")
    assert [r.v for r in reports.by_budget(named, "path").collect()] == [1, 2]


def test_spoofed_counts_and_resume(spark, tmp_path):
    import json

    import numpy as np

    from framewright.sources import reports

    meta = json.dumps({"removed_per_obj": [{"label_type": "Car", "n_removed": 3, "reinjected_centroid": [1, 2, 3]}, {"label_type": "Car", "n_removed": 0}]})
    verdict = json.dumps({"cluster_details": [{"centroid": [1.5, 2, 3]}, {"centroid": [9, 9, 9]}]})
    f = spark.createDataFrame([("r", "f1", True, meta, (True, 1.0, verdict)), ("r", "f2", False, None, (False, 0.0, verdict))], "run string, frame_id string, is_attacked boolean, attack_metadata string, defense_result struct<is_attack_detected: boolean, confidence: double, metadata: string>")
    row = reports.spoofed_summary(f, 1.0).first()
    assert (row.attacked_objects, row.attacked_frames, row.spoofed_clusters, row.missing, row.missing_percent) == (2, 1, 1, 1, 50.0)
    scenes = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("q", "a", 3)], "run string, sequence_id string, x int")
    reports.write_scenes(scenes.filter("run = 'r' and sequence_id = 'a'"), str(tmp_path / "done"))
    left = reports.remaining_scenes(scenes, spark.read.parquet(str(tmp_path / "done")))
    assert sorted(r.x for r in left.collect()) == [2, 3]
    np.save(tmp_path / "ghost.npy", np.arange(8.0).reshape(2, 4))
    assert [tuple(r) for r in reports.read_ghost(spark, str(tmp_path / "ghost.npy")).collect()] == [(0, 1, 2, 3), (4, 5, 6, 7)]


def test_zero_denominators(spark):
    from framewright.operators import metrics

    df = spark.createDataFrame([], "a boolean, p boolean")
    row = metrics.binary_metrics(df, "a", "p").first()
    assert row.tp == 0 and row.f1 == 0.0 and row.accuracy == 0.0
    assert metrics.success_rate(df, "a").count() == 0


def test_a_ghost_is_broadcast_once_not_for_every_frame(spark):
    from framewright.operators import perturb

    cloud = "x double, y double, z double, intensity double"
    points = spark.range(400).selectExpr("id % 50 as frame", "cast(id div 50 as int) as point_idx", "10.0D as x", "cast(id div 50 as double) as y", "0.0D as z", "1.0D as intensity")
    ghost = spark.createDataFrame([(20.0, 0.0, 0.0, 5.0), (20.0, None, 0.0, 6.0), (5.0, 0.0, 0.0, 7.0)], cloud)
    out = perturb.inject_ghost(points, ghost, "frame", 0.05)
    got = out.collect()
    assert len(got) == 50 * (7 + 3) and not [r for r in got if not r.injected and r.point_idx == 0]
    first = sorted((r.point_idx - (1 << 24), r.x, r.y) for r in got if r.injected and r.frame == 7)
    assert first == [(1, 5.0, 0.0), (2, 20.0, 0.0), (3, 20.0, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "frame" not in next(x for x in plan.splitlines() if "Join LeftAnti" in x)


def test_the_least_overlap_of_aligned_boxes_is_kept(spark, duck, tmp_path):
    import duckdb

    boxes = [(0, 0.1, 0.1, 0.1), (1, 0.1 + 4 / 40 - 1e-6, 0.1, 0.1), (2, 0.1, 0.1 + 2 / 40 - 1e-5, 0.1 + 1.5 / 40 - 1e-5), (3, 0.2, 0.1, 0.1)]
    spark.createDataFrame([(k, [float(v) for v in (x, y, z)] + [0.0] * 61, 1) for k, x, y, z in boxes], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("events", "documents", "labels"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    got, want = catalogue.QUERIES["iou_axis_aligned"](spark, str(tmp_path)).toPandas(), con.execute(catalogue.ORACLES["iou_axis_aligned"]).df()
    assert rows(got) == rows(want) and (got.iou == 0).any()


@pytest.mark.parametrize("name", ["chain_association", "icp_sigma", "jitter_verdicts", "shadow_volume", "transport_verdicts"])
def test_no_python_call_for_every_frame_or_scene(spark, name):
    """A call handles a batch of frames, scenes or chains; a call each cost more than the work."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_chains_end_at_a_miss_or_a_small_cluster(spark):
    from framewright.operators import clusters

    rows = [("a", 0, 0, 5, 0.0), ("a", 1, 0, 5, 1.0), ("a", 1, 1, 5, 1.0), ("a", 2, 0, 5, 2.0), ("a", 4, 0, 5, 2.0), ("b", 3, 0, 1, 2.0), ("b", 4, 0, 5, 2.0), ("b", 5, 0, 5, 2.5), ("b", 6, 0, 5, 9.0)]
    frame = spark.createDataFrame([(*r, 0.0, 0.0) for r in rows], "scene string, at int, cluster int, n_points long, x double, y double, z double")
    got = {(r.scene, r.at, r.cluster): [(c.idx, c.cluster) for c in r.chain] for r in clusters.chains(frame, "scene", "at", 3, 1.5, 2).collect()}
    assert len(got) == len(rows)
    assert got["a", 2, 0] == [(2, 0), (1, 0), (0, 0)] and got["a", 1, 1] == [(1, 1), (0, 0)] and got["a", 4, 0] == [(4, 0)]
    assert got["b", 4, 0] == [(4, 0)] and got["b", 5, 0] == [(5, 0), (4, 0)] and got["b", 6, 0] == [(6, 0)] and got["b", 3, 0] == [(3, 0)]
