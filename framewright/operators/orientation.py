"""Detections judged target by target: difficulty levels, don't-care areas, orientation similarity.

Targets are served in their order in the frame.  A first pass, in which the best score wins, gives the scores at
which recall is sampled; a second one, in which the greatest overlap wins, counts at those scores.  A frame is one
row with its boxes inside, shuffled once; both passes sum over the frames of a batch before anything leaves the
task, so that what is shuffled does not grow with frames times scores.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions.kernels import clip_convex, iou_3d, ring_area, ring_of
from framewright.operators.grouped import running_sums
from framewright.operators.matching import CELL, DIFFICULTY, KITTI_IOU, POINTS, samples

# The class whose targets are neither wanted nor wrong, areas without labels, an unknown orientation.
NEIGHBOURS = {"Car": "Van", "Pedestrian": "Person_sitting", "Cyclist": None}
DONT_CARE = "DontCare"
NO_ALPHA = -10.0

EDGES = ("x1", "y1", "x2", "y2")
NUMBERS = ("score", "alpha", *EDGES, "occluded", "truncated")
METRICS = ("image", "ground", "space")


def image_overlap(a: np.ndarray, b: np.ndarray, of_first: bool = False) -> np.ndarray:
    """Of all image boxes ``x1, y1, x2, y2``: the shared area over the union, or over the first one's area."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    shared = np.where((w > 0) & (h > 0), w * h, 0.0)
    area = lambda v: (v[:, 2] - v[:, 0]) * (v[:, 3] - v[:, 1])
    base = np.broadcast_to(area(a)[:, None], shared.shape) if of_first else area(a)[:, None] + area(b)[None, :] - shared
    return np.divide(shared, base, out=np.zeros_like(shared), where=(shared > 0) & (base > 0))


def ground_iou(a: np.ndarray, b: np.ndarray) -> float:
    one, two = ring_of(a), ring_of(b)
    shared = ring_area(clip_convex(one, two))
    union = ring_area(one) + ring_area(two) - shared
    return float(shared / union) if union > 0 else 0.0


def corner_overlap(a: list[np.ndarray | None], b: list[np.ndarray | None], metric: str) -> np.ndarray:
    """Of all boxes by corners, turned as they may be; boxes without corners overlap nothing."""
    measure, axes = (ground_iou, 2) if metric == "ground" else (iou_3d, 3)
    out = np.zeros((len(a), len(b)))
    hull = lambda c: (c[:, :axes].min(axis=0), c[:, :axes].max(axis=0))
    right = [(j, c, *hull(c)) for j, c in enumerate(b) if c is not None]
    for i, c in enumerate(a):
        if c is None:
            continue
        lo, hi = hull(c)
        for j, d, d_lo, d_hi in right:
            if (lo < d_hi).all() and (d_lo < hi).all():
                out[i, j] = measure(c, d)
    return out


def serve(preference: np.ndarray, near: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the detection that each target gets, or -1; the detections left), for every row of ``usable``.

    Targets take their most preferred near detection that is still free, one after another; of equally preferred
    ones the first.  All rows of ``usable``, one for a score threshold, go through the targets together.
    """
    free = usable.copy()
    partner = np.full((len(usable), near.shape[1]), -1)
    at = np.arange(len(usable))
    for target in np.flatnonzero(near.any(axis=0)):
        open_ = free & near[:, target]
        best = np.where(open_, preference[:, target], -np.inf).argmax(axis=1)
        got = open_[at, best]
        partner[got, target] = best[got]
        free[at[got], best[got]] = False
    return partner, free


class Frame:
    """One frame's detections and targets as arrays, with their overlaps measured once."""

    def __init__(self, rows: pa.StructArray, metric: str):
        is_target = rows.field("is_target").to_numpy(zero_copy_only=False)
        number = {c: rows.field(c).to_numpy(zero_copy_only=False).astype(float) for c in NUMBERS}
        kind = np.array([(t or "").lower() for t in rows.field("type").to_pylist()], dtype=object)
        self.det = {c: v[~is_target] for c, v in number.items()}
        self.gt = {c: v[is_target] for c, v in number.items()}
        self.det_kind, self.gt_kind = kind[~is_target], kind[is_target]
        edges = lambda side: np.stack([side[c] for c in EDGES], axis=1)
        a, b = edges(self.det), edges(self.gt)
        if metric == "image":
            self.overlap = image_overlap(a, b)
            self.in_area = image_overlap(a, b[self.gt_kind == DONT_CARE.lower()], of_first=True)
        else:
            corners = [None if c is None else np.array(c, dtype=float).reshape(-1, 3) for c in rows.field("corners").to_pylist()]
            side = lambda wanted: [c for c, t in zip(corners, is_target.tolist(), strict=True) if t == wanted]
            self.overlap = corner_overlap(side(False), side(True), metric)
            self.in_area = np.zeros((len(a), 0))  # areas without labels have no depth
        self.det_height = np.floor(np.abs(self.det["y1"] - self.det["y2"]))
        self.gt_height = self.gt["y2"] - self.gt["y1"]
        self.unknown_turns = int((np.isnan(self.det["alpha"]) | (self.det["alpha"] == NO_ALPHA)).sum())

    def sides(self, own: str, neighbour: str | None, level: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Detections that count, those too low to count; targets that count, those to be left out."""
        least, occlusion, truncation = level
        low = self.det_height < least
        hard = (self.gt["occluded"] > occlusion) | (self.gt["truncated"] > truncation) | (self.gt_height <= least)
        same = self.gt_kind == own.lower()
        beside = self.gt_kind == neighbour.lower() if neighbour else np.zeros(len(same), dtype=bool)
        return (self.det_kind == own.lower()) & ~low, low, same & ~hard, beside | (same & hard)


def _frames(batches: Iterator[pa.RecordBatch], metric: str) -> Iterator[Frame]:
    for batch in batches:
        boxes = batch.column("boxes")
        for k in range(batch.num_rows):
            yield Frame(boxes[k].values, metric)


def _packed(detections: DataFrame, targets: DataFrame, frame: str, metric: str) -> DataFrame:
    def side(df: DataFrame, is_target: bool) -> DataFrame:
        number = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
        corners = F.flatten(F.transform("corners", lambda p: F.array(p.x, p.y, p.z))) if metric != "image" else F.lit(None).cast("array<double>")
        fields = [F.lit(is_target).alias("is_target"), F.col("idx").cast("int").alias("idx"), F.col("type").cast("string").alias("type")]
        return df.select(F.col(frame).alias("frame"), F.struct(*fields, *(number(c).alias(c) for c in NUMBERS), corners.alias("corners")).alias("box"))

    scored = detections.filter(F.col("score").isNotNull())
    return side(scored, False).unionByName(side(targets, True)).groupBy("frame").agg(F.array_sort(F.collect_list("box")).alias("boxes"))


def target_curve(
    detections: DataFrame, targets: DataFrame, frame: str, metric: str = "image", limits: dict[str, float] = KITTI_IOU,
    neighbours: dict[str, str | None] = NEIGHBOURS, levels: dict[str, tuple[float, float, float]] = DIFFICULTY,
) -> DataFrame:
    """``type, level, t_idx, threshold, tp, fp, fn, recall, precision, aos`` of every class of ``limits``.

    Both sides have ``frame, idx, type, x1, y1, x2, y2`` and ``alpha``, detections a ``score``, targets
    ``occluded`` and ``truncated``; types are compared without case.  ``metric`` says what overlaps: image boxes,
    boxes seen from above, or boxes in space (both by ``corners``).  An overlap has to exceed its class's limit.

    Targets of a neighbouring class, or too low, hidden or cut off for a level, neither count nor make a
    detection wrong.  Nor do detections lower than the level's height, of whatever class, or, for image boxes,
    those that lie in don't-care areas by more than the limit.  ``aos`` weights each right detection by
    ``(1 + cos)/2`` of the angle it is off by; it is null throughout if any detection has no orientation.
    Precision and ``aos`` are the greatest from a sample on.

    Detections without a score are left out; boxes with null edges overlap nothing; null occlusion or truncation
    passes; a null frame is a frame.  A class and level without a right detection has no rows.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}, not {metric!r}")
    variants = [(own, name, neighbours.get(own), limit, level) for own, limit in limits.items() for name, level in levels.items()]
    packed = _packed(detections, targets, frame, metric)

    def by_score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: dict[tuple[str, str, float], int] = defaultdict(int)
        wanted: dict[tuple[str, str], int] = defaultdict(int)
        for f in _frames(batches, metric):
            for own, name, neighbour, limit, level in variants:
                counts, low, valid, left_out = f.sides(own, neighbour, level)
                wanted[own, name] += int(valid.sum())
                near = (f.overlap > limit) & (counts | low)[:, None] & (valid | left_out)[None, :]
                if not near[:, valid].any():
                    continue
                partner = serve(np.broadcast_to(f.det["score"][:, None], near.shape), near, np.ones((1, len(low)), dtype=bool))[0][0]
                right = partner[valid & (partner >= 0)]
                for score in f.det["score"][right[~low[right]]].tolist():
                    hits[own, name, score] += 1
        rows = [(*key, n, 0) for key, n in hits.items()] + [(*key, None, 0, n) for key, n in wanted.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("type", "level", "score", "hit", "n"), r, strict=True)) for r in rows], SCORES)

    def by_overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, int, float], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts: dict[tuple[str, str], list[tuple[int, float]]] = defaultdict(list)
            for cut in batch.column("cuts")[0].as_py():
                cuts[cut["type"], cut["level"]].append((cut["t_idx"], cut["score"]))
            for f in _frames(iter([batch]), metric):
                for own, name, neighbour, limit, level in variants:
                    if not cuts[own, name]:
                        continue
                    counts, low, valid, left_out = f.sides(own, neighbour, level)
                    usable = f.det["score"][None, :] >= np.array([s for _, s in cuts[own, name]])[:, None]
                    near = (f.overlap > limit) & (counts | low)[:, None] & (valid | left_out)[None, :]
                    # low detections come after all others, in their order
                    partner, free = serve(np.where(low[:, None], -1.0, f.overlap), near, usable)
                    partner = partner[:, valid]
                    got = partner >= 0
                    right = got & ~np.append(low, False)[partner]
                    turn = f.gt["alpha"][valid][None, :] - np.append(f.det["alpha"], 0.0)[partner]
                    stuffed = (f.in_area > limit).any(axis=1)
                    wrong = free & (counts & ~stuffed)[None, :]
                    similar = np.where(right, (1 + np.cos(turn)) / 2, 0.0)
                    unknown = np.full(len(usable), f.unknown_turns)
                    found = np.stack([right.sum(1), wrong.sum(1), (~got).sum(1), similar.sum(1), unknown], axis=1)
                    for (t_idx, score), row in zip(cuts[own, name], found, strict=True):
                        key = own, name, t_idx, score
                        sums[key] = sums[key] + row if key in sums else row
        names = ("type", "level", "t_idx", "threshold", "tp", "fp", "fn", "similarity", "unknown")
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*k, *v.tolist()), strict=True)) for k, v in sums.items()], COUNTS)

    stats = packed.mapInArrow(by_score, "type string, level string, score double, hit long, n long").groupBy(F.struct("type", "level").alias("part"), "score").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    whole = stats.groupBy("part").agg(F.sum("n").alias("n_gt"), F.sum("hit").alias("hits")).filter("hits > 0")
    ranked = running_sums(stats.filter("hit > 0"), "part", "score", {"tp": "hit"}, CELL).join(whole, "part")
    cut = F.struct("part.type", "part.level", "t_idx", "score")
    cuts = ranked.withColumn("t_idx", F.explode(samples())).agg(F.array_sort(F.collect_list(cut)).alias("cuts"))  # one row of at most 41 scores a variant
    counted = packed.crossJoin(F.broadcast(cuts)).mapInArrow(by_overlap, "type string, level string, t_idx int, threshold double, tp double, fp double, fn double, similarity double, unknown double")
    rows = counted.groupBy("type", "level", "t_idx", "threshold").agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "unknown")), F.sum("similarity").alias("similarity"))
    behind = W.partitionBy("type", "level").orderBy("t_idx").rowsBetween(0, W.unboundedFollowing)
    share = lambda c: F.max(F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))).over(behind)
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return rows.select("type", "level", "t_idx", "threshold", "tp", "fp", "fn", recall.alias("recall"), share("tp").alias("precision"), F.when(F.col("unknown") == 0, share("similarity")).alias("aos"))


SCORES = pa.schema([("type", pa.string()), ("level", pa.string()), ("score", pa.float64()), ("hit", pa.int64()), ("n", pa.int64())])
COUNTS = pa.schema([("type", pa.string()), ("level", pa.string()), ("t_idx", pa.int32()), ("threshold", pa.float64()), *((c, pa.float64()) for c in ("tp", "fp", "fn", "similarity", "unknown"))])


def target_table(detections: DataFrame, targets: DataFrame, frame: str, metric: str = "image", limits: dict[str, float] = KITTI_IOU, **options) -> DataFrame:
    """``type, level, ap, aos``: means of the 41 samples, missing ones as 0, of the classes that were detected.

    A class counts as detected if a detection of it has an image box that does not begin left of the image (for
    the other metrics, corners).  ``aos`` is null if some detection has no orientation.
    """
    levels = list(options.get("levels", DIFFICULTY))
    there = (F.col("x1") >= 0) if metric == "image" else F.col("corners").isNotNull()
    found = detections.filter(there & F.col("score").isNotNull()).select(F.lower("type").alias("key")).distinct()
    turned = detections.filter(F.col("score").isNotNull()).agg((F.count_if(F.col("alpha").isNull() | (F.col("alpha") == NO_ALPHA)) == 0).alias("turned"))
    curve = target_curve(detections, targets, frame, metric, limits, **options).groupBy("type", "level").agg((F.sum("precision") / POINTS).alias("ap"), (F.sum("aos") / POINTS).alias("aos"))
    spelled = F.create_map(*(F.lit(x) for c in limits for x in (c.lower(), c)))
    classes = found.select(spelled[F.col("key")].alias("type")).filter("type is not null").withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    rows = classes.join(curve, ["type", "level"], "left").crossJoin(F.broadcast(turned))
    return rows.select("type", "level", F.coalesce("ap", F.lit(0.0)).alias("ap"), F.when(F.col("turned"), F.coalesce("aos", F.lit(0.0))).alias("aos"))


__all__ = ["target_curve", "target_table", "serve", "image_overlap", "corner_overlap"]
