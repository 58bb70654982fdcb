"""Geometry as column expressions: whole-stage code, no Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.numeric import clip, let

POINT = "struct<x: double, y: double, z: double>"


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def corners_yaw(x: Column, y: Column, z: Column, length: Column, width: Column, height: Column, yaw: Column) -> Column:
    """Eight corners about a centre, turned about the z axis: first the bottom four, then the top four."""
    signs = [(1, 1), (1, -1), (-1, -1), (-1, 1)]
    out = []
    for up in (-0.5, 0.5):
        for sx, sy in signs:
            dx, dy = length * (sx / 2), width * (sy / 2)
            out.append(point(x + dx * F.cos(yaw) - dy * F.sin(yaw), y + dx * F.sin(yaw) + dy * F.cos(yaw), z + height * up))
    return F.array(*out)


def corners_camera(x: Column, y: Column, z: Column, length: Column, width: Column, height: Column, turn: Column) -> Column:
    """Eight corners in a camera frame: turned about y, the origin at the bottom's centre, y downwards."""
    out = []
    for up in (0.0, -1.0):
        for sx, sz in [(1, 1), (1, -1), (-1, -1), (-1, 1)]:
            dx, dz = length * (sx / 2), width * (sz / 2)
            out.append(point(x + dx * F.cos(turn) + dz * F.sin(turn), y + height * up, z - dx * F.sin(turn) + dz * F.cos(turn)))
    return F.array(*out)


def affine(m: Column, x: Column, y: Column, z: Column) -> Column:
    """A point moved by the upper three rows of a row-major 4x4 (or 3x4) matrix column."""
    row = lambda r: m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + m[4 * r + 3]
    return point(row(0), row(1), row(2))


def matmul4(a: Column, b: Column) -> Column:
    return F.array(*(sum((a[4 * r + k] * b[4 * k + c] for k in range(1, 4)), a[4 * r] * b[c]) for r in range(4) for c in range(4)))


def rigid_inverse(m: Column) -> Column:
    """Of a 4x4 rotation and translation: the transpose and the turned-back translation."""
    shift = lambda r: -(m[r] * m[3] + m[4 + r] * m[7] + m[8 + r] * m[11])
    rows = [x for r in range(3) for x in (m[r], m[4 + r], m[8 + r], shift(r))]
    return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def quaternion_matrix(w: Column, x: Column, y: Column, z: Column, tx: Column, ty: Column, tz: Column) -> Column:
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), tx,
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), ty,
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y), tz,
        zero, zero, zero, one,
    )


def yaw_of(m: Column) -> Column:
    """Heading of the x axis after a matrix, flattened to the ground."""
    return F.atan2(m[4], m[0])


def project(p: Column, x: Column, y: Column, z: Column) -> Column:
    """Pixel (u, v) and depth by a 3x4 matrix; null pixels where the depth is 0."""
    image = affine(p, x, y, z)
    return F.struct(F.try_divide(image.x, image.z).alias("u"), F.try_divide(image.y, image.z).alias("v"), image.z.alias("depth"))


def in_view(pixel: Column, width: Column, height: Column) -> Column:
    """In front of the camera and on its image; passes where the image or the matrix is unknown."""
    inside = (pixel.depth > 0) & (pixel.u >= 0) & (pixel.u < width) & (pixel.v >= 0) & (pixel.v < height)
    return F.when(width.isNull() | height.isNull() | pixel.depth.isNull(), True).otherwise(F.coalesce(inside, F.lit(False)))


def radius(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def spherical(x: Column, y: Column, z: Column) -> Column:
    """r, polar angle from the z axis, azimuth; the polar angle of the origin is null."""
    r = radius(x, y, z)
    return F.struct(r.alias("r"), F.acos(clip(F.try_divide(z, r), -1.0, 1.0)).alias("theta"), F.atan2(y, x).alias("phi"))


def beam(x: Column, y: Column, z: Column) -> Column:
    return F.struct(F.atan2(y, x).alias("az"), F.atan2(z, F.hypot(x, y)).alias("el"))


def unit_ray(x: Column, y: Column, z: Column) -> Column:
    r = radius(x, y, z)
    n = F.when(r == 0, F.lit(1.0)).otherwise(r)
    return point(x / n, y / n, z / n)


def turn_clockwise(x: Column, y: Column) -> Column:
    return F.struct(y.alias("x"), (-x).alias("y"))


def cross(a: Column, b: Column) -> Column:
    return point(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def dot(a: Column, b: Column) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def basis(ray: Column, near_up: float = 0.999) -> Column:
    """Two unit vectors across a unit ray; beside x where the ray is nearly upright."""
    return let(_beside(ray, near_up), lambda u: F.struct(u.alias("u"), cross(ray, u).alias("v")))


def _beside(ray: Column, near_up: float) -> Column:
    up = F.when(F.abs(ray.z) > near_up, point(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(point(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    return let(cross(ray, up), lambda s: unit_ray(s.x, s.y, s.z))


def in_box(x: Column, y: Column, z: Column, lo: Column, hi: Column) -> Column:
    return x.between(lo.x, hi.x) & y.between(lo.y, hi.y) & z.between(lo.z, hi.z)


def local(x: Column, y: Column, z: Column, b: Column) -> Column:
    """A point in a box's own axes; ``b`` has x, y, z and yaw."""
    dx, dy = x - b.x, y - b.y
    return point(dx * F.cos(b.yaw) + dy * F.sin(b.yaw), dy * F.cos(b.yaw) - dx * F.sin(b.yaw), z - b.z)


def in_oriented_box(x: Column, y: Column, z: Column, b: Column) -> Column:
    p = local(x, y, z, b)
    return (F.abs(p.x) <= b.length / 2) & (F.abs(p.y) <= b.width / 2) & (F.abs(p.z) <= b.height / 2)


def in_pyramid(x: Column, y: Column, z: Column, apex: Column, base: Column, half: float) -> Column:
    """Strictly inside the pyramid from ``apex`` whose square base of half side ``half`` is about ``base``."""
    way = point(base.x - apex.x, base.y - apex.y, base.z - apex.z)
    p = point(x - apex.x, y - apex.y, z - apex.z)

    def inside(way: Column, ray: Column, u: Column, v: Column) -> Column:
        depth, t = radius(way.x, way.y, way.z), dot(p, ray)
        edge = half * t / F.nullif(depth, F.lit(0.0))
        return F.coalesce((t > 0) & (t < depth) & (F.abs(dot(p, u)) < edge) & (F.abs(dot(p, v)) < edge), F.lit(False))

    return let(way, lambda w: let(unit_ray(w.x, w.y, w.z), lambda r: let(_beside(r, 0.999), lambda u: inside(w, r, u, cross(r, u)))))


def ray_class(x: Column, y: Column, z: Column, b: Column) -> Column:
    """Where a point lies on its beam from the sensor with respect to a box: front, in, behind or miss."""
    o, p = local(F.lit(0.0), F.lit(0.0), F.lit(0.0), b), local(x, y, z, b)
    enters, leaves, parallel_miss = [], [], F.lit(False)
    for axis, half in (("x", b.length / 2), ("y", b.width / 2), ("z", b.height / 2)):
        start, way = o[axis], p[axis] - o[axis]
        flat = F.abs(way) < 1e-12
        t1, t2 = F.try_divide(-half - start, way), F.try_divide(half - start, way)
        enters.append(F.when(flat, F.lit(float("-inf"))).otherwise(F.least(t1, t2)))
        leaves.append(F.when(flat, F.lit(float("inf"))).otherwise(F.greatest(t1, t2)))
        parallel_miss = parallel_miss | (flat & (F.abs(start) > half))
    enter, leave = F.greatest(*enters), F.least(*leaves)
    return F.when(parallel_miss | (enter > leave) | (leave < 0), "miss").when(enter > 1, "front").when(leave < 1, "behind").otherwise("in")


def segment_hits_box(x: Column, y: Column, z: Column, lo: Column, hi: Column) -> Column:
    """Whether the open segment from the sensor to a point passes an axis-aligned box."""
    enters, leaves, miss = [], [], F.lit(False)
    for c, a, b in ((x, lo.x, hi.x), (y, lo.y, hi.y), (z, lo.z, hi.z)):
        t1, t2 = F.try_divide(a, c), F.try_divide(b, c)
        enters.append(F.coalesce(F.least(t1, t2), F.lit(float("-inf"))))
        leaves.append(F.coalesce(F.greatest(t1, t2), F.lit(float("inf"))))
        miss = miss | ((c == 0) & ((a > 0) | (b < 0)))
    return ~miss & (F.greatest(*enters, F.lit(0.0)) <= F.least(*leaves)) & (F.greatest(*enters) < 1) & (F.least(*leaves) > 0)


def aligned_iou(a: Column, b: Column) -> Column:
    """Intersection over union of axis-aligned boxes with centre x, y, z and length, width, height."""
    sides = [("x", "length"), ("y", "width"), ("z", "height")]
    overlap = F.lit(1.0)
    for c, s in sides:
        gap = (a[s] + b[s]) / 2 - F.abs(a[c] - b[c])  # nothing but the distance is rounded: 4 - |d| for two sides of 4
        overlap = overlap * F.greatest(F.lit(0.0), F.when(F.isnan(gap), gap).otherwise(F.least(a[s], b[s], gap)))
    volume = lambda v: v.length * v.width * v.height
    return F.coalesce(F.try_divide(overlap, volume(a) + volume(b) - overlap), F.lit(0.0))


def overlap_2d(a: Column, b: Column, criterion: str = "union") -> Column:
    """Of image boxes x1, y1, x2, y2: shared area over the union or over one of them."""
    w = F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    h = F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    area = lambda v: (v.x2 - v.x1) * (v.y2 - v.y1)
    base = {"union": area(a) + area(b) - w * h, "first": area(a), "second": area(b)}[criterion]
    return F.coalesce(F.try_divide(w * h, base), F.lit(0.0))


def in_halfspaces(x: Column, y: Column, z: Column, faces: Column) -> Column:
    """Inside a convex body given by faces (nx, ny, nz, d): n.p <= d for all."""
    return F.forall(faces, lambda f: f.nx * x + f.ny * y + f.nz * z <= f.d)


def in_footprint(corners: Column, x: Column, y: Column) -> Column:
    """Inside the footprint that the edges from the first corner to the second and to the fourth span."""
    a, b, d = (F.get(corners, F.lit(k)) for k in (0, 1, 3))

    def along(end: Column) -> Column:
        ex, ey = end.x - a.x, end.y - a.y
        return (ex * (x - a.x) + ey * (y - a.y)).between(0, ex * ex + ey * ey)

    return along(b) & along(d)


def beyond_chord(x: Column, y: Column, start_y: Column, angle_deg: float = 10.0) -> Column:
    """y not further below ``start_y`` than the chord of an angle at the radius of (x, start_y)."""
    squared = x * x + start_y * start_y
    return y >= start_y - F.sqrt(2 * squared - 2 * squared * math.cos(math.radians(angle_deg)))


def displacement(m_now: Column, m_next: Column, x: Column, y: Column, z: Column) -> Column:
    """How a point moves with a box between two poses (row-major 4x4), turned by the turn between them."""
    turning = lambda m: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.when((k % 4 == 3) & (k < 12), F.lit(0.0)).otherwise(F.get(m, k)))

    def moved(t: Column) -> Column:
        gone = affine(t, x - F.get(m_now, F.lit(3)), y - F.get(m_now, F.lit(7)), z - F.get(m_now, F.lit(11)))
        return let(gone, lambda p: point(p.x + F.get(m_next, F.lit(3)) - x, p.y + F.get(m_next, F.lit(7)) - y, p.z + F.get(m_next, F.lit(11)) - z))

    back = let(turning(m_now), rigid_inverse)
    return let(let(F.struct(back.alias("a"), turning(m_next).alias("b")), lambda s: matmul4(s.a, s.b)), moved)


def polygon_area(ring: Column) -> Column:
    """Shoelace over an ordered ring of (x, y)."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: ring[i].x * ring[(i + 1) % n].y - ring[(i + 1) % n].x * ring[i].y)
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def bev_ring(corners: Column) -> Column:
    """All corners seen from above, by angle about their mean."""
    n = F.size(corners)
    cx = F.aggregate(corners, F.lit(0.0), lambda s, p: s + p.x) / n
    cy = F.aggregate(corners, F.lit(0.0), lambda s, p: s + p.y) / n
    turned = F.transform(corners, lambda p: F.struct(F.atan2(p.y - cy, p.x - cx).alias("angle"), p.x.alias("x"), p.y.alias("y")))
    return F.array_sort(turned)


def degrees(value: float) -> float:
    return value * math.pi / 180
