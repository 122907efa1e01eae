"""Vectors, quaternions (w, x, y, z), poses and similarities as Column expressions over double arrays.

A pose maps world to camera: struct<q: array<double>, t: array<double>>; a similarity has a scale s besides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(*xs) -> Column:
    return F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in xs])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value's expression there once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def let2(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    return let(a, lambda x: let(b, lambda y: body(x, y)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def cross(a: Column, b: Column) -> Column:
    return let2(a, b, lambda a, b: vec(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def angle_between(a: Column, b: Column) -> Column:
    """Angle of two vectors, 0 if either is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.acos(clamp(dot(a, b) / size, -1.0, 1.0))).otherwise(F.lit(0.0))


def triangulation_angle(centre1: Column, centre2: Column, point: Column) -> Column:
    """The smaller of the angle at point and its supplement."""
    angle = angle_between(sub(centre1, point), sub(centre2, point))
    return F.least(angle, F.lit(math.pi) - angle)


def quat_normalized(q: Column) -> Column:
    return let(q, lambda q: let(norm(q), lambda n: F.when(n > 0, scale(q, 1.0 / F.nullif(n, F.lit(0.0)))).otherwise(vec(1, 0, 0, 0))))


def quat_product(a: Column, b: Column) -> Column:
    return let2(a, b, _product)


def _product(a: Column, b: Column) -> Column:
    return vec(
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def quat_conjugate(q: Column) -> Column:
    return let(q, lambda q: vec(q[0], -q[1], -q[2], -q[3]))


def quat_rotate(q: Column, v: Column) -> Column:
    """v turned by q, which is normalised first; the zero quaternion turns nothing."""

    def turned(q: Column, v: Column) -> Column:
        axis = F.slice(q, 2, 3)
        return let(scale(cross(axis, v), F.lit(2.0)), lambda t: add(add(v, scale(t, q[0])), cross(axis, t)))

    return let2(quat_normalized(q), v, turned)


def quat_from_axis_angle(axis: Column, angle: Column) -> Column:
    """The identity for a zero axis."""
    n = norm(axis)
    s = F.sin(angle / 2) / F.nullif(n, F.lit(0.0))
    return F.when(n > 0, vec(F.cos(angle / 2), axis[0] * s, axis[1] * s, axis[2] * s)).otherwise(vec(1, 0, 0, 0))


def quat_from_rotation_vector(v: Column) -> Column:
    return quat_from_axis_angle(v, norm(v))


def quat_to_rotation_vector(q: Column) -> Column:
    """Axis times angle, the angle from 0 to pi."""
    n = quat_normalized(q)
    unit = F.when(n[0] < 0, scale(n, F.lit(-1.0))).otherwise(n)
    s = norm(F.slice(unit, 2, 3))
    factor = F.when(s > 1e-12, 2 * F.atan2(s, unit[0]) / F.nullif(s, F.lit(0.0))).otherwise(F.lit(2.0))
    return scale(F.slice(unit, 2, 3), factor)


def quat_angular_distance(a: Column, b: Column) -> Column:
    return 2 * F.acos(clamp(F.abs(dot(quat_normalized(a), quat_normalized(b))), 0.0, 1.0))


def rotation_matrix(q: Column) -> Column:
    """Nine numbers, row by row."""
    return let(quat_normalized(q), _matrix)


def _matrix(n: Column) -> Column:
    w, x, y, z = (n[i] for i in range(4))
    return vec(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def pose(q: Column, t: Column) -> Column:
    return F.struct(q.alias("q"), t.alias("t"))


def pose_apply(p: Column, point: Column) -> Column:
    return add(quat_rotate(p["q"], point), p["t"])


def pose_inverse(p: Column) -> Column:
    return let2(p, quat_conjugate(p["q"]), lambda p, back: pose(back, scale(quat_rotate(back, p["t"]), F.lit(-1.0))))


def pose_compose(outer: Column, inner: Column) -> Column:
    return let2(outer, inner, lambda a, b: pose(quat_normalized(quat_product(a["q"], b["q"])), pose_apply(a, b["t"])))


def centre(p: Column) -> Column:
    return pose_inverse(p)["t"]


def sim(s: Column, q: Column, t: Column) -> Column:
    return F.struct(s.alias("s"), q.alias("q"), t.alias("t"))


def sim_apply(m: Column, point: Column) -> Column:
    return add(scale(quat_rotate(m["q"], point), m["s"]), m["t"])


def sim_inverse(m: Column) -> Column:
    """Null scale and translation for a scale of zero."""
    k = lambda m: 1.0 / F.nullif(m["s"], F.lit(0.0))
    return let2(m, quat_conjugate(m["q"]), lambda m, back: sim(k(m), back, scale(quat_rotate(back, m["t"]), -k(m))))


def sim_compose(outer: Column, inner: Column) -> Column:
    return let2(outer, inner, lambda a, b: sim(a["s"] * b["s"], quat_normalized(quat_product(a["q"], b["q"])), sim_apply(a, b["t"])))


def sampson_error_sq(f: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared Sampson error of a match under a fundamental matrix of nine numbers; infinite on a zero denominator."""
    a0, a1, a2 = (f[3 * i] * x1 + f[3 * i + 1] * y1 + f[3 * i + 2] for i in range(3))
    b0, b1 = (f[j] * x2 + f[3 + j] * y2 + f[6 + j] for j in range(2))
    top, below = x2 * a0 + y2 * a1 + a2, a0 * a0 + a1 * a1 + b0 * b0 + b1 * b1
    return F.when(below > 0, top * top / below).otherwise(F.lit(float("inf")))


# --- 3 x 3 matrices: nine numbers, row by row


def mat_vec(m: Column, v: Column) -> Column:
    return vec(*[m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3)])


def mat_product(a: Column, b: Column) -> Column:
    return vec(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])


def mat_transpose(m: Column) -> Column:
    return vec(*[m[3 * j + i] for i in range(3) for j in range(3)])


def mat_determinant(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def mat_inverse(m: Column) -> Column:
    """Null for a singular matrix."""
    k = 1.0 / F.nullif(mat_determinant(m), F.lit(0.0))

    def cofactor(i: int, j: int) -> Column:
        a, b, c, d = ((i + 1) % 3, (i + 2) % 3, (j + 1) % 3, (j + 2) % 3)
        return m[3 * a + c] * m[3 * b + d] - m[3 * a + d] * m[3 * b + c]

    return F.when(k.isNotNull(), vec(*[cofactor(j, i) * k for i in range(3) for j in range(3)]))


def skew(v: Column) -> Column:
    """The matrix of the cross product with v."""
    return vec(0, -v[2], v[1], v[2], 0, -v[0], -v[1], v[0], 0)


def quat_from_matrix(m: Column) -> Column:
    """The unit quaternion of a rotation matrix, from the largest of its four squared components."""
    return let(m, _from_matrix)


def _from_matrix(m: Column) -> Column:
    trace = m[0] + m[4] + m[8]
    squares = [1 + trace, 1 + m[0] - m[4] - m[8], 1 - m[0] + m[4] - m[8], 1 - m[0] - m[4] + m[8]]
    r = F.sqrt(F.greatest(*squares))
    k = 0.5 / r
    # sums and differences of opposite entries are four times a product of two components
    wx, wy, wz = m[7] - m[5], m[2] - m[6], m[3] - m[1]
    xy, xz, yz = m[1] + m[3], m[2] + m[6], m[5] + m[7]
    rows = [(r / 2, wx * k, wy * k, wz * k), (wx * k, r / 2, xy * k, xz * k), (wy * k, xy * k, r / 2, yz * k), (wz * k, xz * k, yz * k, r / 2)]
    out = vec(*rows[3])
    for square, row in zip(squares[2::-1], rows[2::-1]):
        out = F.when(square >= F.greatest(*squares), vec(*row)).otherwise(out)
    return quat_normalized(out)


def rotation_angle_between(a: Column, b: Column) -> Column:
    """Angle of the rotation that takes matrix a to matrix b."""
    return F.acos(clamp((dot(a, b) - 1.0) / 2.0, -1.0, 1.0))


def baseline(centre1: Column, centre2: Column) -> Column:
    return norm(sub(centre1, centre2))


def max_triangulation_angle(centres: Column, point: Column) -> Column:
    """The largest triangulation angle over pairs of an array of centres, 0 below two."""
    pairs = F.flatten(F.transform(centres, lambda a: F.transform(centres, lambda b: triangulation_angle(a, b, point))))
    return F.coalesce(F.array_max(pairs), F.lit(0.0))


def sim_transform_pose(m: Column, p: Column) -> Column:
    """A world-to-camera pose after the world has been moved by m; lengths in camera coordinates scale with m."""
    q = quat_normalized(quat_product(p["q"], quat_conjugate(m["q"])))
    return let(q, lambda q: pose(q, sub(scale(p["t"], m["s"]), quat_rotate(q, m["t"]))))


def sim_from_matrix(m: Column) -> Column:
    """The similarity of a 3 x 4 matrix (twelve numbers); its scale is the first column's length."""
    s = norm(vec(m[0], m[4], m[8]))
    k = 1.0 / F.nullif(s, F.lit(0.0))
    return sim(s, quat_from_matrix(vec(*[m[4 * i + j] * k for i in range(3) for j in range(3)])), vec(m[3], m[7], m[11]))


def epipolar_row(a: Column, b: Column) -> Column:
    """Coefficients of the nine numbers of a matrix in b' M a."""
    return vec(*[b[i] * a[j] for i in range(3) for j in range(3)])


def homography_transfer_error_sq(h: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance of (x2, y2) to where h takes (x1, y1); infinite if that isn't a finite point."""
    moved = mat_vec(h, vec(x1, y1, F.lit(1.0)))
    w = F.nullif(moved[2], F.lit(0.0))
    error = F.pow(moved[0] / w - x2, 2) + F.pow(moved[1] / w - y2, 2)
    return F.when(error.isNull() | F.isnan(error), F.lit(float("inf"))).otherwise(error)


def has_positive_depth(p: Column, point: Column) -> Column:
    """Whether a point lies before a camera, whose 3 x 4 matrix is twelve numbers."""
    return p[8] * point[0] + p[9] * point[1] + p[10] * point[2] + p[11] >= 2.220446049250313e-16


def angular_error(p: Column, ray: Column, point: Column) -> Column:
    """Angle between an observation's unit ray and the direction to the point in camera coordinates, pi at the centre."""
    seen = vec(*[p[4 * i] * point[0] + p[4 * i + 1] * point[1] + p[4 * i + 2] * point[2] + p[4 * i + 3] for i in range(3)])
    n = norm(seen)
    return F.when(n > 0, F.acos(clamp(dot(ray, seen) / F.nullif(n, F.lit(0.0)), -1.0, 1.0))).otherwise(F.lit(math.pi))


def two_view_inverted(f: Column, e: Column, h: Column, p: Column, inliers: Column) -> Column:
    """A pair's geometry seen from the other image: transposed, inverted, inlier indices (idx1, idx2) swapped."""
    swapped = F.transform(inliers, lambda x: F.struct(x["idx2"].alias("idx1"), x["idx1"].alias("idx2")))
    return F.struct(mat_transpose(f).alias("f"), mat_transpose(e).alias("e"), mat_inverse(h).alias("h"), pose_inverse(p).alias("pose"), swapped.alias("inliers"))
