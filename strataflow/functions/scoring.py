"""Robust losses and the priors of view selection and depth fusion, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least slope of a loss, so that a residual never loses all weight.
LEAST_SLOPE = 2.2250738585072014e-308


def emission(cost: Column, sigma: float) -> Column:
    """Density of a matching cost in [0, 2] for a visible pixel: a half-normal, cut off at 2."""
    norm = 2.0 / (math.sqrt(2.0 * math.pi) * sigma * math.erf(2.0 / (sigma * math.sqrt(2.0))))
    return norm * F.exp(-cost * cost / (2.0 * sigma * sigma))


def visibility_probability(cost: Column, sigma: float) -> Column:
    e = emission(cost, sigma)
    return e / (e + 0.5)


def triangulation_prior(cosine: Column, least_angle: float) -> Column:
    """1 for angles of least_angle (radians) and more, falling to 0 at angle 0."""
    edge = math.cos(least_angle)
    s = 1.0 - (1.0 - cosine) / (1.0 - edge)
    return F.when(cosine > edge, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - s * s))).otherwise(1.0)


def incident_prior(cosine: Column, sigma: float) -> Column:
    x = 1.0 - F.greatest(cosine, F.lit(0.0))
    return F.exp(-x * x / (2.0 * sigma * sigma))


def resolution_prior(h: Column, x: Column, y: Column, radius: float) -> Column:
    """How alike in area a window and its image under the homography h (nine numbers) are: the smaller by the larger; 0 for an
    image without area."""
    corners = []
    for dx, dy in ((-1, -1), (-1, 1), (1, 1), (1, -1)):
        a, b = x + dx * radius, y + dy * radius
        w = F.nullif(h[6] * a + h[7] * b + h[8], F.lit(0.0))
        corners.append(((h[0] * a + h[1] * b + h[2]) / w, (h[3] * a + h[4] * b + h[5]) / w))
    twice = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(corners, corners[1:] + corners[:1]))
    moved, own = F.abs(twice) / 2.0, (2.0 * radius + 1.0) ** 2
    return F.when(moved > 0, F.least(moved / own, own / F.nullif(moved, F.lit(0.0)))).otherwise(0.0)


def plane_transfer(depth: Column, normal: Column, ray_from: Column, ray_to: Column) -> Column:
    """Depth along ray_to of the plane through the point at depth along ray_from; null if the plane is nearly parallel to the
    ray or met behind the camera."""
    dot = lambda a: sum(normal[i] * a[i] for i in range(3))
    below = dot(ray_to)
    found = depth * dot(ray_from) / F.when(below <= -1e-6, below)
    return F.when((found > 0) & (found < float("inf")), found)


def inverse_variance(depth: Column, cost: Column, focal: Column, baseline: Column, at_zero: float, slope: float) -> Column:
    """1 by the variance of a stereo depth whose error in pixels is at_zero + slope * cost; 1 without cost or baseline."""
    pixels = at_zero + slope * F.greatest(F.lit(0.0), F.least(F.lit(2.0), cost))
    deviation = depth * depth * pixels / F.nullif(focal * baseline, F.lit(0.0))
    return F.when(cost.isNotNull() & (baseline > 0), 1.0 / F.greatest(deviation * deviation, F.lit(1e-300))).otherwise(1.0)


def confidence(cost: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - cost)), F.lit(1.0))


def loss(kind: str, s: Column, a: float = 1.0) -> tuple[Column, Column, Column]:
    """(value, slope, curvature) of a robust loss at a squared residual s.  kind: trivial, huber, soft_l1 or cauchy."""
    b, one = a * a, F.lit(1.0)
    if kind == "trivial":
        return s, one, F.lit(0.0)
    if kind == "huber":
        far, r = s > b, F.sqrt(F.when(s > b, s))
        slope = F.greatest(a / r, F.lit(LEAST_SLOPE))
        return F.when(far, 2.0 * a * r - b).otherwise(s), F.when(far, slope).otherwise(1.0), F.when(far, -slope / (2.0 * F.when(far, s))).otherwise(0.0)
    total = 1.0 + s / b
    if kind == "soft_l1":
        slope = F.greatest(1.0 / F.sqrt(total), F.lit(LEAST_SLOPE))
        return 2.0 * b * (F.sqrt(total) - 1.0), slope, -slope / (2.0 * b * total)
    if kind == "cauchy":
        return b * F.log(total), F.greatest(1.0 / total, F.lit(LEAST_SLOPE)), -1.0 / (b * total * total)
    raise ValueError(f"unknown loss {kind}")


def loss_weight(kind: str, s: Column, a: float = 1.0) -> tuple[Column, Column]:
    """(contribution to the cost, factor of the residual)."""
    value, slope, _ = loss(kind, s, a)
    return value, F.sqrt(slope)


def rms_error(cost: Column, observations: Column) -> Column:
    """Root mean square of residuals whose half squares sum up to cost, null without observations."""
    return F.sqrt(2.0 * cost / F.nullif(observations, F.lit(0)))
