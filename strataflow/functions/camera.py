"""Camera models as Column expressions: parameters in an array, model by number."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    name: str
    focal: tuple[int, ...]
    centre: tuple[int, int]
    extra: tuple[int, ...]


# Model numbers, names and parameter places of the common model file format.
MODELS = {
    0: Model("SIMPLE_PINHOLE", (0,), (1, 2), ()),
    1: Model("PINHOLE", (0, 1), (2, 3), ()),
    2: Model("SIMPLE_RADIAL", (0,), (1, 2), (3,)),
    3: Model("RADIAL", (0,), (1, 2), (3, 4)),
    4: Model("OPENCV", (0, 1), (2, 3), (4, 5, 6, 7)),
}


def _case(model: Column, make) -> Column:
    out = F.lit(None).cast("double")
    for number, m in MODELS.items():
        out = F.when(model == number, make(m)).otherwise(out)
    return out


def model_name(model: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for n, m in MODELS.items() for x in (n, m.name)]), model)


def focal_x(model: Column, p: Column) -> Column:
    return _case(model, lambda m: p[m.focal[0]])


def focal_y(model: Column, p: Column) -> Column:
    return _case(model, lambda m: p[m.focal[-1]])


def mean_focal(model: Column, p: Column) -> Column:
    return (focal_x(model, p) + focal_y(model, p)) / 2


def distortion(model: Column, p: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """What distortion adds to a normalised point."""
    r2 = u * u + v * v

    def radial(m: Model) -> Column:
        if not m.extra:
            return F.lit(0.0)
        k1 = p[m.extra[0]]
        return k1 * r2 if len(m.extra) == 1 else k1 * r2 + p[m.extra[1]] * r2 * r2

    def tangential(m: Model, x: Column, y: Column, first: int) -> Column:
        if len(m.extra) < 4:
            return F.lit(0.0)
        a, b = p[m.extra[2 + first]], p[m.extra[3 - first]]
        return 2 * a * x * y + b * (r2 + 2 * x * x)

    du = _case(model, lambda m: u * radial(m) + tangential(m, u, v, 0))
    dv = _case(model, lambda m: v * radial(m) + tangential(m, v, u, 1))
    return du, dv


def project(model: Column, p: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Pixel of a point in camera coordinates, null if it isn't in front."""
    front = z > 2.220446049250313e-16
    u, v = F.when(front, x / z), F.when(front, y / z)
    du, dv = distortion(model, p, u, v)
    cx, cy = _case(model, lambda m: p[m.centre[0]]), _case(model, lambda m: p[m.centre[1]])
    return focal_x(model, p) * (u + du) + cx, focal_y(model, p) * (v + dv) + cy


def parameter_count(model: Column) -> Column:
    return _case(model, lambda m: F.lit(float(len(m.focal) + 2 + len(m.extra)))).cast("int")


def model_number(name: Column) -> Column:
    """The number of a model's name, null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for n, m in MODELS.items() for x in (m.name, n)]), name)


def from_focal(model: Column, focal: Column, width: Column, height: Column) -> Column:
    """Parameters with one focal length, the centre in the middle and no distortion; null for an unknown model."""
    out = F.lit(None).cast("array<double>")
    for number, m in MODELS.items():
        slots = dict.fromkeys(m.focal, focal.cast("double")) | {m.centre[0]: width / 2.0, m.centre[1]: height / 2.0}
        out = F.when(model == number, F.array(*[slots.get(i, F.lit(0.0)) for i in range(len(m.focal) + 2 + len(m.extra))])).otherwise(out)
    return out


def centre_x(model: Column, p: Column) -> Column:
    return _case(model, lambda m: p[m.centre[0]])


def centre_y(model: Column, p: Column) -> Column:
    return _case(model, lambda m: p[m.centre[1]])


def calibration_matrix(model: Column, p: Column) -> Column:
    """Nine numbers, row by row, without distortion."""
    zero = F.lit(0.0)
    return F.array(focal_x(model, p), zero, centre_x(model, p), zero, focal_y(model, p), centre_y(model, p), zero, zero, F.lit(1.0))


def implausible(model: Column, p: Column, width: Column, height: Column, least_ratio: float, most_ratio: float, most_extra: float) -> Column:
    """Whether the centre lies outside the image, a focal length by the longer side outside the ratios, or a distortion
    parameter beyond most_extra."""
    cx, cy, side = centre_x(model, p), centre_y(model, p), F.greatest(width, height)
    outside = (cx < 0) | (cx > width) | (cy < 0) | (cy > height)
    ratios = [f(model, p) / side for f in (focal_x, focal_y)]
    extra = _case(model, lambda m: F.greatest(*[F.abs(p[i]) for i in m.extra], F.lit(0.0), F.lit(0.0)))
    return outside | (F.least(*ratios) < least_ratio) | (F.greatest(*ratios) > most_ratio) | (extra > most_extra)


def _scaled(model: Column, p: Column, sx: Column, sy: Column) -> Column:
    out = F.lit(None).cast("array<double>")
    for number, m in MODELS.items():
        factor = dict(zip(m.focal, (sx, sy) if len(m.focal) == 2 else ((sx + sy) / 2,))) | {m.centre[0]: sx, m.centre[1]: sy}
        out = F.when(model == number, F.array(*[p[i] * factor[i] if i in factor else p[i] for i in range(len(m.focal) + 2 + len(m.extra))])).otherwise(out)
    return out


def rescaled(model: Column, p: Column, width: Column, height: Column, factor: Column) -> Column:
    """struct(params, width, height) of an image resized by factor: sizes rounded, 1 at least; distortion stays."""
    size = lambda x: F.greatest(F.lit(1), F.round(x * factor)).cast("long")
    return F.struct(_scaled(model, p, factor, factor).alias("params"), size(width).alias("width"), size(height).alias("height"))


def rescaled_to(model: Column, p: Column, width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """struct(params, width, height) of an image resized to a size; a single focal length takes the mean of both factors."""
    sx, sy = (b / F.nullif(a, F.lit(0)) for a, b in ((width, to_width), (height, to_height)))
    return F.struct(_scaled(model, p, sx, sy).alias("params"), to_width.alias("width"), to_height.alias("height"))


def camera_threshold(model: Column, p: Column, pixels: Column) -> Column:
    """A threshold in pixels as one on the normalised plane."""
    return pixels / F.nullif(mean_focal(model, p), F.lit(0.0))


#: Rounds of Newton's method, and the squared step at which it ends.
ROUNDS, STEP_SQ = 100, 1e-10


def undistorted(model: Column, p: Column, x: Column, y: Column) -> Column:
    """struct(u, v) on the normalised plane of a pixel, by Newton's method; null where it doesn't converge or an input is
    null.  Vectorised: the rounds run over a batch's rows at once."""
    u0, v0 = ((z - c(model, p)) / f(model, p) for z, c, f in ((x, centre_x, focal_x), (y, centre_y, focal_y)))
    zero = F.lit(0.0)
    # k1, k2, p1, p2 of every model
    k = [_case(model, lambda m, i=i: p[m.extra[i]] if i < len(m.extra) else zero) for i in range(4)]

    @F.pandas_udf("struct<u:double,v:double>")
    def solve(u0: pd.Series, v0: pd.Series, k1: pd.Series, k2: pd.Series, p1: pd.Series, p2: pd.Series) -> pd.DataFrame:
        a, b, k1, k2, p1, p2 = (c.to_numpy(dtype=float, na_value=np.nan) for c in (u0, v0, k1, k2, p1, p2))
        u, v, done = a.copy(), b.copy(), np.zeros(len(a), bool)
        with np.errstate(all="ignore"):
            for _ in range(ROUNDS):
                r2 = u * u + v * v
                g, dg = k1 * r2 + k2 * r2 * r2, 2 * k1 + 4 * k2 * r2  # the radial factor, and its slope by half of r2
                eu = u + u * g + 2 * p1 * u * v + p2 * (r2 + 2 * u * u) - a
                ev = v + v * g + 2 * p2 * u * v + p1 * (r2 + 2 * v * v) - b
                uu, uv = 1 + g + u * u * dg + 2 * p1 * v + 6 * p2 * u, u * v * dg + 2 * p1 * u + 2 * p2 * v
                vv = 1 + g + v * v * dg + 2 * p2 * u + 6 * p1 * v
                det = uu * vv - uv * uv
                du, dv = (eu * vv - ev * uv) / det, (ev * uu - eu * uv) / det
                u, v = np.where(done, u, u - du), np.where(done, v, v - dv)
                done |= du * du + dv * dv < STEP_SQ
                if done.all():
                    break
        out = pd.DataFrame({"u": u, "v": v}).astype(object)
        out[~done] = None
        return out

    return solve(u0, v0, *k)


def ray(plane: Column) -> Column:
    """The unit ray of a point struct(u, v) on the normalised plane."""
    n = F.sqrt(plane["u"] * plane["u"] + plane["v"] * plane["v"] + 1.0)
    return F.when(plane["u"].isNotNull(), F.array(plane["u"] / n, plane["v"] / n, 1.0 / n))


def squared_reprojection_error(model: Column, p: Column, x: Column, y: Column, z: Column, px: Column, py: Column) -> Column:
    """Squared distance in pixels of an observation (px, py) to a point in camera coordinates; the largest number if that isn't
    in front."""
    u, v = project(model, p, x, y, z)
    return F.coalesce(F.pow(u - px, 2) + F.pow(v - py, 2), F.lit(1.7976931348623157e308))


def two_view_decision(n_e: Column, n_f: Column, n_h: Column, least: int = 15) -> Column:
    """Configuration of a calibrated pair by inlier counts (null: the estimator failed).

    Fixed values: 1 degenerate, 2 calibrated, 3 uncalibrated, 6 planar or rotation; ratios 0.95 and 0.8.
    """
    e, f, h = (F.coalesce(n, F.lit(0)) for n in (n_e, n_f, n_h))
    over = lambda a, b: F.coalesce(a.cast("double") / F.nullif(b, F.lit(0)), F.when(a > 0, F.lit(float("inf"))))
    planar_e = F.when(over(h, e) > 0.8, 6).otherwise(2)
    planar_f = F.when(over(h, f) > 0.8, 6).otherwise(3)
    return (
        F.when((e < least) & (f < least) & (h < least), 1)
        .when(n_e.isNotNull() & (over(e, f) > 0.95) & (e >= least), planar_e)
        .when(n_f.isNotNull() & (f >= least), planar_f)
        .when(n_h.isNotNull() & (h >= least), 6)
        .otherwise(1)
    )
