"""Keypoints, image sizes and orientation, and focal lengths from image metadata, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: diagonal in millimetres to which 35 mm equivalent focal lengths refer.
DIAGONAL_35MM = 43.27


def keypoint(x: Column, y: Column, scale: Column, orientation: Column) -> Column:
    """struct(x, y, a11, a12, a21, a22): the affine shape of a scaled rotation."""
    c, s = scale * F.cos(orientation), scale * F.sin(orientation)
    return _keypoint(x, y, c, -s, s, c)


def _keypoint(*values: Column) -> Column:
    return F.struct(*[v.alias(n) for v, n in zip(values, ("x", "y", "a11", "a12", "a21", "a22"))])


def keypoint_rescaled(k: Column, sx: Column, sy: Column) -> Column:
    """After the image has been resized by sx and sy."""
    return _keypoint(k["x"] * sx, k["y"] * sy, k["a11"] * sx, k["a12"] * sy, k["a21"] * sx, k["a22"] * sy)


def keypoint_scale(k: Column) -> Column:
    """Mean length of the shape's axes."""
    return (F.hypot(k["a11"], k["a21"]) + F.hypot(k["a12"], k["a22"])) / 2


def keypoint_orientation(k: Column) -> Column:
    return F.atan2(k["a21"], k["a11"])


def keypoint_turned(k: Column, turns: Column, width: Column, height: Column) -> Column:
    """After the image of this size has been turned by quarter turns, counter-clockwise."""
    n = F.pmod(turns, F.lit(4))
    once = lambda q, w: _keypoint(q["y"], w - q["x"], q["a21"], q["a22"], -q["a11"], -q["a12"])
    one = once(k, width)
    two = once(one, height)
    return F.when(n == 1, one).when(n == 2, two).when(n == 3, once(two, width)).otherwise(_keypoint(*[k[c] for c in ("x", "y", "a11", "a12", "a21", "a22")]))


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luminance of 8-bit colours by fixed weights 0.2126, 0.7152, 0.0722, rounded."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.round(0.2126 * r + 0.7152 * g + 0.0722 * b))).cast("int")


def limited_size(width: Column, height: Column, most: int) -> Column:
    """struct(width, height), shrunk so that the longer side is at most most; sides are 1 at least."""
    factor = F.least(F.lit(1.0), most / F.greatest(width, height))
    side = lambda x: F.when(factor < 1.0, F.greatest(F.lit(1), F.round(x * factor))).otherwise(x).cast("long")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def gravity(orientation: Column) -> Column:
    """array(x, y) of the direction down in an image by its EXIF orientation, null for mirrored or unknown ones."""
    # Orientations 1, 3, 6 and 8.
    out = F.lit(None).cast("array<double>")
    for value, (x, y) in {1: (0.0, 1.0), 3: (0.0, -1.0), 6: (1.0, 0.0), 8: (-1.0, 0.0)}.items():
        out = F.when(orientation == value, F.array(F.lit(x), F.lit(y))).otherwise(out)
    return out


def quarter_turns(orientation: Column) -> Column:
    """Counter-clockwise quarter turns that put an image upright, 0 for mirrored or unknown orientations."""
    return F.coalesce(F.when(orientation == 3, 2).when(orientation == 6, 3).when(orientation == 8, 1), F.lit(0))


def sensor_key(text: Column) -> Column:
    """A maker's or model's name without case, white space, _ and -."""
    return F.lower(F.regexp_replace(text, r"[\s_-]", ""))


def sensor_model_key(make: Column, model: Column) -> Column:
    """The key of a model's name, which may begin with the maker's."""
    mk, md = sensor_key(make), sensor_key(model)
    return F.when(F.startswith(md, mk), F.substring(md, F.length(mk) + 1, F.length(md))).otherwise(md)


def infer_focal(focal_35mm: Column, focal_mm: Column, resolution: Column, unit: Column, sensor_width: Column, width: Column, height: Column, factor: float) -> Column:
    """struct(focal in pixels, prior): from the 35 mm equivalent, else from the focal plane's resolution (unit 2 inch, 3 cm,
    4 mm, 5 um), else from the sensor's width in mm, else factor times the longer side, which is no prior."""
    side = F.greatest(width, height)
    positive = lambda x: F.when(x > 0, x)
    per_mm = positive(F.when(unit == 2, resolution / 25.4).when(unit == 3, resolution / 10.0).when(unit == 4, resolution).when(unit == 5, resolution * 1000.0))
    mm = positive(focal_mm)
    known = F.coalesce(positive(focal_35mm) / DIAGONAL_35MM * F.sqrt(width * width + height * height), mm * per_mm, mm / positive(sensor_width) * side)
    return F.struct(F.coalesce(known, factor * side).alias("focal"), known.isNotNull().alias("prior"))
