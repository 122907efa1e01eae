"""Robust statistics by aggregation: trimmed extents, refits by medians, similarity fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators.common import numbered


def trimmed_extent(values: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """One row: n, low and high order statistics at floor(q (n - 1)), and the mean of the values between them.

    The order statistics are elements, not interpolated."""
    known = values.filter(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    ranked = numbered(known, F.floor(F.col("v")), F.col("v"), name="at")
    n = known.agg(F.count(F.lit(1)).alias("n"))
    at = lambda q: F.floor(F.lit(q) * (F.col("n") - 1))
    inside = ranked.join(n).filter((F.col("at") >= at(low)) & (F.col("at") <= at(high)))  # n is one row
    return inside.agg(F.max("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"))


def robust_line(points: DataFrame, rounds: int = 5, factor: float = 3.0, least: float = 0.3) -> tuple[float, float, int]:
    """(slope, offset, kept) of y over x: fit, keep residuals below max(factor * median of the kept ones, least), refit.

    Each round is one aggregation; the median is exact."""
    bound, a, b, kept = None, 0.0, 0.0, 0
    for _ in range(rounds):
        residual = F.abs(F.col("y") - (a * F.col("x") + b))
        use = points if bound is None else points.filter(residual < bound)
        s = use.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx")).first()
        if s.n < 3 or not s.xx:
            break
        a, kept = s.xy / s.xx, s.n
        b = s.my - a * s.mx
        residual = F.abs(F.col("y") - (a * F.col("x") + b))
        bound = max(factor * use.select(F.median(residual)).first()[0], least)
    return a, b, kept


def similarity_sums(pairs: DataFrame) -> DataFrame:
    """One row of sums for a similarity fit of (x, y, z) to (u, v, w): n, means, cross-covariances, variance of x, y, z."""
    source, target = ("x", "y", "z"), ("u", "v", "w")
    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"mean_{c}") for c in source + target],
        *[F.covar_pop(s, t).alias(f"cov_{s}{t}") for s in source for t in target],
        (F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("var"),
    )


def umeyama(pairs: DataFrame) -> tuple[float, np.ndarray, np.ndarray] | None:
    """(scale, rotation, translation) that takes (x, y, z) to (u, v, w) best, None with fewer than three pairs."""
    s = similarity_sums(pairs).first()
    if s is None or s["n"] < 3 or not s["var"]:
        return None
    cov = np.array([[s[f"cov_{a}{b}"] for a in "xyz"] for b in "uvw"])
    u, d, vt = np.linalg.svd(cov)
    sign = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    rotation = u @ sign @ vt
    scale = float(np.trace(np.diag(d) @ sign) / s["var"])
    translation = np.array([s[f"mean_{b}"] for b in "uvw"]) - scale * rotation @ np.array([s[f"mean_{a}"] for a in "xyz"])
    return scale, rotation, translation


def apply_similarity(model: tuple[float, np.ndarray, np.ndarray], names: tuple[str, ...] = ("x", "y", "z")) -> list:
    """Columns of the moved point."""
    scale, rotation, translation = model
    return [sum(float(scale * rotation[i, j]) * F.col(n) for j, n in enumerate(names)) + float(translation[i]) for i in range(3)]


def robust_umeyama(pairs: DataFrame, rounds: int = 5, factor: float = 3.0, least: float = 0.3):
    """(similarity, median residual, kept) of pairs (x, y, z, u, v, w): fit, keep residuals below max(factor * median of the
    kept ones, least), refit; None with fewer than three pairs.  It ends where fewer than three would stay; each round is two
    aggregations over the pairs, with an exact median."""
    use, model, bound, kept, middle = pairs, None, None, 0, None
    for _ in range(max(1, rounds)):
        fitted = umeyama(use)
        if fitted is None:
            break
        model = fitted
        residual = F.sqrt(sum((a - F.col(b)) ** 2 for a, b in zip(apply_similarity(model), "uvw")))
        bound = max(factor * use.select(F.median(residual)).first()[0], least)
        now = pairs.withColumn("_r", residual).filter(F.col("_r") < bound)
        kept, middle = now.agg(F.count(F.lit(1)), F.median("_r")).first()
        if kept < 3:
            break
        use = now.drop("_r")
    return None if model is None else (model, middle, kept)


def collinearity_ratio(points: DataFrame) -> float:
    """Ratio of the second to the first singular value of centred positions (x, y, z), 1 below three points."""
    names = "xyz"
    s = points.agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(a, b).alias(a + b) for a in names for b in names]).first()
    if s["n"] < 3:
        return 1.0
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(np.array([[s[a + b] for a in names] for b in names])), 0.0))[::-1]
    return float(values[1] / values[0]) if values[0] > 0 else 1.0


def stage_times(times: DataFrame) -> DataFrame:
    """(stage, total, n) of times (stage, seconds)."""
    return times.groupBy("stage").agg(F.sum("seconds").alias("total"), F.count(F.lit(1)).alias("n"))
