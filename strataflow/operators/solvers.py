"""Geometry solvers: small numeric problems, one per pair, image or point, run in groups of bounded size.

A group here is one pair's matches, one image's correspondences or one track's rays, which the feature limits bound; the
solvers see one group at a time, and Spark deals the groups over the cluster.  Linear algebra that SQL has no form for is
vectorised numpy.  A group that has too few rows or is degenerate gives a null model, never an error.
"""

from __future__ import annotations

import itertools
import math
import zlib
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trials of a random-sample search, unless the caller says otherwise.
MIN_TRIALS, MAX_TRIALS, CONFIDENCE, TRIAL_FACTOR = 100, 10_000, 0.999, 3.0


# ---- rotations -----------------------------------------------------------------------------------------------------


def so3_exp(w: np.ndarray) -> np.ndarray:
    """Rotation matrix of an axis-angle vector."""
    angle = float(np.linalg.norm(w))
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]], float)
    if angle < 1e-9:
        return np.eye(3) + k
    return np.eye(3) + math.sin(angle) / angle * k + (1 - math.cos(angle)) / angle**2 * k @ k


def so3_log(r: np.ndarray) -> np.ndarray:
    """Axis-angle vector of a rotation matrix, by way of the quaternion with the largest part."""
    q = quat_of(r)
    size = float(np.linalg.norm(q[1:]))
    if size < 1e-12:
        return 2 * q[1:]
    return 2 * math.atan2(size, q[0]) / size * q[1:]


def quat_of(r: np.ndarray) -> np.ndarray:
    """(w, x, y, z) of a rotation matrix, w not negative: the top eigenvector of its symmetric form."""
    a = r
    k = np.array(
        [
            [a[0, 0] + a[1, 1] + a[2, 2], a[2, 1] - a[1, 2], a[0, 2] - a[2, 0], a[1, 0] - a[0, 1]],
            [0, a[0, 0] - a[1, 1] - a[2, 2], a[0, 1] + a[1, 0], a[0, 2] + a[2, 0]],
            [0, 0, a[1, 1] - a[0, 0] - a[2, 2], a[1, 2] + a[2, 1]],
            [0, 0, 0, a[2, 2] - a[0, 0] - a[1, 1]],
        ]
    )
    q = np.linalg.eigh(k, UPLO="U")[1][:, -1]
    return -q if q[0] < 0 else q


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(m)
    return u @ np.diag([1, 1, np.linalg.det(u @ vt)]) @ vt


# ---- linear models -------------------------------------------------------------------------------------------------


def normalization(x: np.ndarray) -> np.ndarray:
    """The 3x3 map that centres points and sets their root mean square distance to sqrt(2)."""
    centre = x.mean(axis=0)
    spread = math.sqrt(((x - centre) ** 2).sum(axis=1).mean())
    k = math.sqrt(2) / spread if spread > 0 else 1.0
    return np.array([[k, 0, -k * centre[0]], [0, k, -k * centre[1]], [0, 0, 1]])


def _homogeneous(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


def fundamental(x1: np.ndarray, x2: np.ndarray) -> np.ndarray | None:
    """Normalised eight-point matrix of rank two, None with fewer than eight matches."""
    if len(x1) < 8:
        return None
    n1, n2 = normalization(x1), normalization(x2)
    a, b = _homogeneous(x1) @ n1.T, _homogeneous(x2) @ n2.T
    rows = (b[:, :, None] * a[:, None, :]).reshape(len(a), 9)
    f = np.linalg.svd(rows)[2][-1].reshape(3, 3)
    u, s, vt = np.linalg.svd(f)
    f = n2.T @ (u @ np.diag([s[0], s[1], 0]) @ vt) @ n1
    size = np.linalg.norm(f)
    return f / size if size > 0 else None


def essential(x1: np.ndarray, x2: np.ndarray) -> np.ndarray | None:
    """Eight-point matrix over calibrated points with two equal singular values."""
    f = fundamental(x1, x2)
    if f is None:
        return None
    u, s, vt = np.linalg.svd(f)
    return u @ np.diag([1, 1, 0]) @ vt


def homography(x1: np.ndarray, x2: np.ndarray) -> np.ndarray | None:
    """Direct linear transform over four matches or more; None if nearly singular (|det| < 1e-8)."""
    if len(x1) < 4:
        return None
    n1, n2 = normalization(x1), normalization(x2)
    a, b = _homogeneous(x1) @ n1.T, _homogeneous(x2) @ n2.T
    zero = np.zeros_like(a)
    rows = np.concatenate([np.hstack([a, zero, -b[:, :1] * a]), np.hstack([zero, a, -b[:, 1:2] * a])])
    h = np.linalg.svd(rows)[2][-1].reshape(3, 3)
    size = np.linalg.norm(h)
    if size == 0 or abs(np.linalg.det(h / size)) < 1e-8:
        return None
    h = np.linalg.inv(n2) @ h @ n1
    return h / np.linalg.norm(h)


def sampson(f: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Squared Sampson errors, infinite where the denominator is zero."""
    a, b = _homogeneous(x1), _homogeneous(x2)
    fa, fb = a @ f.T, b @ f
    below = fa[:, 0] ** 2 + fa[:, 1] ** 2 + fb[:, 0] ** 2 + fb[:, 1] ** 2
    top = (b * fa).sum(axis=1) ** 2
    return np.divide(top, below, out=np.full(len(a), np.inf), where=below > 0)


def transfer(h: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Squared distances of the mapped first points to the second ones."""
    y = _homogeneous(x1) @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        d = ((y[:, :2] / y[:, 2:] - x2) ** 2).sum(axis=1)
    return np.where(np.isfinite(d), d, np.inf)


# ---- random-sample search ------------------------------------------------------------------------------------------


def trials_needed(inliers: int, n: int, sample: int, confidence: float = CONFIDENCE, factor: float = TRIAL_FACTOR) -> int:
    """Trials until one all-inlier sample is that certain: 1 if all samples are, MAX_TRIALS if none can be."""
    chance = math.prod(max(inliers - i, 0) / (n - i) for i in range(sample)) if n >= sample else 0.0
    if chance <= 0:
        return MAX_TRIALS
    if chance >= 1:
        return 1
    return min(MAX_TRIALS, math.ceil(math.log(1 - confidence) / math.log1p(-chance) * factor))


def search(n: int, sample: int, fit, residuals, threshold: float, seed: int, min_trials: int = MIN_TRIALS):
    """(model, inlier mask) with most inliers, then the least inlier residual sum; (None, no inliers) without a model.

    Each new best is fitted again to its inliers, and kept if better.
    """
    rng, best, mask, score = np.random.default_rng(seed), None, np.zeros(n, bool), (0, 0.0)
    if n < sample:
        return best, mask
    done, needed = 0, MAX_TRIALS
    while done < min_trials or done < needed:
        if done >= MAX_TRIALS:
            break
        done += 1
        model = fit(rng.choice(n, sample, replace=False))
        improved = True
        while model is not None and improved:
            r = residuals(model)
            inside = r <= threshold
            now = (int(inside.sum()), -float(r[inside].sum()))
            improved = now > score
            if improved:
                best, mask, score = model, inside, now
                needed = trials_needed(now[0], n, sample)
                model = fit(np.flatnonzero(inside)) if now[0] > sample else None
    return best, mask


# ---- two views -----------------------------------------------------------------------------------------------------


def decompose_essential(e: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four (rotation, unit translation) pairs of an essential matrix."""
    u, _, vt = np.linalg.svd(e)
    u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    return [(r, s * u[:, 2]) for r in (u @ w @ vt, u @ w.T @ vt) for s in (1, -1)]


def triangulate(projections: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Homogeneous point of k >= 2 views: projections (k, 3, 4), normalised points (k, 2)."""
    rows = np.concatenate([points[:, :1] * projections[:, 2] - projections[:, 0], points[:, 1:] * projections[:, 2] - projections[:, 1]])
    return np.linalg.svd(rows)[2][-1]


def triangulate_pairs(r: np.ndarray, t: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Points (n, 3) of matches between a camera at the origin and one at (r, t); rows of nan for rays that never meet."""
    p1, p2 = np.eye(3, 4), np.column_stack([r, t])
    rows = np.stack([x1[:, :1] * p1[2] - p1[0], x1[:, 1:] * p1[2] - p1[1], x2[:, :1] * p2[2] - p2[0], x2[:, 1:] * p2[2] - p2[1]], axis=1)
    h = np.linalg.svd(rows)[2][:, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        x = h[:, :3] / h[:, 3:]
    return np.where(np.isfinite(x), x, np.nan)


def pose_from_essential(e: np.ndarray, x1: np.ndarray, x2: np.ndarray):
    """(rotation, translation, points, in-front mask) of the candidate with most points before both cameras."""
    best = None
    for r, t in decompose_essential(e):
        x = triangulate_pairs(r, t, x1, x2)
        with np.errstate(invalid="ignore"):
            front = (x[:, 2] > 0) & ((x @ r.T + t)[:, 2] > 0)
        if best is None or front.sum() >= best[3].sum():
            best = r, t, x, front
    return best


def median_angle(r: np.ndarray, t: np.ndarray, x: np.ndarray) -> float:
    """Median triangulation angle of points seen from the origin and from (r, t); 0 without points."""
    if not len(x):
        return 0.0
    other = x + r.T @ t
    cos = (x * other).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(other, axis=1))
    angle = np.arccos(np.clip(cos, -1, 1))
    return float(np.median(np.minimum(angle, math.pi - angle)))


TWO_VIEW = "pair bigint, n_e int, n_f int, n_h int, f array<double>, h array<double>, q array<double>, t array<double>, tri_angle double, inliers array<bigint>"


def two_views(matches: DataFrame, threshold: float = 4.0, seed: int = 0) -> DataFrame:
    """Per pair: inlier counts of essential, fundamental and homography models, the pose, and the inlier matches.

    matches has pair, idx, x1, y1, x2, y2 (pixels) and focal, cx, cy of the shared camera, as doubles; rows with a null or
    a non-finite number are no matches.  Counts are null where an estimator finds no model.  The matches of one pair are
    bounded by the feature limit, so a pair is one group.
    """
    numbers = ("x1", "y1", "x2", "y2", "focal", "cx", "cy")
    known = matches.select("pair", "idx", *[F.col(c).cast("double").alias(c) for c in numbers]).dropna()

    def solve(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[np.isfinite(pdf[list(numbers)]).all(axis=1)].sort_values("idx", kind="stable").reset_index(drop=True)
        row = dict.fromkeys(("n_e", "n_f", "n_h", "f", "h", "q", "t", "tri_angle")) | {"pair": key[0], "inliers": []}
        if len(pdf):
            x1, x2 = pdf[["x1", "y1"]].to_numpy(), pdf[["x2", "y2"]].to_numpy()
            focal, centre = float(pdf.focal[0]), pdf.loc[0, ["cx", "cy"]].to_numpy(float)
            u1, u2, n, own = (x1 - centre) / focal, (x2 - centre) / focal, len(pdf), zlib.crc32(f"{seed}:{key[0]}".encode())
            e, in_e = search(n, 8, lambda i: essential(u1[i], u2[i]), lambda m: sampson(m, u1, u2), (threshold / focal) ** 2, own)
            f, in_f = search(n, 8, lambda i: fundamental(x1[i], x2[i]), lambda m: sampson(m, x1, x2), threshold**2, own)
            h, in_h = search(n, 4, lambda i: homography(x1[i], x2[i]), lambda m: transfer(m, x1, x2), threshold**2, own)
            row |= {"n_e": None if e is None else int(in_e.sum()), "n_f": None if f is None else int(in_f.sum()), "n_h": None if h is None else int(in_h.sum())}
            row |= {"f": None if f is None else f.ravel().tolist(), "h": None if h is None else h.ravel().tolist()}
            inside = max((in_e, in_f, in_h), key=lambda m: int(m.sum()))
            row["inliers"] = pdf.idx[inside].astype(int).tolist()
            if e is not None:
                r, t, x, front = pose_from_essential(e, u1[in_e], u2[in_e])
                row |= {"q": quat_of(r).tolist(), "t": t.tolist(), "tri_angle": median_angle(r, t, x[front])}
        out = pd.DataFrame([row])
        return out.astype({c: "Int32" for c in ("n_e", "n_f", "n_h")})[["pair", "n_e", "n_f", "n_h", "f", "h", "q", "t", "tri_angle", "inliers"]]

    return known.groupBy("pair").applyInPandas(solve, TWO_VIEW)


# ---- points --------------------------------------------------------------------------------------------------------


POINT = "point bigint, x double, y double, z double, n_inliers int, error double"


def triangulate_tracks(rays: DataFrame, max_error: float = math.radians(2.0), min_angle: float = math.radians(1.5)) -> DataFrame:
    """Per point: the position that most rays agree with, over all pairs of rays in lexicographic order; no randomness.

    rays has point, ord, the observing pose (q, t: world to camera, double arrays) and the normalised image point (u, v).
    A ray agrees if its angular error is at most max_error and the position is before its camera; a pair proposes only if
    its rays meet at min_angle or more.  A point without two agreeing rays has null coordinates.  At most MAX_TRIALS pairs
    propose (all pairs of up to 141 rays); all rays vote on each proposal and enter the final fit.
    """
    known = rays.select("point", "ord", "q", "t", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")).dropna()

    def solve(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        q, t = np.stack(pdf.q.to_list()), np.stack(pdf.t.to_list())
        rot = np.stack([rotation(v) for v in q])
        p, uv = np.concatenate([rot, t[:, :, None]], axis=2), pdf[["u", "v"]].to_numpy()
        centres = -np.einsum("kji,kj->ki", rot, t)
        bearing = _homogeneous(uv) / np.linalg.norm(_homogeneous(uv), axis=1)[:, None]

        def errors(x: np.ndarray) -> np.ndarray:
            seen = np.einsum("kij,j->ki", rot, x) + t
            size = np.linalg.norm(seen, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                e = np.arccos(np.clip((bearing * seen).sum(axis=1) / size, -1, 1))
            return np.where((seen[:, 2] > 0) & np.isfinite(e), e, np.inf)

        def fit(i) -> np.ndarray | None:
            h = triangulate(p[i], uv[i])
            return h[:3] / h[3] if abs(h[3]) > 1e-12 else None

        best, mask, score = None, np.zeros(len(pdf), bool), (1, -np.inf)
        for a, b in itertools.islice(itertools.combinations(range(len(pdf)), 2), MAX_TRIALS):
            x = fit([a, b])
            if x is None or _angle_at(x, centres[a], centres[b]) < min_angle:
                continue
            e = errors(x)
            inside = e <= max_error
            now = (int(inside.sum()), -float(e[inside].sum()))
            if now > score:
                best, mask, score = x, inside, now
        if best is not None and mask.sum() > 2 and (x := fit(np.flatnonzero(mask))) is not None and (errors(x) <= max_error).sum() >= mask.sum():
            best, mask = x, errors(x) <= max_error
        row = [key[0], None, None, None, 0, None] if best is None else [key[0], *best.tolist(), int(mask.sum()), float(errors(best)[mask].mean())]
        return pd.DataFrame([row], columns=["point", "x", "y", "z", "n_inliers", "error"]).astype({"x": float, "y": float, "z": float, "error": float})

    return known.groupBy("point").applyInPandas(solve, POINT)


def _angle_at(x: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> float:
    a, b = c1 - x, c2 - x
    size = np.linalg.norm(a) * np.linalg.norm(b)
    if size == 0:
        return 0.0
    angle = math.acos(min(1.0, max(-1.0, float(a @ b / size))))
    return min(angle, math.pi - angle)


def rotation(q) -> np.ndarray:
    """Rotation matrix of a quaternion (w, x, y, z), normalised first."""
    w, x, y, z = np.asarray(q, float) / np.linalg.norm(q)
    return np.array(
        [
            [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
            [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
            [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
        ]
    )


# ---- absolute poses ------------------------------------------------------------------------------------------------


def absolute_pose(uv: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(rotation, translation) of six or more points by a direct linear transform, then a projection to rotations."""
    if len(x) < 6:
        return None
    centre = x.mean(axis=0)
    spread = math.sqrt(((x - centre) ** 2).sum(axis=1).mean()) or 1.0
    y, zero = np.column_stack([(x - centre) / spread, np.ones(len(x))]), np.zeros((len(x), 4))
    rows = np.concatenate([np.hstack([y, zero, -uv[:, :1] * y]), np.hstack([zero, y, -uv[:, 1:] * y])])
    p = np.linalg.svd(rows)[2][-1].reshape(3, 4)
    u, s, vt = np.linalg.svd(p[:, :3])
    if s[0] <= 0 or s[2] / s[0] < 1e-3:
        return None
    sign = np.sign(np.linalg.det(p[:, :3]))
    r = sign * u @ vt
    if np.linalg.det(r) < 0:
        return None
    t = sign * p[:, 3] / s.mean() * spread - r @ centre
    return refine_pose(r, t, uv, x)


def refine_pose(r: np.ndarray, t: np.ndarray, uv: np.ndarray, x: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Damped least squares of one pose on its reprojection errors."""

    def residual(r, t):
        y = x @ r.T + t
        with np.errstate(divide="ignore", invalid="ignore"):
            return y, np.where(y[:, 2:] > 1e-12, y[:, :2] / y[:, 2:] - uv, 1e3)

    damping = 1e-4
    y, e = residual(r, t)
    for _ in range(rounds):
        z, zero = np.maximum(y[:, 2], 1e-12), np.zeros(len(x))
        d = np.stack([np.stack([1 / z, zero, -y[:, 0] / z**2], axis=1), np.stack([zero, 1 / z, -y[:, 1] / z**2], axis=1)], axis=1)
        v = y - t
        skew = np.stack([np.stack([zero, v[:, 2], -v[:, 1]], 1), np.stack([-v[:, 2], zero, v[:, 0]], 1), np.stack([v[:, 1], -v[:, 0], zero], 1)], 1)
        jac = np.concatenate([d @ skew, d], axis=2).reshape(-1, 6)
        a, b = jac.T @ jac, -jac.T @ e.ravel()
        try:
            step = np.linalg.solve(a + damping * np.diag(np.diag(a) + 1e-12), b)
        except np.linalg.LinAlgError:  # a point at the camera's centre leaves no usable step
            break
        r2, t2 = so3_exp(step[:3]) @ r, t + step[3:]
        y2, e2 = residual(r2, t2)
        if (e2**2).sum() < (e**2).sum():
            r, t, y, e, damping = r2, t2, y2, e2, damping / 10
            if np.abs(step).max() < 1e-12:
                break
        else:
            damping *= 10
    return nearest_rotation(r), t


POSE = "image bigint, q array<double>, t array<double>, n_inliers int"


def register_images(correspondences: DataFrame, threshold: float = 12.0, least: int = 30, seed: int = 0) -> DataFrame:
    """Per image: its pose from 2D-3D correspondences, null with fewer than `least` of them or of inliers.

    correspondences has image, idx, u, v (normalised), x, y, z, focal.
    """
    names = ["u", "v", "x", "y", "z", "focal"]
    known = correspondences.select("image", "idx", *[F.col(c).cast("double").alias(c) for c in names]).dropna()

    def solve(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        uv, x, bound = pdf[["u", "v"]].to_numpy(), pdf[["x", "y", "z"]].to_numpy(), (threshold / float(pdf.focal.iloc[0])) ** 2

        def residuals(m):
            y = x @ m[0].T + m[1]
            with np.errstate(divide="ignore", invalid="ignore"):
                e = ((y[:, :2] / y[:, 2:] - uv) ** 2).sum(axis=1)
            return np.where((y[:, 2] > 0) & np.isfinite(e), e, np.inf)

        model, mask = (None, np.zeros(0, bool)) if len(pdf) < least else search(len(pdf), 6, lambda i: absolute_pose(uv[i], x[i]), residuals, bound, zlib.crc32(f"{seed}:{key[0]}".encode()))
        found = model is not None and mask.sum() >= least
        row = [int(key[0]), quat_of(model[0]).tolist() if found else None, model[1].tolist() if found else None, int(mask.sum())]
        return pd.DataFrame([row], columns=["image", "q", "t", "n_inliers"])

    return known.groupBy("image").applyInPandas(solve, POSE)
