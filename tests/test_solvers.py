"""Solvers on scenes with known poses."""

from __future__ import annotations

import math

import numpy as np
import pytest

from strataflow.operators import solvers as s


def scene(n=120, seed=3, flat=False):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.uniform(-4, 4, n), rng.uniform(-3, 3, n), np.full(n, 9.0) if flat else rng.uniform(6, 14, n)])
    r, t = s.so3_exp(np.array([0.03, -0.08, 0.05])), np.array([-1.0, 0.15, 0.1])
    y = x @ r.T + t
    return x, r, t, x[:, :2] / x[:, 2:], y[:, :2] / y[:, 2:]


def test_rotations():
    w = np.array([0.4, -1.2, 0.7])
    r = s.so3_exp(w)
    np.testing.assert_allclose(s.so3_log(r), w, atol=1e-12)
    np.testing.assert_allclose(s.rotation(s.quat_of(r)), r, atol=1e-12)
    np.testing.assert_allclose(s.so3_exp(np.zeros(3)), np.eye(3))
    np.testing.assert_allclose(s.nearest_rotation(3 * r), r, atol=1e-12)


def test_trials():
    assert s.trials_needed(10, 10, 4) == 1
    assert s.trials_needed(0, 10, 4) == s.MAX_TRIALS
    assert s.trials_needed(3, 3, 4) == s.MAX_TRIALS
    assert s.trials_needed(50, 100, 4) == math.ceil(math.log(0.001) / math.log1p(-(50 * 49 * 48 * 47) / (100 * 99 * 98 * 97)) * 3)


def test_two_views(spark):
    _, r, t, u1, u2 = scene()
    p1, p2 = u1 * 1000 + [1000, 750], u2 * 1000 + [1000, 750]
    p2[:20] = np.random.default_rng(1).uniform(0, 1500, (20, 2))
    flat1, flat2 = (v * 1000 + [1000, 750] for v in scene(flat=True)[3:])
    rows = [(1, i, *map(float, a), *map(float, b), 1000.0, 1000.0, 750.0) for i, (a, b) in enumerate(zip(p1, p2))]
    rows += [(2, i, *map(float, a), *map(float, b), 1000.0, 1000.0, 750.0) for i, (a, b) in enumerate(zip(flat1, flat2))]
    rows += [(3, i, 1.0, 1.0, 2.0, 2.0, 1000.0, 1000.0, 750.0) for i in range(20)] + [(4, 0, 1.0, 1.0, 2.0, 2.0, 1000.0, 1000.0, 750.0), (5, 0, None, 1.0, 2.0, 2.0, 1.0, 0.0, 0.0), (4, 1, float("nan"), 1.0, 2.0, 2.0, 1.0, 0.0, 0.0)]
    schema = "pair long, idx long, x1 double, y1 double, x2 double, y2 double, focal double, cx double, cy double"
    got = {x.pair: x for x in s.two_views(spark.createDataFrame(rows, schema)).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1].n_e >= 98 and set(range(20, 120)) - set(got[1].inliers) == set()
    np.testing.assert_allclose(s.rotation(got[1].q), r, atol=1e-3)
    np.testing.assert_allclose(got[1].t, t / np.linalg.norm(t), atol=1e-2)
    assert got[1].n_h < 0.8 * got[1].n_e and got[2].n_h == 120
    assert got[4].n_e is None and got[4].q is None and got[4].inliers == []
    assert s.two_views(spark.createDataFrame([], schema)).count() == 0


def test_triangulation(spark):
    point, rows = np.array([0.5, -0.4, 10.0]), []
    for i in range(6):
        r, t = s.so3_exp(np.array([0, 0.02 * i, 0])), np.array([-0.8 * i, 0.1, 0.0])
        y = r @ point + t
        uv = y[:2] / y[2] + (0.3 if i == 4 else 0)
        rows.append((7, i, s.quat_of(r).tolist(), t.tolist(), float(uv[0]), float(uv[1])))
    rows.append((8, 0, *rows[0][2:]))
    got = {x.point: x for x in s.triangulate_tracks(spark.createDataFrame(rows, "point long, ord long, q array<double>, t array<double>, u double, v double")).collect()}
    np.testing.assert_allclose([got[7].x, got[7].y, got[7].z], point, atol=1e-6)
    assert got[7].n_inliers == 5 and got[8].x is None and got[8].n_inliers == 0


def test_registration(spark):
    x, r, t, _, uv = scene()
    uv = uv.copy()
    uv[:25] += 0.4
    rows = [(1, i, *map(float, uv[i]), *map(float, x[i]), 1000.0) for i in range(120)] + [(2, i, *map(float, uv[i]), *map(float, x[i]), 1000.0) for i in range(29)]
    got = {p.image: p for p in s.register_images(spark.createDataFrame(rows, "image long, idx long, u double, v double, x double, y double, z double, focal double")).collect()}
    np.testing.assert_allclose(s.rotation(got[1].q), r, atol=1e-6)
    np.testing.assert_allclose(got[1].t, t, atol=1e-5)
    assert got[1].n_inliers == 95 and got[2].q is None and got[2].n_inliers == 0


@pytest.mark.parametrize("n", [0, 3])
def test_too_few(n):
    x = np.zeros((n, 2))
    assert s.fundamental(x, x) is None and s.homography(x, x) is None and s.absolute_pose(x, np.zeros((n, 3))) is None
