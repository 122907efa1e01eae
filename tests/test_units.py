"""Small cases of the relational operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.functions import geodesy, ids
from strataflow.functions import geometry as g
from strataflow.operators import clouds, display, graph, matching, pairing, stats, tracks
from strataflow.plans import plan
from strataflow.sources import ply, text
from strataflow.streaming.reconcile import REPLAY_WINDOW, STRICT, Reconciler, reconcile, reconcile_stream


def test_zones(spark):
    got = spark.range(26).select(F.explode(pairing.zones_of(F.col("id"), 12, 2, F.lit(26))).alias("z")).select("z.*").distinct().orderBy("zone").collect()
    assert [tuple(r) for r in got] == [(0, 0, 14), (1, 10, 26), (2, 22, 26)]


def test_pairs_of_a_position(spark):
    rows = [(c, p, f"{c}/{p:03d}") for c in "abc" for p in range(18)]
    got = pairing.candidate_pairs(spark.createDataFrame(rows, "camera string, position long, name string"))
    assert got.filter("substr(name1, 3) = '000' and substr(name2, 3) = '000'").count() == 3
    assert got.filter("greatest(substr(name1, 3), substr(name2, 3)) = '017'").count() == 48


def test_track_selection(spark):
    t = spark.createDataFrame([(0, 3), (1, 5), (2, 4), (3, 4)], "track long, length long")
    assert [r.track for r in tracks.select_tracks(t, 2).collect()] == [1, 3]
    assert [r.track for r in tracks.select_tracks(t, 9).collect()] == [1, 3, 2, 0]


def test_track_consistency(spark):
    o = [(t, i, x, 0.0) for t, d in ((1, 5.0), (2, 15.0)) for i, x in (("a", 0.0), ("a", d), ("b", 0.0), ("c", 0.0))] + [(3, "a", None, 0.0)]
    got = {r.track: r.verdict for r in tracks.track_verdicts(spark.createDataFrame(o, "track long, image string, x double, y double")).collect()}
    assert got == {1: "valid", 2: "inconsistent", 3: "inconsistent"}


def test_observation_filter_takes_nan_as_bad(spark):
    o = spark.createDataFrame([(1, 0.0), (1, 0.0), (1, math.nan), (2, 0.0)], "point long, error double")
    assert sorted((r.point, r.action) for r in tracks.filter_observations(o, 1.0).collect()) == [(1, "drop"), (1, "keep"), (1, "keep"), (2, "drop_point")]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 99), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in graph.components(e).collect()}
    assert set(got.values()) == {0, 99} and got[30] == 0 and got[100] == 99
    near = graph.transitive(e, spark.createDataFrame([(5,)], "node long"), 2)
    assert sorted(r.node for r in near.collect()) == [3, 4, 6, 7]


def test_similarity_fit(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(50, 3))
    r = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    r *= np.sign(np.linalg.det(r))
    q = 2.5 * p @ r.T + [1, 2, 3]
    s, rotation, t = stats.umeyama(spark.createDataFrame(np.hstack([p, q]).tolist(), "x double, y double, z double, u double, v double, w double"))
    assert s == pytest.approx(2.5) and np.allclose(rotation, r) and np.allclose(t, [1, 2, 3])


def test_pose_inverse(spark):
    q = [math.cos(0.35), *(math.sin(0.35) * np.array([1, 2, 3]) / math.sqrt(14)).tolist()]
    row = spark.createDataFrame([(q, [4.0, 5.0, 6.0], [7.0, 8.0, 9.0])], "q array<double>, t array<double>, x array<double>")
    p = g.pose(F.col("q"), F.col("t"))
    there = row.select("q", "t", g.pose_apply(p, F.col("x")).alias("y"))
    back = there.select(g.pose_inverse(p).alias("i"), "y").select(g.pose_apply(F.col("i"), F.col("y")).alias("x"))
    assert np.allclose(back.first().x, [7, 8, 9])


def test_names(spark):
    n = spark.createDataFrame([("camF/camF_0012.jpg",), ("x.png",)], "n string")
    assert [tuple(r) for r in n.select(ids.position_index(F.col("n")), ids.image_folder(F.col("n"))).collect()] == [(12, "camF"), (None, "")]


def test_diff_and_mirror(spark):
    schema = "key long, x double, y double, z double, color string, zone int"
    before = spark.createDataFrame([(1, 0.0, 0.0, 0.0, "a", 0), (2, 0.0, 0.0, 0.0, "a", 0), (3, 0.0, 0.0, 0.0, "a", 0)], schema)
    after = spark.createDataFrame([(1, 0.0, 0.0, 0.5, "a", 0), (3, 0.0, 0.0, 0.0, "a", 1), (4, 0.0, 0.0, 0.0, "a", 0)], schema)
    delta = display.keyed_diff(before, after)
    assert sorted((r.op, r.key) for r in delta.collect()) == [("add", 3), ("add", 4), ("move", 1), ("remove", 2), ("remove", 3)]
    assert sorted(map(tuple, display.apply_delta(before, delta).collect())) == sorted(map(tuple, after.collect()))


def test_merge_fills(spark):
    a = spark.createDataFrame([(1.0, 0.5)], "x double, nx double")
    b = spark.createDataFrame([(2.0, 7)], "x double, r int")
    assert sorted(tuple(r) for r in clouds.merge_clouds(a, b).select("x", "nx", "r").collect()) == [(1.0, 0.5, 255), (2.0, 0.0, 7)]


def test_reconciler():
    m = Reconciler(REPLAY_WINDOW, 2)
    said = [m.offer(1, s, r)[0] for s, r in ((1, 0), (4, 0), (4, 0), (4, 1), (3, 0), (0, 0), (5, 0))]
    assert said == ["appended", "appended", "duplicate", "replayed", "replayed", "ignored", "appended"]
    assert m.order == [1, 3, 4, 5] and Reconciler(STRICT, order=[1], revisions={1: 0}, source=1).offer(1, 3, 0)[:2] == ("rejected", "gap")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(n, a, 1, (a * 7) % 11, a % 2) for n in (1, 2) for a in range(40)]
    schema = "node long, arrival long, source long, sequence long, revision long"
    df = spark.createDataFrame(rows, schema)
    for k in range(4):
        df.filter(f"arrival div 10 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = reconcile_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.node, r.arrival, r.outcome) for r in spark.table("outcomes").collect())
    assert got == sorted((r.node, r.arrival, r.outcome) for r in reconcile(df).collect())


def test_gps_and_pairs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("camF_1  36.0 127.0 30\n\n camL_1\t36.1 127.1 31 \n")
    assert [tuple(r)[1:] for r in text.read_gps(spark, str(tmp_path / "a.txt")).orderBy("ord").collect()] == [("camF_1", 36.0, 127.0, 30.0), ("camL_1", 36.1, 127.1, 31.0)]
    (tmp_path / "b.txt").write_text("# no comment\n")
    with pytest.raises(Exception, match="GPS line 1"):
        text.read_gps(spark, str(tmp_path / "b.txt")).collect()
    (tmp_path / "p.txt").write_text("# c\na b\n\n")
    assert [tuple(r)[1:] for r in text.read_pairs(spark, str(tmp_path / "p.txt")).collect()] == [("a", "b")]


@pytest.mark.parametrize("layout", ply.LAYOUTS)
def test_ply(spark, tmp_path, layout):
    cloud = spark.createDataFrame([(1.0, 2.0, 3.0, 0.0, 0.0, 1.0, 9, 8, 7)], ply.COLUMNS)
    (tmp_path / "c.ply").write_bytes(ply.ply_parts(cloud, layout).first().content)
    (tmp_path / "d.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nproperty float q\nend_header\n4 5 6 1\n")
    got = sorted(tuple(r)[1:] for r in ply.read_ply(spark, str(tmp_path / "*.ply")).collect())
    assert got == [(0, 1.0, 2.0, 3.0, 0.0, 0.0, 1.0, 9, 8, 7), (0, 4.0, 5.0, 6.0, None, None, None, None, None, None)]


def test_plan():
    assert plan.parse(plan.to_toml(plan.Plan())) == plan.Plan()
    assert plan.parse("[zones]\nspan = 6").zones.span == 6
    for bad in ("[zones]\nspam = 6", "[live]\npolicy = 'x'"):
        with pytest.raises(ValueError):
            plan.parse(bad)


def test_poles_and_zero_inputs(spark):
    b = geodesy.SEMI_MAJOR * (1 - geodesy.FLATTENING)
    frame = spark.createDataFrame([(0.0, 0.0, b + 12.0), (0.0, 0.0, -b - 12.0), (1e-3, 0.0, b + 12.0)], "x double, y double, z double")
    found = [tuple(r) for r in frame.select(*geodesy.ecef_to_lla(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert [round(r[0], 6) for r in found] == [90.0, -90.0, 90.0] and all(abs(r[2] - 12.0) < 1e-3 for r in found)
    one = spark.range(1)
    row = one.select(g.quat_from_axis_angle(g.vec(0, 0, 0), F.lit(1.0)).alias("q"), g.quat_rotate(g.vec(0, 0, 0, 2), g.vec(1, 0, 0)).alias("v"), g.quat_angular_distance(g.vec(2, 0, 0, 0), g.vec(-3, 0, 0, 0)).alias("d"), matching.quantize(g.vec(0, 0)).alias("z"), g.mat_inverse(g.vec(*[1] * 9)).alias("m")).first()
    assert (row.q, row.d, row.z, row.m) == ([1.0, 0.0, 0.0, 0.0], 0.0, [0, 0], None)
    assert [round(x, 9) for x in row.v] == [-1.0, 0.0, 0.0]
    samples = spark.createDataFrame([(1, 0.0, 2.0), (1, 0.0, 2.0), (2, 1.9, 2.0), (3, 1.0, 0.0), (4, 0.0, 2.0)], "key int, depth double, observed double")
    assert {tuple(r) for r in clouds.visibility_votes(samples, 0.1).collect()} == {(1, 0, 2), (2, 1, 0), (4, 0, 1)}
    assert sorted(r.key for r in clouds.visible_keys(samples, 0.1).collect()) == [2, 4]


def test_keyed_diff_sees_nulls_and_keeps_the_first_of_a_key(spark):
    schema = "key int, x double, y double, z double, color string, zone int"
    before = spark.createDataFrame([(1, 0.0, 0.0, 0.0, None, 0), (2, 0.0, 0.0, 0.0, "r", None), (3, 0.0, 0.0, 0.0, "r", 1)], schema)
    after = spark.createDataFrame([(1, 0.0, 0.0, 0.0, "r", 0), (2, 0.0, 0.0, 0.0, "r", 3), (3, float("nan"), 0.0, 0.0, "r", 1), (4, 1.0, 0.0, 0.0, "r", 2), (4, 9.0, 0.0, 0.0, "r", 3)], schema)
    delta = display.keyed_diff(before, after)
    assert sorted((r.op, r.key, r.zone) for r in delta.select("op", "key", F.coalesce("zone", F.lit(-1)).alias("zone")).collect()) == [("add", 2, 3), ("add", 4, 2), ("move", 1, 0), ("remove", 2, -1), ("remove", 3, 1)]
    assert sorted((r.key, r.x, r.zone) for r in display.apply_delta(before, delta).collect()) == [(1, 0.0, 0), (2, 0.0, 3), (4, 1.0, 2)]


def test_strict_rejects_whatever_would_be_ignored():
    machine = Reconciler(STRICT)
    offers = [(1, 1, 2), (2, 2, 0), (1, 1, 1), (1, 1, 3), (1, 1, 2), (1, 3, 0), (1, 2, 0), (1, 1, 9)]
    assert [machine.offer(*x)[0] for x in offers] == ["appended", "rejected", "rejected", "rejected", "duplicate", "rejected", "appended", "rejected"]


def test_required_tracks(spark):
    own = {0: "abc", 1: "ab", 2: "ab", 3: "cd", 4: "d"}
    members = spark.createDataFrame([(t, i) for t, images in own.items() for i in images], "track long, image string")
    lengths = spark.createDataFrame([(t, len(x)) for t, x in own.items()], "track long, length long")
    assert tracks.required_tracks(lengths, members, 0) == [0, 3]
    assert tracks.required_tracks(lengths, members, 1) == [0, 3, 2, 4]
    assert tracks.required_tracks(lengths, members, 9, limit=3) == [0, 3, 2]


def test_view_graph_filters(spark):
    q = lambda a: [math.cos(a / 2), 0.0, 0.0, math.sin(a / 2)]
    edges = spark.createDataFrame([(1, 2, q(0.5), True), (2, 3, q(0.9), True), (7, 8, q(0.0), True), (3, 7, q(0.0), False)], "u long, v long, q array<double>, valid boolean")
    rotations = spark.createDataFrame([(1, q(0.0)), (2, q(0.5)), (3, q(1.0))], "node long, q array<double>")
    assert {(r.u, r.v): r.valid for r in graph.rotation_outliers(edges, rotations, 0.2).collect()} == {(1, 2): True, (2, 3): False, (7, 8): True, (3, 7): False}
    assert {(r.u, r.v): r.valid for r in graph.invalidate_outside(edges).collect()} == {(1, 2): True, (2, 3): True, (7, 8): False, (3, 7): False}


def test_append_only_windows_equal_the_state_machine(spark):
    rng = np.random.default_rng(2)
    rows = [(int(n), a, int(rng.integers(1, 3)) if a % 9 == 4 else 1, int(rng.integers(a // 4, a // 4 + 5)), int(rng.integers(0, 3))) for n in range(3) for a in range(80)]
    found = reconcile(spark.createDataFrame(rows, "node long, arrival long, source long, sequence long, revision long")).collect()
    want = []
    for node in range(3):
        machine = Reconciler()
        want += [(*r, *machine.offer(*r[2:])) for r in rows if r[0] == node]
    assert sorted(map(tuple, found), key=lambda r: r[:2]) == want
    assert {r.outcome for r in found} == {"appended", "duplicate", "ignored"} and len({r.reason for r in found}) == 5
