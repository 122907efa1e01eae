"""Small cases of row changes, match graphs, feature limits, anchors and spacings."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from strataflow import store_queries
from strataflow.functions import geometry as g
from strataflow.operators import clouds, store
from strataflow.queries import SQL

XYZ = "id long, x double, y double, z double"


def found(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


def test_changes_of_rows(spark):
    own = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k long, v string")
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, store.upserted(own, new, ["k"]).collect()), key=key) == [(1, "a"), (2, "x"), (3, "y"), (None, "c")]
    assert sorted(map(tuple, store.updated(own, new, ["k"]).collect()), key=key) == [(1, "a"), (2, "x"), (None, "c")]
    assert sorted(map(tuple, store.deleted(own, new, ["k"]).collect()), key=key) == [(1, "a"), (None, "c")]
    assert found(store.retained(own, new, ["k"])) == [(2, "b")]
    assert found(store.upserted(own.limit(0), new, ["k"])) == [(2, "x"), (3, "y")]
    nulled = spark.createDataFrame([(2, None)], "k long, v string")
    assert ("2", None) in {(str(r.k), r.v) for r in store.updated(own, nulled, ["k"]).collect()}


def test_updates_repeat_no_row(spark, tmp_path):
    own = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (2, "y"), (3, "z")], "k long, v string")
    assert found(store.updated(own, new, ["k"])) == [(1, "a"), (2, "y"), (2, "y")]
    # order 0 of a third customer, whose negative is itself; a number that repeats; a number and its negative; none
    rows = [(0, 3, 1.0), (5, 3, 1.0), (5, 3, 1.0), (5, 6, 2.0), (5, 7, 3.0), (-5, 4, 4.0), (None, 3, 5.0), (8, None, 6.0), (9, 3, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = store_queries.updated_rows(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.sql(SQL["updated_rows"]).fetchall()))


@pytest.mark.parametrize("held, want", [([], [(7, 3), (8, 5), (9, 9)]), ([(9, 1)], [(7, 3), (9, 1), (10, 5), (11, 9)])])
def test_new_ids(spark, held, want):
    rows = spark.createDataFrame([(None, 9), (7, 3), (None, 5)], "k long, o long")
    assert found(store.added(spark.createDataFrame(held, "k long, o long"), rows, "k", "o")) == want
    alone = spark.createDataFrame([(None, 4)], "k long, o long")
    assert found(store.added(rows.limit(0), alone, "k", "o")) == [(1, 4)]


def test_match_graph(spark):
    m = spark.createDataFrame([(1, 2, 0, 0), (1, 2, 0, 0), (1, 2, 1, 9), (1, 2, 1, 9), (1, 3, 2, 0), (1, 3, 2, 1), (4, 4, 0, 0), (1, 8, 0, 0)], "image1 long, image2 long, idx1 long, idx2 long")
    sizes = spark.createDataFrame([(1, 3), (2, 3), (3, 3), (4, 3)], "image long, n long")
    edges = store.two_view_edges(m, sizes)
    assert found(store.insert_counts(edges)) == [(1, 2, 1, 2, 1), (1, 3, 2, 0, 0)]
    inside = edges.filter("inside")
    assert found(store.two_view_tracks(inside)) == [(1, 0, 2, 0)]
    linked = spark.createDataFrame([(2, 0, 70), (3, 0, 80), (3, 1, 80), (1, 1, None)], "image long, idx long, point long")
    posed = spark.createDataFrame([(3,)], "image long")
    assert found(store.correspondences_2d3d(inside, linked, posed)) == [(1, 2, 80)]
    assert found(store.visible_points(inside, linked)) == [(1, 2)]
    assert found(store.correspondences_2d3d(inside.limit(0), linked, posed)) == []


def test_focal_changes(spark):
    schema = "camera long, model int, focals array<double>"
    one = lambda *rows: spark.createDataFrame(list(rows), schema)
    change = lambda a, b: store.intrinsics_change(a, b).first()[0]
    assert change(one((1, 1, [100.0, 50.0])), one((1, 1, [101.0, 40.0]), (2, 1, [1.0]))) == pytest.approx(0.2)
    assert change(one((1, 1, [100.0])), one((1, 2, [100.0]))) == float("inf")
    assert change(one((1, 1, [0.0])), one((1, 1, [1.0]))) == float("inf")
    assert change(one((1, 1, [0.0])), one((1, 1, [0.0]))) == 0.0
    assert change(one((1, 1, [5.0])), one((2, 1, [9.0]))) == 0.0


def test_feature_limits(spark):
    rows = [(0, level, at, float(r), x, 1.0) for level, at, r, x in [(0, 0, 1, 1.0), (0, 1, -9, 1.0), (1, 0, 5, 9.0), (1, 1, 5, 1.0), (1, 2, 2, 1.0), (2, 0, 8, 9.0)]]
    own = spark.createDataFrame(rows, "image long, level int, at long, response double, x double, y double")
    place = ("level", "at")
    assert found(store.first_levels(own, 1), *place) == [(0, 0), (0, 1)]
    assert found(store.first_levels(own, 2), *place) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]
    assert found(store.strongest_features(own, 3), *place) == [(0, 0), (0, 1), (1, 0)]
    assert found(store.spread_features(own, 10.0, 10.0, 2, 3), *place) == [(0, 1), (1, 1), (2, 0)]
    assert found(store.spread_features(own, 10.0, 10.0, 2, 99), *place) == found(own, *place)


def test_anchors(spark):
    link = F.when(F.col("t").isNotNull(), g.sim(F.lit(2.0), g.vec(1, 0, 0, 0), g.vec(F.col("t"), 0, 0)))
    own = spark.createDataFrame([(0, 0, 9.0), (0, 1, 1.0), (0, 2, None), (0, 3, 3.0)], "chain long, zone long, t double").select("chain", "zone", link.alias("link"))
    got = store.anchors(own).select("zone", "to_latest.s", F.col("to_latest.t")[0].alias("tx"), "linked")
    assert found(got) == [(0, 4.0, 5.0, False), (1, 2.0, 3.0, True), (2, 2.0, 3.0, False), (3, 1.0, 0.0, True)]


def test_nearest_at_any_distance(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 50.0, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, None, 0.0, 0.0), (5, float("inf"), 0.0, 0.0)], XYZ)
    other = spark.createDataFrame([(7, 1.0, 0.0, 0.0), (8, -1.0, 0.0, 0.0), (9, float("nan"), 0.0, 0.0)], XYZ)
    assert found(store.nearest_any(points, other, 0.3)) == [(1, 7, 1.0), (2, 7, 49.0)]
    assert found(store.nearest_any(points, other.limit(0), 0.3)) == []
    assert found(store.nearest_any(points.limit(0), other, 0.3)) == []


def test_nearest_counts_positions_once(spark, monkeypatch):
    points = spark.createDataFrame([(i, float(i % 2), -0.0, 0.0) for i in range(20)] + [(7, 0.9, 0.0, 0.0), (99, 50.0, 0.0, 0.0), (98, None, 0.0, 0.0)], XYZ)
    other = spark.createDataFrame([(100 + i, 0.5 + i % 2, 0.0, 0.0) for i in range(40)], XYZ)
    meet, met = clouds.within_radius, []
    monkeypatch.setattr(clouds, "within_radius", lambda *a: met.append(meet(*a)) or met[-1])
    want = [(i, 100, 0.5) for i in range(20) if i != 7] + [(7, 100, 0.4)]
    assert [(i, o, round(d, 9)) for i, o, d in found(clouds.nearest(points, other, 2.0))] == sorted(want)
    assert met[0].count() == 6  # three positions, two of the reference


def test_gps_about_an_origin(spark):
    own = spark.createDataFrame([(1, "a", 36.0, 127.0, 10.0), (0, "b", 36.0, 127.0, 4.0)], "ord long, name string, lat double, lon double, alt double")
    assert [(n, round(u, 6)) for n, u in found(store.gps_to_enu(own), "name", "up")] == [("a", 6.0), ("b", 0.0)]
    assert [(n, round(u, 6)) for n, u in found(store.gps_to_enu(own, (36, 127, 0)), "name", "up")] == [("a", 10.0), ("b", 4.0)]
