"""Queries of column functions and of cloud, graph and track operators over the driver tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.functions import camera, features, geodesy, scoring
from strataflow.functions import geometry as g
from strataflow.operators import clouds, graph, stats, tracks
from strataflow.queries import query, table


def _r(column, name: str, places: int = 6):
    return (F.round(column, places) + 0.0).alias(name)


def _rounded(**columns: str) -> str:
    return ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in columns.items())


# --- cameras

_PART = "p AS (SELECT p_partkey AS k, p_partkey % 5 AS model, p_retailprice AS f, 640 + p_size AS w, 480 AS h, (p_partkey % 5) IN (1, 4) AS two FROM part)"


@query(f"""
    WITH {_PART} SELECT k, CAST(CASE model WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 8 END AS INT) AS n,
        {_rounded(fx="f", cx="w / 2.0", threshold="4 / f", fx2="f * 0.5", cx2="w / 4.0", fx3="CASE WHEN two THEN f * 320 / w ELSE f * (320.0 / w + 360.0 / h) / 2 END", cy3="180.0")},
        CAST(greatest(1, round(w * 0.5)) AS BIGINT) AS w2, f / w < 1.5 OR f / w > 2.5 AS odd FROM p""")
def camera_intrinsics(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    m, f, w, h = (F.col("p_partkey") % 5).cast("int"), F.col("p_retailprice"), (640 + F.col("p_size")).cast("double"), F.lit(480.0)
    own = p.select(F.col("p_partkey").alias("k"), m.alias("m"), w.alias("w"), h.alias("h"), camera.from_focal(m, f, w, h).alias("p"))
    half = camera.rescaled(F.col("m"), F.col("p"), F.col("w"), F.col("h"), F.lit(0.5))
    other = camera.rescaled_to(F.col("m"), F.col("p"), F.col("w"), F.col("h"), F.lit(320.0), F.lit(360.0))
    k = camera.calibration_matrix(F.col("m"), F.col("p"))
    return own.select(
        "k", camera.parameter_count(F.col("m")).alias("n"), _r(k[0], "fx"), _r(k[2], "cx"), _r(camera.camera_threshold(F.col("m"), F.col("p"), F.lit(4.0)), "threshold"),
        _r(camera.focal_x(F.col("m"), half["params"]), "fx2"), _r(camera.centre_x(F.col("m"), half["params"]), "cx2"), half["width"].alias("w2"),
        _r(camera.focal_x(F.col("m"), other["params"]), "fx3"), _r(camera.centre_y(F.col("m"), other["params"]), "cy3"),
        camera.implausible(F.col("m"), F.col("p"), F.col("w"), F.col("h"), 1.5, 2.5, 1.0).alias("odd"),
    )


@query("SELECT l_orderkey, l_linenumber, round(l_discount * 4, 5) + 0.0 AS u, round(l_tax * 4 - 0.1, 5) + 0.0 AS v FROM lineitem")
def undistorted_points(spark, sf_dir):
    """Points projected with distortion and brought back: the points themselves."""
    p = F.array(*map(F.lit, (800.0, 810.0, 500.0, 400.0, 0.05, -0.01, 0.002, -0.001)))
    own = table(spark, sf_dir, "lineitem").withColumns({"u": F.col("l_discount") * 4, "v": F.col("l_tax") * 4 - 0.1})
    x, y = camera.project(F.lit(4), p, F.col("u"), F.col("v"), F.lit(1.0))
    return own.select("l_orderkey", "l_linenumber", camera.undistorted(F.lit(4), p, x, y).alias("q")).select("l_orderkey", "l_linenumber", _r(F.col("q.u"), "u", 5), _r(F.col("q.v"), "v", 5))


# --- rotations, poses and errors


@query("SELECT l_orderkey, l_linenumber, round(l_discount * 9, 6) + 0.0 AS x, round(l_tax * 9 - 0.3, 6) + 0.0 AS y, round(l_linenumber / 4.0 - 1, 6) + 0.0 AS z, 0.0 AS apart FROM lineitem")
def rotation_round_trip(spark, sf_dir):
    """Rotation vector to quaternion, to matrix, and back: the vector itself."""
    own = table(spark, sf_dir, "lineitem").withColumn("v", g.vec(F.col("l_discount") * 9, F.col("l_tax") * 9 - 0.3, F.col("l_linenumber") / 4.0 - 1))
    own = own.withColumn("m", g.rotation_matrix(g.quat_from_rotation_vector(F.col("v"))))
    own = own.withColumn("q", g.quat_from_matrix(F.col("m"))).withColumn("back", g.quat_to_rotation_vector(F.col("q")))
    return own.select("l_orderkey", "l_linenumber", *[_r(F.col("back")[i], c) for i, c in enumerate("xyz")], _r(g.rotation_angle_between(F.col("m"), g.rotation_matrix(F.col("q"))), "apart", 5))


@query(f"""
    WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y, 5.0 + l_tax * 100 AS z FROM lineitem),
         d AS (SELECT *, (x * (x - 3) + y * y + z * z) / sqrt((x * x + y * y + z * z) * ((x - 3) * (x - 3) + y * y + z * z)) AS cosine FROM c)
    SELECT l_orderkey, l_linenumber, {_rounded(angle="least(acos(greatest(-1, least(1, cosine))), pi() - acos(greatest(-1, least(1, cosine))))", widest="least(acos(greatest(-1, least(1, cosine))), pi() - acos(greatest(-1, least(1, cosine))))", baseline="3.0")} FROM d""")
def triangulation_angles(spark, sf_dir):
    point, one, two = g.vec(F.col("l_quantity"), F.col("l_discount") * 100, 5.0 + F.col("l_tax") * 100), g.vec(0, 0, 0), g.vec(3, 0, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _r(g.triangulation_angle(one, two, point), "angle"), _r(g.max_triangulation_angle(F.array(one, two, one), point), "widest"), _r(g.baseline(one, two), "baseline"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity, 5) + 0.0 AS x, round(l_discount, 5) + 0.0 AS y, round(l_tax, 5) + 0.0 AS z, round(l_quantity, 5) + 0.0 AS sx FROM lineitem")
def pose_round_trip(spark, sf_dir):
    """A point moved by a pose and its inverse, by a similarity and its inverse: the point itself."""
    q = g.quat_from_axis_angle(g.vec(F.col("l_tax"), F.col("l_discount"), F.lit(1.0)), F.col("l_linenumber").cast("double"))
    point, t = g.vec(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")), g.vec(F.lit(1.0), F.col("l_quantity"), F.lit(-3.0))
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", point.alias("point"), g.pose(q, t).alias("p"), g.sim(1 + F.col("l_discount"), q, t).alias("s"))
    own = own.withColumns({"pi": g.pose_inverse(F.col("p")), "si": g.sim_inverse(F.col("s"))})
    own = own.withColumns({"pc": g.pose_compose(F.col("pi"), F.col("p")), "sc": g.sim_compose(F.col("si"), F.col("s"))})
    own = own.select("l_orderkey", "l_linenumber", g.pose_apply(F.col("pc"), F.col("point")).alias("a"), g.sim_apply(F.col("sc"), F.col("point")).alias("b"))
    return own.select("l_orderkey", "l_linenumber", *[_r(F.col("a")[i], c, 5) for i, c in enumerate("xyz")], _r(F.col("b")[0], "sx", 5))


@query(f"""
    WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 1.5 AS x2, l_tax * 100 AS y2 FROM lineitem),
         e AS (SELECT *, 2 * y1 - 3 AS a0, -2 * x1 + 1 AS a1, 3 * x1 - y1 AS a2, -2 * y2 + 3 AS b0, 2 * x2 - 1 AS b1 FROM c)
    SELECT l_orderkey, l_linenumber, {_rounded(sampson="(x2 * a0 + y2 * a1 + a2) ** 2 / (a0 * a0 + a1 * a1 + b0 * b0 + b1 * b1)", transfer="(2 * x1 / (1 + 0.01 * y1) - x2) ** 2 + (3 * y1 / (1 + 0.01 * y1) - y2) ** 2")} FROM e""")
def match_errors(spark, sf_dir):
    x1, y1, x2, y2 = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_quantity") + 1.5, F.col("l_tax") * 100
    f, h = g.skew(g.vec(-1, -3, -2)), g.vec(2, 0, 0, 0, 3, 0, 0, 0.01, 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _r(g.sampson_error_sq(f, x1, y1, x2, y2), "sampson"), _r(g.homography_transfer_error_sq(h, x1, y1, x2, y2), "transfer"))


@query("SELECT c_custkey AS k, round(36 + c_custkey % 1000 / 1000.0, 6) AS lat, round(127 + c_custkey % 777 / 1000.0, 6) AS lon, round(c_acctbal / 100, 4) + 0.0 AS alt FROM customer")
def enu_round_trip(spark, sf_dir):
    c, k, at = table(spark, sf_dir, "customer"), F.col("c_custkey"), [F.lit(x) for x in (36.2, 127.3, 30.0)]
    enu = geodesy.ecef_to_enu(*geodesy.lla_to_ecef(36 + k % 1000 / 1000.0, 127 + k % 777 / 1000.0, F.col("c_acctbal") / 100), *at)
    lat, lon, alt = geodesy.enu_to_lla(F.col("e"), F.col("n"), F.col("u"), *at)
    return c.select(k.alias("k"), *[x.alias(a) for x, a in zip(enu, "enu")]).select("k", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), _r(alt, "alt", 4))


# --- images


@query(f"""
    WITH k AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_tax * 100 AS y, 2 + l_discount AS s, l_linenumber / 2.0 AS o, l_linenumber % 4 AS t FROM lineitem)
    SELECT l_orderkey, l_linenumber, {_rounded(x="CASE t WHEN 0 THEN 2 * x WHEN 1 THEN 3 * y WHEN 2 THEN 100 - 2 * x ELSE 60 - 3 * y END", y="CASE t WHEN 0 THEN 3 * y WHEN 1 THEN 100 - 2 * x WHEN 2 THEN 60 - 3 * y ELSE 2 * x END", scale="s", turned="s * cos(o)")} FROM k""")
def keypoint_shapes(spark, sf_dir):
    k = features.keypoint(F.col("l_quantity"), F.col("l_tax") * 100, 2 + F.col("l_discount"), F.col("l_linenumber") / 2.0)
    own = table(spark, sf_dir, "lineitem").withColumn("k", k)
    t = features.keypoint_turned(features.keypoint_rescaled(F.col("k"), F.lit(2.0), F.lit(3.0)), F.col("l_linenumber"), F.lit(100.0), F.lit(60.0))
    return own.withColumn("t", t).select("l_orderkey", "l_linenumber", _r(F.col("t.x"), "x"), _r(F.col("t.y"), "y"), _r(features.keypoint_scale(F.col("k")), "scale"), _r(F.col("k.a11"), "turned"))


@query("""
    SELECT p_partkey AS k, CAST(CASE WHEN w > 900 THEN greatest(1, round(w * (900.0 / w))) ELSE w END AS BIGINT) AS w, CAST(CASE WHEN w > 900 THEN greatest(1, round(100 * (900.0 / w))) ELSE 100 END AS BIGINT) AS h,
           CAST(round(0.2126 * (p_partkey % 256) + 0.7152 * (p_size * 5) + 0.0722 * (p_partkey % 200)) AS INT) AS gray,
           CASE p_partkey % 9 WHEN 3 THEN 2 WHEN 6 THEN 3 WHEN 8 THEN 1 ELSE 0 END AS turns, CASE p_partkey % 9 WHEN 6 THEN 1.0 WHEN 8 THEN -1.0 WHEN 1 THEN 0.0 WHEN 3 THEN 0.0 END AS down_x
    FROM (SELECT *, 300 + p_partkey AS w FROM part)""")
def image_sizes(spark, sf_dir):
    k = F.col("p_partkey")
    size = features.limited_size(300 + k, F.lit(100), 900)
    return table(spark, sf_dir, "part").select(k.alias("k"), size["width"].alias("w"), size["height"].alias("h"), features.gray(k % 256, F.col("p_size") * 5, k % 200).alias("gray"), features.quarter_turns(k % 9).alias("turns"), features.gravity(k % 9)[0].alias("down_x"))


@query("""
    SELECT p_partkey AS k, p_partkey % 4 < 3 AS prior, round(CASE p_partkey % 4 WHEN 0 THEN p_size / 43.27 * sqrt(640.0 * 640 + 480 * 480) WHEN 1 THEN p_size * 300 / 25.4 WHEN 2 THEN p_size / 6.4 * 640 ELSE 1.2 * 640 END, 6) AS focal FROM part""")
def inferred_focals(spark, sf_dir):
    k, mm = F.col("p_partkey") % 4, F.col("p_size").cast("double")
    none = F.lit(None).cast("double")
    found = features.infer_focal(F.when(k == 0, mm), F.when(k != 3, mm), F.when(k == 1, 300.0).otherwise(none), F.lit(2), F.when(k == 2, 6.4), F.lit(640.0), F.lit(480.0), 1.2)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), found["prior"].alias("prior"), F.round(found["focal"], 6).alias("focal"))


# --- losses and priors


@query(f"""
    SELECT l_orderkey, l_linenumber, {_rounded(huber="CASE WHEN s > 4 THEN 4 * sqrt(s) - 4 ELSE s END", huber_slope="CASE WHEN s > 4 THEN 2 / sqrt(s) ELSE 1 END", soft="8 * (sqrt(1 + s / 4) - 1)", soft_curve="-1 / (8 * (1 + s / 4) * sqrt(1 + s / 4))", cauchy="4 * ln(1 + s / 4)", cauchy_scale="sqrt(1 / (1 + s / 4))", trivial="s")}
    FROM (SELECT l_orderkey, l_linenumber, l_quantity / 5 AS s FROM lineitem)""")
def robust_losses(spark, sf_dir):
    s = F.col("l_quantity") / 5
    huber, soft, cauchy = (scoring.loss(k, s, 2.0) for k in ("huber", "soft_l1", "cauchy"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", _r(huber[0], "huber"), _r(huber[1], "huber_slope"), _r(soft[0], "soft"), _r(soft[2], "soft_curve"),
        _r(cauchy[0], "cauchy"), _r(scoring.loss_weight("cauchy", s, 2.0)[1], "cauchy_scale"), _r(scoring.loss("trivial", s)[0], "trivial"),
    )


@query(f"""
    WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity / 30 AS cost, 1 - l_discount AS c FROM lineitem),
         e AS (SELECT *, 2 / (sqrt(2 * pi()) * 0.6 * 0.999141896) * exp(-cost * cost / 0.72) AS e FROM p)
    SELECT l_orderkey, l_linenumber, {_rounded(visible="round(e / (e + 0.5), 5)", angle="CASE WHEN c > 0.95 THEN 1 - (1 - (1 - c) / 0.05) ** 2 ELSE 1 END", incident="exp(-((1 - c) ** 2) / 0.08)", weight="1 / ((4 * (0.5 + 0.1 * least(2, cost)) / 200) ** 2)", sure="greatest(0, least(1, 1 - cost))", depth="3 * (0.5 + c) / (0.4 + c)")} FROM e""")
def view_priors(spark, sf_dir):
    import math

    cost, c = F.col("l_quantity") / 30, 1 - F.col("l_discount")
    plane = scoring.plane_transfer(F.lit(3.0), g.vec(0, F.lit(0.0), -1), g.vec(F.lit(0.0), F.lit(0.0), 0.5 + c), g.vec(F.lit(0.0), F.lit(0.0), 0.4 + c))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", _r(F.round(scoring.visibility_probability(cost, 0.6), 5), "visible"), _r(scoring.triangulation_prior(c, math.acos(0.95)), "angle"), _r(scoring.incident_prior(c, 0.2), "incident"),
        _r(scoring.inverse_variance(F.lit(2.0), cost, F.lit(100.0), F.lit(2.0), 0.5, 0.1), "weight"), _r(scoring.confidence(cost), "sure"), _r(plane, "depth"),
    )


# --- clouds

_NEAR = "p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS f, l_quantity * 3 AS x, l_discount * 200 AS y, l_tax * 200 AS z, l_orderkey AS o FROM lineitem), a AS (SELECT * FROM p WHERE f = 'A' AND o % 8 = 1), b AS (SELECT * FROM p WHERE f = 'R' AND o % 8 = 2)"


def _near(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("f"), (F.col("l_quantity") * 3).alias("x"), (F.col("l_discount") * 200).alias("y"), (F.col("l_tax") * 200).alias("z"), F.col("l_orderkey").alias("o"))
    return p.filter("f = 'A' and o % 8 = 1"), p.filter("f = 'R' and o % 8 = 2")


@query(f"""
    WITH {_NEAR}, m AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM a, b WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 9.5)
    SELECT id, count(*) AS n, round(min(d), 6) AS nearest FROM m GROUP BY id""")
def radius_neighbours(spark, sf_dir):
    a, b = _near(spark, sf_dir)
    return clouds.within_radius(a, b, 9.5**0.5).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("distance"), 6).alias("nearest"))


@query(f"""
    WITH {_NEAR}, m AS (SELECT a.id, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM a, b GROUP BY a.id)
    SELECT id, round(sqrt(d), 6) AS distance FROM m WHERE d <= 20.5""")
def nearest_points(spark, sf_dir):
    a, b = _near(spark, sf_dir)
    return clouds.nearest(a, b, 20.5**0.5).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_NEAR} SELECT id FROM a UNION ALL SELECT id FROM b WHERE id NOT IN (SELECT b.id FROM a, b WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 9.5)")
def snapshot(spark, sf_dir):
    a, b = _near(spark, sf_dir)
    return clouds.compose_snapshot(a, b, 9.5**0.5, key="id").select("id")


@query("""
    WITH r AS (SELECT l_suppkey AS "view", l_quantity AS d, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) - 1 AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
    SELECT "view", round(max(CASE WHEN k = floor(0.01 * (n - 1)) THEN d END) * 0.75, 6) AS near, round(max(CASE WHEN k = floor(0.99 * (n - 1)) THEN d END) * 1.25, 6) AS far FROM r GROUP BY "view" """)
def depth_ranges(spark, sf_dir):
    out = clouds.depth_ranges(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("view"), F.col("l_quantity").alias("depth")))
    return out.select("view", F.round("near", 6).alias("near"), F.round("far", 6).alias("far"))


@query("""
    SELECT CAST(l_orderkey AS BIGINT) AS key, round(2 * l_quantity + 1, 6) AS x, round(-2 * l_tax + 2, 6) AS y, round(2 * l_discount + 3, 6) AS z, 0.0 AS nx, 0.0 AS ny, 1.0 AS nz FROM lineitem WHERE l_linenumber = 1
    UNION ALL SELECT o_orderkey, round(2 * o_totalprice + 1, 6), 2.0, 3.0, 0.0, 0.0, 0.0 FROM orders""")
def merged_and_moved_clouds(spark, sf_dir):
    """Points with normals and points without, in one cloud, turned a quarter about x, doubled and shifted."""
    a = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"), F.lit(0.0).alias("nx"), F.lit(1.0).alias("ny"), F.lit(0.0).alias("nz"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    moved = clouds.transform_cloud(clouds.merge_clouds(a, b), 2.0, [1.0, 0, 0, 0, 0, -1.0, 0, 1.0, 0], [1.0, 2.0, 3.0])
    return moved.select("key", *[_r(F.col(c), c) for c in ("x", "y", "z", "nx", "ny", "nz")])


# --- graphs and tracks


@query("""
    WITH e AS (SELECT DISTINCT s_suppkey % 40 AS u, 40 + s_nationkey AS v FROM supplier), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
         s AS (SELECT u AS start, v AS node, 1 AS hops FROM b WHERE u < 4),
         t AS (SELECT start, b.v AS node, 2 AS hops FROM s JOIN b ON b.u = s.node UNION SELECT start, node, hops FROM s)
    SELECT start, node, min(hops) AS hops FROM t WHERE node <> start GROUP BY start, node""")
def transitive_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 40).alias("u"), (40 + F.col("s_nationkey")).cast("long").alias("v")).distinct()
    return graph.transitive(e, spark.range(4).select(F.col("id").alias("node")), 2)


@query("""
    WITH m AS (SELECT l_partkey AS image, l_suppkey + 1000000 AS other, l_linenumber AS idx FROM lineitem UNION ALL SELECT l_suppkey + 1000000, l_partkey, CAST(l_quantity AS BIGINT) FROM lineitem)
    SELECT image, count(DISTINCT other) AS pairs, count(*) AS matches, count(DISTINCT idx) AS observations FROM m GROUP BY image""")
def pair_counts(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("image1"), (F.col("l_suppkey") + 1000000).alias("image2"), F.col("l_linenumber").cast("long").alias("idx1"), F.col("l_quantity").cast("long").alias("idx2"))
    return graph.pair_counts(m)


@query("""
    WITH RECURSIVE e AS (SELECT o_orderkey * 2 AS u, o_custkey * 2 + 1 AS v FROM orders WHERE o_custkey % 3 = 0), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
         w AS (SELECT u AS node, u AS c FROM b UNION SELECT b.v, w.c FROM w JOIN b ON b.u = w.node WHERE w.c < b.v OR w.c > b.v), n AS (SELECT node, min(c) AS c FROM w GROUP BY node),
         t AS (SELECT c FROM n GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)
    SELECT node FROM n WHERE c IN (SELECT c FROM t)""")
def largest_component(spark, sf_dir):
    return graph.largest_component(table(spark, sf_dir, "orders").filter("o_custkey % 3 = 0").select((F.col("o_orderkey") * 2).alias("u"), (F.col("o_custkey") * 2 + 1).alias("v")))


@query("""
    WITH n AS (SELECT l_orderkey, l_linenumber, l_quantity - 8 AS d, count(*) OVER (PARTITION BY l_orderkey) AS n, count_if(l_quantity < 8 OR l_quantity = 8) OVER (PARTITION BY l_orderkey) AS bad FROM lineitem)
    SELECT l_orderkey AS point, l_linenumber, CASE WHEN bad > 0 AND n - bad < 2 THEN 'drop_point' WHEN d <= 0 THEN 'drop' ELSE 'keep' END AS action FROM n""")
def points_behind_cameras(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("point"), "l_linenumber", (F.col("l_quantity") - 8).alias("depth"))
    return tracks.behind_camera(o).select("point", "l_linenumber", "action")


@query("SELECT l_orderkey AS point, round(avg(l_discount), 6) AS error FROM lineitem GROUP BY l_orderkey")
def point_errors(spark, sf_dir):
    return tracks.point_errors(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("point"), F.col("l_discount").alias("error"))).select("point", F.round("error", 6).alias("error"))


@query("""
    SELECT l_partkey AS "group", round(sum(l_quantity * l_linenumber) / sum(l_linenumber), 6) AS x, round(sum(l_discount * l_linenumber) / sum(l_linenumber), 6) AS y, round(sum(l_tax * l_linenumber) / sum(l_linenumber), 6) AS z, CAST(sum(l_linenumber) AS BIGINT) AS length
    FROM lineitem GROUP BY l_partkey""")
def merged_points(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("group"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"), F.col("l_linenumber").alias("length"))
    return tracks.merged_points(p).select("group", *[F.round(c, 6).alias(c) for c in "xyz"], "length")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity - 20) ** 2 + (l_discount * 100) ** 2 > 16")
def moving_matches(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("y1"), F.lit(20.0).alias("x2"), F.lit(0.0).alias("y2"))
    return tracks.moving_matches(m).select("l_orderkey", "l_linenumber")


@query("""
    WITH c AS (SELECT l_orderkey AS point, count(*) AS n, max(l_suppkey % 50) - min(l_suppkey % 50) AS wide FROM lineitem GROUP BY l_orderkey)
    SELECT point, n AS observations FROM c WHERE wide < 2 OR n < 2""")
def points_seen_under_small_angles(spark, sf_dir):
    """Centres on a circle about the point, one degree a step: an angle is the difference of their steps."""
    step = F.radians((F.col("l_suppkey") % 50).cast("double"))
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("point"), g.vec(10 * F.cos(step), 10 * F.sin(step), F.lit(0.0)).alias("centre"), g.vec(0, 0, 0).alias("xyz"))
    return tracks.small_angle_points(o, 0.0262).select("point", "observations")


@query("SELECT event_type AS stage, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY event_type")
def stage_times(spark, sf_dir):
    return stats.stage_times(table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))).select("stage", F.round("total", 4).alias("total"), "n")


@query("SELECT 2.0 AS scale, 1.0 AS tx, 2.0 AS ty, 3.0 AS tz, count(*) AS kept FROM lineitem WHERE l_orderkey % 13 <> 0")
def robust_similarity(spark, sf_dir):
    """Points turned a quarter about z, doubled and shifted, with every thirteenth order's far off: the transform comes back."""
    x, y, z = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100
    off = F.when(F.col("l_orderkey") % 13 == 0, 500.0).otherwise(0.0)
    pairs = table(spark, sf_dir, "lineitem").select(x.alias("x"), y.alias("y"), z.alias("z"), (1 - 2 * y).alias("u"), (2 + 2 * x + off).alias("v"), (3 + 2 * z).alias("w"))
    (scale, _, shift), _, kept = stats.robust_umeyama(pairs)
    return spark.createDataFrame([(round(scale, 5), *[round(float(v), 3) for v in shift], kept)], "scale double, tx double, ty double, tz double, kept long")
