"""Queries of the relational operators over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import camera, geodesy, ids
from strataflow.functions import geometry as g
from strataflow.operators import clouds, display, graph, matching, pairing, stats, tracks
from strataflow.operators.common import numbered
from strataflow.streaming import reconcile as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
    SELECT l_orderkey, l_linenumber, 2147483647 * least(l_partkey, l_suppkey) + greatest(l_partkey, l_suppkey) AS pair,
           least(l_partkey, l_suppkey) AS first, greatest(l_partkey, l_suppkey) AS second, l_partkey > l_suppkey AS swapped FROM lineitem""")
def pair_ids(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").withColumn("pair", ids.pair_id(F.col("l_partkey"), F.col("l_suppkey")))
    first, second = ids.pair_images(F.col("pair"))
    return own.select("l_orderkey", "l_linenumber", "pair", first.alias("first"), second.alias("second"), ids.swapped(F.col("l_partkey"), F.col("l_suppkey")).alias("swapped"))


def _images(spark, sf_dir):
    """Events as images: a camera per event type, positions in time order."""
    e = table(spark, sf_dir, "events")
    own = numbered(e.select(F.struct("event_type", F.to_date("ts").alias("day")).alias("k"), "event_type", "ts", "event_id"), F.col("k"), F.col("ts"), F.col("event_id"), name="at")
    first = own.groupBy("event_type").agg(F.min("at").alias("first"))
    return own.join(F.broadcast(first), "event_type").select(F.col("event_type").alias("camera"), (F.col("at") - F.col("first")).alias("position"), F.format_string("%s/%06d", "event_type", "event_id").alias("name"))


_IMAGES = "i AS (SELECT event_type AS camera, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS position, event_type || '/' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS name FROM events)"


@query(f"""
    WITH {_IMAGES} SELECT DISTINCT least(a.name, b.name) AS name1, greatest(a.name, b.name) AS name2
    FROM i a JOIN i b ON a.name <> b.name AND (a.camera = b.camera AND a.position - b.position IN (1, 2, 3, 4, 5, 8, 16)
                                               OR a.camera <> b.camera AND a.position - b.position BETWEEN 0 AND 4)""")
def candidate_pairs(spark, sf_dir):
    return pairing.candidate_pairs(_images(spark, sf_dir))


@query("""
    WITH p AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position, o_totalprice FROM orders),
         z AS (SELECT k AS zone, greatest(0, 12 * k - 2) AS lo, least(t, 12 * (k + 1) + 2) AS hi
               FROM (SELECT count(*) AS t FROM orders), range(0, 1000000) r(k) WHERE 12 * k < t)
    SELECT zone, lo, hi, count(*) AS positions, round(sum(o_totalprice), 2) AS total FROM z JOIN p ON position >= lo AND position < hi GROUP BY ALL""")
def overlapping_zones(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    own = numbered(orders.select("o_orderdate", "o_orderkey", "o_totalprice"), F.to_date("o_orderdate"), F.col("o_orderdate"), F.col("o_orderkey"))
    total = orders.agg(F.count(F.lit(1)).alias("t"))
    zoned = own.join(F.broadcast(total)).withColumn("z", F.explode(pairing.zones_of(F.col("position"), 12, 2, F.col("t"))))  # total is one row
    return zoned.groupBy("z.zone", "z.lo", "z.hi").agg(F.count(F.lit(1)).alias("positions"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_MATCHES = """
    q AS (SELECT vec_id, label, list_transform(embedding, lambda x: least(255, CAST(round(abs(CAST(x AS DOUBLE)) * 512 / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS INTEGER))) AS d FROM embeddings),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(list_sum(list_transform(list_zip(a.d, b.d), lambda z: CAST(z[1] AS BIGINT) * z[2])) AS BIGINT) AS p FROM q a, q b WHERE a.label % 2 = 0 AND b.label % 2 = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY p DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY p DESC, a) AS rb,
                 lead(p) OVER (PARTITION BY a ORDER BY p DESC, b) AS sa, lead(p) OVER (PARTITION BY b ORDER BY p DESC, a) AS sb FROM s)"""


def _top2(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", matching.quantize(F.col("embedding")).alias("d"))
    return matching.top2(q.filter("label % 2 = 0"), q.filter("label % 2 = 1"))


@query(f"WITH {_MATCHES} SELECT 0 AS side, a AS id, p AS best, b AS best_id, coalesce(sa, -1) AS second FROM r WHERE ra = 1 UNION ALL SELECT 1, b, p, a, coalesce(sb, -1) FROM r WHERE rb = 1")
def top2_partners(spark, sf_dir):
    return _top2(spark, sf_dir).withColumn("second", F.coalesce("second", F.lit(-1)))


@query(f"""
    WITH {_MATCHES} SELECT a AS id1, b AS id2, p AS best FROM r
    WHERE ra = 1 AND rb = 1 AND acos(least(p / 262144.0, 1)) <= 0.7 AND (sa IS NULL OR acos(least(p / 262144.0, 1)) < 0.98 * acos(least(sa / 262144.0, 1)))
          AND (sb IS NULL OR acos(least(p / 262144.0, 1)) < 0.98 * acos(least(sb / 262144.0, 1)))""")
def mutual_matches(spark, sf_dir):
    return matching.mutual_matches(_top2(spark, sf_dir), max_ratio=0.98)


@query("""
    WITH RECURSIVE e AS (SELECT o_orderkey * 2 AS u, o_custkey * 2 + 1 AS v FROM orders),
         b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
         w AS (SELECT u AS node, u AS c FROM b UNION SELECT b.v, w.c FROM w JOIN b ON b.u = w.node WHERE w.c < b.v OR w.c > b.v)
    SELECT node, min(c) AS component FROM w GROUP BY node""")
def track_components(spark, sf_dir):
    return graph.components(table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2).alias("u"), (F.col("o_custkey") * 2 + 1).alias("v")))


@query("""
    WITH e AS (SELECT DISTINCT l_partkey * 2 AS u, l_suppkey * 2 + 1 AS v FROM lineitem), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e)
    SELECT u AS node, count(*) AS degree FROM b GROUP BY u""")
def graph_degrees(spark, sf_dir):
    return graph.degrees(table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v")))


_TRACKS = """
    o AS (SELECT o_custkey AS track, o_orderpriority AS image, o_totalprice / 20000 AS x, o_orderkey % 12 AS y FROM orders),
    v AS (SELECT track, count(*) AS length, count(DISTINCT image) AS images FROM o GROUP BY track),
    f AS (SELECT DISTINCT a.track FROM o a JOIN o b ON a.track = b.track AND a.image = b.image WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 > 100),
    t AS (SELECT v.track, length, images, CASE WHEN f.track IS NOT NULL THEN 'inconsistent' WHEN images < 3 THEN 'too_few_views' ELSE 'valid' END AS verdict FROM v LEFT JOIN f USING (track))"""


def _tracks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track"), F.col("o_orderpriority").alias("image"), (F.col("o_totalprice") / 20000).alias("x"), (F.col("o_orderkey") % 12).cast("double").alias("y"))
    return tracks.track_verdicts(o)


@query(f"WITH {_TRACKS} SELECT * FROM t")
def track_verdicts(spark, sf_dir):
    return _tracks(spark, sf_dir)


@query(f"WITH {_TRACKS} SELECT track, length FROM t WHERE verdict = 'valid' ORDER BY length DESC, track DESC LIMIT 100")
def selected_tracks(spark, sf_dir):
    return tracks.select_tracks(_tracks(spark, sf_dir).filter("verdict = 'valid'"), 100).select("track", "length")


@query("""
    WITH c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, sum(CAST(l_discount > 0.05 AS INT)) OVER (PARTITION BY l_orderkey) AS bad FROM lineitem)
    SELECT l_orderkey AS point, l_linenumber, CASE WHEN n < 2 OR bad >= n - 1 THEN 'drop_point' WHEN l_discount > 0.05 THEN 'drop' ELSE 'keep' END AS action FROM c""")
def observation_filter(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("point"), "l_linenumber", F.col("l_discount").alias("error"))
    return tracks.filter_observations(o, 0.05).select("point", "l_linenumber", "action")


@query("""
    WITH i AS (SELECT count(*) AS images, count_if(s_acctbal > 0) AS registered FROM supplier), p AS (SELECT count(*) AS points, avg(CASE WHEN p_size > 1 THEN p_size END) AS e FROM part),
         o AS (SELECT count(*) AS observations FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))
    SELECT images, registered, points, observations, round(observations / points, 6) AS mean_track_length, round(observations / registered, 6) AS mean_observations, round(e, 6) AS mean_error FROM i, p, o""")
def model_statistics(spark, sf_dir):
    images = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image"), (F.col("s_acctbal") > 0).alias("registered"))
    observations = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), F.col("l_partkey").alias("point"))
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point"), F.when(F.col("p_size") > 1, F.col("p_size")).otherwise(-1).alias("error"))
    out = tracks.model_statistics(images, observations, points)
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("mean") else c for c in out.columns])


@query("""
    WITH r AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS place, count(*) OVER () AS n FROM customer)
    SELECT max(n) AS n, min(v) AS low, max(v) AS high, round(avg(v), 4) AS mean FROM r WHERE place >= floor(0.1 * (n - 1)) AND place <= floor(0.9 * (n - 1))""")
def trimmed_extent(spark, sf_dir):
    return stats.trimmed_extent(table(spark, sf_dir, "customer"), "c_acctbal", 0.1, 0.9).withColumn("mean", F.round("mean", 4))


def _refit_sql():
    """Five rounds written out; each round's own points are those that the round before kept."""
    parts, source = [], "d"
    for k in range(1, 6):
        parts.append(f"f{k} AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b, count(*) AS kept FROM {source})")
        parts.append(f"m{k} AS (SELECT a, b, kept, greatest(3 * quantile_cont(abs(y - (a * x + b)), 0.5), 0.3) AS bound FROM {source}, f{k} GROUP BY a, b, kept)")
        parts.append(f"k{k} AS (SELECT x, y FROM d, m{k} WHERE abs(y - (a * x + b)) < bound)")
        source = f"k{k}"
    return f"WITH d AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part), {', '.join(parts)} SELECT round(a, 6) AS slope, round(b, 4) AS intercept, kept FROM f5"


@query(_refit_sql())
def robust_refit(spark, sf_dir):
    a, b, kept = stats.robust_line(table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y")))
    return spark.createDataFrame([(a, b, kept)], "slope double, intercept double, kept long").select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "kept")


_SIX = {"x": "l_quantity", "y": "l_discount * 100", "z": "l_tax * 100", "u": "l_extendedprice / 1000", "v": "l_linenumber", "w": "l_quantity * 2 + l_tax"}


@query(
    "WITH p AS (SELECT "
    + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _SIX.items())
    + " FROM lineitem) SELECT count(*) AS n, "
    + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in _SIX)
    + ", "
    + ", ".join(f"round(covar_pop({a}, {b}), 4) AS cov_{a}{b}" for a in "xyz" for b in "uvw")
    + ", round(var_pop(x) + var_pop(y) + var_pop(z), 4) AS var FROM p"
)
def similarity_sums(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(*[F.expr(f"cast({e} as double)").alias(c) for c, e in _SIX.items()])
    out = stats.similarity_sums(pairs)
    return out.select("n", *[F.round(c, 6 if c.startswith("mean") else 4).alias(c) for c in out.columns[1:]])


def _points(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), "l_returnflag",
        F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"), F.round(F.col("l_tax") * 100).alias("z"),
    ).withColumn("id", F.struct("order", "line", "x", "y", "z"))


_POINTS = "p AS (SELECT l_orderkey AS \"order\", l_linenumber AS line, l_returnflag, l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z FROM lineitem)"


@query(f"""
    WITH {_POINTS}, r AS (SELECT DISTINCT x, y, z FROM p WHERE l_returnflag = 'A' AND x > 40)
    SELECT "order", line FROM p WHERE l_returnflag <> 'A' AND NOT EXISTS (SELECT 1 FROM r WHERE (p.x - r.x) ** 2 + (p.y - r.y) ** 2 + (p.z - r.z) ** 2 <= 4)""")
def remove_near(spark, sf_dir):
    p = _points(spark, sf_dir)
    return clouds.remove_near(p.filter("l_returnflag != 'A'"), p.filter("l_returnflag = 'A' and x > 40"), 2.0).select("order", "line")


@query(f"""
    WITH {_POINTS}, k AS (SELECT "order" AS key, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS zone, x, y, z, line FROM p),
         o AS (SELECT floor(x / 4) AS a, floor(y / 4) AS b, floor(z / 4) AS c, min(zone) AS owner FROM k GROUP BY ALL), f AS (SELECT key, min(zone) AS first FROM k GROUP BY key)
    SELECT k.key, zone, line FROM k JOIN o ON floor(x / 4) = a AND floor(y / 4) = b AND floor(z / 4) = c AND zone = owner JOIN f ON f.key = k.key AND zone = first""")
def voxel_ownership(spark, sf_dir):
    zone = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return clouds.owned_points(_points(spark, sf_dir).select(F.col("order").alias("key"), zone.alias("zone"), "x", "y", "z", "line"), 4.0).select("key", "zone", "line")


@query("""
    WITH k AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS UHUGEINT) AS k FROM lineitem), m AS (SELECT CAST(18446744073709551616 AS UHUGEINT) AS m),
         a AS (SELECT *, (k + CAST(11400714819323198485 AS UHUGEINT)) % m AS x FROM k, m),
         b AS (SELECT *, (xor(x, x // 1073741824) * CAST(13787848793156543929 AS UHUGEINT)) % m AS y FROM a),
         c AS (SELECT *, (xor(y, y // 134217728) * CAST(10723151780598845931 AS UHUGEINT)) % m AS z FROM b)
    SELECT l_orderkey, l_linenumber FROM c WHERE xor(z, z // 2147483648) % 7 = 0""")
def thin_by_hash(spark, sf_dir):
    return clouds.thin(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), 7, "l_orderkey")


_BEFORE = "(SELECT o_orderkey AS key, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y, 0.0 AS z, o_orderpriority AS color, o_custkey % 5 AS zone FROM orders WHERE o_orderkey % 11 <> 0)"
_AFTER = "(SELECT o_orderkey AS key, o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 0.00001 END AS x, CAST(o_custkey AS DOUBLE) AS y, 0.0 AS z, CASE WHEN o_orderkey % 17 = 0 THEN 'red' ELSE o_orderpriority END AS color, CASE WHEN o_orderkey % 13 = 0 THEN (o_custkey + 1) % 5 ELSE o_custkey % 5 END AS zone FROM orders WHERE o_orderkey % 7 <> 0)"


def _clouds(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    both = o.select(key.alias("key"), F.col("o_totalprice").alias("x"), cust.cast("double").alias("y"), F.lit(0.0).alias("z"), F.col("o_orderpriority").alias("color"), (cust % 5).alias("zone"))
    after = both.withColumns({"x": F.col("x") + F.when(F.col("key") % 3 == 0, 0.5).otherwise(0.00001), "color": F.when(F.col("key") % 17 == 0, "red").otherwise(F.col("color")), "zone": F.when(F.col("key") % 13 == 0, (F.col("y").cast("long") + 1) % 5).otherwise(F.col("zone"))})
    return both.filter("key % 11 != 0"), after.filter("key % 7 != 0")


@query(f"""
    WITH b AS {_BEFORE}, a AS {_AFTER}, j AS (SELECT a.key AS ak, b.key AS bk, a.zone AS az, b.zone AS bz, a.x AS ax, b.x AS bx, a.color AS ac, b.color AS bc FROM a FULL JOIN b ON a.key = b.key)
    SELECT 'add' AS op, ak AS key, az AS zone, round(ax, 5) AS x FROM j WHERE bk IS NULL OR az <> bz
    UNION ALL SELECT 'remove', bk, bz, round(bx, 5) FROM j WHERE ak IS NULL OR az <> bz
    UNION ALL SELECT 'move', ak, az, round(ax, 5) FROM j WHERE az = bz AND (abs(ax - bx) > 0.0001 OR ac <> bc)""")
def keyed_diff(spark, sf_dir):
    return display.keyed_diff(*_clouds(spark, sf_dir)).select("op", "key", "zone", F.round("x", 5).alias("x"))


@query(f"""
    WITH b AS {_BEFORE}, a AS {_AFTER}
    SELECT a.key, a.zone, a.color, round(CASE WHEN b.key IS NOT NULL AND a.zone = b.zone AND a.color = b.color AND abs(a.x - b.x) <= 0.0001 THEN b.x ELSE a.x END, 5) AS x FROM a LEFT JOIN b ON a.key = b.key""")
def mirrored_display(spark, sf_dir):
    before, after = _clouds(spark, sf_dir)
    return display.apply_delta(before, display.keyed_diff(before, after)).select("key", "zone", "color", F.round("x", 5).alias("x"))


_SETS = "s AS (SELECT user_id AS node, event_id AS arrival, CASE WHEN event_id % 23 = 5 THEN 2 ELSE 1 END AS source, event_id // 400 - CASE WHEN event_id % 7 = 0 THEN 3 ELSE 0 END AS sequence, event_id % 2 AS revision FROM events)"


def _sets(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), e.alias("arrival"), F.when(e % 23 == 5, 2).otherwise(1).cast("long").alias("source"), (F.expr("event_id div 400") - F.when(e % 7 == 0, 3).otherwise(0)).alias("sequence"), (e % 2).alias("revision"))


@query(f"""
    WITH {_SETS}, w AS (SELECT *, first_value(source) OVER (PARTITION BY node ORDER BY arrival) AS own FROM s),
         n AS (SELECT *, max(sequence) OVER (PARTITION BY node ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest,
                      first_value(revision) OVER (PARTITION BY node, sequence ORDER BY arrival) AS first_revision, row_number() OVER (PARTITION BY node, sequence ORDER BY arrival) AS k FROM w WHERE source = own),
         m AS (SELECT *, first_value(newest) OVER (PARTITION BY node, sequence ORDER BY arrival) AS newest_then FROM n),
         o AS (SELECT node, arrival, newest_then IS NULL OR sequence > newest_then AS accepted, k, revision, first_revision FROM m)
    SELECT node, arrival, 'ignored' AS outcome, 'foreign_source' AS reason FROM w WHERE source <> own
    UNION ALL SELECT node, arrival, CASE WHEN NOT accepted THEN 'ignored' WHEN k = 1 THEN 'appended' WHEN revision = first_revision THEN 'duplicate' ELSE 'ignored' END,
              CASE WHEN NOT accepted THEN 'late' WHEN k = 1 OR revision = first_revision THEN NULL WHEN revision < first_revision THEN 'stale_revision' ELSE 'correction' END FROM o""")
def reconcile_outcomes(spark, sf_dir):
    return live.reconcile(_sets(spark, sf_dir)).select("node", "arrival", "outcome", "reason")


@query()
def replay_outcomes(spark, sf_dir):
    return live.reconcile(_sets(spark, sf_dir), live.REPLAY_WINDOW)


@query("SELECT event_type, user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts", "value")
    return display.latest_per_key(e, ["event_type", "user_id"], F.struct("ts", "event_id")).select("event_type", "user_id", "event_id", "value")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) > 1 AS superseded FROM events")
def superseded_events(spark, sf_dir):
    return display.superseded(table(spark, sf_dir, "events"), ["event_type", "user_id"], ["ts", "event_id"]).select("event_id", "superseded")


@query("""
    WITH p AS (SELECT c_nationkey AS image, least(63, greatest(0, floor(64 * (c_custkey % 1000) / 1000.0))) AS cx, least(63, greatest(0, floor(64 * (c_acctbal + 1000) / 11000))) AS cy FROM customer),
         l AS (SELECT DISTINCT image, k, CAST(cx AS BIGINT) >> (5 - k) AS cx, CAST(cy AS BIGINT) >> (5 - k) AS cy FROM p, range(0, 6) r(k))
    SELECT image, CAST(sum(4 ** (k + 1)) AS BIGINT) AS score FROM l GROUP BY image""")
def visibility_scores(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return tracks.visibility_scores(c.select(F.col("c_nationkey").alias("image"), (F.col("c_custkey") % 1000).cast("double").alias("x"), (F.col("c_acctbal") + 1000).alias("y"), F.lit(1000.0).alias("width"), F.lit(11000.0).alias("height")))


@query("""
    WITH c AS (SELECT l_partkey AS pair, nullif(count_if(l_returnflag = 'A'), 0) * 3 AS e, nullif(count_if(l_returnflag = 'N'), 0) * 2 AS f, nullif(count_if(l_returnflag = 'R'), 0) * 3 AS h FROM lineitem GROUP BY l_partkey),
         d AS (SELECT *, coalesce(e, 0) AS ne, coalesce(f, 0) AS nf, coalesce(h, 0) AS nh FROM c)
    SELECT pair, CASE WHEN ne < 15 AND nf < 15 AND nh < 15 THEN 1
        WHEN e IS NOT NULL AND ne >= 15 AND (nf = 0 OR ne / nf > 0.95) THEN CASE WHEN nh / ne > 0.8 THEN 6 ELSE 2 END
        WHEN f IS NOT NULL AND nf >= 15 THEN CASE WHEN nh / nf > 0.8 THEN 6 ELSE 3 END
        WHEN h IS NOT NULL AND nh >= 15 THEN 6 ELSE 1 END AS config FROM d""")
def two_view_decision(spark, sf_dir):
    n = lambda flag, k: (F.nullif(F.count_if(F.col("l_returnflag") == flag), F.lit(0)) * k).alias(flag)
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pair")).agg(n("A", 3), n("N", 2), n("R", 3))
    return c.select("pair", camera.two_view_decision(F.col("A"), F.col("N"), F.col("R")).alias("config"))


_LLA = "l AS (SELECT c_custkey AS k, radians(36 + c_custkey % 1000 / 1000.0) AS p, radians(127 + c_custkey % 777 / 1000.0) AS m, c_acctbal / 100 AS h FROM customer), e2 AS (SELECT (1 / 298.257223563) * (2 - 1 / 298.257223563) AS e), n AS (SELECT *, 6378137.0 / sqrt(1 - e * sin(p) * sin(p)) AS n FROM l, e2), x AS (SELECT k, (n + h) * cos(p) * cos(m) AS x, (n + h) * cos(p) * sin(m) AS y, (n * (1 - e) + h) * sin(p) AS z FROM n)"


@query(f"""
    WITH {_LLA}, o AS (SELECT radians(36.0) AS p0, radians(127.0) AS m0, 6378137.0 / sqrt(1 - e * sin(p0) * sin(p0)) AS n0, (n0 + 30) * cos(p0) * cos(m0) AS x0, (n0 + 30) * cos(p0) * sin(m0) AS y0, (n0 * (1 - e) + 30) * sin(p0) AS z0 FROM e2)
    SELECT k, round(-sin(m0) * (x - x0) + cos(m0) * (y - y0), 3) + 0 AS east, round(-sin(p0) * cos(m0) * (x - x0) - sin(p0) * sin(m0) * (y - y0) + cos(p0) * (z - z0), 3) AS north,
           round(cos(p0) * cos(m0) * (x - x0) + cos(p0) * sin(m0) * (y - y0) + sin(p0) * (z - z0), 3) AS up FROM x, o""")
def gps_to_enu(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    ecef = geodesy.lla_to_ecef(36 + k % 1000 / 1000.0, 127 + k % 777 / 1000.0, F.col("c_acctbal") / 100)
    east, north, up = geodesy.ecef_to_enu(*ecef, F.lit(36.0), F.lit(127.0), F.lit(30.0))
    return c.select(k.alias("k"), (F.round(east, 3) + 0).alias("east"), F.round(north, 3).alias("north"), F.round(up, 3).alias("up"))


@query("SELECT c_custkey AS k, round(36 + c_custkey % 1000 / 1000.0, 6) AS lat, round(127 + c_custkey % 777 / 1000.0, 6) AS lon, round(c_acctbal / 100, 4) AS alt FROM customer")
def gps_roundtrip(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    placed = c.select(k.alias("k"), *[x.alias(a) for a, x in zip("xyz", geodesy.lla_to_ecef(36 + k % 1000 / 1000.0, 127 + k % 777 / 1000.0, F.col("c_acctbal") / 100))])
    lat, lon, alt = geodesy.ecef_to_lla(F.col("x"), F.col("y"), F.col("z"))
    return placed.select("k", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), F.round(alt, 4).alias("alt"))


@query("""
    WITH d AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
         n AS (SELECT a.s AS "view", b.s AS neighbour, CAST((a.s * 7 + b.s * 7 + a.p * 3) % 60 AS DOUBLE) AS angle FROM d a JOIN d b ON a.p = b.p AND a.s <> b.s),
         g AS (SELECT "view", neighbour, count(*) AS n, quantile_cont(angle, 0.75) AS angle75 FROM n GROUP BY ALL HAVING angle75 >= 30)
    SELECT "view", neighbour, n, angle75 FROM (SELECT *, row_number() OVER (PARTITION BY "view" ORDER BY n DESC, neighbour) AS k FROM g) WHERE k <= 8""")
def neighbour_views(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("view")).distinct()
    shared = d.join(d.withColumnRenamed("view", "neighbour"), "p").filter("view < neighbour").select("view", "neighbour", ((F.col("view") * 7 + F.col("neighbour") * 7 + F.col("p") * 3) % 60).cast("double").alias("angle"))
    return tracks.neighbour_views(shared, 30.0, 8).select("view", "neighbour", "n", "angle75")


@query("""
    WITH s AS (SELECT l_orderkey AS key, l_quantity AS depth, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity * (1 + (l_discount - 0.03)) END AS observed FROM lineitem),
         v AS (SELECT key, count_if(abs(depth - observed) <= 0.0205 * observed) AS supports, count_if(depth < observed * (1 - 0.0205)) AS violations FROM s WHERE observed > 0 GROUP BY key)
    SELECT key FROM v WHERE violations < 2 OR violations <= supports""")
def visibility_filter(spark, sf_dir):
    observed = F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_quantity") * (1 + (F.col("l_discount") - 0.03)))
    return clouds.visible_keys(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("depth"), observed.alias("observed")), 0.0205)


@query("""
    WITH f AS (SELECT min(ts) AS t0 FROM events)
    SELECT event_type, count(*) AS n, round(avg(epoch(ts) - epoch(t0)), 3) AS mean_seconds, round(max(epoch(ts) - epoch(t0)), 3) AS last_seconds, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events, f GROUP BY event_type""")
def event_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("ts").alias("t0"))
    since = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 1e6
    own = e.join(F.broadcast(first)).withColumn("s", since).withColumn("k", F.get_json_object("props", "$.k").cast("long"))  # first is one row
    return own.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 3).alias("mean_seconds"), F.round(F.max("s"), 3).alias("last_seconds"), F.sum("k").alias("k"))


@query("""
    SELECT l_orderkey, l_linenumber, round(800 * (u + u * (0.01 * r + 0.001 * r * r)) + 500, 4) AS px, round(800 * (v + v * (0.01 * r + 0.001 * r * r)) + 400, 4) AS py
    FROM (SELECT *, u * u + v * v AS r FROM (SELECT l_orderkey, l_linenumber, l_discount * 5 / (1 + l_quantity / 50) AS u, l_tax * 5 / (1 + l_quantity / 50) AS v FROM lineitem))""")
def projected_points(spark, sf_dir):
    p = F.array(*map(F.lit, (800.0, 500.0, 400.0, 0.01, 0.001)))
    x, y = camera.project(F.lit(3), p, F.col("l_discount") * 5, F.col("l_tax") * 5, 1 + F.col("l_quantity") / 50)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 4).alias("px"), F.round(y, 4).alias("py"))


@query("""
    SELECT l_orderkey, l_linenumber, round(2 * (0.6 * l_quantity - 0.8 * l_linenumber) + 1, 6) AS x, round(2 * (0.8 * l_quantity + 0.6 * l_linenumber) + 2, 6) AS y, round(2 * l_tax + 3, 6) AS z FROM lineitem""")
def similarity_transform(spark, sf_dir):
    m = g.sim(F.lit(2.0), g.vec(0.8**0.5, 0, 0, 0.2**0.5), g.vec(1, 2, 3))  # the angle whose cosine is 0.6, about z
    moved = g.sim_apply(m, g.vec(F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.col("l_tax")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", moved.alias("m")).select("l_orderkey", "l_linenumber", *[F.round(F.col("m")[i], 6).alias(c) for i, c in enumerate("xyz")])


@query("SELECT event_id, CAST(event_id AS BIGINT) AS index, event_type AS folder FROM events")
def image_names(spark, sf_dir):
    name = F.format_string("%s/%s_%06d.jpg", "event_type", "event_type", "event_id")
    return table(spark, sf_dir, "events").select("event_id", ids.position_index(name).alias("index"), ids.image_folder(name).alias("folder"))


from strataflow import scalar_queries, store_queries  # noqa: E402,F401  add their own queries
