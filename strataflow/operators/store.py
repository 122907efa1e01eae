"""Row changes, lookups and checks on a store's tables: merges, logs, match graphs, feature limits, anchors.

A table is never changed in place: each function returns the table after the change.  Null keys equal nothing, so rows with
them stay where a merge or a deletion looks for keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions import geodesy
from strataflow.functions import geometry as g
from strataflow.operators import clouds
from strataflow.operators.common import materialize, numbered, scratch

# --- row changes


def upserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with all rows of each key in rows replaced by those of rows; keys that are new are added."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def updated(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with the columns of rows written over those of rows with the same key; other keys stay, and no row comes twice.

    Of several rows with one key in rows, that with the largest new values counts, column by column."""
    new = [c for c in rows.columns if c not in key]
    held = rows.groupBy(*key).agg(F.max(F.struct(*new)).alias("_new"))
    out = table.join(held, key, "left")
    return out.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])


def deleted(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(*key).distinct(), key, "left_anti")


def retained(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """The rows of table whose key is in keys: a copy of a store is this on each of its tables."""
    return table.join(keys.select(*key).distinct(), key, "left_semi")


def added(table: DataFrame, rows: DataFrame, id_col: str, order: str) -> DataFrame:
    """table and rows; rows with a null id get those after the largest one of both, by order (long), 1 for empty tables."""
    given = table.select(id_col).unionByName(rows.select(id_col)).agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_last"))
    unnamed = numbered(rows.filter(F.col(id_col).isNull()), F.floor(F.col(order) / 4096), F.col(order), name="_place")
    named = unnamed.join(F.broadcast(given)).withColumn(id_col, F.col("_last") + F.col("_place") + 1)  # given is one row
    return table.unionByName(rows.filter(F.col(id_col).isNotNull()).select(*table.columns)).unionByName(named.select(*table.columns))


def changed_since(log: DataFrame, table: DataFrame, cursor: int, key: str = "pair") -> DataFrame:
    """The rows of table whose key was logged at or after cursor, each once.  log: seq, key.  The next cursor is the largest
    seq and one."""
    return table.join(log.filter(F.col("seq") >= cursor).select(key).distinct(), key, "left_semi")


# --- match graphs and models


def two_view_edges(matches: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image1, image2, idx1, idx2, n, inside): each match of known images once, with how often it is given and whether both
    features exist.  matches: image1, image2, idx1, idx2, each pair in one direction; sizes: image, n.  Images matched with
    themselves are left out."""
    one = sizes.select(F.col("image").alias("image1"), F.col("n").alias("_n1"))
    two = sizes.select(F.col("image").alias("image2"), F.col("n").alias("_n2"))
    own = matches.filter("image1 != image2").groupBy("image1", "image2", "idx1", "idx2").agg(F.count(F.lit(1)).alias("n"))
    inside = (F.col("idx1") < F.col("_n1")) & (F.col("idx2") < F.col("_n2"))
    return own.join(one, "image1").join(two, "image2").select("image1", "image2", "idx1", "idx2", "n", inside.alias("inside"))


def insert_counts(edges: DataFrame) -> DataFrame:
    """(image1, image2, added, out_of_range, duplicates) of two_view_edges: matches out of range count as often as given."""
    inside = F.col("inside")
    return edges.groupBy("image1", "image2").agg(
        F.count_if(inside).alias("added"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("out_of_range"),
        F.sum(F.when(inside, F.col("n") - 1).otherwise(0)).alias("duplicates"),
    )


def both_ways(edges: DataFrame) -> DataFrame:
    """(image, idx, other, other_idx): each edge (image1, image2, idx1, idx2) in both directions, once."""
    there = edges.select(F.col("image1").alias("image"), F.col("idx1").alias("idx"), F.col("image2").alias("other"), F.col("idx2").alias("other_idx"))
    back = edges.select(F.col("image2").alias("image"), F.col("idx2").alias("idx"), F.col("image1").alias("other"), F.col("idx1").alias("other_idx"))
    return there.unionByName(back).distinct()


def two_view_tracks(edges: DataFrame) -> DataFrame:
    """(image, idx, other, other_idx), image < other: features matched with each other and with nothing else."""
    both = both_ways(edges)
    single = both.groupBy("image", "idx").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("image", "idx")
    other = single.select(F.col("image").alias("other"), F.col("idx").alias("other_idx"))
    return both.filter("image < other").join(single, ["image", "idx"], "left_semi").join(other, ["other", "other_idx"], "left_semi").select("image", "idx", "other", "other_idx")


def correspondences_2d3d(edges: DataFrame, linked: DataFrame, posed: DataFrame) -> DataFrame:
    """(image, idx, point): the 3D points that a feature's neighbours in posed images are linked to, each once a feature.

    linked: image, idx, point; posed: image."""
    seen = linked.filter(F.col("point").isNotNull()).join(posed.select("image").distinct(), "image", "left_semi")
    seen = seen.select(F.col("image").alias("other"), F.col("idx").alias("other_idx"), "point")
    return both_ways(edges).join(seen, ["other", "other_idx"]).select("image", "idx", "point").distinct()


def visible_points(edges: DataFrame, linked: DataFrame) -> DataFrame:
    """(image, visible): features with a neighbour that is linked to a 3D point; images without any have no row."""
    found = correspondences_2d3d(edges, linked, linked.select("image"))
    return found.select("image", "idx").distinct().groupBy("image").agg(F.count(F.lit(1)).alias("visible"))


def shared_points(a: DataFrame, b: DataFrame) -> DataFrame:
    """(point_a, point_b), each once: points that two models link to one feature of an image of the same name.

    Both: name, idx, point (null: none)."""
    own = a.filter(F.col("point").isNotNull()).select("name", "idx", F.col("point").alias("point_a"))
    other = b.filter(F.col("point").isNotNull()).select("name", "idx", F.col("point").alias("point_b"))
    return own.join(other, ["name", "idx"]).select("point_a", "point_b").distinct()


def intrinsics_change(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: change, the largest relative change of a focal length over shared cameras; infinite if a model changed or a
    focal length was zero and isn't, 0 without shared cameras.  Both: camera, model, focals (array of doubles)."""
    both = a.select("camera", F.col("model").alias("_m"), F.col("focals").alias("_f")).join(b.select("camera", "model", "focals"), "camera")
    infinite = F.lit(float("inf"))

    def one(x: Column, y: Column) -> Column:
        return F.when(x != 0, F.abs(F.try_divide(y - x, x))).when(y != 0, infinite).otherwise(F.lit(0.0))

    change = F.when(F.col("_m") != F.col("model"), infinite).otherwise(F.array_max(F.zip_with("_f", "focals", one)))
    return both.agg(F.coalesce(F.max(change), F.lit(0.0)).alias("change"))


# --- feature limits


def first_levels(features: DataFrame, most: int) -> DataFrame:
    """Whole levels, coarse ones first: a level stays while those before it hold no more than most.

    features: image, level (0: coarsest), and others."""
    sizes = features.groupBy("image", "level").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("image").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    kept = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).filter(F.col("_before") <= most)
    return features.join(kept.select("image", "level"), ["image", "level"], "left_semi")


def strongest_features(features: DataFrame, most: int) -> DataFrame:
    """At most so many features an image: coarse levels first, in the last one those of largest absolute response, then by at."""
    w = Window.partitionBy("image").orderBy("level", F.abs("response").desc(), "at")
    return features.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")


def spread_features(features: DataFrame, width: float, height: float, cells: int, most: int) -> DataFrame:
    """At most so many features an image, dealt in rounds over cells by cells of it: each round takes the next strongest of
    each cell (ties by level, then at), cells row by row.  features: image, level, at, response, x, y."""
    side = lambda v, size: F.least(F.greatest(F.floor(v / size * cells), F.lit(0)), F.lit(cells - 1))
    own = features.withColumn("_cell", side(F.col("y"), height) * cells + side(F.col("x"), width))
    own = own.withColumn("_round", F.row_number().over(Window.partitionBy("image", "_cell").orderBy(F.abs("response").desc(), "level", "at")))
    own = own.withColumn("_k", F.row_number().over(Window.partitionBy("image").orderBy("_round", "_cell")))
    return own.filter(F.col("_k") <= most).select(*features.columns)


# --- alignment


def gps_to_enu(records: DataFrame, origin: tuple[float, float, float] | None = None) -> DataFrame:
    """records (ord, name, lat, lon, alt) with east, north, up about origin (lat, lon, alt), the first record if none."""
    if origin is None:
        first = records.agg(F.min(F.struct("ord", "lat", "lon", "alt")).alias("o")).select("o.lat", "o.lon", "o.alt")
    else:
        first = records.sparkSession.createDataFrame([tuple(map(float, origin))], "lat double, lon double, alt double")
    at = [f"_{c}" for c in ("lat", "lon", "alt")]
    own = records.join(F.broadcast(first.toDF(*at)))  # one row
    enu = geodesy.ecef_to_enu(*geodesy.lla_to_ecef(F.col("lat"), F.col("lon"), F.col("alt")), *map(F.col, at))
    return own.select(*records.columns, *[c.alias(n) for c, n in zip(enu, ("east", "north", "up"))])


def anchors(links: DataFrame) -> DataFrame:
    """(chain, zone, to_latest, linked): each zone's similarity to the newest zone's frame of its chain.

    links: chain, zone, link (similarity from the zone before, null if that isn't known).  An unknown link leaves the zones
    before it as they are and its own zone in its own frame; the first zone is never linked.  A chain holds a row a zone."""
    held = links.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("zone", "link"))).alias("_all"))
    each = held.select("chain", "_all", F.posexplode("_all").alias("_at", "_own"))
    later = F.filter(F.slice(F.col("_all"), F.col("_at") + 2, F.size("_all")), lambda x: x["link"].isNotNull())
    identity = g.sim(F.lit(1.0), g.vec(1, 0, 0, 0), g.vec(0, 0, 0))
    to_latest = F.aggregate(later, identity, lambda acc, x: g.sim_compose(x["link"], acc))
    return each.select("chain", F.col("_own.zone").alias("zone"), to_latest.alias("to_latest"), ((F.col("_at") > 0) & F.col("_own.link").isNotNull()).alias("linked"))


# --- spacings


def nearest_any(points: DataFrame, reference: DataFrame, radius: float) -> DataFrame:
    """(id, other, distance): each point's nearest reference point however far, the smaller id among equals.

    Points without one in radius are looked for with twice the radius, until all are found; no rows for an empty reference.
    Both: id, x, y, z; rows with a null or non-finite position have no row."""
    finite = " and ".join(f"abs({a}) < double('infinity')" for a in clouds.AXES)  # not a number counts as larger
    points, reference = points.filter(finite), reference.filter(finite)
    if not reference.head(1):
        return nearest_none(points)
    folder, found, left, step = scratch(points.sparkSession, "nearest"), [], points, 0
    while left.head(1):
        met = materialize(clouds.nearest(left, reference, radius), f"{folder}/met-{step}")
        found.append(met)
        left = materialize(left.join(met, "id", "left_anti"), f"{folder}/left-{step}")
        radius, step = radius * 2, step + 1
    out = found[0] if found else nearest_none(points)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def nearest_none(points: DataFrame) -> DataFrame:
    return points.limit(0).select("id", F.col("id").alias("other"), F.lit(0.0).alias("distance"))


def sampled_spacing(points: DataFrame, stride: int, radius: float) -> DataFrame:
    """One row (spacing, n): median distance of every stride-th point (id a gapless number) to the nearest of the others."""
    sample = F.col("id") % stride == 0
    near = nearest_any(points.filter(sample), points.filter(~sample), radius)
    return near.agg(F.median("distance").alias("spacing"), F.count(F.lit(1)).alias("n"))


def overlap_median(before: DataFrame, now: DataFrame, stride: int = 20, radius: float = 5.0) -> DataFrame:
    """One row (median, n): distances below radius of every stride-th point of now (id a gapless number) to the nearest of before."""
    near = clouds.nearest(now.filter(F.col("id") % stride == 0), before, radius).filter(F.col("distance") < radius)
    return near.agg(F.median("distance").alias("median"), F.count(F.lit(1)).alias("n"))


def ground_sample_distance(depths: DataFrame, focals: DataFrame, every: int = 97) -> DataFrame:
    """One row (gsd): the median over views of the median depth over the focal length; every so many-th positive depth counts.

    depths: view, at, depth; focals: view, focal.  Views without a positive depth don't count."""
    at = F.row_number().over(Window.partitionBy("view").orderBy("at")) - 1
    own = depths.filter("depth > 0").withColumn("_k", at).filter(F.col("_k") % every == 0)
    return own.groupBy("view").agg(F.median("depth").alias("_d")).join(focals, "view").agg(F.median(F.col("_d") / F.col("focal")).alias("gsd"))
