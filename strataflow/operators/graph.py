"""Graphs over observations: components and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions.geometry import quat_angular_distance, quat_conjugate, quat_product
from strataflow.operators.common import materialize, scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of edges (u, v long).

    Large-star and small-star steps in turn, each written to the shared folder; a node's neighbours are never gathered.
    """
    folder = scratch(edges.sparkSession, "components")
    nodes = materialize(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), f"{folder}/nodes")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), f"{folder}/edges-0")
    state, step = None, 0
    while (now := tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != state:
        state, step = now, step + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{folder}/edges-{step}")
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): distinct neighbours of each node of an undirected edge list."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    return both.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def transitive(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, hops) of nodes within depth steps of each start, without the start itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    seen = starts.select(F.col("node").alias("start"), F.col("node"), F.lit(0).alias("hops"))
    front = seen
    for hop in range(1, depth + 1):
        found = front.join(both, front["node"] == both["u"]).select("start", F.col("v").alias("node")).distinct()
        front = found.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(front)
    return seen.filter("hops > 0")


def largest_component(edges: DataFrame) -> DataFrame:
    """(node) of the component with most nodes, the one with the smallest node among equals."""
    named = components(edges)
    best = named.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return named.join(F.broadcast(best.select("component")), "component", "left_semi").select("node")


def invalidate_outside(edges: DataFrame) -> DataFrame:
    """edges (u, v, valid) with valid false where an end isn't in the largest component of the valid edges."""
    kept = largest_component(edges.filter("valid"))
    inside = kept.select(F.col("node").alias("u"), F.lit(True).alias("_u"))
    other = kept.select(F.col("node").alias("v"), F.lit(True).alias("_v"))
    out = edges.join(inside, "u", "left").join(other, "v", "left")
    return out.select(*[F.col(c) if c != "valid" else (F.col("valid") & F.col("_u").isNotNull() & F.col("_v").isNotNull()).alias("valid") for c in edges.columns])


def rotation_outliers(edges: DataFrame, rotations: DataFrame, most: float) -> DataFrame:
    """edges (u, v, q, valid) with valid false where the relative rotation differs by more than most (radians) from what the
    ends' rotations (node, q) give; edges without both stay as they are."""
    a = rotations.select(F.col("node").alias("u"), F.col("q").alias("_a"))
    b = rotations.select(F.col("node").alias("v"), F.col("q").alias("_b"))
    given = quat_product(F.col("_b"), quat_conjugate(F.col("_a")))
    far = F.coalesce(quat_angular_distance(F.col("q"), given) > most, F.lit(False))
    out = edges.join(a, "u", "left").join(b, "v", "left")
    return out.select(*[F.col(c) if c != "valid" else (F.col("valid") & ~far).alias("valid") for c in edges.columns])


def pair_counts(matches: DataFrame) -> DataFrame:
    """(image, pairs, matches, observations): pairs that an image is in, their matches, and its distinct matched features.

    matches: image1, image2, idx1, idx2."""
    both = matches.select(F.col("image1").alias("image"), F.col("image2").alias("other"), F.col("idx1").alias("idx")).unionByName(matches.select(F.col("image2").alias("image"), F.col("image1").alias("other"), F.col("idx2").alias("idx")))
    per = both.groupBy("image", "other").agg(F.count(F.lit(1)).alias("n")).groupBy("image").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("matches"))
    seen = both.select("image", "idx").distinct().groupBy("image").agg(F.count(F.lit(1)).alias("observations"))
    return per.join(seen, "image").select("image", "pairs", "matches", "observations")
