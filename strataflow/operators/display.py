"""Display deltas: what to add, move and remove to get from one set of keyed points to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A point has moved if an axis changed by more than this.
EPSILON = 1e-4


def first_per_key(points: DataFrame, *order: str) -> DataFrame:
    """The first row per key by order, nulls first; rows with a coordinate that isn't finite are left out."""
    finite = points
    for a in ("x", "y", "z"):
        finite = finite.filter(F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf")))
    one = finite.groupBy("key").agg(F.min_by(F.struct(*[c for c in points.columns if c != "key"]), F.struct(*order)).alias("one"))
    return one.select("key", "one.*")


def keyed_diff(before: DataFrame, after: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(op, key, x, y, z, color, zone): add, move and remove; a change of zone is a removal and an addition.

    before, after: key, x, y, z, color, zone.  A change from or to null is a change.  Rows of after whose coordinates aren't
    finite are left out; of rows with one key the first by zone, x, y and z counts (null first).  before: keys distinct."""
    value = ("x", "y", "z", "color", "zone")
    after = first_per_key(after.select("key", *value), "zone", "x", "y", "z")
    old = before.select("key", *[F.col(c).alias(f"old_{c}") for c in value])
    both = after.select("key", *value, F.lit(True).alias("new")).join(old.withColumn("was", F.lit(True)), "key", "full_outer")
    moved = ~F.col("color").eqNullSafe(F.col("old_color"))
    for a in ("x", "y", "z"):
        moved = moved | (F.abs(F.col(a) - F.col(f"old_{a}")) > epsilon)

    def row(op: str, prefix: str = "") -> Column:
        return F.struct(F.lit(op).alias("op"), *[F.col(prefix + c).alias(c) for c in value])

    rezoned = ~F.col("zone").eqNullSafe(F.col("old_zone"))
    ops = (
        F.when(F.col("was").isNull(), F.array(row("add")))
        .when(F.col("new").isNull(), F.array(row("remove", "old_")))
        .when(rezoned, F.array(row("remove", "old_"), row("add")))
        .when(moved, F.array(row("move")))
    )
    return both.select("key", F.explode(ops).alias("o")).select("o.op", "key", *[f"o.{c}" for c in value])


def apply_delta(before: DataFrame, delta: DataFrame) -> DataFrame:
    """The points after a delta: removed ones go, then added and moved ones replace."""
    value = ["key", "x", "y", "z", "color", "zone"]
    gone = delta.filter("op in ('remove', 'move')").select("key")
    return before.select(*value).join(gone, "key", "left_anti").unionByName(delta.filter("op in ('add', 'move')").select(*value))


def superseded(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """events with superseded: whether a later event of the same key is queued."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return events.withColumn("superseded", last > 1)


def latest_per_key(events: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last event per key, by an aggregate that combines before the shuffle."""
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*key, "last.*")
