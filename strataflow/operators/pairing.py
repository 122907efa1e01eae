"""Which images to match: positions by camera, and overlapping zones of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gaps to earlier positions, of the same camera and of others.
SAME_CAMERA = (1, 2, 3, 4, 5, 8, 16)
OTHER_CAMERA = (0, 1, 2, 3, 4)


def candidate_pairs(images: DataFrame) -> DataFrame:
    """(name1, name2) of images to match, smaller name first.  images: camera, position, name (distinct).

    Each image asks for a fixed number of earlier positions, so these are equi-joins: on camera and position within a
    camera, on position for the others.  A pair of two cameras can be asked for from both sides only at gap 0, where the
    smaller camera asks, so no pair comes twice as long as names are distinct.  Rows with a null camera, position or name
    pair with nothing."""
    asks = lambda gaps: images.select("camera", "name", "position", F.explode(F.array(*map(F.lit, gaps))).alias("gap")).withColumn("position", F.col("position") - F.col("gap"))
    other = images.select(F.col("camera").alias("camera2"), F.col("name").alias("name2"), F.col("position").alias("position2"))

    def ordered(met: DataFrame) -> DataFrame:
        return met.filter(F.col("name") != F.col("name2")).select(F.least("name", "name2").alias("name1"), F.greatest("name", "name2").alias("name2"))

    same, across = asks(SAME_CAMERA), asks(OTHER_CAMERA)
    within = same.join(other, (same["camera"] == other["camera2"]) & (same["position"] == other["position2"]))
    met = across.join(other, across["position"] == other["position2"])
    between = met.filter((F.col("camera") < F.col("camera2")) | ((F.col("camera") > F.col("camera2")) & (F.col("gap") > 0)))
    return ordered(within).unionByName(ordered(between))


def zones_of(position: Column, span: int, overlap: int, total: Column) -> Column:
    """Zones that hold a position: array of structs (zone, lo, hi); zone k covers [k span - overlap, (k + 1) span + overlap)."""
    first = F.greatest(F.lit(0), F.floor((position - overlap) / span))
    last = F.least(F.floor((total - 1) / span), F.floor((position + overlap) / span))

    def zone(k: Column) -> Column:
        return F.struct(k.alias("zone"), F.greatest(F.lit(0), k * span - overlap).cast("long").alias("lo"), F.least(total, (k + 1) * span + overlap).cast("long").alias("hi"))

    return F.filter(F.transform(F.sequence(first, last), zone), lambda z: (z["lo"] <= position) & (position < z["hi"]))
