"""Descriptor matching: the two best partners of each descriptor, ratio and mutual tests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block of descriptors; a task compares one block with another.
BLOCK = 2048
# Largest ratio of best to second angle, largest angle.
MAX_RATIO, MAX_ANGLE = 0.8, 0.7


def quantize(vector: Column) -> Column:
    """Bytes of a vector scaled to unit length, 512 steps a unit, as 0 to 255; zeros for a zero vector, null for null."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    size = F.when(size > 0, size).otherwise(F.lit(1.0))
    return F.transform(vector, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round(F.abs(x.cast("double")) * 512 / size).cast("int"))))


def top2(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, id, best, best_id, second): for each descriptor of both sides its best partner and the second best value.

    left, right: id long, d array<int>.  Blocks of both sides meet in one task each; partial results of a descriptor are
    merged by an associative aggregate (largest value, smallest id among equals).
    """
    n = max(1, -(-left.count() // BLOCK))
    m = max(1, -(-right.count() // BLOCK))
    block = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    a = left.select("id", "d", block(n).alias("i")).withColumn("j", F.explode(F.array(*map(F.lit, range(m))))).withColumn("side", F.lit(0))
    b = right.select("id", "d", block(m).alias("j")).withColumn("i", F.explode(F.array(*map(F.lit, range(n))))).withColumn("side", F.lit(1)).select("id", "d", "i", "j", "side")

    def work(table: pa.Table) -> pa.Table:
        side, ids = table["side"].to_numpy(), table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        # sums of up to 256 products of bytes stay below 2 ** 24, where 32-bit floats are whole numbers
        d = np.array(table["d"].to_pylist(), np.float32).reshape(len(ids), -1)[order]
        side, ids = side[order], ids[order]
        products = d[side == 0] @ d[side == 1].T
        out = []
        for s, p in ((0, products), (1, products.T)):
            own, other = ids[side == s], ids[side != s]
            if not p.size:
                continue
            best = p.argmax(axis=1)
            value = p[np.arange(len(p)), best].astype(np.int64)
            rest = p.copy()
            rest[np.arange(len(p)), best] = -1.0
            out.append(pa.table([np.full(len(own), s, np.int32), own, value, other[best], rest.max(axis=1).astype(np.int64)], names=["side", "id", "best", "best_id", "second"]))
        return pa.concat_tables(out) if out else pa.schema([("side", pa.int32()), ("id", pa.int64()), ("best", pa.int64()), ("best_id", pa.int64()), ("second", pa.int64())]).empty_table()

    parts = a.unionByName(b).groupBy("i", "j").applyInArrow(work, "side int, id long, best long, best_id long, second long")
    key = F.struct(F.col("best"), (-F.col("best_id")).alias("neg"))
    merged = parts.groupBy("side", "id").agg(F.max(key).alias("top"), F.slice(F.array_sort(F.flatten(F.collect_list(F.array("best", "second"))), lambda x, y: (y - x).cast("int")), 1, 2).alias("two"))
    return merged.select("side", "id", F.col("top.best").alias("best"), (-F.col("top.neg")).alias("best_id"), F.col("two")[1].alias("second"))


def angle(product: Column) -> Column:
    return F.acos(F.least(product.cast("double") / (512.0 * 512.0), F.lit(1.0)))


def mutual_matches(best: DataFrame, max_ratio: float = MAX_RATIO, max_angle: float = MAX_ANGLE) -> DataFrame:
    """(id1, id2, best) of pairs that are each other's best and pass the tests in both directions."""
    passed = best.filter((angle(F.col("best")) <= max_angle) & ((F.col("second") < 0) | (angle(F.col("best")) < max_ratio * angle(F.col("second")))))
    one = passed.filter("side = 0").select(F.col("id").alias("id1"), F.col("best_id").alias("id2"), "best")
    two = passed.filter("side = 1").select(F.col("id").alias("id2"), F.col("best_id").alias("id1"))
    return one.join(two, ["id1", "id2"], "left_semi")
