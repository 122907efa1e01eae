"""Helpers of the relational operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one where that isn't set in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/strataflow-shared"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Writes df and reads it back: cuts the lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, coarse: Column, *order: Column, name: str = "position") -> DataFrame:
    """df with a gapless number from 0 in a total order, without sorting all rows in one task.

    coarse must not decrease along the order and split the rows into moderate groups: the running count is taken over
    groups, the row number within one.
    """
    own = df.withColumn("_coarse", coarse)
    sizes = own.groupBy("_coarse").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_coarse", F.coalesce(F.sum("_n").over(Window.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_coarse").orderBy(*order)) - 1
    return own.withColumn("_at", at).join(before, "_coarse").withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_coarse", "_at", "_before")
