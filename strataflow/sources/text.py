"""Text sources: GPS series and pair lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line number, text), file order kept: a file is one row, its lines are its elements."""
    files = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    return files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))


def read_gps(spark: SparkSession, path: str) -> DataFrame:
    """ord, name, lat, lon, alt of lines with exactly four fields; blank lines are skipped, any other line is an error."""
    lines = _lines(spark, path).withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " "))).filter("line != ''")
    parts = F.split("line", " ")
    number = lambda i: F.expr(f"try_cast(split(line, ' ')[{i}] as double)")
    good = (F.size(parts) == 4) & F.expr(" and ".join(f"try_cast(get(split(line, ' '), {i}) as double) is not null" for i in (1, 2, 3)))
    checked = lines.withColumn("ok", F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("GPS line "), F.col("ord") + 1, F.lit(": "), F.col("line"))).cast("boolean")))
    return checked.filter("ok").select("ord", parts[0].alias("name"), number(1).alias("lat"), number(2).alias("lon"), number(3).alias("alt"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name1, name2) of a pair list: blank lines and comments skipped, the two names apart by one space."""
    lines = _lines(spark, path).withColumn("line", F.trim("line")).filter("line != '' and not startswith(line, '#')")
    parts = F.split("line", " ")
    ok = F.when(F.size(parts) == 2, True).otherwise(F.raise_error(F.concat(F.lit("pair list line "), F.col("ord") + 1)).cast("boolean"))
    return lines.withColumn("ok", ok).filter("ok").select("ord", parts[0].alias("name1"), parts[1].alias("name2"))
