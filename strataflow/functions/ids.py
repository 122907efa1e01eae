"""Identifiers and keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the multiplier of pair ids, 2**31 - 1.
PAIR_BASE = 2147483647


def pair_id(a: Column, b: Column) -> Column:
    """One id for an unordered pair of image ids."""
    return F.least(a, b) * F.lit(PAIR_BASE) + F.greatest(a, b)


def pair_images(pair: Column) -> tuple[Column, Column]:
    """The two image ids of a pair id, smaller one first."""
    second = pair % F.lit(PAIR_BASE)
    return ((pair - second) / F.lit(PAIR_BASE)).cast("long"), second


def swapped(a: Column, b: Column) -> Column:
    """Whether a pair is stored in the other direction."""
    return a > b


def pixel_key(image: Column, row: Column, col: Column) -> Column:
    """Image, row and column in one 64-bit key: 32, 16 and 16 bits."""
    return F.shiftleft(image.cast("long"), 32).bitwiseOR(F.shiftleft(row.cast("long"), 16)).bitwiseOR(col.cast("long"))


def voxel(x: Column, edge: float) -> Column:
    return F.floor(x / F.lit(edge))


def position_index(name: Column) -> Column:
    """The last run of digits in a file name's stem, null if there is none."""
    stem = F.regexp_extract(name, r"([^/]*?)(?:\.[^./]*)?$", 1)
    digits = F.regexp_extract(stem, r"([0-9]+)[^0-9]*$", 1)
    return F.when(digits != "", digits.cast("long"))


def image_folder(name: Column) -> Column:
    """The parent folder of an image name, empty at the top."""
    return F.when(F.contains(name, F.lit("/")), F.regexp_extract(name, r"^(.*)/[^/]*$", 1)).otherwise("")
