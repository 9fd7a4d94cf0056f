"""Reproducible pseudo-random values: the same in every run, attempt and engine."""

from pyspark.sql import functions as F


def md5_int(value, digits: int):
    """The first `digits` hex digits of the MD5 of a string as a bigint (at most 15)."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("bigint")


def shuffle_key(id_col, seed):
    """A hash whose order is a fixed random order of the rows for a given seed."""
    return F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))
