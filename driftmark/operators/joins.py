"""Joins that stay balanced when one key holds a large part of the rows, and shuffles that don't pile up."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of rows that may share a hot key with an aggregate of one row per key.

    The adaptive skew join splits a hot partition only where both sides of the join come straight
    from an exchange. An aggregate on the join key brings its own partitioning and has none, so
    the key's hash joins as one more column: it matches whenever the key does, and makes Spark
    exchange both sides.
    """
    spread = F.xxhash64(*on)
    return (
        left.withColumn("_spread", spread)
        .join(right.withColumn("_spread", spread), [*on, "_spread"], how)
        .drop("_spread")
    )


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Lets the shuffle files of what is written inside go with the write that made them. Else they stay
    until the driver's garbage is collected, those of all steps of a run together."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
