"""Join shapes of the pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_match(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Inner equi lookup; of several matches on the right the one of the least order. The right side is reduced before
    the join, so that no key is expanded."""
    cols = [c for c in right.columns if c != key]
    one = right.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("m"))
    return left.join(one, key).select("*", *[F.col(f"m.{c}").alias(f"right_{c}") for c in cols]).drop("m")


def keep(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def state_difference(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 1e-5) -> DataFrame:
    """Rows of two keyed states that differ by more than the tolerance, or that one of them lacks."""
    x, y = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    return x.join(y, key, "full_outer").filter(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance))
