"""Labelled sparse matrices as long tables: one row for each entry that is not zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.columns import null_safe_join, safe_div


def matmul(a: DataFrame, b: DataFrame, rows: Sequence[str], inner: Sequence[str], cols: Sequence[str], left: str = "value", right: str = "value", out: str = "value") -> DataFrame:
    """Product over ``inner``: join, multiply, sum. Products that are zero everywhere have no row."""
    a2 = a.select(*rows, *inner, F.col(left).alias("__a"))
    b2 = b.select(*inner, *cols, F.col(right).alias("__b"))
    return a2.join(b2, list(inner)).groupBy(*rows, *cols).agg(F.sum(F.col("__a") * F.col("__b")).alias(out))


def share(df: DataFrame, within: Sequence[str], value: str = "value", out: str | None = None, large: bool = False) -> DataFrame:
    """``value`` divided by its sum over ``within``; sums of at most 1e-12 count as 1. For ``large`` groups, which may be too much for a task, the sums are joined."""
    if large:
        sums = df.groupBy(*within).agg(F.sum(value).alias("__sum"))
        return null_safe_join(df, sums, list(within), "left").withColumn(out or value, safe_div(F.col(value), F.col("__sum"))).drop("__sum")
    return df.withColumn(out or value, safe_div(F.col(value), F.sum(value).over(Window.partitionBy(*within))))


def best(df: DataFrame, row: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each ``row`` in ``order``; give ties an order to have one result."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*row).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def argmax(df: DataFrame, row: Sequence[str], col: str, value: str = "value") -> DataFrame:
    """The column with the largest value of each row; of equal ones the first by name."""
    return best(df, row, [F.desc(value), F.asc(col)]).select(*row, col)


def pad(df: DataFrame, ids: DataFrame, key: str, mask: str = "mask") -> DataFrame:
    """Every key of ``ids`` with ``mask`` 1 where ``df`` doesn't have it, else 0. Zeros stay without rows."""
    have = df.select(key).distinct().withColumn("__has", F.lit(1))
    return ids.select(key).distinct().join(have, key, "left").select(key, F.when(F.col("__has").isNull(), 1).otherwise(0).alias(mask))


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both tables have; an error if there is none."""
    both = a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")
    if both.isEmpty():
        raise ValueError(f"no common {key}")
    return both
