"""Running sums of one key's rows that do not need one task for one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.columns import null_safe_join


def prefix_sums(df: DataFrame, keys: list[str], slice_col: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``, the running sum of ``value`` per key in ``order``, this row included.

    ``slice_col`` must not fall along ``order``; it cuts the rows of a key into slices. Sums run inside
    each slice, slice totals run over the few slices of a key, and each row adds the total of the slices
    before its own. Both steps read the same shuffle. A key that holds a third of all rows is thus spread over as many tasks as it has slices.
    """
    spread = df.repartition(*[F.col(k) for k in keys], F.col(slice_col))
    own = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    carry = spread.groupBy(*keys, slice_col).agg(F.sum(value).alias("__total")).select(*keys, slice_col, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__carry"))
    local = spread.withColumn(out, F.sum(value).over(own))
    return null_safe_join(local, carry, [*keys, slice_col], "left").withColumn(out, F.col(out) + F.col("__carry")).drop("__carry")


def ranks(df: DataFrame, keys: list[str], slice_of: Column, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``, each row's number from 1 among the rows of its key in ``order``. ``slice_of`` must not fall along ``order``. No keys: one numbering of all rows."""
    within = keys or ["__all"]
    cut = df if keys else df.withColumn("__all", F.lit(0))
    done = prefix_sums(cut.withColumn("__slice", slice_of).withColumn("__one", F.lit(1).cast("bigint")), within, "__slice", order, "__one", out)
    return done.drop("__slice", "__one", "__all")


def drawn_ranks(df: DataFrame, keys: list[str], unit: str, out: str) -> DataFrame:
    """``ranks`` in a random but repeatable order, that of the MD5 hash of ``unit``; 256 slices a key, whatever the units are called."""
    mark = F.md5(F.col(unit).cast("binary"))
    return ranks(df, keys, F.left(mark, F.lit(2)), [mark, F.col(unit)], out)
