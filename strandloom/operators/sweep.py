"""Covered periods and gaps of intervals: a sweep line over start and end events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.columns import null_safe_join
from strandloom.operators.prefix import prefix_sums


def _sliced(events: DataFrame, keys: list[str], rows_per_slice: int, slices: int) -> DataFrame:
    """Adds ``__slice``: 0 for the rows of most keys; the rows of a key with more than ``rows_per_slice``
    positions are cut at approximate quantiles of its positions, so that a hot key has many slices."""
    hot = events.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > rows_per_slice).drop("__n")
    cuts = null_safe_join(events, hot, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx("__pos", [i / slices for i in range(1, slices)], 10 * slices).alias("__cuts"))
    return null_safe_join(events, cuts, keys, "left").withColumn("__slice", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__pos"))), F.lit(0))).withColumn("__slice", F.greatest("__slice", F.lit(0))).drop("__cuts")


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, rows_per_slice: int = 500_000, slices: int = 128) -> DataFrame:
    """Rows ``kind, *keys, start_pos, end_pos``: a ``period`` for each longest stretch covered by overlapping or
    touching half-open intervals of a key, a ``gap`` from the end of each period to the start of the key's next.

    Each interval becomes an event of +1 at its start and of -1 at its end. Events at one position of a key are
    summed first, by map tasks too, so repeats and ties cost nothing. The running sum is the number of active
    intervals; it leaves and reaches zero where periods start and end. Intervals that are null or empty on either
    side (start >= end) are ignored. Null keys form a key of their own. An empty table gives an empty table.
    Other columns are left out.
    """
    keys = list(keys)
    live = df.select(*[F.col(k) for k in keys], F.col(start).cast("bigint").alias("__s"), F.col(end).cast("bigint").alias("__e")).where("__s < __e")
    both = F.explode(F.array(F.struct(F.col("__s").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("__e").alias("pos"), F.lit(-1).alias("d"))))
    events = live.select(*keys, both.alias("__x")).groupBy(*keys, F.col("__x.pos").alias("__pos")).agg(F.sum("__x.d").alias("__d"))
    swept = prefix_sums(_sliced(events, keys, rows_per_slice, slices), keys, "__slice", [F.col("__pos")], "__d", "__active")
    edges = swept.where(((F.col("__active") == 0) | (F.col("__active") == F.col("__d"))) & (F.col("__d") != 0)).select(*keys, "__slice", "__pos", (F.col("__active") > 0).alias("__opens"))
    own = Window.partitionBy(*keys, "__slice").orderBy("__pos")
    later = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(1, Window.unboundedFollowing)
    firsts = edges.groupBy(*keys, "__slice").agg(F.min("__pos").alias("__first")).select(*keys, "__slice", F.min("__first").over(later).alias("__next_slice"))
    ends = null_safe_join(edges.withColumn("__next", F.lead("__pos").over(own)), firsts, [*keys, "__slice"], "left")
    until = F.coalesce("__next", "__next_slice")
    return ends.select(F.when(F.col("__opens"), "period").otherwise("gap").alias("kind"), *keys, F.col("__pos").alias("start_pos"), until.alias("end_pos")).where("end_pos IS NOT NULL")
