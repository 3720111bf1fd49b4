"""Per-key statistics where a few keys hold most rows: value-frequency compression.

Rows are first grouped by key *and* value. A hot key thereby falls into as many groups as it has
distinct values, map tasks combine repeats before anything is shuffled, and what is left per key is a
table of weighted values, from which distinct counts, modes and percentiles follow exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.columns import null_safe_join
from strandloom.operators.prefix import prefix_sums


def compress(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """One row for each key and value with ``weight``, the number (or summed weight) of its rows.

    Null keys and null values form groups of their own. Columns other than these are left out.
    An empty table gives an empty table.
    """
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    picked = df.select(*[F.col(k) for k in keys], F.col(value).alias("value"), w.alias("weight"))
    return picked.groupBy(*keys, "value").agg(F.sum("weight").alias("weight"))


def totals(compressed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From weighted values, per key: ``n_rows`` (nulls included), ``n_values`` (rows whose value is not null),
    ``n_distinct`` (distinct values, null not counted) and ``mode`` (most frequent value; of equally frequent ones the
    smallest; null if there is no value)."""
    has = F.col("value").isNotNull()
    best = F.struct(-F.col("weight"), F.col("value"))
    return compressed.groupBy(*keys).agg(
        F.sum("weight").alias("n_rows"),
        F.coalesce(F.sum(F.when(has, F.col("weight"))), F.lit(0)).alias("n_values"),
        F.count(F.when(has, 1)).alias("n_distinct"),
        F.min_by("value", F.when(has, best)).alias("mode"),
    )


def coarse_bin(v: Column, steps: int = 64) -> Column:
    """A coarse number that never falls as ``v`` rises: 64 (or ``steps``) steps an octave; NaN ranks last as in Spark's order."""
    v = v.cast("double")
    step = F.floor(F.log2(F.abs(v) + 1) * steps)
    return F.when(F.isnan(v), F.lit(2**62)).when(v < 0, -step).otherwise(step)


def percentiles(compressed: DataFrame, keys: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Exact percentiles (linear interpolation, as ``percentile``) of weighted numeric values: column
    ``percentiles``, an array in the order of ``points``. Null values do not count; keys without values are left out.

    Level one sums weights by coarse bin and finds, per key, the bins that hold the wanted ranks; there are at
    most some 10^5 bins per key whatever the number of rows. Level two looks only at the values inside those bins, summed in a thousand finer slices each, so
    a task has no more distinct values of a key than lie within a 65,536th of an octave.
    """
    keys = list(keys)
    vals = compressed.where(F.col("value").isNotNull()).withColumn("__bin", coarse_bin(F.col("value")))
    per_key = Window.partitionBy(*keys)
    bins = vals.groupBy(*keys, "__bin").agg(F.sum("weight").alias("__w"))
    bins = bins.withColumn("__n", F.sum("__w").over(per_key)).withColumn("__from", F.sum("__w").over(per_key.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__w"))
    exact = [F.lit(float(p)) * (F.col("__n") - 1) for p in points]
    ranks = F.array(*[F.floor(x) for x in exact], *[F.ceil(x) for x in exact])
    hit = F.filter(F.array_distinct(ranks), lambda r: (r >= F.col("__from")) & (r < F.col("__from") + F.col("__w")))
    bins = bins.select(*keys, "__bin", "__n", "__from", hit.alias("__ranks")).where(F.size("__ranks") > 0)
    inside = null_safe_join(vals, bins, [*keys, "__bin"])
    inside = prefix_sums(inside.withColumn("__fine", coarse_bin(F.col("value"), 1 << 16)), [*keys, "__bin"], "__fine", [F.col("value")], "weight", "__to").withColumn("__to", F.col("__to") + F.col("__from"))
    inside = inside.withColumn("__rank", F.explode(F.filter("__ranks", lambda r: (r < F.col("__to")) & (r >= F.col("__to") - F.col("weight")))))
    at = inside.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__rank", F.col("value").cast("double")))).alias("__at"), F.first("__n").alias("__n"))  # at most two ranks a point
    lo, hi = [F.element_at("__at", F.floor(x)) for x in exact], [F.element_at("__at", F.ceil(x)) for x in exact]
    return at.select(*keys, F.array(*[F.when(F.floor(x) == x, a).otherwise(a + (b - a) * (x - F.floor(x))) for a, b, x in zip(lo, hi, exact)]).alias("percentiles"))


def key_stats(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float] = (), weight: str | None = None) -> DataFrame:
    """``totals`` and, if ``points`` are given, ``percentiles`` of ``value`` per key, through ``compress``.

    Null keys are a key of their own; with points, a key without any value has null percentiles.
    """
    packed = compress(df, keys, value, weight)
    out = totals(packed, keys)
    return null_safe_join(out, percentiles(packed, keys, points), list(keys), "left") if points else out
