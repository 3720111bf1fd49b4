"""Column expressions shared by the operators. All stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def type_name(c: Column | str) -> Column:
    """Cell type names: lower case, runs of blanks and underscores become one blank, none at the ends.

    An empty name becomes null.
    """
    c = F.col(c) if isinstance(c, str) else c
    clean = F.trim(F.regexp_replace(F.lower(c), r"[\s_]+", " "))
    return F.when(clean != "", clean)


def trimmed(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def chrom_name(c: Column | str) -> Column:
    """Chromosome: trimmed, lower case, without a leading ``chr``."""
    return F.regexp_replace(F.lower(trimmed(c)), "^chr", "")


def sample_of(cell: Column | str) -> Column:
    """The part of a cell id before the first underscore."""
    return F.substring_index(cell, "_", 1)


def log2p1(c: Column) -> Column:
    return F.log2(c + 1)


def safe_div(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """a / b, where a denominator of at most ``eps`` counts as 1."""
    return a / F.when(b <= eps, F.lit(1.0)).otherwise(b)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def number(n: Column | float) -> Column:
    return (n if isinstance(n, Column) else F.lit(n)).cast("double")


def count_of(df: DataFrame, *cols: str) -> Column:
    """Number of distinct values, as a scalar subquery: no job runs before the query that uses it."""
    return df.agg(F.count_distinct(*cols)).scalar()


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition under which null keys meet null keys; hash joins still apply."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, null meeting null; the keys of the left side stay."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])
