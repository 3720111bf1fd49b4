"""Composed operators: preparation chains, trimming, feature choice, scaled truth, model choice."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.columns import count_of
from strandloom.operators import preprocess as P
from strandloom.operators.matrix import argmax, pad
from strandloom.operators.prefix import prefix_sums
from strandloom.operators.skew import coarse_bin

def prepare(counts: DataFrame, batch: DataFrame | None = None, norm: bool = True, to_log: bool = False, from_log: bool = False, cell: str = "cell_id", batch_cols: Sequence[str] = (), quantile: bool = False) -> DataFrame:
    """The preparation of cells, or of bulk samples (``cell`` names their column), in its fixed order: drop zeros, batch correction (one after the other), library size, logarithm,
    antilogarithm, quantile normalisation over samples.

    Negative values after a correction become zero, and so lose their row. Absent zeros stay absent through corrections (``combat`` tells what they would become).
    """
    out = P.drop_zeros(counts)
    for b in batch_cols:
        labelled = out.join(batch.select(cell, b).where(F.col(b).isNotNull()), cell, "left")
        out = P.drop_zeros(P.combat(labelled, b, cell).drop(b, "zero_value"))
    if norm:
        out = P.library_norm(out, cell, guard=True)
    if to_log:
        out = P.log2p1(out)
    if from_log:
        out = out.withColumn("value", P.antilog2(F.col("value")))
    return P.quantile_norm(out, cell, "gene").drop("zero_value") if quantile else out


def trimming(df: DataFrame, sample: str, feature: str, n_samples: int | Column | None = None, threshold: float = 0.9, least: float = 1.0, value: str = "value") -> DataFrame:
    """Values above ``least`` of the features that have one in at least ``int(threshold * n_samples)`` samples, missing ones filled with the feature's median, in log2(x + 1).

    The result is dense: a row for each kept feature and sample."""
    kept = df.where(F.col(value) > least)
    fill = P.impute(kept, feature, count_of(df, sample) if n_samples is None else n_samples, threshold, "median", value)
    samples = df.select(sample).distinct().withColumn("__k", F.lit(1))
    grid = fill.select(feature, "fill", F.lit(1).alias("__k")).join(samples, "__k").drop("__k")  # the dense result
    full = grid.join(kept.select(sample, feature, value), [sample, feature], "left")
    return full.select(sample, feature, F.log2(F.coalesce(value, "fill") + 1).alias(value))


def choose_genes(counts: DataFrame, kinds: DataFrame, use: str | Sequence[str], n_markers: int = 200, n_variable: int = 500, min_genes: int = 200, min_cells: int = 10) -> DataFrame:
    """``gene``: a given list (those that occur), ``MARKER``, ``HVG``, both (``BOTH``), or all. ``min_genes`` and ``min_cells`` screen cells and genes for the markers."""
    if not isinstance(use, str):
        return counts.select("gene").distinct().where(F.col("gene").isin(list(use)))
    markers = P.take_markers(P.find_markers(counts, kinds, min_genes, min_cells).withColumn("z", F.round("z", 9)), n_markers)
    variable = P.highly_variable(counts, count_of(counts, "cell_id"), n_variable).select("gene")
    return {"MARKER": markers, "HVG": variable, "BOTH": markers.union(variable).distinct()}.get(use, counts.select("gene").distinct())


def foundation_input(counts: DataFrame, genes: DataFrame, min_genes: int = 200, min_cells: int = 0) -> tuple[DataFrame, DataFrame]:
    """Cells with enough genes, restricted to a gene list and in logarithms of ten thousandths, and the list with ``mask`` 1 for genes that had to be padded."""
    kept = P.basic_filter(counts, min_genes, min_cells)
    mask = pad(kept, genes, "gene")
    return P.log1p_norm(kept.join(genes.select("gene").distinct(), "gene", "left_semi")), mask


def scaled_truth(means: DataFrame, peak: str = "peak_id", value: str = "value") -> DataFrame:
    """Each peak's signal in the types divided by its total over them in ten thousands, rounded half to even; a divisor of 0 counts as 1."""
    scale = F.bround(F.sum(value).over(Window.partitionBy(peak)) / 10_000)
    return means.withColumn(value, F.col(value) / F.when(scale == 0, 1.0).otherwise(scale))


def cumulative_choice(sizes: DataFrame, size: str, threshold: float | Column, ties: Sequence[str]) -> DataFrame:
    """The largest rows by ``size`` (of equal ones the first in ``ties``) until their sum first reaches ``threshold``, that row included. Sums run in slices of like sizes."""
    cut = sizes.withColumn("__all", F.lit(0)).withColumn("__slice", -F.floor(coarse_bin(F.col(size)) / 16))
    done = prefix_sums(cut, ["__all"], "__slice", [F.desc(size), *ties], size, "__upto")
    return done.where(F.col("__upto") - F.col(size) < (threshold if isinstance(threshold, Column) else F.lit(threshold))).select(*sizes.columns)


def ratio(c: Column) -> Column:
    """``a/b`` as a number; null if b is 0 or a part is no number."""
    parts = F.split(c, "/")
    return F.try_divide(parts[0].try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double"))


def term_title(c: Column) -> Column:
    """A description with a capital at its start and single blanks."""
    clean = F.trim(F.regexp_replace(F.translate(c, "_", " "), r"\s+", " "))
    return F.concat(F.upper(F.left(clean, F.lit(1))), F.right(clean, F.greatest(F.length(clean) - 1, F.lit(0))))


def prefer(scores: DataFrame, first: str = "bayes_norm") -> DataFrame:
    """One row ``rule, accuracy`` of ``rule, accuracy``: the rule with the higher accuracy; ``first`` wins ties, and an accuracy of null counts as 0."""
    a = F.coalesce("accuracy", F.lit(0.0))
    return scores.agg(F.max_by("rule", F.struct(a, F.col("rule") == first)).alias("rule"), F.max(a).alias("accuracy"))


def topics_of_types(topic_type: DataFrame, weight: str = "weight") -> DataFrame:
    """``topic_id, main_cell_type``: for each cell type its heaviest topic (of equal ones the lowest), and ``unsure`` for the topics that no type takes."""
    taken = argmax(topic_type, ["main_cell_type"], "topic_id", weight).select("topic_id", "main_cell_type")
    left = topic_type.select("topic_id").distinct().join(taken, "topic_id", "left_anti")
    return taken.unionByName(left.withColumn("main_cell_type", F.lit("unsure")))


def select_model(runs: DataFrame, metric: str, order: Sequence[str] = ("ntopics", "seed")) -> DataFrame:
    """The run with the highest metric; of equal ones the first in ``order``."""
    return runs.orderBy(F.desc(metric), *order).limit(1)


def topic_grid(n_types: int) -> list[int]:
    """Numbers of topics to try: from the number of cell types to three times it."""
    return list(range(n_types, 3 * n_types + 1))


def perplexity(log_likelihood: float, tokens: int) -> float:
    return math.exp(-log_likelihood / tokens) if tokens else math.nan


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its power series."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    total, term, k = 1.0, 1.0, 0
    while abs(term) > 1e-16 * abs(total) and k < 10_000:
        term *= x * (a + b + k) / (a + 1 + k)
        total += term
        k += 1
    return front * total


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p value of a correlation ``r`` of ``n`` pairs (t distribution with n - 2 degrees); null below three pairs."""

    def tail(r: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for x, m in zip(r, n):
            df = m - 2
            out.append(np.nan if x != x or m < 3 else 0.0 if abs(x) >= 1 else _incomplete_beta(df / 2, 0.5, 1 - x * x))
        return pd.Series(out)

    return F.nullif(F.pandas_udf(tail, "double")(r, n), F.lit(float("nan")))


def p_text(p: Column) -> Column:
    """Below 0.01 in powers of ten with two decimals, else with two decimals."""
    return F.when(p < 0.01, F.format_string("%.2e", p)).otherwise(F.format_string("%.2f", p))


def map_ids(hits: DataFrame, mapping: DataFrame, key: str = "gene", target: str = "entrez") -> tuple[DataFrame, DataFrame]:
    """Hits with their ids in another naming, one row for each of several, and the keys that have none."""
    found = hits.join(mapping.select(key, target).distinct(), key)
    return found, hits.select(key).distinct().join(mapping, key, "left_anti")
