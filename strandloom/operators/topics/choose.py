"""Choice of a topic model over numbers of topics and seeds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import ctfidf, metrics
from strandloom.operators.deconvolve import fractions, rule_weights, type_means, type_shares
from strandloom.operators.matrix import argmax, best
from strandloom.operators.pipelines import prefer
from strandloom.operators.topics.lda import Fitted
from strandloom.session import cut


def accuracy(cell_topic: DataFrame, kinds: DataFrame, rule: str) -> DataFrame:
    """One row ``accuracy``: share of the typed cells whose heaviest type under a combination rule is their own."""
    f = fractions(cell_topic, rule_weights(rule, type_means(cell_topic, kinds), type_shares(kinds)), "cell_id").withColumn("value", F.round("fraction", 9))
    said = argmax(f, ["cell_id"], "main_cell_type").withColumnRenamed("main_cell_type", "said")
    return said.join(kinds, "cell_id").agg(F.avg((F.col("said") == F.col("main_cell_type")).cast("int")).alias("accuracy"))


def indicator(fitted: Fitted, counts: DataFrame, kinds: DataFrame, name: str = "accuracy", top: int = 30) -> DataFrame:
    """One row ``rule, metric``: the better accuracy of the two Bayes rules (``accuracy``), the mutual information of each cell's heaviest topic with its type (``nmi``), or the mean
    coherence of the topics' ``top`` genes (``umass``). ``rule`` is null for the last two."""
    if name == "accuracy":
        scores = [accuracy(fitted.cell_topic, kinds, r).select(F.lit(r).alias("rule"), "accuracy") for r in ("bayes", "bayes_norm")]
        return prefer(scores[0].unionAll(scores[1])).select("rule", F.col("accuracy").alias("metric"))
    if name == "nmi":
        top_topic = best(fitted.cell_topic, ["cell_id"], [F.desc("weight"), F.asc("topic_id")]).select("cell_id", "topic_id")
        return metrics.nmi(top_topic.join(kinds, "cell_id"), "topic_id", "main_cell_type").select(F.lit(None).cast("string").alias("rule"), F.col("nmi").alias("metric"))
    if name == "umass":
        tops = ctfidf.top_terms(fitted.gene_topic, "topic_id", top, "gene").select("topic_id", F.col("gene").alias("term"), "rank")
        docs = counts.select(F.col("cell_id").alias("doc_id"), F.col("gene").alias("term"))
        return ctfidf.umass(tops, docs, "topic_id").agg(F.avg("coherence").alias("metric")).select(F.lit(None).cast("string").alias("rule"), "metric")
    raise ValueError(f"unknown indicator {name}")


def select_topics(fit: Callable[[int, int], Fitted], counts: DataFrame, kinds: DataFrame, grid: Sequence[int], seeds: Sequence[int], name: str = "accuracy") -> DataFrame:
    """``ntopics, seed, rule, metric, chosen`` of a fit for each number of topics and seed; the highest metric is chosen, of equal ones the first in the order of the grid.

    Fits follow each other; each is a series of Spark jobs, and of each only one row is kept.
    """
    rows = []
    for n, k in enumerate(grid):
        for m, seed in enumerate(seeds):
            place = F.lit(n * len(seeds) + m).alias("__o")
            rows.append(cut(indicator(fit(k, seed), counts, kinds, name).select(F.lit(k).alias("ntopics"), F.lit(seed).alias("seed"), "rule", "metric", place)))
    runs = reduce(DataFrame.unionAll, rows)
    first = runs.agg(F.max_by("__o", F.struct(F.col("metric"), -F.col("__o")))).scalar()
    return runs.withColumn("chosen", F.col("__o") == first).drop("__o")
