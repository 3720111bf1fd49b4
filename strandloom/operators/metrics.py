"""Agreement of predictions with truth, and of labelings with each other."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.prefix import ranks
from strandloom.session import cut


def regression(df: DataFrame, predicted: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """n, Pearson correlation (null for fewer than 3 rows or no spread), RMSE, MSE, MAE and R2 of pairs."""
    p, t = F.col(predicted), F.col(truth)
    e = p - t
    parts = df.groupBy(*by).agg(
        F.count(e).alias("n"), F.corr(p, t).alias("__r"), F.stddev_pop(p).alias("__sp"), F.stddev_pop(t).alias("__st"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae")
    )
    ok = (F.col("n") >= 3) & (F.col("__sp") > 0) & (F.col("__st") > 0)
    r2 = F.when(F.col("__st") > 0, 1 - F.col("mse") / F.col("__st") ** 2)
    return parts.select(*by, "n", F.when(ok, F.col("__r")).alias("pcc"), F.sqrt("mse").alias("rmse"), "mse", "mae", r2.alias("r2"))


def nmi(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``nmi``: mutual information of two labelings over the mean of their entropies; 1 if both are constant."""
    n = pairs.groupBy(a, b).agg(F.count("*").alias("__n"))
    every = Window.partitionBy(F.lit(0))  # pairs of labels
    total = F.sum("__n").over(every)
    c = n.withColumn("__p", F.col("__n") / total).withColumn("__pa", F.sum("__n").over(Window.partitionBy(a)) / total).withColumn("__pb", F.sum("__n").over(Window.partitionBy(b)) / total)
    mi = F.sum(F.col("__p") * F.ln(F.col("__p") / (F.col("__pa") * F.col("__pb"))))
    ha, hb = -F.sum(F.col("__p") * F.ln("__pa")), -F.sum(F.col("__p") * F.ln("__pb"))
    return c.agg(F.when(ha + hb > 0, 2 * mi / (ha + hb)).otherwise(1.0).alias("nmi"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, n, share``: rows of each pair of labels, and their share of the rows with the same ``b``."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(b)))


def cosine_coherence(tops: DataFrame, vectors: DataFrame, topic: str = "topic_id", item: str = "gene") -> DataFrame:
    """``topic, coherence``: mean cosine of the vectors (``item, position, weight``; absent positions are 0) of each two of a topic's top items (``topic, item``).

    Items without a vector, or with one of zeros, have a cosine of 0 with all others. Pairs are within the few top items of a topic.
    """
    mine = vectors.join(tops.select(item).distinct(), item)
    norms = mine.groupBy(item).agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("__n"))
    pairs = tops.select(topic, item).join(tops.select(topic, F.col(item).alias("__other")), topic).where(F.col(item) < F.col("__other"))
    other = mine.select(F.col(item).alias("__other"), "position", F.col("weight").alias("__w"))
    dots = pairs.join(mine, item).join(other, ["__other", "position"]).groupBy(topic, item, "__other").agg(F.sum(F.col("weight") * F.col("__w")).alias("__d"))
    full = pairs.join(dots, [topic, item, "__other"], "left").join(norms, item, "left").join(norms.select(F.col(item).alias("__other"), F.col("__n").alias("__m")), "__other", "left")
    return full.groupBy(topic).agg(F.avg(F.coalesce(F.try_divide("__d", F.col("__n") * F.col("__m")), F.lit(0.0))).alias("coherence"))


def confusion_scores(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """One row: accuracy and the mean F1 over the classes of truth or prediction."""
    pairs = df.groupBy(predicted, truth).agg(F.count("*").alias("n"))
    hit = F.when(F.col(predicted) == F.col(truth), F.col("n")).otherwise(0)
    as_p = pairs.select(F.col(predicted).alias("c"), "n", hit.alias("tp"), F.lit(0).alias("truth_n"), F.col("n").alias("pred_n"))
    as_t = pairs.select(F.col(truth).alias("c"), "n", F.lit(0).alias("tp"), F.col("n").alias("truth_n"), F.lit(0).alias("pred_n"))
    per = as_p.unionAll(as_t).groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("truth_n").alias("t"), F.sum("pred_n").alias("p"))
    return per.agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(2 * F.col("tp") / (F.col("t") + F.col("p"))).alias("macro_f1"))


def bootstrap(df: DataFrame, unit: str, predicted: str, truth: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """One row: PCC and RMSE of the pairs, and their standard deviations over ``rounds`` resamplings of the units with replacement.

    A unit's multiplicity in a round is its number of draws among as many as there are units: each of the n draws of a round picks a unit by the MD5 hash of round, draw and seed.
    Units (cell types or samples) are numbered in the order of their names, in slices of like names.
    """
    mark = F.col(unit).cast("string")
    units = cut(df.select(unit).distinct())  # counted and numbered
    n = units.count()
    units = ranks(units, [], F.left(mark, F.lit(3)), [mark], "__u").withColumn("__u", F.col("__u") - 1)
    draws = df.sparkSession.range(rounds).select(F.col("id").alias("round"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("__d"))
    drawn = draws.select("round", F.pmod(F.conv(F.left(F.md5(F.concat_ws("-", "round", "__d", F.lit(seed)).cast("binary")), F.lit(8)), 16, 10).cast("bigint"), F.lit(max(n, 1))).alias("__u")).groupBy("round", "__u").agg(F.count("*").alias("w"))
    x = drawn.join(units, "__u").join(df.select(unit, F.col(predicted).alias("p"), F.col(truth).alias("t")), unit)
    m = x.groupBy("round").agg(*[F.sum(F.col("w") * e).alias(k) for k, e in {"n": F.lit(1), "p": F.col("p"), "t": F.col("t"), "pp": F.col("p") ** 2, "tt": F.col("t") ** 2, "pt": F.col("p") * F.col("t"), "ee": (F.col("p") - F.col("t")) ** 2}.items()])
    vp, vt = F.col("pp") - F.col("p") ** 2 / F.col("n"), F.col("tt") - F.col("t") ** 2 / F.col("n")
    pcc = F.when((vp > 1e-15) & (vt > 1e-15), (F.col("pt") - F.col("p") * F.col("t") / F.col("n")) / F.sqrt(vp * vt))
    sds = m.agg(F.stddev_pop(pcc).alias("pcc_sd"), F.stddev_pop(F.sqrt(F.col("ee") / F.col("n"))).alias("rmse_sd"))
    one = F.lit(1).alias("__one")
    return regression(df, predicted, truth).select(one, "n", "pcc", "rmse").join(sds.select(one, "*"), "__one").drop("__one")  # one row each


def _tail(k: int, total: int, marked: int, drawn: int) -> float:
    """P(at least k marked among ``drawn`` of ``total`` with ``marked``)."""
    lf = math.lgamma

    def choose(n: int, r: int) -> float:
        return lf(n + 1) - lf(r + 1) - lf(n - r + 1)

    top = min(marked, drawn)
    if k <= max(0, drawn + marked - total):
        return 1.0
    logs = [choose(marked, i) + choose(total - marked, drawn - i) - choose(total, drawn) for i in range(k, top + 1)]
    most = max(logs, default=-math.inf)
    return min(1.0, math.exp(most) * math.fsum(math.exp(x - most) for x in logs)) if logs else 0.0


def hypergeometric_tail(k: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """Probability of at least ``k`` marked among the drawn, in Arrow batches."""

    def tail(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
        return pd.Series([_tail(*map(int, x)) for x in zip(k, total, marked, drawn)])

    return F.pandas_udf(tail, "double")(k, total, marked, drawn)


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, in Arrow batches; null for null and NaN."""

    def tail(z: pd.Series) -> pd.Series:
        return pd.Series([math.erfc(abs(x) / math.sqrt(2)) if x == x and x is not None else np.nan for x in z])

    return F.nullif(F.pandas_udf(tail, "double")(z), F.lit(float("nan")))


def benjamini_hochberg(df: DataFrame, p: str, within: Sequence[str], out: str = "p_adjusted") -> DataFrame:
    """Adjusted p values: the smallest p * m / rank at or above each."""
    w = Window.partitionBy(*within)
    up = w.orderBy(F.asc(p))
    ranked = df.withColumn("__q", F.col(p) * F.count("*").over(w) / F.row_number().over(up))
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min("__q").over(w.orderBy(F.desc(p), F.asc("__q")).rowsBetween(Window.unboundedPreceding, 0)))).drop("__q")


def over_representation(hits: DataFrame, sets: DataFrame, universe: int | Column, low: int = 10, high: int = 500) -> DataFrame:
    """``topic_id, set_id, k, n, m, fold, p, p_adjusted``: enrichment of each topic's genes in each gene set of ``low`` to ``high`` genes."""
    sized = sets.select("set_id", "gene").distinct().withColumn("m", F.count("*").over(Window.partitionBy("set_id"))).where(F.col("m").between(low, high))
    drawn = hits.select("topic_id", "gene").distinct().withColumn("n", F.count("*").over(Window.partitionBy("topic_id")))
    k = drawn.join(sized, "gene").groupBy("topic_id", "set_id", "n", "m").agg(F.count("*").alias("k"))
    fold = (F.col("k") / F.col("n")) / (F.col("m") / F.lit(universe))
    scored = k.withColumn("fold", fold).withColumn("p", hypergeometric_tail(F.col("k"), F.lit(universe), F.col("m"), F.col("n")))
    return benjamini_hochberg(scored, "p", ["topic_id"])


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function by Stirling's series, moved up by seven for small arguments."""
    up = F.when(x < 7, x + 7).otherwise(x)
    series = (up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi) + 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * up * up * up * up * up)
    down = F.lit(0.0)
    for i in range(7):
        down = down + F.ln(x + i)
    return F.when(x < 7, series - down).otherwise(series)
