"""Cell type fractions of bulk samples through topics, reference profiles and predicted peaks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.columns import count_of
from strandloom.operators.matrix import aligned, matmul, share
from strandloom.operators.metrics import regression
from strandloom.operators.prefix import drawn_ranks
from strandloom.session import cut

#: Topics or cell types that a dense square matrix of them may have on the driver.
MOST_FACTORS = 2_000
#: Fractions of samples, and rows of a reference profile, that are broadcast.
MOST_SENT, MOST_PROFILE = 1_000_000, 200_000


def type_means(cell_topic: DataFrame, kinds: DataFrame, weight: str = "weight", over: Sequence[str] = ("topic_id",)) -> DataFrame:
    """``topic_id, main_cell_type, weight``: mean weight over all cells of the type, those without a row counting as 0."""
    sizes = kinds.groupBy("main_cell_type").agg(F.count("*").alias("__n"))
    sums = cell_topic.join(kinds, "cell_id").groupBy(*over, "main_cell_type").agg(F.sum(weight).alias("__s"))
    return sums.join(sizes, "main_cell_type").select(*over, "main_cell_type", (F.col("__s") / F.col("__n")).alias(weight))


def type_shares(kinds: DataFrame) -> DataFrame:
    """``main_cell_type, n_cells, proportion``."""
    n = kinds.groupBy("main_cell_type").agg(F.count("*").alias("n_cells"))
    return n.withColumn("proportion", F.col("n_cells") / F.sum("n_cells").over(Window.partitionBy(F.lit(0))))  # one row a type


def bayes(topic_type: DataFrame, shares: DataFrame) -> DataFrame:
    """``topic_id, main_cell_type, p``: p(topic given type) * p(type) / p(topic), where p(topic) is the topic's part of the sum of all means; 0/0 is 0."""
    every = Window.partitionBy(F.lit(0))  # topics x types rows
    pt = F.sum("weight").over(Window.partitionBy("topic_id")) / F.sum("weight").over(every)
    w = topic_type.withColumn("__pt", pt).join(shares.select("main_cell_type", "proportion"), "main_cell_type")
    return w.select("topic_id", "main_cell_type", F.when(F.col("__pt") > 0, F.col("weight") * F.col("proportion") / F.col("__pt")).otherwise(0.0).alias("p"))


def rule_weights(rule: str, topic_type: DataFrame, shares: DataFrame) -> DataFrame:
    """The topic-by-type weights of a combination rule: raw, norm, norm_sd, bayes or bayes_norm."""
    if rule == "raw":
        return topic_type.select("topic_id", "main_cell_type", "weight")
    if rule == "norm":
        return share(topic_type, ["topic_id"], "weight").select("topic_id", "main_cell_type", "weight")
    if rule == "norm_sd":
        n = count_of(shares, "main_cell_type")
        w = Window.partitionBy("topic_id")
        mean = F.sum("weight").over(w) / n
        var = F.sum(F.col("weight") ** 2).over(w) / n - mean * mean
        sd = F.sqrt(F.greatest(var, F.lit(0.0)))
        return topic_type.withColumn("__sd", sd).select("topic_id", "main_cell_type", (F.col("weight") / F.when(F.col("__sd") <= 1e-12, 1.0).otherwise(F.col("__sd"))).alias("weight"))
    p = bayes(topic_type, shares).withColumnRenamed("p", "weight")
    if rule == "bayes":
        return p
    if rule == "bayes_norm":
        return share(p, ["topic_id"], "weight")
    raise ValueError(f"unknown rule {rule}")


def fractions(topic_sample: DataFrame, weights: DataFrame, sample: str = "sample_id") -> DataFrame:
    """``sample, main_cell_type, fraction``: topic weights of a sample times the rule's weights, summing to 1 per sample."""
    raw = matmul(topic_sample, weights, [sample], ["topic_id"], ["main_cell_type"], "weight", "weight", "fraction")
    return share(raw, [sample], "fraction")


def reference_profile(counts: DataFrame, kinds: DataFrame) -> DataFrame:
    """``main_cell_type, gene, value``: summed counts of the type scaled to ten thousand (a total of 0 stays)."""
    sums = counts.join(kinds, "cell_id").groupBy("main_cell_type", "gene").agg(F.sum("value").alias("value"))
    scale = F.sum("value").over(Window.partitionBy("main_cell_type")) / 1e4
    return sums.withColumn("value", F.col("value") / F.when(scale == 0, 1.0).otherwise(scale))


def reference_scale(counts: DataFrame, kinds: DataFrame) -> DataFrame:
    """``main_cell_type, scale``: the summed counts of each type in ten thousands, by which its profile is divided."""
    return counts.join(kinds, "cell_id").groupBy("main_cell_type").agg((F.sum("value") / 1e4).alias("scale"))


def peak_weights(profile: DataFrame, links: DataFrame, few: bool = False) -> DataFrame:
    """``main_cell_type, peak_id, value``: profile times gene-peak weights, divided by the peak's mean over all types (a mean of 0 stays).

    ``few``: the profile is small enough to be broadcast. Then the links are shuffled by peak, and products, one for each link and type, stay in their task."""
    n = count_of(profile, "main_cell_type")
    if few:
        profile, links = F.broadcast(profile), links.repartition("peak_id")
    w = matmul(profile, links, ["main_cell_type"], ["gene"], ["peak_id"], "value", "weight")
    mean = F.sum("value").over(Window.partitionBy("peak_id")) / n
    return w.withColumn("value", F.col("value") / F.when(mean == 0, 1.0).otherwise(mean))


def predict_peaks(frac: DataFrame, peaks: DataFrame, weights: DataFrame) -> DataFrame:
    """``sample_id, main_cell_type, peak_id, value``: fraction * peak signal * weight; peaks that are 0 in all types of a sample have no row."""
    both = peaks.withColumnRenamed("value", "__peak").join(weights.withColumnRenamed("value", "__w"), "peak_id").join(frac, ["sample_id", "main_cell_type"])
    out = both.withColumn("value", F.col("fraction") * F.col("__peak") * F.col("__w"))
    return out.withColumn("__all", F.sum("value").over(Window.partitionBy("sample_id", "peak_id"))).where("__all > 0").select("sample_id", "main_cell_type", "peak_id", "value")


def _active_set(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Least squares with no negative weight from the normal equations (Lawson and Hanson)."""
    k = len(rhs)
    x, free = np.zeros(k), np.zeros(k, bool)
    tol = 1e-10 * max(1.0, np.abs(rhs).max(initial=0.0))
    for _ in range(10 * k + 10):
        grad = rhs - gram @ x
        grad[free] = -np.inf
        j = int(grad.argmax())
        if grad[j] <= tol:
            break
        free[j] = True
        while True:
            s = np.zeros(k)
            s[free] = np.linalg.lstsq(gram[np.ix_(free, free)], rhs[free], rcond=None)[0]
            if (s[free] > 0).all():
                x = s
                break
            low = free & (s <= 0)
            step = (x[low] / (x[low] - s[low])).min()
            x = x + step * (s - x)
            free &= x > 1e-14
            x[~free] = 0
            if not free.any():
                break
    return x


def nnls(basis: DataFrame, samples: DataFrame, factor: str, inner: str = "gene", sample: str = "sample_id", normal: bool = True, uniform_if_zero: bool = True) -> DataFrame:
    """``sample, factor, weight``: weights >= 0 of the factors (``factor, inner, weight``) that come closest to each sample (``sample, inner, value``) in squares.

    The products of the factors with each other and with the samples are Spark aggregates; a task solves a sample from as many numbers as there are
    factors, at most MOST_FACTORS. ``normal`` divides by the sum; a sample without any weight then is uniform, or stays without rows.
    """
    names = [r[0] for r in basis.select(factor).distinct().orderBy(factor).limit(MOST_FACTORS + 1).collect()]
    if len(names) > MOST_FACTORS:
        raise ValueError(f"more than {MOST_FACTORS} factors")
    at = {v: i for i, v in enumerate(names)}
    other = basis.withColumnRenamed(factor, "__other")
    gram = np.zeros((len(names), len(names)))
    for a, b, v in matmul(basis, other, [factor], [inner], ["__other"], "weight", "weight").collect():
        gram[at[a], at[b]] = v
    rhs = matmul(samples, basis, [sample], [inner], [factor], "value", "weight")
    kind = dict(basis.dtypes)[factor]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        b = np.zeros(len(names))
        b[[at[v] for v in pdf[factor]]] = pdf["value"]
        x = np.nan_to_num(_active_set(gram, b))
        if normal:
            x = x / x.sum() if x.sum() > 1e-12 else np.full(len(x), 1 / len(x)) if uniform_if_zero else x
        return pd.DataFrame({sample: pdf[sample].iloc[0], factor: names, "weight": x})[x > 0]

    return rhs.groupBy(sample).applyInPandas(solve, f"{sample} string, {factor} {kind}, weight double")


def external_topics(topic_sample: DataFrame, topic_type: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both matrices restricted to their common topics; an error if there is none."""
    keep = aligned(topic_sample, topic_type, "topic_id")
    return topic_sample.join(keep, "topic_id", "left_semi"), topic_type.join(keep, "topic_id", "left_semi")


def scenario(counts: DataFrame, kinds: DataFrame, keep: float, attenuation: float = 1.0, rare: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A pseudobulk of each type, all attenuated, after the type ``rare`` (by default the smallest; of equal ones the first by name) was thinned to ``max(1, int(n * keep))`` cells, and the true proportions.

    Cells are drawn by hash of their id, a type with most of them in slices."""
    sizes = kinds.groupBy("main_cell_type").agg(F.count("*").alias("__n"))
    thin = F.lit(rare) if rare is not None else sizes.agg(F.min_by("main_cell_type", F.struct("__n", "main_cell_type"))).scalar()
    sizes = sizes.select("main_cell_type", F.when(F.col("main_cell_type") == thin, F.greatest(F.lit(1), F.floor(F.col("__n") * keep))).otherwise(F.col("__n")).alias("__n"))
    left = drawn_ranks(kinds, ["main_cell_type"], "cell_id", "__r").join(sizes, "main_cell_type").where("__r <= __n").select("cell_id", "main_cell_type")
    bulk = counts.join(left, "cell_id").groupBy("main_cell_type", "gene").agg((F.sum("value") * attenuation).alias("value"))
    return bulk, type_shares(left)


def signal_scores(predicted: DataFrame, truth: DataFrame, bulk: DataFrame) -> DataFrame:
    """Agreement of predicted peaks (``sample_id, main_cell_type, peak_id, value``) with the types' measured ones (``main_cell_type, peak_id, value``), a row for each sample.

    Over the sample's peaks with a prediction: ``mae, mse, rmse, r2`` of the sums over types, the same ``_bulk`` against the sample's own signal (``sample_id, peak_id, value``), and
    ``peak_cor``, the mean over types of the correlation along the peaks (types without spread left out). Absent entries are zeros.
    """
    total = predicted.groupBy("sample_id", "peak_id").agg(F.sum("value").alias("p")).where("p > 0")
    measured = truth.groupBy("peak_id").agg(F.sum("value").alias("t"))
    both = total.join(measured, "peak_id", "left").join(bulk.select("sample_id", "peak_id", F.col("value").alias("b")), ["sample_id", "peak_id"], "left").na.fill(0.0, ["t", "b"])
    sums = regression(both, "p", "t", ["sample_id"]).select("sample_id", "n", "mae", "mse", "rmse", "r2")
    own = regression(both, "p", "b", ["sample_id"]).select("sample_id", *[F.col(c).alias(f"{c}_bulk") for c in ("mae", "mse", "rmse", "r2")])
    peaks = total.select("sample_id", "peak_id")
    cells = predicted.join(peaks, ["sample_id", "peak_id"], "left_semi").select("sample_id", "main_cell_type", "peak_id", F.col("value").alias("p"), F.lit(0.0).alias("t"))
    cells = cells.unionByName(peaks.join(truth, "peak_id").select("sample_id", "main_cell_type", "peak_id", F.lit(0.0).alias("p"), F.col("value").alias("t")))
    cells = cells.groupBy("sample_id", "main_cell_type", "peak_id").agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
    m = cells.groupBy("sample_id", "main_cell_type").agg(*[F.sum(e).alias(k) for k, e in {"p": F.col("p"), "t": F.col("t"), "pp": F.col("p") ** 2, "tt": F.col("t") ** 2, "pt": F.col("p") * F.col("t")}.items()])
    m = m.join(sums.select("sample_id", "n"), "sample_id")
    vp, vt = F.col("pp") - F.col("p") ** 2 / F.col("n"), F.col("tt") - F.col("t") ** 2 / F.col("n")
    r = F.when((vp > 1e-12 * F.col("pp")) & (vt > 1e-12 * F.col("tt")), (F.col("pt") - F.col("p") * F.col("t") / F.col("n")) / F.sqrt(vp * vt))
    return sums.join(own, "sample_id").join(m.groupBy("sample_id").agg(F.avg(r).alias("peak_cor")), "sample_id", "left")


def predicted_scores(frac: DataFrame, peaks: DataFrame, weights: DataFrame, truth: DataFrame) -> DataFrame:
    """``signal_scores`` of ``predict_peaks`` without laying the prediction out: it has samples times types times peaks rows, which are neither shuffled nor written.

    The weights and measured values of a peak (``main_cell_type, peak_id, value`` each) travel as one row and meet the samples' signals there; a sample's fractions, a number for each
    type, are broadcast up to ``MOST_SENT`` of them (8 MB), else shuffled; give ``frac`` written down, it is read twice. What leaves a task are sums for each sample and type, and for the sample as a whole under number -1.
    """
    names = [r[0] for r in frac.select("main_cell_type").distinct().orderBy("main_cell_type").limit(MOST_FACTORS + 1).collect()]
    if len(names) > MOST_FACTORS:
        raise ValueError(f"more than {MOST_FACTORS} types")
    known = F.lit(names) if names else F.array().cast("array<string>")
    at = F.nullif(F.array_position(known, F.col("main_cell_type")), F.lit(0)).cast("int") - 1  # null for types that no sample has: nothing is predicted of them
    shares = frac.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct(at.alias("k"), F.col("fraction").alias("v")))).alias("__m"))
    shares = cut(shares.select("sample_id", F.transform(F.sequence(F.lit(0), F.lit(max(len(names) - 1, 0))), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0.0))).alias("__f")))
    few = shares.count() * len(names) <= MOST_SENT
    none = F.lit(0.0)
    entries = weights.select("peak_id", at.alias("i"), F.col("value").alias("w"), none.alias("t")).unionAll(truth.select("peak_id", at.alias("i"), none.alias("w"), F.col("value").alias("t")))
    entries = entries.groupBy("peak_id", "i").agg(F.sum("w").alias("w"), F.sum("t").alias("t"))
    packed = entries.groupBy("peak_id").agg(F.collect_list(F.struct("i", "w", "t")).alias("__e"))
    met = peaks.select("sample_id", "peak_id", F.col("value").alias("__c")).join(packed, "peak_id").join(F.broadcast(shares) if few else shares, "sample_id")
    own = F.transform("__e", lambda e: F.struct(e["i"].alias("i"), (F.coalesce(F.get("__f", e["i"]), none) * F.col("__c") * e["w"]).alias("p"), e["t"].alias("t"), none.alias("b")))
    total = lambda name: F.aggregate("__own", none, lambda x, e: x + e[name])
    met = met.select("sample_id", "__c", own.alias("__own")).withColumn("__p", total("p")).where("__p > 0")
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.col("__p").alias("p"), total("t").alias("t"), F.col("__c").alias("b")))
    flat = met.select("sample_id", F.inline(F.concat(whole, "__own")))
    p, t, b, all_types = F.col("p"), F.col("t"), F.col("b"), F.col("i") < 0
    of = lambda f, e: f(F.when(all_types, e))
    m = flat.groupBy("sample_id", "i").agg(
        *[F.sum(e).alias(k) for k, e in {"p": p, "t": t, "pp": p**2, "tt": t**2, "pt": p * t}.items()],
        of(F.count, p).alias("n"), of(F.avg, F.abs(p - t)).alias("mae"), of(F.avg, (p - t) ** 2).alias("mse"), of(F.stddev_pop, t).alias("st"),
        of(F.avg, F.abs(p - b)).alias("mae_bulk"), of(F.avg, (p - b) ** 2).alias("mse_bulk"), of(F.stddev_pop, b).alias("sb"),
    )
    n = F.max("n").over(Window.partitionBy("sample_id"))
    m = m.withColumn("__n", n).withColumn("__vp", F.col("pp") - F.col("p") ** 2 / F.col("__n")).withColumn("__vt", F.col("tt") - F.col("t") ** 2 / F.col("__n"))
    r = F.when(~all_types & (F.col("__vp") > 1e-12 * F.col("pp")) & (F.col("__vt") > 1e-12 * F.col("tt")), (F.col("pt") - F.col("p") * F.col("t") / F.col("__n")) / F.sqrt(F.col("__vp") * F.col("__vt")))
    one = m.groupBy("sample_id").agg(F.max("n").alias("n"), *[of(F.max, F.col(c)).alias(c) for c in ("mae", "mse", "st", "mae_bulk", "mse_bulk", "sb")], F.avg(r).alias("peak_cor"))
    r2 = lambda mse, sd: F.when(F.col(sd) > 0, 1 - F.col(mse) / F.col(sd) ** 2)
    return one.select(
        "sample_id", "n", "mae", "mse", F.sqrt("mse").alias("rmse"), r2("mse", "st").alias("r2"), "mae_bulk", "mse_bulk", F.sqrt("mse_bulk").alias("rmse_bulk"), r2("mse_bulk", "sb").alias("r2_bulk"), "peak_cor"
    )


def sample_types(topic_sample: DataFrame, topic_type: DataFrame, sample: str = "sample_id") -> DataFrame:
    """``sample, main_cell_type, weight``: topic weights of a sample times the topics' cell type weights, each type's column first divided by its sum (+ 1e-10), summing to 1 per sample."""
    column = topic_type.withColumn("weight", F.col("weight") / (F.sum("weight").over(Window.partitionBy("main_cell_type")) + 1e-10))
    return share(matmul(topic_sample, column, [sample], ["topic_id"], ["main_cell_type"], "weight", "weight", "weight"), [sample], "weight")


def stretched(topic_type: DataFrame, high: int = 5) -> DataFrame:
    """Each type's weights brought to 0 to ``high`` over the topics, decimals cut off; 0 where a type has the same weight in all topics."""
    w = Window.partitionBy("main_cell_type")
    least, most = F.min("weight").over(w), F.max("weight").over(w)
    return topic_type.withColumn("weight", F.floor(F.round(high * F.coalesce((F.col("weight") - least) / F.nullif(most - least, F.lit(0.0)), F.lit(0.0)), 9)))
