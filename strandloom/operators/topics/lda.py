"""Latent Dirichlet allocation by variational Bayes: passes over Arrow lists, sums of the topics' statistics by slice."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import cut

#: Distinct genes that a vocabulary may have on the driver.
MOST_GENES = 200_000
#: Topics times genes of a model; the driver holds one such matrix, and each worker one.
MOST_WEIGHTS = 20_000_000
#: Cells whose topic weights are iterated together, few enough for a processor's cache; a cell's result doesn't depend on the others.
CELLS = 1024
#: A cell is settled when its topic weights, which sum to its tokens and priors, move less than this on average.
SETTLED = 1e-3


def vocabulary(counts: DataFrame, gene: str = "gene") -> list[str]:
    names = [r[0] for r in counts.select(gene).distinct().orderBy(gene).limit(MOST_GENES + 1).collect()]
    if len(names) > MOST_GENES:
        raise ValueError(f"more than {MOST_GENES} genes")
    return names


def bags(counts: DataFrame, cell: str = "cell_id", gene: str = "gene", value: str = "value") -> DataFrame:
    """``cell, genes, values``: the genes of each cell in order, with whole counts of at least 1."""
    whole = counts.withColumn("__v", F.floor(value)).where("__v >= 1")
    packed = whole.groupBy(cell).agg(F.array_sort(F.collect_list(F.struct(F.col(gene).alias("g"), F.col("__v").alias("v")))).alias("__x"))
    return packed.select(cell, F.transform("__x", lambda e: e["g"]).alias("genes"), F.transform("__x", lambda e: e["v"]).alias("values"))


@dataclass
class Fitted:
    """``gene_topic`` (gene, topic_id, weight), ``cell_topic`` (cell, topic_id, weight) and what else the model says of itself."""

    gene_topic: DataFrame
    cell_topic: DataFrame
    about: dict


def numbered(counts: DataFrame, genes: Sequence[str], cell: str = "cell_id", gene: str = "gene", value: str = "value") -> DataFrame:
    """``cell, genes, values``: numbers of the vocabulary's genes that a cell has, in order, and their whole counts of at least 1; other genes are left out."""
    names = counts.sparkSession.createDataFrame(pa.table({gene: pa.array(list(genes), pa.string()), "number": pa.array(range(len(genes)), pa.int32())}))  # at most MOST_GENES rows
    whole = counts.join(names, gene).withColumn("v", F.floor(value).cast("int")).where("v >= 1")
    packed = whole.groupBy(cell).agg(F.array_sort(F.collect_list(F.struct("number", "v"))).alias("x"))
    return packed.select(cell, F.transform("x", lambda e: e["number"]).alias("genes"), F.transform("x", lambda e: e["v"]).alias("values"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of lists, and the length of each list."""
    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)


def gene_weights(spark: SparkSession, genes: Sequence[str], weights: np.ndarray) -> DataFrame:
    """``gene, topic_id, weight`` of a matrix topics x genes, a row for each entry, written out by tasks from a broadcast variable."""
    held, k = spark.sparkContext.broadcast((list(genes), weights)), weights.shape[0]

    def rows(batches):
        for b in batches:
            names, w = held.value
            at = b.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in np.repeat(at, k)], pa.string()), pa.array(np.tile(np.arange(k), len(at)), pa.int32()), pa.array(w[:, at].T.ravel(), pa.float64())], names=["gene", "topic_id", "weight"])

    return spark.range(len(genes)).mapInArrow(rows, "gene string, topic_id int, weight double")


def add_up(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of arrays of ``size`` doubles that tasks give as rows ``slice int, data binary`` (see ``in_slices``): each slice is summed in a task of its own, and only the sum comes here."""

    def total(t: pa.Table) -> pa.Table:
        data = t.column("data").to_pylist()
        out = np.frombuffer(data[0]).copy()
        for x in data[1:]:
            out += np.frombuffer(x)
        return pa.table({"slice": t.column("slice").slice(0, 1), "data": pa.array([out.tobytes()], pa.binary())})

    got = parts.groupBy("slice").applyInArrow(total, "slice int, data binary").toArrow().sort_by("slice")["data"].to_pylist()
    return np.concatenate([np.frombuffer(x) for x in got]) if got else np.zeros(size)


def in_slices(x: np.ndarray, rows: int = 1 << 16) -> pa.RecordBatch:
    cuts = range(0, len(x), rows)
    return pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([x[i : i + rows].tobytes() for i in cuts], pa.binary())], names=["slice", "data"])


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma of positive numbers."""
    y = x + 6
    r = 1 / (y * y)
    out = np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    for i in range(6):
        out -= 1 / (x + i)
    return out


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, x.ravel().tolist()), np.float64, x.size).reshape(x.shape)


@dataclass
class Topics:
    """``weights``: topics x genes, the parameters of each topic's Dirichlet distribution over the genes; ``alpha`` and ``eta``: the priors of cells and topics."""

    weights: np.ndarray
    alpha: float
    eta: float

    def topicsMatrix(self) -> DenseMatrix:  # noqa: N802  named as in pyspark.ml
        """Genes x topics."""
        return DenseMatrix(self.weights.shape[1], self.weights.shape[0], self.weights.ravel())

    def means(self) -> np.ndarray:
        """Topics x genes: the expected logarithm of each gene's share of a topic."""
        return digamma(self.weights) - digamma(self.weights.sum(axis=1, keepdims=True))


def settle(genes: np.ndarray, sizes: np.ndarray, values: np.ndarray, beta: np.ndarray, alpha: float) -> np.ndarray:
    """Topics x cells: the weights of the topics in each cell, iterated for each cell until they stand still. ``beta``: exponential of ``Topics.means``.

    A cell starts with its tokens spread evenly, so nothing is drawn. Settled cells drop out of the iteration.
    """
    ends = np.r_[0, np.cumsum(sizes)]
    out = np.empty((len(beta), len(sizes)))
    for first in range(0, len(sizes), CELLS):
        n = sizes[first : first + CELLS]
        at, part = np.arange(first, first + len(n)), slice(ends[first], ends[first + len(n)])
        w, v = beta[:, genes[part]], values[part].astype(np.float64)
        starts, doc = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        tokens = np.add.reduceat(v, starts)
        gamma = np.repeat((alpha + tokens / len(beta))[None, :], len(beta), axis=0)
        moving = np.ones(len(n), bool)
        while moving.any():
            e = np.exp(digamma(gamma))
            norm = np.einsum("kn,kn->n", np.take(e, doc, axis=1), w) + 1e-100
            new = alpha + e * np.add.reduceat(w * (v / norm), starts, axis=1)
            stopped = moving & (np.abs(new - gamma).mean(axis=0) < SETTLED + 1e-12 * tokens)  # the second for numbers so large that rounding moves them
            out[:, at[stopped]] = new[:, stopped]
            moving &= ~stopped
            gamma = new
            if moving.sum() < 0.75 * len(moving):
                here = moving[doc]
                w, v, gamma, n, at, tokens = w[:, here], v[here], gamma[:, moving], n[moving], at[moving], tokens[moving]
                starts, doc, moving = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n), np.ones(len(n), bool)
    return out


def _lists(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    genes, sizes = flat(b.column("genes"))
    return genes, sizes, flat(b.column("values"))[0]


def _pass(x: DataFrame, topics: Topics) -> np.ndarray:
    """Topics x genes: the tokens of each gene that fall to each topic, over all cells."""
    k, v = topics.weights.shape
    held, alpha = x.sparkSession.sparkContext.broadcast(np.exp(topics.means())), topics.alpha

    def count(batches):
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            genes, sizes, values = _lists(b)
            beta, doc = held.value, np.repeat(np.arange(len(sizes)), sizes)
            e = np.exp(digamma(settle(genes, sizes, values, beta, alpha)))
            norm = 1e-100 + sum(e[j][doc] * beta[j][genes] for j in range(k))
            r = values / norm
            found = np.concatenate([np.bincount(genes, e[j][doc] * r, v) for j in range(k)])
            total = found if total is None else total + found
        if total is not None:
            yield in_slices(total)

    out = add_up(x.mapInArrow(count, "slice int, data binary"), k * v).reshape(k, v) * held.value
    held.unpersist()
    return out


def _judged(x: DataFrame, topics: Topics, cell: str) -> DataFrame:
    """``cell, weights, bound, tokens``: each cell's shares of the topics, its part of the lower bound of the log likelihood, and its tokens."""
    held, alpha, k = x.sparkSession.sparkContext.broadcast(np.exp(topics.means())), topics.alpha, len(topics.weights)

    def judge(batches):
        for b in batches:
            if not b.num_rows:
                continue
            genes, sizes, values = _lists(b)
            beta, doc, starts = held.value, np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            gamma = settle(genes, sizes, values, beta, alpha)
            total = gamma.sum(axis=0)
            mean = digamma(gamma) - digamma(total)
            e = np.exp(mean)
            norm = 1e-100 + sum(e[j][doc] * beta[j][genes] for j in range(k))
            bound = np.add.reduceat(values * np.log(norm), starts) + ((alpha - gamma) * mean + _lgamma(gamma) - math.lgamma(alpha)).sum(axis=0) + math.lgamma(alpha * k) - _lgamma(total)
            ends = pa.array(np.arange(len(sizes) + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array((gamma / total).T.ravel())), pa.array(bound), pa.array(np.add.reduceat(values.astype(np.int64), starts))], names=[cell, "weights", "bound", "tokens"])

    return x.mapInArrow(judge, f"`{cell}` {x.schema[cell].dataType.simpleString()}, weights array<double>, bound double, tokens bigint")


def _perplexity(judged: DataFrame, topics: Topics) -> float:
    """Minus the lower bound of the log likelihood a token, as pyspark.ml's ``logPerplexity``."""
    got = judged.agg(F.sum("bound").alias("bound"), F.sum("tokens").alias("tokens")).head()
    if not got.tokens:
        return math.nan
    w, eta = topics.weights, topics.eta
    own = ((eta - w) * topics.means() + _lgamma(w) - math.lgamma(eta)).sum() + (math.lgamma(eta * w.shape[1]) - _lgamma(w.sum(axis=1))).sum()
    return -(got.bound + float(own)) / got.tokens


def fit_lda(counts: DataFrame, k: int, max_iter: int = 100, seed: int = 9, alpha: float | None = None, eta: float | None = None, cell: str = "cell_id") -> Fitted:
    """Variational Bayes with symmetric priors of 1 / k, or those given. Full distributions are returned, in the given gene order.

    Every iteration is a pass over all cells, each counted once; of the topics' weights the share (1 + iteration) ^ -0.51 is made new. This is pyspark.ml's online optimizer with a learning offset
    of 1, whose passes draw the cells with replacement. Only the start of the topics is drawn, so the fit doesn't depend on how cells lie in partitions (but for rounding).
    """
    genes, spark = vocabulary(counts), counts.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a pass is work for the processor, however few the bytes
    x = cut(numbered(counts, genes, cell).repartition(tasks, cell))  # read once by every pass
    topics = Topics(np.random.default_rng(seed).gamma(100.0, 0.01, (k, len(genes))), alpha or 1 / k, eta or 1 / k)
    for t in range(1, max_iter + 1):
        topics.weights = topics.weights + (1 + t) ** -0.51 * (_pass(x, topics) + topics.eta - topics.weights)
    judged = cut(_judged(x, topics, cell))
    w = topics.weights
    return Fitted(gene_weights(spark, genes, w / w.sum(axis=1, keepdims=True)), _long(judged, cell), {"model": topics, "genes": genes, "perplexity": _perplexity(judged, topics)})


def _long(judged: DataFrame, cell: str) -> DataFrame:
    return judged.select(cell, F.posexplode("weights").alias("topic_id", "weight"))


def infer_lda(fitted: Fitted, counts: DataFrame, cell: str = "cell_id") -> DataFrame:
    """``cell, topic_id, weight`` of other samples; genes the model doesn't know are left out."""
    return _long(_judged(numbered(counts, fitted.about["genes"], cell), fitted.about["model"], cell), cell)


def vectors_of(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))
