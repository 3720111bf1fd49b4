"""Guided LDA: collapsed Gibbs sampling with seeded genes, cells distributed over the cluster.

Each sweep samples all cells against the topic counts of the sweep before (Newman et al. 2009) and adds up the new counts in Spark. Within a cell,
the tokens of one gene are drawn together from a multinomial.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.matrix import share
from strandloom.operators.topics.lda import MOST_WEIGHTS, Fitted, add_up, flat, gene_weights, in_slices, numbered, vocabulary
from strandloom.session import cut

STATE = "cell_id string, genes array<int>, values array<int>, z array<int>"


def _cell_topics(z: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Tokens of each cell and topic; every cell has a gene."""
    return np.add.reduceat(z, np.cumsum(sizes) - sizes, axis=0)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers: Stirling's series from 8 up, reached by the recurrence."""
    y, down = x.astype(float), np.zeros(x.shape)
    for _ in range(8):
        low = y < 8
        down += np.where(low, np.log(y), 0)
        y = np.where(low, y + 1, y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - down


def _topic_counts(state: DataFrame, k: int, v: int, alpha: float) -> tuple[np.ndarray, float]:
    """Tokens of each topic and gene, and the cells' part of the log likelihood, log p(assignments); k * v numbers on the driver."""

    def add(batches):
        total, part = np.zeros((v, k)), 0.0
        for b in batches:
            if not b.num_rows:
                continue
            genes, sizes = flat(b.column("genes"))
            z = flat(b.column("z"))[0].reshape(-1, k)
            for t in range(k):
                total[:, t] += np.bincount(genes, weights=z[:, t], minlength=v)
            dz = _cell_topics(z, sizes)
            part += float((_lgamma(np.array([alpha * k])) * len(sizes) - _lgamma(alpha * k + dz.sum(axis=1)).sum() + (_lgamma(alpha + dz) - _lgamma(np.array([alpha]))).sum())[0])
        yield in_slices(np.r_[part, total.T.ravel()])

    out = add_up(state.mapInArrow(add, "slice int, data binary"), 1 + k * v)
    return out[1:].reshape(k, v), float(out[0])


def _sweep(state: DataFrame, k: int, seed: int, sweep: int, odds) -> DataFrame:
    """Draws the topics of all tokens anew, those of one gene in a cell together; ``odds(genes, sizes, z)`` has a row of weights for each gene of each cell."""

    def run(batches):
        task = TaskContext.get().partitionId()
        for n, b in enumerate(batches):
            if not b.num_rows:
                continue
            genes, sizes = flat(b.column("genes"))
            z = flat(b.column("z"))[0]
            p = odds(genes, sizes, z.reshape(-1, k) if len(z) else None)
            new = np.random.default_rng([seed, sweep, task, n]).multinomial(flat(b.column("values"))[0], p / p.sum(axis=1, keepdims=True))
            ends = np.r_[0, np.cumsum(sizes * k)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("cell_id"), b.column("genes"), b.column("values"), pa.ListArray.from_arrays(pa.array(ends), pa.array(new.ravel(), pa.int32()))], names=[f.split()[0] for f in STATE.split(", ")])

    return cut(state.mapInArrow(run, STATE))


def fit_guided(counts: DataFrame, k: int, seeds: dict[str, int], confidence: float = 0.15, n_iter: int = 100, alpha: float | None = None, eta: float | None = None, seed: int = 9) -> Fitted:
    """``seeds`` maps a gene to its topic: its tokens start there with probability ``confidence``, all others spread evenly.

    The weights of ``cell_topic`` sum to 1 per cell. ``about["log_likelihood"]`` has the value after each sweep and ``about["tokens"]`` the number of tokens, which no
    sweep changes. Random numbers depend on seed, sweep, partition and batch of the written state, so a lost task repeats its draws.
    """
    genes = vocabulary(counts)
    v, a, e, spark = len(genes), alpha or 1 / k, eta or 1 / k, counts.sparkSession
    if k * v > MOST_WEIGHTS:
        raise ValueError(f"more than {MOST_WEIGHTS} topics times genes")
    topic_of = np.array([seeds.get(g, -1) for g in genes], np.int64)

    def start(g, sizes, z):
        p = np.full((len(g), k), 1 / k)
        seeded = topic_of[g] >= 0
        p[seeded] *= 1 - confidence
        p[np.flatnonzero(seeded), topic_of[g][seeded]] += confidence
        return p

    base = cut(numbered(counts, genes).sortWithinPartitions("cell_id").withColumn("z", F.array().cast("array<int>")))
    state = _sweep(base, k, seed, 0, start)
    kw, _ = _topic_counts(state, k, v, a)
    history = []
    for sweep in range(1, n_iter + 1):
        held = spark.sparkContext.broadcast((kw + e) / (kw.sum(axis=1, keepdims=True) + e * v))
        state = _sweep(state, k, seed, sweep, lambda g, sizes, z, held=held: held.value[:, g].T * (np.repeat(_cell_topics(z, sizes), sizes, axis=0) + a))
        held.unpersist()
        kw, part = _topic_counts(state, k, v, a)
        history.append(_log_likelihood(kw, e) + part)
    phi = (kw + e) / (kw + e).sum(axis=1, keepdims=True)
    long = state.select("cell_id", F.posexplode("z").alias("p", "n")).groupBy("cell_id", (F.col("p") % k).alias("topic_id")).agg((F.sum("n") + a).alias("weight"))
    return Fitted(gene_weights(spark, genes, phi), share(long, ["cell_id"], "weight"), {"genes": genes, "phi": phi, "alpha": a, "tokens": int(kw.sum()), "counts": kw, "log_likelihood": history})


def _log_likelihood(kw: np.ndarray, eta: float) -> float:
    """log p(genes given topics' assignments)."""
    k, v = kw.shape
    one = _lgamma(np.array([eta * v, eta]))
    return float(k * one[0] - _lgamma(eta * v + kw.sum(axis=1)).sum() + (_lgamma(eta + kw[kw > 0]) - one[1]).sum())


def infer_guided(fitted: Fitted, counts: DataFrame, max_iter: int = 20, tol: float = 1e-16) -> DataFrame:
    """``cell_id, topic_id, weight`` of other samples by iterated pseudo-counts: P becomes phi * (sum of P - P + alpha) for each token, at most ``max_iter`` + 1 times."""
    held, a = counts.sparkSession.sparkContext.broadcast(fitted.about["phi"]), fitted.about["alpha"]
    k = fitted.about["phi"].shape[0]

    def infer(batches):
        for b in batches:
            if not b.num_rows:
                continue
            genes, sizes = flat(b.column("genes"))
            values, ends = flat(b.column("values"))[0], np.r_[0, np.cumsum(sizes)]
            theta = np.concatenate([pseudo_counts(held.value, genes[s:e], values[s:e], a, max_iter, tol) for s, e in zip(ends[:-1], ends[1:])])
            yield pa.RecordBatch.from_arrays([b.column("cell_id").take(pa.array(np.repeat(np.arange(b.num_rows), k))), pa.array(np.tile(np.arange(k), b.num_rows), pa.int32()), pa.array(theta)], names=["cell_id", "topic_id", "weight"])

    return numbered(counts, fitted.about["genes"]).mapInArrow(infer, "cell_id string, topic_id int, weight double")


def cells_by_topic(cell_topic: DataFrame) -> DataFrame:
    """The weights of each topic divided by their sum over the cells."""
    return share(cell_topic, ["topic_id"], "weight", large=True)


def pseudo_counts(phi: np.ndarray, genes: np.ndarray, values: np.ndarray, alpha: float, max_iter: int = 20, tol: float = 1e-16) -> np.ndarray:
    """Topic weights of one cell. Tokens of one gene stay equal, so they are iterated once and counted ``values`` times."""
    p = np.zeros((len(genes), phi.shape[0]))
    for _ in range(max_iter + 1):
        new = phi[:, genes].T * ((p * values[:, None]).sum(axis=0) - p + alpha)
        new /= new.sum(axis=1, keepdims=True)
        moved = (np.abs(new - p).sum(axis=1) * values).sum()
        p = new
        if moved < tol:
            break
    return (p * values[:, None]).sum(axis=0) / values.sum()

