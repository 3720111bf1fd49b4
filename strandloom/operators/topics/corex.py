"""Anchored correlation explanation over binary data (Gallagher, Reing, Kale and Ver Steeg 2017).

Every iteration is one pass over the cells: a task holds the parameters (topics by genes), computes each cell's topic probabilities from the genes it has, and
returns sums by topic and gene, which Spark adds up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.topics.lda import MOST_WEIGHTS, Fitted, add_up, flat, gene_weights, in_slices, vocabulary
from strandloom.session import cut


class Parameters:
    """log p(x given y) for x, y in 0 and 1, the weights alpha and log p(y)."""

    def __init__(self, k: int, v: int) -> None:
        self.log_x = np.zeros((2, 2, k, v))  # by y, x
        self.log_px = np.zeros((2, v))
        self.alpha = np.full((k, v), 0.5)
        self.log_y = np.log(np.full((2, k), 0.5))

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """By y and topic: the log weight of a cell without genes, and what each gene adds."""
        ratio = self.log_x - self.log_px[None, :, None, :]
        return self.log_y + (self.alpha[None] * ratio[:, 0]).sum(axis=2), self.alpha[None] * (ratio[:, 1] - ratio[:, 0])


def posterior(base: np.ndarray, step: np.ndarray, genes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p(y = 1 given x) of cells whose genes lie end to end in ``genes``, ``sizes`` of them each, and the log partition of each topic; rows are cells."""
    z = np.repeat(base[:, :, None], len(sizes), axis=2)
    some = sizes > 0
    if some.any():
        z[:, :, some] += np.add.reduceat(step[:, :, genes], (np.cumsum(sizes) - sizes)[some], axis=2)
    top = z.max(axis=0)
    norm = top + np.log(np.exp(z - top).sum(axis=0))
    return np.exp(z[1] - norm).T, norm.T


def _sums(cells: DataFrame, k: int, v: int, params: Parameters | None, seed: int, anchored: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means over the cells of p(y), p(y) x, x and of the log partition; k * v numbers on the driver.

    Without parameters p(y) is random; in topics with anchors it lies halfway to the share of the anchored genes (``anchored``: gene to topic) that
    the cell has, so an anchored topic starts on the side of its genes.
    """
    spark = cells.sparkSession
    sizes_of = np.bincount(list(anchored.values()), minlength=k)
    topic = np.full(v, -1)
    topic[list(anchored)] = list(anchored.values())
    held = spark.sparkContext.broadcast(params.steps() if params is not None else None)

    def start(names: list[str], genes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        p = np.stack([np.random.default_rng([seed, *c.encode()]).random(k) for c in names])
        owner, t = np.repeat(np.arange(len(names)), sizes), topic[genes]
        has = np.bincount(owner[t >= 0] * k + t[t >= 0], minlength=len(names) * k).reshape(-1, k)
        return np.where(sizes_of > 0, (p + has / np.maximum(sizes_of, 1)) / 2, p)

    def add(batches):
        py, pyx, x, tc, n = np.zeros(k), np.zeros((k, v)), np.zeros(v), np.zeros(k), 0
        for b in batches:
            if not b.num_rows:
                continue
            genes, sizes = flat(b.column("genes"))
            if held.value is None:
                p = start(b.column("cell_id").to_pylist(), genes, sizes)
            else:
                p, norm = posterior(*held.value, genes, sizes)
                tc += norm.sum(axis=0)
            py += p.sum(axis=0)
            n += len(sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            for t in range(k):
                pyx[t] += np.bincount(genes, weights=p[owner, t], minlength=v)
            x += np.bincount(genes, minlength=v)
        yield in_slices(np.concatenate([py, tc, [n], x, pyx.ravel()]))

    out = add_up(cells.mapInArrow(add, "slice int, data binary"), 2 * k + 1 + v + k * v)
    n = max(out[2 * k], 1.0)
    held.unpersist()
    return out[:k] / n, out[2 * k + 1 + v :].reshape(k, v) / n, out[2 * k + 1 : 2 * k + 1 + v] / n, out[k : 2 * k] / n


def infer_corex(fitted: Fitted, counts: DataFrame, cell: str = "cell_id") -> DataFrame:
    """``cell, topic_id, weight``: p(topic given its genes) of cells or samples the model has not seen. Genes it doesn't know are left out; a cell without any of them has no rows."""
    spark = counts.sparkSession
    names = spark.createDataFrame(pa.table({"gene": pa.array(fitted.about["genes"], pa.string()), "number": pa.array(range(len(fitted.about["genes"])), pa.int32())}))
    return _labelled(counts.join(names, "gene").groupBy(cell).agg(F.array_sort(F.collect_set("number")).alias("genes")), fitted.about["params"], cell)


def _labelled(cells: DataFrame, params: Parameters, cell: str = "cell_id") -> DataFrame:
    held, k = cells.sparkSession.sparkContext.broadcast(params.steps()), params.alpha.shape[0]

    def label(batches):
        for b in batches:
            if not b.num_rows:
                continue
            p, _ = posterior(*held.value, *flat(b.column("genes")))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), k))), pa.array(np.tile(np.arange(k), b.num_rows), pa.int32()), pa.array(p.ravel())], names=[cell, "topic_id", "weight"])

    return cells.select(cell, "genes").mapInArrow(label, f"{cell} string, topic_id int, weight double")


def fit_corex(counts: DataFrame, k: int, anchors: dict[str, int] | None = None, strength: float = 2.0, n_iter: int = 100, seed: int = 1) -> Fitted:
    """Topics as latent binary factors of the genes a cell has. Anchored genes keep the weight ``strength`` in their topic.

    ``gene_topic`` holds the mutual information of gene and topic times its weight; ``cell_topic`` p(topic given cell). ``about["tc"]`` is the total correlation
    after each iteration, ``about["tcs"]`` that of each topic at the end. Ends after ``n_iter`` iterations, or when the total correlation has stood still for ten.
    """
    spark = counts.sparkSession
    genes = vocabulary(counts)
    number = {g: i for i, g in enumerate(genes)}
    if k * len(genes) > MOST_WEIGHTS:
        raise ValueError(f"more than {MOST_WEIGHTS} topics times genes")
    names = spark.createDataFrame(pa.table({"gene": pa.array(genes, pa.string()), "number": pa.array(range(len(genes)), pa.int32())}))
    cells = cut(counts.join(names, "gene").groupBy("cell_id").agg(F.array_sort(F.collect_set("number")).alias("genes")))
    v, eps = len(genes), 1e-9
    params, history, alpha = None, [], np.full((k, v), 0.5)
    info, tc = np.zeros((k, v)), np.zeros(k)
    anchored = {number[g]: t for g, t in (anchors or {}).items() if g in number and t < k}
    for it in range(n_iter + 1):
        py, pyx, px, tc = _sums(cells, k, v, params, seed, anchored)
        if it:
            history.append(float(tc.sum()))
            settled = len(history) >= 10 and abs(np.mean(history[-5:]) - np.mean(history[-10:-5])) < 1e-5
        py = np.clip(py, eps, 1 - eps)
        px = np.clip(px, eps, 1 - eps)
        x1y1 = np.clip(pyx, eps, None)
        x1y0 = np.clip(px - pyx, eps, None)
        x0y1 = np.clip(py[:, None] - pyx, eps, None)
        x0y0 = np.clip(1 - px - py[:, None] + pyx, eps, None)
        new = Parameters(k, v)
        new.log_x[1, 1], new.log_x[1, 0] = np.log(x1y1 / py[:, None]), np.log(x0y1 / py[:, None])
        new.log_x[0, 1], new.log_x[0, 0] = np.log(x1y0 / (1 - py[:, None])), np.log(x0y0 / (1 - py[:, None]))
        new.log_px = np.log(np.stack([1 - px, px]))
        new.log_y = np.log(np.stack([1 - py, py]))
        info = sum(m * (new.log_x[y, x] - new.log_px[x]) for m, y, x in ((x1y1, 1, 1), (x1y0, 0, 1), (x0y1, 1, 0), (x0y0, 0, 0)))
        info = np.clip(info, 0, None)
        best = info.max(axis=0, keepdims=True)
        target = np.exp(np.clip((info - best) / np.maximum(best, eps) * 10, -50, 0)) if k > 1 else np.ones((k, v))
        alpha = 0.3 * alpha + 0.7 * target if it else target
        for g, t in anchored.items():
            alpha[:, g] = 0
            alpha[t, g] = strength
        new.alpha = alpha
        params = new
        if it and settled:
            break
    weights = alpha * info
    return Fitted(gene_weights(spark, genes, weights).where("weight > 0"), _labelled(cells, params), {"tc": history, "tcs": tc.tolist(), "genes": genes, "params": params})


def hierarchy(fitted: Fitted, layers: list[int], n_iter: int = 100, seed: int = 1, most_edges: int = 200) -> tuple[list[Fitted], DataFrame]:
    """Fits each further layer on the labels (p > 0.5) of the one below. ``edges``: ``parent_layer, parent, child_layer, child, weight``, at most ``most_edges`` a layer."""
    below, out, edges = fitted, [], None
    for i, k in enumerate(layers):
        labels = below.cell_topic.where("weight > 0.5").select("cell_id", F.concat(F.lit("t"), F.col("topic_id")).alias("gene"), F.lit(1.0).alias("value"))
        below = fit_corex(labels, k, n_iter=n_iter, seed=seed + i)
        out.append(below)
        e = below.gene_topic.select(F.lit(i + 1).alias("parent_layer"), F.col("topic_id").alias("parent"), F.lit(i).alias("child_layer"), F.substring("gene", 2, 9).cast("int").alias("child"), "weight").orderBy(F.desc("weight"), "parent", "child").limit(most_edges)
        edges = e if edges is None else edges.unionAll(e)
    return out, edges
