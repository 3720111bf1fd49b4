"""The k most similar vectors of every vector: block matrix join of int8 product tiles."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.vectors import Copies, Index, build_index, fold_copies, lay_out, record_type, screen, slices_of, tiles_of, usable, whole
from strandloom.session import cut

PAIRS = "a bigint, b bigint, cosine double"
#: Products of queries and rows that a task has at a time.
PRODUCTS = 1 << 23


def top_per_row(a: np.ndarray, b: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best b of each a: highest cosine first, of equal ones the smaller id."""
    order = np.lexsort((b, -cosine, a))
    a, b, cosine = a[order], b[order], cosine[order]
    new = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    rank = np.arange(len(a)) - np.maximum.accumulate(np.where(new, np.arange(len(a)), 0)) if len(a) else np.zeros(0, int)
    keep = rank < k
    return a[keep], b[keep], cosine[keep]


class Heaps:
    """A heap of the k best partners of each row, its worst at the root; of equal cosines the smaller id is better."""

    def __init__(self, rows: int, k: int) -> None:
        self.k, self.worst = k, np.full(rows, -2.0)
        self.heaps: dict[int, list[tuple[float, int]]] = {}

    def offer(self, row: np.ndarray, partner: np.ndarray, cosine: np.ndarray) -> None:
        """Merges the pairs of a tile: those worse than a row's full heap are passed over, and a tile's k best of a row enter."""
        may = cosine >= self.worst[row]
        for r, p, c in zip(*(x.tolist() for x in top_per_row(row[may], partner[may], cosine[may], self.k))):
            heap = self.heaps.setdefault(r, [])
            if len(heap) < self.k:
                heapq.heappush(heap, (c, -p))
            else:
                heapq.heappushpop(heap, (c, -p))
            if len(heap) == self.k:
                self.worst[r] = heap[0][0]

    def table(self, ids: np.ndarray) -> pa.Table:
        row = np.repeat(np.array(list(self.heaps), np.int64), [len(h) for h in self.heaps.values()])
        best = [x for h in self.heaps.values() for x in h]
        return pa.table({"a": pa.array(ids[row] if len(row) else [], pa.int64()), "b": pa.array([-p for _, p in best], pa.int64()), "cosine": pa.array([c for c, _ in best], pa.float64())})


def _near(k: int, min_cosine: float, kind: np.dtype, index: Index):
    def find(t: pa.Table) -> pa.Table:
        out = []
        for tiles in tiles_of(t, kind, index):
            heaps = Heaps(len(tiles.ids), k)
            for i, j, cosine in tiles.pairs(min_cosine):
                heaps.offer(np.r_[i, j], tiles.ids[np.r_[j, i]], np.r_[cosine, cosine])
            out.append(heaps.table(tiles.ids))
        return pa.concat_tables(out)

    return find


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return pairs.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def _unfold(pairs: DataFrame, copies: Copies, k: int) -> DataFrame:
    """From pairs of representatives to pairs of ids. A copy's nearest are the other copies; of a set of copies only
    the k + 1 smallest ids can be among anyone's k nearest if equals are taken in the order of their ids."""
    w = Window.partitionBy("rep").orderBy("vec_id")
    firsts = copies.members.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k + 1).groupBy("rep").agg(F.collect_list("vec_id").alias("ids"))
    own = firsts.select(F.col("rep").alias("a"), F.explode("ids").alias("b"), F.lit(1.0).alias("cosine"))
    others = pairs.join(firsts.withColumnRenamed("rep", "b"), "b", "left").select("a", F.explode(F.coalesce("ids", F.array("b"))).alias("b"), "cosine")
    near = _ranked(own.unionAll(others), k + 1)
    every = near.join(copies.members.select(F.col("rep").alias("a"), "vec_id"), "a", "left").select(F.coalesce("vec_id", "a").alias("a"), "b", "cosine")
    return _ranked(every.where("a <> b"), k)


def chosen(vectors: DataFrame, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The rows of ``vectors`` named by ``ids``. The ids are counted; up to ``most`` (8 MB) are broadcast, so the vectors aren't shuffled."""
    ids = cut(ids.distinct())
    return vectors.join(F.broadcast(ids) if ids.count() <= most else ids, "vec_id", "left_semi")


def folded(df: DataFrame, id_col: str, vec_col: str, dim: int) -> Copies:
    return fold_copies(usable(df, id_col, vec_col, dim))


def with_neighbours(df: DataFrame, copies: Copies, dim: int, min_cosine: float, block_rows: int, and_copies: bool = False) -> tuple[DataFrame, Index]:
    """The representatives that may have a partner of at least ``min_cosine`` (with ``and_copies`` also those with copies), written down, and an index of their own.

    All representatives meet as int8 codes, each two of them once; those without any possible partner drop out. What is left, often few, meets again.
    ``block_rows``: rows of the parts within a task; the result doesn't depend on it.
    """
    index = whole(df.count(), dim, block_rows)
    ids = screen(copies.reps, index, dim, min_cosine)
    if and_copies:
        ids = ids.unionAll(copies.members.select(F.col("rep").alias("vec_id")))
    near = cut(chosen(copies.reps, ids))
    return near, whole(near.count(), dim, block_rows)


def nearest_above(df: DataFrame, k: int, min_cosine: float, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, block_rows: int = 256) -> DataFrame:
    """Rows ``a, b, cosine``: for every usable vector a, its up to k most similar others b with a cosine of at least ``min_cosine``.

    First all rows meet as int8 codes, and those without any possible partner drop out.
    The rest meet again with their float vectors; surviving pairs are recomputed, a heap of k a row takes them in tile after tile, and the k best
    over all tasks stay. No pair is lost at any size: the codes' error bounds are kept, and every two rows meet unless geometry rules them out (see ``Tiles.parts``). Equal vectors are near each other with cosine 1; equals are taken in the order of their ids. Unusable vectors (null, wrong
    length, NaN, infinite, all zero, without id) have no rows; an empty table gives an empty result; other columns are left out.
    """
    copies = folded(df, id_col, vec_col, dim)
    near, index = with_neighbours(df, copies, dim, min_cosine, block_rows)
    kind = record_type(dim, index.visits)
    found = lay_out(near.withColumn("extra", F.lit(0)), index, dim, kind).groupBy("tile_group").applyInArrow(_near(k, min_cosine, kind, index), PAIRS)
    return _unfold(_ranked(found, k), copies, k)


def _searched(k: int, kind: np.dtype, index: Index):
    def find(t: pa.Table) -> pa.Table:
        out = []
        for tiles in tiles_of(t, kind, index):
            asks, home = np.flatnonzero(tiles.rec["extra"] == 1), np.flatnonzero(tiles.rec["visits"][:, 0] == tiles.block)
            heaps, res = Heaps(len(tiles.ids), k), len(home)
            most = float(tiles.err[home].max()) if res else 0.0
            step = max(1, min(256, PRODUCTS // max(res, 1)))
            for s in range(0, len(asks) if res else 0, step):
                i = asks[s : s + step]
                est = np.full((len(i), res), -2.0, np.float32)
                for b in range(0, res, TILE_COLUMNS):
                    h = home[b : b + TILE_COLUMNS]
                    est[:, b : b + TILE_COLUMNS] = (tiles.code[i] @ tiles.code[h].T) * tiles.scale[i][:, None] * tiles.scale[h][None, :]
                est[tiles.ids[i][:, None] == tiles.ids[home][None, :]] = -2
                if tiles.slice is not None:
                    est[(tiles.slice[i][:, None] != tiles.slice[home][None, :]) != tiles.across] = -2
                slack = tiles.err[i] + most + tiles.err[i] * most + 1e-5
                kth = np.partition(est, max(res - k, 0), axis=1)[:, max(res - k, 0)]
                r, j = np.nonzero((est >= (kth - 2 * slack)[:, None]) & (est > -1.5))
                heaps.offer(i[r], tiles.ids[home[j]], tiles.exact(i[r], home[j]))
            out.append(heaps.table(tiles.ids))
        return pa.concat_tables(out)

    return find


#: Columns of a product of queries and rows.
TILE_COLUMNS = 4096


def search(df: DataFrame, k: int, query_step: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, block_rows: int | None = None) -> DataFrame:
    """``a, b, cosine``: the k most similar others b, of all usable vectors, of each usable vector a whose id is divisible by
    ``query_step``.

    The rows searched lie in the block of their nearest pivot; queries visit all blocks, so no neighbour is lost at any size, and the result doesn't depend on ``block_rows`` (by default
    as many blocks as ``whole`` has slices). In a tile, every row whose upper bound reaches the lower bound of the k-th best is recomputed in float, and heaps keep the best.
    Equals and unusable vectors are treated as in ``nearest_above``.
    """
    copies, n = folded(df, id_col, vec_col, dim), df.count()
    asking = F.col("vec_id") % query_step == 0
    sets = copies.members.where(asking).select(F.col("rep").alias("vec_id"), F.lit(True).alias("__asked")).distinct()
    flagged = cut(copies.reps.join(sets, "vec_id", "left").withColumn("asks", asking | F.coalesce("__asked", F.lit(False))).withColumn("extra", F.col("asks").cast("bigint")).withColumn("at_home", ~F.col("asks")).drop("__asked"))
    index = build_index(flagged, n, dim, visits=1, block_rows=block_rows or max(1, n // slices_of(n)))
    index.visits = len(index.pivots)
    kind = record_type(dim, index.visits)
    found = lay_out(flagged, index, dim, kind, "at_home").groupBy("tile_group").applyInArrow(_searched(k, kind, index), PAIRS)
    return _unfold(_ranked(found, k), copies, k).where(F.col("a") % query_step == 0)


def mutual_pairs(near: DataFrame) -> DataFrame:
    """Each pair once, the smaller id first."""
    return near.select(F.least("a", "b").alias("vec_id_a"), F.greatest("a", "b").alias("vec_id_b")).distinct()
