"""Clusters of mutually similar vectors: density peaks over blocked neighbour joins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.columns import dot, norm
from strandloom.llm.neighbours import folded, with_neighbours
from strandloom.llm.vectors import Copies, Index, lay_out, mixed, record_type, tiles_of
from strandloom.session import cut

DENSITY = "vec_id bigint, weight bigint, rows bigint, mark bigint, own bigint, near double"


def _density(min_cosine: float, kind: np.dtype, index: Index):
    def count(t: pa.Table) -> pa.Table:
        out = []
        for tiles in tiles_of(t, kind, index):
            n, copies = len(tiles.ids), tiles.rec["copies"]
            weight, rows, mark = (np.zeros(n, np.int64) for _ in range(3))
            near, hashes = np.zeros(n), mixed(tiles.ids).view(np.int64)
            home = (tiles.rec["visits"][:, 0] == tiles.block) & (not tiles.across)  # a vector counts itself at home
            weight[home], rows[home], mark[home], near[home] = copies[home], 1, hashes[home], copies[home]
            for i, j, cosine in tiles.pairs(min_cosine):
                for x, y in ((i, j), (j, i)):
                    np.add.at(weight, x, copies[y])
                    np.add.at(rows, x, 1)
                    np.bitwise_xor.at(mark, x, hashes[y])
                    np.add.at(near, x, cosine * copies[y])
            some = rows > 0
            out.append(pa.table({"vec_id": tiles.ids[some], "weight": weight[some], "rows": rows[some], "mark": mark[some], "own": np.where(home, hashes, 0)[some], "near": near[some]}))
        return pa.concat_tables(out)

    return count


DENSER = "vec_id bigint, parent bigint, cosine double"


def _denser(min_cosine: float, kind: np.dtype, index: Index):
    def find(t: pa.Table) -> pa.Table:
        out = []
        for tiles in tiles_of(t, kind, index):
            n, ids, density = len(tiles.ids), tiles.ids, tiles.rec["extra"]
            parent, best = np.full(n, -1), np.full(n, -2.0)
            for i, j, cosine in tiles.pairs(min_cosine):
                for x, y in ((i, j), (j, i)):
                    up = (density[y] > density[x]) | ((density[y] == density[x]) & (ids[y] < ids[x]))
                    x, y, c = x[up], y[up], cosine[up]
                    order = np.lexsort((-ids[y], c))  # later writes win: highest cosine, then smallest id
                    x, y, c = x[order], y[order], c[order]
                    last = len(x) - 1 - np.unique(x[::-1], return_index=True)[1]
                    x, y, c = x[last], y[last], c[last]
                    win = (c > best[x]) | ((c == best[x]) & (parent[x] >= 0) & (ids[y] < ids[np.maximum(parent[x], 0)]))
                    best[x[win]], parent[x[win]] = c[win], y[win]
            some = parent >= 0
            out.append(pa.table({"vec_id": ids[some], "parent": ids[parent[some]], "cosine": best[some]}))
        return pa.concat_tables(out)

    return find


def follow(parents: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``vec_id, label`` from ``vec_id, parent`` (itself at a peak): pointers are doubled until none moves."""
    now = cut(parents)
    for _ in range(max_rounds):
        up = now.select(F.col("vec_id").alias("parent"), F.col("parent").alias("__up"))
        step = cut(now.join(up, "parent").select("vec_id", F.col("__up").alias("parent"), (F.col("__up") != F.col("parent")).alias("moved")))
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return now.withColumnRenamed("parent", "label")


@dataclass
class Clusters:
    """``nodes``: ``vec_id, copies, density, parent, cosine, near, label, isolated`` of the representatives that have a neighbour or copies; ``near`` is the sum of the
    cosines to all vectors within the radius, copies and itself included. ``vectors``: ``vec_id, embedding`` of the same. ``copies``: all usable vectors, folded."""

    nodes: DataFrame
    vectors: DataFrame
    copies: Copies


def density_peaks(df: DataFrame, min_cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, block_rows: int = 256) -> Clusters:
    """Density peaks of the usable vectors, with ``min_cosine`` as the radius.

    ``density`` is the number of vectors within the radius, itself and copies included; ``parent`` the nearest denser vector
    within the radius (of equally dense ones the smaller id is denser) and ``cosine`` its similarity; both are null at a peak. ``label`` is
    the peak at the end of the pointers. Both neighbour joins run on the blocks and int8 tiles of ``vectors``; pairs that may reach the
    radius are recomputed in float, and only sums per vector leave a tile, never the pairs.

    ``isolated`` is the exact check of a cluster: every member has all members within the radius and nobody else. Each vector
    carries the number and the exclusive-or of hashes of its neighbours; they must equal those of the cluster.

    Vectors without any neighbour are peaks of clusters of one and are not among the nodes. Null, empty, repeated and unusable rows: as in
    ``nearest_above``.
    """
    copies = folded(df, id_col, vec_col, dim)
    near, index = with_neighbours(df, copies, dim, min_cosine, block_rows, and_copies=True)
    kind = record_type(dim, index.visits)
    counted = lay_out(near.withColumn("extra", F.lit(0)), index, dim, kind).groupBy("tile_group").applyInArrow(_density(min_cosine, kind, index), DENSITY)
    dense = cut(counted.groupBy("vec_id").agg(F.sum("weight").alias("density"), F.sum("rows").alias("rows"), F.bit_xor("mark").alias("mark"), F.bit_xor("own").alias("own"), F.sum("near").alias("near")))
    up = lay_out(near.join(dense.select("vec_id", F.col("density").alias("extra")), "vec_id"), index, dim, kind).groupBy("tile_group").applyInArrow(_denser(min_cosine, kind, index), DENSER)
    up = up.groupBy("vec_id").agg(F.max_by("parent", F.struct(F.col("cosine"), -F.col("parent"))).alias("parent"), F.max("cosine").alias("cosine"))
    joined = cut(dense.join(up, "vec_id", "left").join(near.select("vec_id", "copies"), "vec_id"))
    labels = follow(joined.select("vec_id", F.coalesce("parent", "vec_id").alias("parent")))
    nodes = joined.join(labels, "vec_id")
    whole = nodes.groupBy("label").agg(F.sum("copies").alias("w_all"), F.count("*").alias("n_all"), F.bit_xor("own").alias("m_all"))
    nodes = nodes.join(whole, "label")
    good = nodes.groupBy("label").agg(F.bool_and((F.col("density") == F.col("w_all")) & (F.col("rows") == F.col("n_all")) & (F.col("mark") == F.col("m_all"))).alias("isolated"))
    return Clusters(cut(nodes.join(good, "label").select("vec_id", "copies", "density", "parent", "cosine", "near", "label", "isolated")), near.select("vec_id", "embedding"), copies)


def typicality(nodes: DataFrame) -> DataFrame:
    """Adds ``size`` (copies count) and ``mean_cosine``, the mean cosine to the other members of the cluster.

    The mean follows from the sum of the members' unit vectors: (x . sum - 1) / (size - 1), which needs no pairs.
    """
    unit = nodes.withColumn("__norm", norm(F.col("embedding"))).withColumn("unit", F.transform("embedding", lambda x: x.cast("double") / F.col("__norm"))).drop("__norm")
    parts = unit.select("label", "copies", F.posexplode("unit").alias("pos", "x")).groupBy("label", "pos").agg(F.sum(F.col("x") * F.col("copies")).alias("s"))
    sums = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda e: e["s"]).alias("total"))
    size = nodes.groupBy("label").agg(F.sum("copies").alias("size"))
    both = unit.join(sums.join(size, "label"), "label")
    return both.withColumn("mean_cosine", (dot(F.col("unit"), F.col("total")) - 1) / F.nullif(F.col("size") - 1, F.lit(0))).drop("unit", "total")


def groups(found: Clusters, min_size: int = 3, slack: float = 1e-6) -> DataFrame:
    """``typical_id, vec_id`` of the members, copies too, of isolated clusters of at least ``min_size`` vectors.
    Typical is the member with the highest mean cosine to the others; within ``slack`` of it, the smallest id. In an isolated cluster all members are within each
    other's radius, so the mean follows from the sum ``near`` that the density pass took."""
    nodes = found.nodes.where("isolated")
    size = nodes.groupBy("label").agg(F.sum("copies").alias("size")).where(F.col("size") >= min_size)
    rated = nodes.join(size, "label").select("label", "vec_id", ((F.col("near") - 1) / (F.col("size") - 1)).alias("mean_cosine"))
    top = rated.groupBy("label").agg(F.max("mean_cosine").alias("__top"))
    typical = rated.join(top, "label").where(F.col("mean_cosine") >= F.col("__top") - slack).groupBy("label").agg(F.min("vec_id").alias("typical_id"))
    reps = rated.select("label", "vec_id").join(typical, "label")
    every = reps.join(found.copies.members.select(F.col("rep").alias("vec_id"), F.col("vec_id").alias("__member")), "vec_id", "left")
    return every.select("typical_id", F.coalesce("__member", "vec_id").alias("vec_id"))


def descriptions(found: Clusters, members: int = 3) -> DataFrame:
    """One row for each cluster of two or more: ``cluster_id`` (its peak), ``size``, ``isolated``, ``mean_cosine`` (mean over members) and the
    ids of its most typical members."""
    rated = cut(typicality(found.nodes.join(found.vectors, "vec_id")).where("size > 1").drop("embedding"))
    w = Window.partitionBy("label").orderBy(F.desc("mean_cosine"), "vec_id")
    best = rated.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= members).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "vec_id"))), lambda e: e["vec_id"]).alias("typical_ids"))
    about = rated.groupBy("label").agg(F.first("size").alias("size"), F.bool_and("isolated").alias("isolated"), (F.sum(F.col("mean_cosine") * F.col("copies")) / F.first("size")).alias("mean_cosine"))
    return about.join(best, "label").withColumnRenamed("label", "cluster_id")
