"""Blocks of vectors, and the product tiles that find near pairs within them.

Vectors are brought to length one. For pairs above a threshold all rows are one block, cut into slices that meet pairwise (``whole``), so no pair is lost at
any size; a task passes over those pairs that geometry rules out (``Tiles``). Only a search has blocks of nearest pivots (``build_index``), all of which a query visits. Tiles of a block
multiply int8 codes. The rounding error of every code is known, so a product gives an upper and a lower bound of the true cosine; only pairs whose upper bound reaches the threshold are
recomputed from the float vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut

#: Rows of one tile side.
TILE = 1024
#: Rows of a block up to which all of it meets; the rows of the parts that a task lays larger ones into, and the most parts.
WHOLE_ROWS, PART_ROWS, MOST_PARTS = 3072, 512, 64
#: Rows that blocks are bundled to, so that a task gets some of them at a time.
GROUP_ROWS = 32_768
#: Rows of a block beyond which it is cut into slices that meet pairwise.
SLICE_ROWS = 200_000
#: Rows of a slice, and how many slices there are at most, where a table is cut only for the sake of its tasks.
SPREAD_ROWS, SPREAD = 30_000, 7
#: Share of a sample's pairs that may pass the bound by the first axes (see ``Tiles.shortened``).
PASSED = 5e-4


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``vec_id, embedding`` of the rows with an id and a vector that is not null, has ``dim`` numbers, none of them
    null, NaN or infinite, and not all of them 0. Other rows and columns are left out."""
    e, inf = F.col("embedding"), F.lit(float("inf")).cast("float")
    plain = F.array_contains(e, F.lit(float("nan")).cast("float")) == False  # noqa: E712  null if there are nulls and no NaN
    ok = (F.size(e) == dim) & plain & (F.array_max(e) < inf) & (F.array_min(e) > -inf) & ((F.array_max(e) != 0) | (F.array_min(e) != 0))
    return df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull()).where(ok)


@dataclass
class Copies:
    """``reps``: ``vec_id, embedding, copies`` with one row for each set of equal vectors, its smallest id standing for it.
    ``members``: ``rep, vec_id`` of all rows in sets of two or more."""

    reps: DataFrame
    members: DataFrame


def fold_copies(vectors: DataFrame) -> Copies:
    """Equal vectors become one row, so that a group of copies, however large, costs as much as one vector.

    Equality is that of two 64-bit hashes of the numbers. Only ids and hashes are shuffled; the join back
    is broadcast if the sets of copies are few (they are counted), else shuffled.
    """
    hashed = vectors.withColumn("__h", F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64("embedding", F.lit(7)).alias("b")))
    sets = cut(hashed.groupBy("__h").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.count("*").alias("rows")).where("rows > 1"))
    joinable = F.broadcast(sets) if sets.count() < 200_000 else sets
    joined = hashed.join(joinable, "__h", "left")
    first = joined.where("rep IS NULL OR vec_id = rep").withColumn("copies", F.coalesce("copies", F.lit(1)))
    plain = first.where("rows IS NULL OR copies = rows").select("vec_id", "embedding", "copies")
    repeated = first.where("copies < rows").select("vec_id", "embedding", "copies").dropDuplicates(["vec_id"])
    members = joined.where("copies > 1").select("rep", "vec_id").distinct()
    return Copies(plain.unionAll(repeated), members)


def hash_share(df: DataFrame, mark: str, share: float) -> DataFrame:
    """The rows in the lowest ``share`` of the range of a 64-bit hash: a sample that every task draws for itself."""
    return df.where(F.col(mark) < F.lit(int(-(2**63) + min(1.0, share) * (2**64 - 2**11)))) if share < 1 else df


def mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each id (the finisher of splitmix64)."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """Numbers of the ``m`` pivots most similar to each row, the most similar first."""
    out = np.empty((len(unit), m), np.int32)
    for a in range(0, len(unit), 4096):
        s = unit[a : a + 4096].astype(np.float32) @ pivots.T
        near = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < s.shape[1] else np.tile(np.arange(m), (len(s), 1))
        out[a : a + 4096] = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
    return out


def lowest_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest number that both rows of two tables of numbers have; a number beyond all if there is none."""
    out = np.empty(len(a), np.int32)
    for s in range(0, len(a), 65536):
        x, y = a[s : s + 65536], b[s : s + 65536]
        out[s : s + 65536] = np.where((x[:, :, None] == y[:, None, :]).any(axis=2), x, np.iinfo(np.int32).max).min(axis=1)
    return out


@dataclass
class Index:
    """Pivots of the blocks, how many blocks a row is laid into, the number of groups that blocks are bundled into, and the number of slices of
    blocks that are too large for one task."""

    pivots: np.ndarray
    visits: int
    groups: int
    slices: dict[int, int]
    part_rows: int = PART_ROWS

    def groups_of(self, block: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, group)``: the group that each row of a block goes to; for a row of a block in slices all groups with its slice."""
        row, group = np.arange(len(block)), (block % self.groups).astype(np.int64)
        if not self.slices:
            return row, group
        parts = np.array([self.slices.get(b, 1) for b in range(len(self.pivots))])
        first = self.groups + np.r_[0, np.cumsum(parts * parts)[:-1]]
        n, own = parts[block], self.slice_of(ids, parts[block])
        row = np.repeat(row, n)
        other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        low, high = np.minimum(own[row], other), np.maximum(own[row], other)
        return row, np.where(n[row] > 1, first[block[row]] + low * n[row] + high, group[row])

    @staticmethod
    def slice_of(ids: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (mixed(ids) % np.asarray(n).astype(np.uint64)).astype(np.int64)


def unit_rows(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of length one in double precision from an Arrow column of lists."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def build_index(vectors: DataFrame, n: int, dim: int, visits: int = 6, block_rows: int = 256, max_blocks: int = 8192, sample_per_block: int = 32, rounds: int = 4) -> Index:
    """Pivots by spherical k-means on ``sample_per_block`` rows a block, drawn by hash of the id.

    There is a block for every ``block_rows`` rows, up to ``max_blocks``, so the sample has at most ``max_blocks * sample_per_block`` rows (262,144) and the pivots, the only
    thing broadcast, are at most ``max_blocks * dim`` floats. A row is laid into ``visits`` blocks whatever their number, so what is shuffled grows with the
    rows alone. Two rows of cosine c share one of their nearest pivots unless each of those is far down the other's list: with six visits some 3 pairs in
    100,000 of cosine 0.9 are lost (measured in the tests), about equally many with 100 and with 1,600 blocks. Blocks beyond ``SLICE_ROWS`` are cut into slices that meet pairwise.
    """
    k = int(max(1, min(max_blocks, round(n / block_rows))))
    want = sample_per_block * k
    marked = vectors.select("embedding", F.xxhash64("vec_id").alias("o"))
    rows = hash_share(marked, "o", 1.5 * want / max(n, 1)).orderBy("o").limit(want).select("embedding").toArrow() if k > 1 else None
    x = unit_rows(rows["embedding"], dim).astype(np.float32) if rows is not None and rows.num_rows else np.ones((1, dim), np.float32) / np.sqrt(np.float32(dim))
    pivots = x[:k].copy()
    for _ in range(rounds if len(pivots) > 1 else 0):
        near = nearest_pivots(x, pivots, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.r_[True, near[order][1:] != near[order][:-1]])
        total = np.add.reduceat(x[order], at, axis=0)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        pivots[near[order][at]] = total / np.maximum(size, 1e-12)
    k = len(pivots)
    visits = min(visits, k)
    expected = np.bincount(nearest_pivots(x, pivots, visits).ravel(), minlength=k) * (n / len(x)) if k > 1 else np.array([n])
    slices = {int(b): int(-(-rows // SLICE_ROWS)) for b, rows in enumerate(expected) if rows > SLICE_ROWS}
    return Index(pivots, visits, int(max(1, min(k, -(-n * visits // GROUP_ROWS)))), slices)


def slices_of(n: int) -> int:
    """How many slices ``n`` rows are cut into; at least 1."""
    return max(1, -(-n // SLICE_ROWS), min(SPREAD, -(-n // SPREAD_ROWS)))


def whole(n: int, dim: int, part_rows: int = PART_ROWS) -> Index:
    """All rows in one block, whose slices meet pairwise: every two rows meet once, whatever ``n``. A row travels once for each slice: up to ``SPREAD`` times as long as slices have at most ``SLICE_ROWS`` rows,
    beyond that in proportion to ``n``."""
    slices = slices_of(n)
    return Index(np.zeros((1, dim), np.float32), 1, 1, {0: slices} if slices > 1 else {}, part_rows)


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and the length of each row's rounding error."""
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    scale = scale.astype(np.float32)
    gone = unit - code * scale[:, None].astype(np.float64)
    return code, scale, (np.sqrt((gone * gone).sum(axis=1)) + 1e-6).astype(np.float32)


LAID = "tile_group bigint, record binary"


def record_type(dim: int, visits: int) -> np.dtype:
    """What travels of a row: to be screened (``visits`` 0) its code, else its float vector and the blocks it is laid into."""
    if not visits:
        return np.dtype([("id", "<i8"), ("block", "<i4"), ("scale", "<f4"), ("err", "<f4"), ("code", "i1", (dim,))])
    return np.dtype([("id", "<i8"), ("copies", "<i8"), ("extra", "<i8"), ("block", "<i4"), ("visits", "<i4", (visits,)), ("unit", "<f4", (dim,))])


def lay_out(vectors: DataFrame, index: Index, dim: int, kind: np.dtype, at_home: str | None = None) -> DataFrame:
    """``tile_group, record``: the rows of ``vectors`` (``vec_id, embedding, copies, extra``) in each of the blocks they visit.

    ``at_home`` names a Boolean column: rows where it is true stay in the block of their nearest pivot.
    """
    full = "unit" in kind.names

    def lay(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            u = unit_rows(b.column("embedding"), dim)
            near = nearest_pivots(u, index.pivots, index.visits)
            ids = b.column("vec_id").to_numpy()
            every = np.empty(len(u), kind)
            every["id"] = ids
            if full:
                every["copies"], every["extra"], every["visits"], every["unit"] = b.column("copies").to_numpy(), b.column("extra").to_numpy(), near, u
            else:
                every["code"], every["scale"], every["err"] = codes(u)
            go = np.ones(near.shape, bool)
            if at_home:
                go[:, 1:] = ~b.column(at_home).to_numpy(zero_copy_only=False).astype(bool)[:, None]
            row, slot = np.nonzero(go)
            block = near[row, slot]
            again, group = index.groups_of(block, ids[row])
            out = every[row[again]]
            out["block"] = block[again]
            column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(kind.itemsize), len(out), [None, pa.py_buffer(out)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), column], names=["tile_group", "record"])

    cols = ["vec_id", "embedding", *([F.col(c).cast("bigint").alias(c) for c in ("copies", "extra")] if full else []), *([at_home] if at_home else [])]
    return vectors.select(*cols).mapInArrow(lay, LAID)


def records(t: pa.Table, kind: np.dtype) -> np.ndarray:
    column = t.column("record").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    start = int(np.frombuffer(offsets, np.int32)[column.offset])
    return np.frombuffer(data, kind, count=len(column), offset=start)


def tiles_of(t: pa.Table, kind: np.dtype, index: Index):
    """The blocks of one group as ``Tiles``."""
    rec, group = records(t, kind), int(t.column("tile_group")[0].as_py())
    order = np.argsort(rec["block"], kind="stable")
    edge = np.flatnonzero(np.r_[True, rec["block"][order][1:] != rec["block"][order][:-1], True])
    for a, b in zip(edge[:-1], edge[1:]):
        yield Tiles(rec[order[a:b]], index, group)


class Tiles:
    """The rows of one block (or of two of its slices), and an iteration over its near pairs by tiles of int8 products."""

    def __init__(self, rec: np.ndarray, index: Index, group: int) -> None:
        self.block = int(rec["block"][0])
        if "unit" in rec.dtype.names:
            code, scale, err = codes(rec["unit"].astype(np.float64))
        else:
            code, scale, err = rec["code"], rec["scale"], rec["err"]
        order = np.argsort(scale, kind="stable")  # tiles of like scales have sharp bounds
        self.rec, self.scale, self.err = rec[order], scale[order], err[order]
        self.code = code[order].astype(np.float32)  # whole numbers; their products are exact up to dim 1040
        self.ids = self.rec["id"]
        n, self.part_rows = index.slices.get(self.block, 1), index.part_rows
        self.slice, self.across = (index.slice_of(self.ids, n), self._two_slices(index, group, n)) if n > 1 else (None, False)

    def _two_slices(self, index: Index, group: int, n: int) -> bool:
        first = index.groups + sum(index.slices.get(b, 1) ** 2 for b in range(self.block))
        low, high = divmod(group - first, n)
        return low != high

    def parts(self, reach: float):
        """``(part, home, guests)`` row numbers, so that any two rows whose codes are at most ``reach`` apart meet in a part where one is at home. Sets ``part`` and ``guest``.

        A row's home is the pivot it has the largest product with. Rows x and y at home with P and Q are apart, along Q - P, by the sum of their distances from the plane where
        both products are equal. So of two rows within reach one is at most half of it from that plane, and rows are guests of all parts they are that near to.
        """
        n, rows = len(self.ids), min(PART_ROWS, self.part_rows)
        self.part = None
        if n <= min(WHOLE_ROWS, 2 * rows):
            yield 0, np.arange(n), np.zeros(0, np.int64)
            return
        point = self.code * self.scale[:, None]
        pick = np.argsort(mixed(self.ids), kind="stable")[: 64 * MOST_PARTS]
        pivots, some = point[pick[: min(MOST_PARTS, -(-n // rows))]], point[pick]
        for _ in range(3):
            near = (some @ pivots.T).argmax(axis=1)
            for j in np.unique(near):
                mean = some[near == j].sum(axis=0)
                pivots[j] = mean / max(float(np.sqrt(mean @ mean)), 1e-12)
        apart = np.sqrt(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))
        self.part, self.guest = np.empty(n, np.int64), np.empty((n, len(pivots)), bool)
        for a in range(0, n, 16384):
            s = point[a : a + 16384] @ pivots.T
            own = s.argmax(axis=1)
            self.part[a : a + 16384] = own
            self.guest[a : a + 16384] = np.take_along_axis(s, own[:, None], 1) - s <= reach / 2 * apart[own] + 1e-5
        for j in range(len(pivots)):
            yield j, np.flatnonzero(self.part == j), np.flatnonzero(self.guest[:, j] & (self.part != j))

    def meetings(self, home: np.ndarray, guests: np.ndarray):
        """``(left, right, same)``: the rows to be multiplied, which are the same rows on both sides if ``same``. Of two slices only rows of different slices meet."""
        if not self.across:
            return [(home, home, True), (home, guests, False)]
        low = self.slice == self.slice.min()
        home, other, near, far = home[low[home]], home[~low[home]], guests[low[guests]], guests[~low[guests]]
        return [(home, other, False), (home, far, False), (other, near, False)]

    def shortened(self, min_cosine: float) -> np.ndarray:
        """The codes turned to their main axes, of which the first are kept, and behind them the length of the rest: a product of two such rows is at least that of the codes.

        As few axes are kept as leave no more than ``PASSED`` of a sample's pairs; all of them if even most axes leave more.
        """
        point = self.code * self.scale[:, None]
        dim = point.shape[1]
        some = point[np.argsort(mixed(self.ids), kind="stable")[:4096]].astype(np.float64)
        axes = np.linalg.eigh(some.T @ some)[1][:, ::-1]
        few = some[:512] @ axes
        least = min_cosine - 2 * float(np.median(self.err))
        kept = dim
        for d in (16, 24, 32, 48) if len(point) > TILE else ():
            rest = np.sqrt((few[:, d:] ** 2).sum(axis=1))
            passed = few[:, :d] @ few[:, :d].T + rest[:, None] * rest[None, :] >= least
            if d < dim and passed.sum() - len(few) <= PASSED * len(few) ** 2:
                kept = d
                break
        if kept == dim:
            return point
        out = np.empty((len(point), kept + 1), np.float32)
        for a in range(0, len(point), 16384):
            turned = point[a : a + 16384] @ axes.astype(np.float32)
            out[a : a + 16384, :kept] = turned[:, :kept]
            out[a : a + 16384, kept] = np.sqrt((turned[:, kept:] ** 2).sum(axis=1)) + 1e-6
        return out

    def candidates(self, min_cosine: float):
        """``(i, j)`` arrays of row numbers, each pair once, whose upper bound reaches ``min_cosine``."""
        if not len(self.ids):
            return
        out, short = np.empty((TILE, TILE), np.float32), self.shortened(min_cosine)
        reach = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)) + 2 * self.err.max() + 1e-5)
        for part, home, guests in self.parts(reach):
            for left, right, same in self.meetings(home, guests):
                for b in range(0, len(right), TILE):
                    cols = right[b : b + TILE]
                    y, most = np.ascontiguousarray(short[cols].T), float(self.err[cols].max())
                    for a in range(b if same else 0, len(left), TILE):
                        rows = left[a : a + TILE]
                        s, e = np.matmul(short[rows], y, out=out[: len(rows), : len(cols)]), self.err[rows]
                        floor = (min_cosine - e - most - e * most - 2e-5).astype(np.float32)
                        at = np.flatnonzero(s >= floor[:, None])
                        i, j = at // len(cols), at % len(cols)
                        if same:
                            i, j = i[j + b < i + a], j[j + b < i + a]
                        i, j = rows[i], cols[j]
                        ok = self.ids[i] != self.ids[j]
                        if self.part is not None and not same:  # two rows at home in different parts may meet in both: the lower part has the pair
                            elsewhere = np.where(self.part[j] == part, self.part[i], self.part[j])
                            host = np.where(self.part[j] == part, j, i)
                            ok &= (elsewhere == part) | (part < elsewhere) | ~self.guest[host, elsewhere]
                        i, j = i[ok], j[ok]
                        for c in range(0, len(i), 65536):
                            x, z = i[c : c + 65536], j[c : c + 65536]
                            est = np.einsum("ij,ij->i", self.code[x], self.code[z]) * self.scale[x] * self.scale[z]
                            ok = est + self.err[x] + self.err[z] + self.err[x] * self.err[z] + 1e-5 >= min_cosine
                            if ok.any():
                                yield x[ok], z[ok]

    def pairs(self, min_cosine: float):
        """``(i, j, cosine)`` of the pairs of at least ``min_cosine`` by their float vectors. Of the blocks that hold both rows, the lowest has the pair."""
        for i, j in self.candidates(min_cosine):
            here = lowest_common(self.rec["visits"][i], self.rec["visits"][j]) == self.block
            i, j = i[here], j[here]
            cosine = self.exact(i, j)
            ok = cosine >= min_cosine
            if ok.any():
                yield i[ok], j[ok], cosine[ok]

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Cosines of the float vectors."""
        out, unit = np.empty(len(i)), self.rec["unit"]
        for s in range(0, len(i), 65536):
            a, b = unit[i[s : s + 65536]].astype(np.float64), unit[j[s : s + 65536]].astype(np.float64)
            out[s : s + 65536] = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
        return out


def screen(vectors: DataFrame, index: Index, dim: int, min_cosine: float) -> DataFrame:
    """``vec_id``, possibly repeated, of the rows with at least one pair whose upper bound reaches ``min_cosine``; codes alone are shuffled."""
    kind = record_type(dim, 0)

    def near(t: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)]
        for tiles in tiles_of(t, kind, index):
            seen = np.zeros(len(tiles.ids), bool)
            for i, j in tiles.candidates(min_cosine):
                seen[i] = True
                seen[j] = True
            found.append(tiles.ids[seen])
        return pa.table({"vec_id": pa.array(np.unique(np.concatenate(found)), pa.int64())})

    return lay_out(vectors, index, dim, kind).groupBy("tile_group").applyInArrow(near, "vec_id bigint")
