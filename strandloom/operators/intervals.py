"""Genomic intervals: joins, extensions, distances, gene activity, feature counts, stitching and enhancers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.columns import number
from strandloom.operators.prefix import ranks
from strandloom.operators.skew import coarse_bin
from strandloom.operators.sweep import periods_and_gaps
from strandloom.session import cut


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], bin_width: int = 100_000, closed: bool = False, salts: int = 1) -> DataFrame:
    """Pairs of rows of ``a`` (``start, end``) and ``b`` (``start_b, end_b``) of equal keys that overlap (half-open; with ``closed`` both ends belong to the interval).

    Both sides are laid into bins and meet in an equi-join on key and bin, so a key that holds a third of all rows is spread over its bins; a pair
    is kept only in the bin where its overlap starts, which needs no distinct. Where ``b`` crowds into a few bins (a gene with a third of all fragments), its rows are dealt
    to ``salts`` parts of each bin, which all have the rows of ``a``.
    """
    last = 0 if closed else 1
    left = a.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor((F.col("end") - last) / bin_width))))
    right = b.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start_b") / bin_width), F.floor((F.col("end_b") - last) / bin_width))))
    if salts > 1:
        right = right.withColumn("__salt", F.pmod(F.xxhash64(*b.columns), F.lit(salts)).cast("int"))
        left = left.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
        keys = [*keys, "__salt"]
    meet = (F.col("start") <= F.col("end_b")) & (F.col("start_b") <= F.col("end")) if closed else (F.col("start") < F.col("end_b")) & (F.col("start_b") < F.col("end"))
    return left.join(right, [*keys, "__bin"]).where(meet & (F.col("__bin") == F.floor(F.greatest("start", "start_b") / bin_width))).drop("__bin", "__salt")


def extend_tss(genes: DataFrame, upstream: int = 100_000, downstream: int = 100_000, symmetric: bool = False) -> DataFrame:
    """Adds ``tss_start, tss_end``. On the plus strand the downstream end counts from the start already moved upstream, unless ``symmetric``; on the minus strand from the end."""
    plus = F.col("strand") == "+"
    moved = F.greatest(F.col("start") - upstream, F.lit(0))
    start = F.when(plus, moved).otherwise(F.greatest(F.least(F.col("start"), F.col("end") - downstream), F.lit(0)))
    end = F.when(plus, F.greatest(F.col("end"), (F.col("start") if symmetric else moved) + downstream)).otherwise(F.col("end") + upstream)
    return genes.withColumn("tss_start", start).withColumn("tss_end", end)


def extend_body(genes: DataFrame, upstream: int = 5_000) -> DataFrame:
    """Adds ``body_start, body_end``: the gene with ``upstream`` more before its start, by strand."""
    plus = F.col("strand") == "+"
    return genes.withColumn("body_start", F.when(plus, F.greatest(F.col("start") - upstream, F.lit(0))).otherwise(F.col("start"))).withColumn("body_end", F.when(plus, F.col("end")).otherwise(F.col("end") + upstream))


def length_weight(genes: DataFrame, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """Adds ``gene_weight``: 1 / length, scaled over all genes to ``low`` to ``high``; ``low`` if all are equally long."""
    own = 1.0 / F.nullif((F.col("end") - F.col("start")).cast("double"), F.lit(0.0))
    edge = genes.select(own.alias("x")).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    a, wide = edge.select("a").scalar(), edge.select(F.nullif(F.col("b") - F.col("a"), F.lit(0.0))).scalar()
    return genes.withColumn("gene_weight", F.coalesce(low + (high - low) * (own - a) / wide, F.lit(low)))


def gene_peaks(genes: DataFrame, peaks: DataFrame, upstream: int = 100_000, downstream: int = 100_000, body: int = 5_000, cutoff: float = 0.0) -> DataFrame:
    """``gene, peak_id, dist, weight`` of the peaks within reach of each gene (``chr, start, end, gene, strand``).

    One join with the extended promoter is enough, as the extended body lies within it; a peak in the body has distance 0, others the distance to the gene.
    ``weight`` is exp(-dist / body), and 0 below ``cutoff`` (1: the body only).
    """
    g = extend_body(extend_tss(genes, upstream, downstream), body).withColumnsRenamed({"start": "g_start", "end": "g_end"}).withColumn("start", F.col("tss_start")).withColumn("end", F.col("tss_end"))
    p = peaks.select("chr", "peak_id", F.col("start").alias("start_b"), F.col("end").alias("end_b"))
    near = overlap_join(g, p, ["chr"])
    inside = (F.col("start_b") < F.col("body_end")) & (F.col("body_start") < F.col("end_b"))
    plus = F.least(F.abs(F.col("start_b") - F.col("g_end")), F.abs(F.col("end_b") - F.greatest(F.lit(0), F.col("g_start") - body)))
    minus = F.least(F.abs(F.col("start_b") - (F.col("g_end") + body)), F.abs(F.col("end_b") - F.col("g_start")))
    dist = F.when(inside, 0).when(F.col("strand") == "+", plus).otherwise(minus).cast("double")
    w = F.exp(-dist / body)
    return near.select("gene", "peak_id", dist.alias("dist"), F.when(w < cutoff, 0.0).otherwise(w).alias("weight"))


def gene_activity(genes: DataFrame, peaks: DataFrame, peak_counts: DataFrame, cutoff: float = 0.0, whole: bool = False) -> DataFrame:
    """``sample_id, gene, score``: counts of a gene's peaks times their weights, times the gene's length weight. ``whole`` cuts off decimals."""
    links = gene_peaks(genes, peaks, cutoff=cutoff).where("weight > 0")
    sums = peak_counts.join(links, "peak_id").groupBy("sample_id", "gene").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
    score = F.col("score") * F.col("gene_weight")
    return sums.join(length_weight(genes).select("gene", "gene_weight"), "gene").select("sample_id", "gene", (F.floor(score) if whole else score).alias("score"))


def at_positions(fragments: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """``*keys, chr, start_b, end_b`` with the summed ``score`` of the fragments at the same place, by map tasks first: repeats cost nothing in a join."""
    return fragments.groupBy(*keys, "chr", F.col("start").alias("start_b"), F.col("end").alias("end_b")).agg(F.sum(score).alias(score))


def feature_counts(peaks: DataFrame, fragments: DataFrame) -> DataFrame:
    """``chr, start, end, count``: overlapping and touching peaks that meet fragments merged, with the summed scores of all peak-fragment overlaps in them.

    A fragment over two peaks counts twice.
    """
    f = at_positions(fragments, [], "score")
    hits = overlap_join(peaks.select("chr", "start", "end"), f, ["chr"], 20_000, salts=4).groupBy("chr", "start", "end").agg(F.sum("score").alias("score"))
    merged = periods_and_gaps(hits, ["chr"], "start", "end").where("kind = 'period'").select("chr", F.col("start_pos").alias("start_b"), F.col("end_pos").alias("end_b"))
    return overlap_join(hits, merged, ["chr"]).groupBy("chr", F.col("start_b").alias("start"), F.col("end_b").alias("end")).agg(F.sum("score").alias("count"))


def stitch(peaks: DataFrame, gap: int = 12_500, keys: Sequence[str] = ("chr",)) -> DataFrame:
    """Closed intervals with fewer than ``gap`` positions between them become one region: ``*keys, start, end``."""
    wide = peaks.select(*keys, "start", (F.col("end") + gap).alias("end"))
    return periods_and_gaps(wide, list(keys), "start", "end").where("kind = 'period'").select(*keys, F.col("start_pos").alias("start"), (F.col("end_pos") - gap).alias("end"))


def region_max(regions: DataFrame, peaks: DataFrame, n_samples: int | Column) -> DataFrame:
    """``region_id, signal``: the largest value of each region and sample (none counts as 0), averaged over ``n_samples``."""
    p = peaks.select("chr", F.col("start").alias("start_b"), F.col("end").alias("end_b"), "sample_id", "value")
    top = overlap_join(regions, p, ["chr"], closed=True).groupBy("region_id", "sample_id").agg(F.max("value").alias("value"))
    means = top.groupBy("region_id").agg((F.sum("value") / number(n_samples)).alias("signal"))
    return regions.select("region_id").join(means, "region_id", "left").select("region_id", F.coalesce("signal", F.lit(0.0)).alias("signal"))


def enhancers(signal: DataFrame, order: Sequence[str] = ("region_id",)) -> DataFrame:
    """Adds ``cutoff``, ``rank`` (1: strongest) and ``is_super`` (signal above the cutoff).

    The cutoff is the point of the sorted signal curve farthest below the line from its lowest to its highest value: the smallest of y_i - slope * i, in closed form.
    Regions are ranked in slices of like signals; their number and edges are scalar aggregates. The signal is written down first, as all of these read it.
    """
    y = cut(signal.withColumn("signal", F.greatest("signal", F.lit(0.0))))
    edge = y.agg(F.count("*").alias("n"), ((F.max("signal") - F.min("signal")) / F.nullif(F.count("*"), F.lit(0))).alias("slope"))
    sloped = ranks(y, [], F.floor(coarse_bin(F.col("signal")) / 8), [F.col("signal"), *[F.col(c) for c in order]], "__i")
    residual = F.round(F.col("signal") - edge.select("slope").scalar() * F.col("__i"), 9)
    cutoff = sloped.agg(F.min_by("signal", F.struct(residual, F.col("__i")))).scalar()
    out = sloped.withColumn("rank", edge.select("n").scalar() - F.col("__i") + 1).withColumn("cutoff", cutoff)
    return out.withColumn("is_super", F.col("signal") > F.col("cutoff")).select(*signal.columns, "cutoff", "rank", "is_super")


def peak_parts(ids: Column) -> tuple[Column, Column, Column, Column]:
    """Chromosome, start, end of ``chr_start_end``, and whether the id is valid: three parts, whole numbers, 0 < start <= end."""
    parts = F.split(ids, "_")
    start, end = F.try_element_at(parts, F.lit(2)).try_cast("bigint"), F.try_element_at(parts, F.lit(3)).try_cast("bigint")
    return F.element_at(parts, 1), start, end, F.coalesce((F.size(parts) == 3) & (start > 0) & (start <= end), F.lit(False))
