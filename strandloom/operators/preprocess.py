"""Cleaning, filtering, normalising and scaling of count tables ``cell, gene, value``.

Zeros have no row. Wherever they count (means, variances, medians, ranks) the number of cells or genes is an explicit denominator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.columns import count_of, null_safe_join, number
from strandloom.operators.matrix import best
from strandloom.operators.prefix import drawn_ranks, prefix_sums, ranks
from strandloom.operators.skew import coarse_bin, compress, key_stats, percentiles
from strandloom.session import cut


def latest(df: DataFrame, keys: Sequence[str], value: str, time: str) -> DataFrame:
    """The value in the row with the latest ``time`` of each key; of equal times the largest value. Repeats vanish. Rows with a null key are left out."""
    known = df.where(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys)))
    return known.groupBy(*keys).agg(F.max_by(value, F.struct(time, value)).alias(value))


def drop_zeros(df: DataFrame, value: str = "value") -> DataFrame:
    """Negative values become zero, and zeros and nulls have no row; cells without any count thereby vanish."""
    return df.where(F.col(value) > 0)


def library_norm(df: DataFrame, cell: str = "cell_id", value: str = "value", guard: bool = False) -> DataFrame:
    """``value / total of the cell * scale``, scale being the upper quartile of the cells' totals rounded (half to even) to thousands.

    With ``guard`` a scale of 0 (upper quartile up to 500) becomes 1; values of a cell with a total of 0 become null. The quartile is exact, from counted distinct totals in two steps, so no task holds all cells' totals.
    """
    sizes = df.groupBy(cell).agg(F.sum(value).alias("__size"))
    packed = compress(sizes.withColumn("__all", F.lit(0)), ["__all"], "__size")
    scale = percentiles(packed, ["__all"], [0.75]).agg(F.coalesce(F.max(F.bround(F.col("percentiles")[0] / 1000) * 1000), F.lit(0.0)).alias("s"))
    if guard:
        scale = scale.select(F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")))
    return df.join(sizes, cell).withColumn(value, F.col(value) / F.nullif("__size", F.lit(0.0)) * scale.scalar()).drop("__size")


def log2p1(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn(value, F.log2(F.col(value) + 1))


def antilog2(c: Column) -> Column:
    """2 to the power, at most 2 to the 30th."""
    return F.when(c < 30, F.pow(F.lit(2.0), c)).otherwise(F.lit(float(2**30)))


def log1p_norm(df: DataFrame, cell: str = "cell_id", value: str = "value", total: float = 1e4) -> DataFrame:
    return df.withColumn(value, F.log1p(F.col(value) / F.sum(value).over(Window.partitionBy(cell)) * total))


def qc_metrics(df: DataFrame, cell: str = "cell_id", gene: str = "gene", value: str = "value", prefix: str = "MT-") -> DataFrame:
    """Detected genes, total and percentage of genes with ``prefix`` of each cell."""
    mt = F.upper(F.col(gene)).startswith(prefix)
    return df.groupBy(cell).agg(F.count("*").alias("n_genes"), F.sum(value).alias("total"), (100 * F.sum(F.when(mt, F.col(value)).otherwise(0.0)) / F.sum(value)).alias("pct_mt"))


def basic_filter(df: DataFrame, min_genes: int, min_cells: int, cell: str = "cell_id", gene: str = "gene") -> DataFrame:
    """Cells with at least ``min_genes`` genes, then genes in at least ``min_cells`` of those cells."""
    cells = df.groupBy(cell).agg(F.count("*").alias("__n")).where(F.col("__n") >= min_genes)
    kept = df.join(cells, cell, "left_semi")
    if min_cells <= 1:
        return kept
    genes = kept.groupBy(gene).agg(F.count("*").alias("__n")).where(F.col("__n") >= min_cells)  # counted by map tasks first: a gene that all cells have is no burden
    return kept.join(genes, gene, "left_semi")


def max_abs_scale(df: DataFrame, cell: str = "cell_id", value: str = "value", scale: float = 10.0) -> DataFrame:
    """``scale * floor(value) / largest floor of the cell``."""
    whole = df.withColumn(value, F.floor(value)).where(F.col(value) != 0)
    return whole.withColumn(value, F.lit(scale) * F.col(value) / F.max(F.abs(F.col(value))).over(Window.partitionBy(cell)))


def quantile_norm(df: DataFrame, sample: str, feature: str, n_samples: int | Column | None = None, n_features: int | Column | None = None, value: str = "value", median: bool = False) -> DataFrame:
    """Quantile normalisation over all features, zeros included: every value becomes the mean (or median) over the samples of the values at its rank, equal values taking the lowest of their ranks.

    Zeros share the lowest ranks and are not laid out: only their number is used. Entries that are zero become ``zero_value``, given in each row.
    """
    n_samples = count_of(df, sample) if n_samples is None else F.lit(n_samples)
    n_features = count_of(df, feature) if n_features is None else F.lit(n_features)
    by = Window.partitionBy(sample)
    zeros = n_features - F.count("*").over(by)
    ranked = df.withColumn("__pos", zeros + F.row_number().over(by.orderBy(value, feature))).withColumn("__rank", zeros + F.rank().over(by.orderBy(value)))
    if median:
        stored = ranked.select("__pos", F.col(value).alias("value"), F.lit(1).cast("bigint").alias("weight"))
        missing = stored.groupBy("__pos").agg((n_samples - F.count("*")).alias("weight")).where("weight > 0").select("__pos", F.lit(0.0).alias("value"), "weight")
        ref = percentiles(stored.unionAll(missing).groupBy("__pos", "value").agg(F.sum("weight").alias("weight")), ["__pos"], [0.5]).select(F.col("__pos").alias("__rank"), F.element_at("percentiles", 1).alias("__ref"))
    else:
        ref = ranked.groupBy(F.col("__pos").alias("__rank")).agg((F.sum(value) / n_samples).alias("__ref"))
    lowest = ref.where("__rank = 1").agg(F.coalesce(F.max("__ref"), F.lit(0.0))).scalar()
    return ranked.join(ref, "__rank").select(sample, feature, F.col("__ref").alias(value), lowest.alias("zero_value"))


def zscore(df: DataFrame, within: Sequence[str], value: str = "value") -> DataFrame:
    """(value - mean) / (sample deviation + epsilon) over ``within``; rows without a finite result are left out. Moments are aggregates that are joined, so a group may hold any part of the rows."""
    return _deviation(df, within, F.col(value), value)


def _deviation(df: DataFrame, within: Sequence[str], standard: Column, value: str) -> DataFrame:
    """``value`` in deviations from the mean of the column ``standard`` within its group."""
    moments = df.groupBy(*within).agg(F.avg(standard).alias("__mean"), F.stddev_samp(standard).alias("__sd"))
    z = (F.col(value) - F.col("__mean")) / (F.col("__sd") + 2.220446049250313e-16)
    scored = null_safe_join(df, moments, list(within), "left").withColumn(value, z).select(*df.columns)
    return scored.where(F.col(value).isNotNull() & ~F.isnan(value))


def control_zscore(df: DataFrame, feature: str, is_control: Column, value: str = "value") -> DataFrame:
    """Deviation of each value from the control samples of its feature."""
    return _deviation(df, [feature], F.when(is_control, F.col(value)), value)


def dispersion(df: DataFrame, n_cells: int | Column, gene: str = "gene", value: str = "value") -> DataFrame:
    """Mean, variance and variance / mean of each gene over all cells, zeros included; with a single cell the variance is null."""
    s1, s2, n = F.sum(value), F.sum(F.col(value) * F.col(value)), number(n_cells)
    out = df.groupBy(gene).agg((s1 / n).alias("mean"), ((s2 - s1 * s1 / n) / F.nullif(n - 1, F.lit(0.0))).alias("variance"))
    return out.withColumn("dispersion", F.when(F.col("mean") > 0, F.col("variance") / F.col("mean")))


def highly_variable(df: DataFrame, n_cells: int | Column, n_top: int, gene: str = "gene", value: str = "value") -> DataFrame:
    """The ``n_top`` genes with the largest dispersion."""
    return dispersion(df, n_cells, gene, value).orderBy(F.desc_nulls_last("dispersion"), gene).limit(n_top)


def median_over_repeats(df: DataFrame, sample: str, gene: str, source: str, value: str = "value") -> DataFrame:
    """One value for each sample and gene: the median over the gene's sources (repeated symbols), a source without a row counting as zero.

    Values are counted before they are ranked and the absent zeros are one weighted value, so a symbol with a third of all sources is no burden."""
    sources = df.groupBy(gene).agg(F.count_distinct(source).alias("__n"))
    packed = compress(df.where(F.col(value).isNotNull()), [sample, gene], value)
    absent = packed.groupBy(sample, gene).agg(F.sum("weight").alias("__k")).join(sources, gene)
    zeros = absent.where("__n > __k").select(sample, gene, F.lit(0.0).alias("value"), (F.col("__n") - F.col("__k")).alias("weight"))
    middle = percentiles(packed.unionByName(zeros).groupBy(sample, gene, "value").agg(F.sum("weight").alias("weight")), [sample, gene], [0.5])
    return middle.select(sample, gene, F.element_at("percentiles", 1).alias(value)).where(F.col(value) != 0)


def group_totals_norm(df: DataFrame, groups: DataFrame, gene: str = "gene", value: str = "value") -> DataFrame:
    """Scales the genes of each marker group so that all groups have the total of the largest; a gene in several groups gets the mean of its scaled values. Genes outside
    all groups stay as they are, and so do groups with a total of 0."""
    member = df.join(groups.select(gene, "group_id").distinct(), gene, "left")
    total = member.where("group_id IS NOT NULL").groupBy("group_id").agg(F.sum(value).alias("__t")).where("__t > 0").withColumn("__f", F.max("__t").over(Window.partitionBy(F.lit(0))) / F.col("__t"))  # one row a group
    keys = [c for c in df.columns if c != value]
    return member.join(total, "group_id", "left").withColumn(value, F.col(value) * F.coalesce("__f", F.lit(1.0))).groupBy(*keys).agg(F.avg(value).alias(value))


def group_sizes_norm(df: DataFrame, groups: DataFrame, gene: str = "gene", value: str = "value") -> DataFrame:
    """Multiplies the genes of each group by largest group size / number of the group's genes that occur; a row for each group the gene is in. Genes outside all groups are left out."""
    g = groups.select(gene, "group_id").distinct().join(df.select(gene).distinct().withColumn("__in", F.lit(1)), gene, "left")
    sizes = g.groupBy("group_id").agg(F.count("*").alias("__n"), F.count("__in").alias("__own")).withColumn("__f", F.max("__n").over(Window.partitionBy(F.lit(0))) / F.nullif("__own", F.lit(0)))  # one row a group
    return df.join(g.drop("__in"), gene).join(sizes, "group_id").withColumn(value, F.col(value) * F.col("__f")).drop("__n", "__own", "__f")


def impute(df: DataFrame, feature: str, n_samples: int | Column, threshold: float, strategy: str = "median", value: str = "value") -> DataFrame:
    """The features with at least ``int(threshold * n_samples)`` values, and ``fill`` for those they lack: median, mean or mode (of equally frequent values the smallest).

    Median and mode come from counted values (``skew``), so no task holds all values of a feature."""
    if strategy == "mean":
        out = df.groupBy(feature).agg(F.count(value).alias("present"), F.avg(value).alias("fill"))
    else:
        fill = {"median": F.element_at("percentiles", 1), "mode": F.col("mode")}[strategy]
        out = key_stats(df, [feature], value, [0.5] if strategy == "median" else []).select(feature, F.col("n_values").alias("present"), fill.alias("fill"))
    return out.where(F.col("present") >= F.floor(F.lit(threshold) * number(n_samples)))


def subsample(df: DataFrame, kind: str, fractions: dict[str, float], unit: str) -> DataFrame:
    """Cells such that a type makes up the wanted fraction: of a type with n cells, and others in all, ``min(n, max(1, round(others * f / (1 - f))))`` stay, drawn by hash of ``unit`` (half to even); all for f >= 1, none for f <= 0. Types without fraction stay whole.

    A type with most of the cells is ranked in slices."""
    total = Window.partitionBy(F.lit(0))
    sizes = df.groupBy(kind).agg(F.count("*").alias("__n")).withColumn("__all_n", F.sum("__n").over(total))  # one row a type
    f = F.element_at(F.create_map(*[F.lit(x) for kv in fractions.items() for x in kv]), F.col(kind))
    others = F.col("__all_n") - F.col("__n")
    keep = F.when(f.isNull() | (f >= 1), F.col("__n")).when(f <= 0, 0).otherwise(F.least(F.col("__n"), F.greatest(F.lit(1), F.bround(others * f / F.nullif(1 - f, F.lit(0.0))))))
    sizes = sizes.select(kind, keep.cast("bigint").alias("__keep"))
    return drawn_ranks(df, [kind], unit, "__r").join(sizes, kind).where("__r <= __keep").drop("__r", "__keep")


def stratified_split(df: DataFrame, kind: str, unit: str, share: float) -> DataFrame:
    """Adds ``train``: of each type the rows, drawn by hash of ``unit``, whose place from 0 to 1 among the type's is below ``share``; a single row trains."""
    n = df.groupBy(kind).agg(F.count("*").alias("__n"))
    place = F.coalesce((F.col("__r") - 1) / F.nullif(F.col("__n") - 1, F.lit(0)), F.lit(0.0))
    return drawn_ranks(df, [kind], unit, "__r").join(n, kind).withColumn("train", place < share).drop("__r", "__n")


def complete_features(df: DataFrame, feature: str, n_samples: int | Column, value: str = "value") -> DataFrame:
    """``feature, n, variance`` of the features that have a finite value in every sample and vary."""
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    out = df.groupBy(feature).agg(F.count(F.when(finite, F.col(value))).alias("n"), F.var_samp(F.when(finite, F.col(value))).alias("variance"))
    return out.where((F.col("n") == number(n_samples)) & (F.col("variance") > 0))


def uniquify(df: DataFrame, symbol: str, order: Sequence[Column], out: str = "symbol_unique", slice_of: Column | None = None) -> DataFrame:
    """The second occurrence of a symbol becomes ``symbol-2``, the third ``symbol-3``. Occurrences are numbered in slices; ``slice_of`` (by default the first column of ``order``) must not fall along ``order``."""
    r = ranks(df, [symbol], order[0] if slice_of is None else slice_of, list(order), "__r")
    return r.withColumn(out, F.when(F.col("__r") > 1, F.concat_ws("-", symbol, "__r")).otherwise(F.col(symbol))).drop("__r")


def registered_anchors(anchors: DataFrame, genes: DataFrame) -> DataFrame:
    """Anchors that are expressed, their topics numbered anew from 0 in order of the old number."""
    kept = anchors.join(genes.select("gene").distinct(), "gene", "left_semi").select("topic_id", "gene").distinct()
    numbers = kept.select("topic_id").distinct().withColumn("seed_topic", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("topic_id")) - 1)  # one row a topic
    return kept.join(numbers, "topic_id")


def specific_anchors(registered: DataFrame) -> DataFrame:
    """Anchors of exactly one topic."""
    return registered.withColumn("__n", F.count("*").over(Window.partitionBy("gene"))).where("__n = 1").drop("__n")


def combat(df: DataFrame, batch: str, cell: str = "cell_id", gene: str = "gene", value: str = "value", rounds: int = 30) -> DataFrame:
    """Location and scale batch correction with parametric empirical Bayes shrinkage (Johnson, Li and Rabinovic 2007) over all cells of each batch, zeros included.

    Adds ``zero_value``: what the absent zeros of the row's gene and batch become (all of them the same); rows keep their place, and nothing dense is laid out.
    Moments are aggregates of stored values and of numbers of cells. The two conditional estimates of a gene and batch need only their sums, so they are iterated,
    ``rounds`` times, within an expression. Genes without spread within the batches keep their values; a batch of one cell is only moved. Rows without a batch keep their values.
    """
    known = df.where(F.col(batch).isNotNull())
    sizes = known.groupBy(batch).agg(F.count_distinct(cell).alias("__n"))
    every = sizes.agg(F.sum("__n")).scalar().cast("double")
    batches = sizes.agg(F.collect_list(F.struct(batch, "__n"))).scalar()  # a few
    sums = known.groupBy(gene, batch).agg(F.sum(value).alias("__s"), F.sum(F.col(value) * F.col(value)).alias("__q"))
    grid = sums.select(gene).distinct().withColumn("__x", F.explode(batches)).select(gene, f"__x.{batch}", "__x.__n").join(sums, [gene, batch], "left").na.fill(0.0, ["__s", "__q"])
    by = Window.partitionBy(gene)
    within = F.sum(F.col("__q") - F.col("__s") * F.col("__s") / F.col("__n")).over(by) / every
    grid = grid.withColumn("__m", F.sum("__s").over(by) / every).withColumn("__sd", F.sqrt(F.when(within > 1e-12, within)))
    z1, z2 = (F.col("__s") - F.col("__n") * F.col("__m")) / F.col("__sd"), (F.col("__q") - 2 * F.col("__m") * F.col("__s") + F.col("__n") * F.col("__m") * F.col("__m")) / (F.col("__sd") * F.col("__sd"))
    grid = grid.withColumn("__z1", z1).withColumn("__z2", z2).withColumn("__g", F.col("__z1") / F.col("__n"))
    grid = grid.withColumn("__d", (F.col("__z2") - F.col("__z1") * F.col("__g")) / F.nullif(F.col("__n") - 1, F.lit(0)))
    prior = grid.groupBy(batch).agg(F.avg("__g").alias("__gm"), F.var_samp("__g").alias("__gv"), F.avg("__d").alias("__dm"), F.var_samp("__d").alias("__dv"))
    a = 2 + F.col("__dm") ** 2 / F.nullif("__dv", F.lit(0.0))
    grid = grid.join(F.broadcast(prior), batch).withColumn("__a", a).withColumn("__b", F.col("__dm") * (F.col("__a") - 1))
    pair = lambda g, d: F.struct(g.alias("g"), d.alias("d"))

    def again(now: Column, _: Column) -> Column:
        weight = F.col("__n") * F.col("__gv")
        g = (weight * F.col("__g") + now["d"] * F.col("__gm")) / (weight + now["d"])
        spread = F.col("__z2") - 2 * g * F.col("__z1") + F.col("__n") * g * g
        return pair(g, (F.col("__b") + spread / 2) / (F.col("__n") / 2 + F.col("__a") - 1))

    shrunk = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), pair(F.col("__g"), F.col("__d")), again)
    plain = pair(F.col("__g"), F.coalesce(F.when(F.col("__d") > 0, F.col("__d")), F.lit(1.0)))
    grid = grid.withColumn("__e", F.when((F.col("__gv") > 0) & F.col("__a").isNotNull() & (F.col("__d") > 0), shrunk).otherwise(plain))
    grid = grid.select(gene, batch, "__m", "__sd", F.col("__e.g").alias("__gs"), F.sqrt("__e.d").alias("__ds"))
    moved = lambda x: F.col("__m") + ((x - F.col("__m")) - F.col("__sd") * F.col("__gs")) / F.col("__ds")
    out = df.join(grid, [gene, batch], "left").withColumn("zero_value", F.coalesce(moved(F.lit(0.0)), F.lit(0.0)))
    return out.withColumn(value, F.coalesce(moved(F.col(value)), F.col(value))).select(*df.columns, "zero_value")


def take_markers(scores: DataFrame, n: int) -> DataFrame:
    """Genes among the ``n`` best of any type."""
    return best(scores, ["main_cell_type"], [F.desc("z"), F.asc("gene")], n).select("gene").distinct()


def find_markers(counts: DataFrame, kinds: DataFrame, min_genes: int = 200, min_cells: int = 10) -> DataFrame:
    """``rank_sum`` of cells with at least ``min_genes`` genes over genes in at least ``min_cells`` of them, on logarithms of ten thousandths. Cells without a type aren't ranked."""
    kept = cut(basic_filter(counts, min_genes, min_cells))
    return rank_sum(log1p_norm(kept), kinds.join(kept.select("cell_id").distinct(), "cell_id", "left_semi"))


def rank_sum(df: DataFrame, kinds: DataFrame, cell: str = "cell_id", gene: str = "gene", kind: str = "main_cell_type", value: str = "value") -> DataFrame:
    """Wilcoxon rank-sum statistic of each gene and type against all other cells, corrected for ties: ``rank_sum`` and ``z``.

    Only stored values are ranked. The zeros of a gene are one block of ties below them: their number gives their common rank. Values are compressed to
    (gene, value, type) counts before ranking, and ranks are running sums in slices of the values, so a gene that nearly all cells have is spread over many tasks.
    """
    n = count_of(kinds, cell).cast("double")
    per_kind = kinds.groupBy(kind).agg(F.count("*").alias("__n1"))
    packed = df.join(kinds, cell).groupBy(gene, value, kind).agg(F.count("*").alias("__c"))
    vals = packed.groupBy(gene, value).agg(F.sum("__c").alias("__t"))
    stored = vals.groupBy(gene).agg((n - F.sum("__t")).alias("__n0"))
    vals = prefix_sums(vals.withColumn("__slice", F.floor(coarse_bin(F.col(value)) / 16)), [gene], "__slice", [F.col(value)], "__t", "__upto").join(stored, gene)
    vals = vals.withColumn("__rank", F.col("__n0") + F.col("__upto") - (F.col("__t") - 1) / 2)
    ties = vals.groupBy(gene).agg((F.sum(F.col("__t") ** 3 - F.col("__t"))).alias("__ties"), F.first("__n0").alias("__n0")).withColumn("__ties", F.col("__ties") + F.col("__n0") ** 3 - F.col("__n0"))
    ranked = packed.join(vals.select(gene, value, "__rank"), [gene, value]).groupBy(gene, kind).agg(F.sum(F.col("__c") * F.col("__rank")).alias("__r"), F.sum("__c").alias("__k"))
    full = ranked.join(ties, gene).join(per_kind, kind)
    r = F.col("__r") + (F.col("__n1") - F.col("__k")) * (F.col("__n0") + 1) / 2
    spread = (1 - F.col("__ties") / F.nullif(n * n * n - n, F.lit(0.0))) * F.col("__n1") * (n - F.col("__n1")) * ((n + 1) / 12)
    return full.select(gene, kind, r.alias("rank_sum"), ((r - F.col("__n1") * ((n + 1) / 2)) / F.sqrt(F.nullif(spread, F.lit(0.0)))).alias("z"))
