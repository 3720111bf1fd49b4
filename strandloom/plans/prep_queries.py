"""Queries of cleaning, filtering, normalising and selecting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.columns import count_of, log2p1, sample_of
from strandloom.operators import pipelines
from strandloom.operators import preprocess as P
from strandloom.operators.matrix import pad
from strandloom.plans import adapters as A
from strandloom.plans.adapters import with_sql
from strandloom.plans.registry import Catalog, table

CATALOG = Catalog()
add = CATALOG.add

LIBSIZE = "sizes AS (SELECT cell_id, sum(value) AS size FROM counts GROUP BY 1), scale AS (SELECT round_even(quantile_cont(size, 0.75) / 1000, 0) * 1000 AS s FROM sizes)"


def _more(sql: str, ctes: str, *views: str) -> str:
    """``sql`` with ``ctes`` behind the views."""
    base = with_sql("", *views).rstrip()
    return f"{base}, {ctes} {sql}"


@add("clamp_drop_empty", with_sql("SELECT cell_id, count(*) AS n_genes, round(sum(value), 6) AS total FROM counts GROUP BY 1", "counts"))
def clamp_drop_empty(s: SparkSession, d: str) -> DataFrame:
    return A.counts(s, d).groupBy("cell_id").agg(F.count("*").alias("n_genes"), F.round(F.sum("value"), 6).alias("total"))


@add("norm_libsize_log2", _more("SELECT cell_id, gene, round(log2(value / size * greatest(s, 1) + 1), 6) AS value FROM counts JOIN sizes USING (cell_id), scale", LIBSIZE.replace("AS s FROM", "AS s FROM"), "counts"))
def norm_libsize_log2(s: SparkSession, d: str) -> DataFrame:
    return P.log2p1(P.library_norm(A.counts(s, d), guard=True)).withColumn("value", F.round("value", 6))


@add("norm_antilog", with_sql("SELECT cell_id, gene, round(CASE WHEN value < 30 THEN pow(2, value) ELSE 1073741824 END, 3) AS value FROM counts", "counts"))
def norm_antilog(s: SparkSession, d: str) -> DataFrame:
    return A.counts(s, d).withColumn("value", F.round(P.antilog2(F.col("value")), 3))


@add("norm_log1p", with_sql("SELECT cell_id, gene, round(ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * 1e4), 6) AS value FROM counts", "counts"))
def norm_log1p(s: SparkSession, d: str) -> DataFrame:
    return P.log1p_norm(A.counts(s, d)).withColumn("value", F.round("value", 6))


@add("qc_metrics", with_sql("SELECT cell_id, count(*) AS n_genes, round(sum(value), 6) AS total, round(100 * coalesce(sum(value) FILTER (upper(gene) LIKE 'MT-%'), 0) / sum(value), 6) AS pct_mt FROM counts GROUP BY 1", "counts"))
def qc_metrics(s: SparkSession, d: str) -> DataFrame:
    return P.qc_metrics(A.counts(s, d)).withColumn("total", F.round("total", 6)).withColumn("pct_mt", F.round("pct_mt", 6))


@add("basic_filter", with_sql("SELECT * FROM (SELECT * FROM counts QUALIFY count(*) OVER (PARTITION BY cell_id) >= 8) QUALIFY count(*) OVER (PARTITION BY gene) >= 3", "counts"))
def basic_filter(s: SparkSession, d: str) -> DataFrame:
    return P.basic_filter(A.counts(s, d), 8, 3)


@add("cell_prefix_select", with_sql("SELECT * FROM counts WHERE split_part(cell_id, '_', 1) IN ('S00001', 'S00003')", "counts"))
def cell_prefix_select(s: SparkSession, d: str) -> DataFrame:
    return A.counts(s, d).where(sample_of("cell_id").isin("S00001", "S00003"))


@add("gene_shared", with_sql("SELECT * FROM counts WHERE gene IN (SELECT gene FROM use_gene)", "counts"))
def gene_shared(s: SparkSession, d: str) -> DataFrame:
    return A.counts(s, d).join(table(s, d, "use_gene").select("gene"), "gene", "left_semi")


@add("gene_selection_missing", with_sql("SELECT ord, gene, gene NOT IN (SELECT gene FROM counts) AS missing FROM use_gene", "counts"))
def gene_selection_missing(s: SparkSession, d: str) -> DataFrame:
    have = A.counts(s, d).select("gene").distinct().withColumn("have", F.lit(True))
    return table(s, d, "use_gene").join(have, "gene", "left").select("ord", "gene", F.col("have").isNull().alias("missing"))


@add("other_genes", with_sql("SELECT DISTINCT gene FROM counts WHERE gene NOT IN (SELECT gene FROM use_gene)", "counts"))
def other_genes(s: SparkSession, d: str) -> DataFrame:
    return A.counts(s, d).select("gene").distinct().join(table(s, d, "use_gene"), "gene", "left_anti")


@add("pad_gene_list_mask", with_sql("SELECT DISTINCT gene, CAST(gene NOT IN (SELECT gene FROM counts) AS INTEGER) AS mask FROM use_gene", "counts"))
def pad_gene_list_mask(s: SparkSession, d: str) -> DataFrame:
    return pad(A.counts(s, d), table(s, d, "use_gene"), "gene")


@add("dup_symbol_median", with_sql("""SELECT sample_id, gene, round(value, 6) AS value FROM (SELECT sample_id, gene, median(v) AS value FROM (SELECT s.sample_id, g.gene, coalesce(b.value, 0) AS v
 FROM (SELECT DISTINCT sample_id, gene FROM by_chr) s JOIN (SELECT DISTINCT gene, chr FROM by_chr) g USING (gene) LEFT JOIN by_chr b ON b.sample_id = s.sample_id AND b.gene = g.gene AND b.chr = g.chr) GROUP BY 1, 2) WHERE value <> 0""", "bulk").replace(" SELECT sample_id, gene, round", """, by_chr AS (SELECT sample_id, gene, chr, sum(value * (1 + length(chr) % 3)) AS value FROM bulk JOIN (SELECT DISTINCT genome || ':' || chr AS chr, symbol AS gene FROM gene_anno WHERE symbol IS NOT NULL) USING (gene) GROUP BY ALL) SELECT sample_id, gene, round""", 1))  # fmt: skip
def dup_symbol_median(s: SparkSession, d: str) -> DataFrame:
    sites = table(s, d, "gene_anno").where("symbol IS NOT NULL").select(F.concat(F.col("genome"), F.lit(":"), F.col("chr")).alias("chr"), F.col("symbol").alias("gene")).where("chr IS NOT NULL").distinct()
    by_chr = A.bulk(s, d).join(sites, "gene").withColumn("value", F.col("value") * (1 + F.length("chr") % 3))
    return P.median_over_repeats(by_chr, "sample_id", "gene", "chr").withColumn("value", F.round("value", 6))


@add("maxabs_scale", with_sql("SELECT cell_id, gene, round(10 * floor(value) / max(floor(value)) OVER (PARTITION BY cell_id), 6) AS value FROM counts WHERE floor(value) <> 0", "counts"))
def maxabs_scale(s: SparkSession, d: str) -> DataFrame:
    return P.max_abs_scale(A.counts(s, d)).withColumn("value", F.round("value", 6))


QUANTILE = """grid AS (SELECT s.sample_id, g.gene, coalesce(b.value, 0) AS value FROM (SELECT DISTINCT sample_id FROM bulk) s CROSS JOIN (SELECT DISTINCT gene FROM bulk) g LEFT JOIN bulk b ON b.sample_id = s.sample_id AND b.gene = g.gene),
 pos AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY value, gene) AS p, rank() OVER (PARTITION BY sample_id ORDER BY value) AS r FROM grid), ref AS (SELECT p, {f}(value) AS v FROM pos GROUP BY 1)"""


def _quantile_sql(f: str) -> str:
    return _more("SELECT sample_id, gene, round(v, 6) AS value, (SELECT round(v, 6) FROM ref WHERE p = 1) AS zero_value FROM pos JOIN ref ON ref.p = pos.r WHERE value > 0", QUANTILE.format(f=f), "bulk")


def _quantile(s: SparkSession, d: str, median: bool) -> DataFrame:
    return P.quantile_norm(A.bulk(s, d), "sample_id", "gene", median=median).select("sample_id", "gene", F.round("value", 6).alias("value"), F.round("zero_value", 6).alias("zero_value"))


@add("quantile_norm_mean", _quantile_sql("avg"))
def quantile_norm_mean(s: SparkSession, d: str) -> DataFrame:
    return _quantile(s, d, False)


@add("quantile_norm_median", _quantile_sql("median"))
def quantile_norm_median(s: SparkSession, d: str) -> DataFrame:
    return _quantile(s, d, True)


@add("zscore_sample", with_sql("SELECT sample_id, gene, round((value - avg(value) OVER w) / (stddev_samp(value) OVER w + 2.220446049250313e-16), 6) AS value FROM bulk WINDOW w AS (PARTITION BY sample_id)", "bulk"))
def zscore_sample(s: SparkSession, d: str) -> DataFrame:
    return P.zscore(A.bulk(s, d), ["sample_id"]).withColumn("value", F.round("value", 6))


CONTROL = "avg(value) FILTER (sample_id < 'S00003') OVER w"


@add("ctrl_norm", with_sql(f"SELECT * FROM (SELECT sample_id, gene, round((value - {CONTROL}) / (stddev_samp(value) FILTER (sample_id < 'S00003') OVER w + 2.220446049250313e-16), 3) AS value FROM bulk WINDOW w AS (PARTITION BY gene)) WHERE value IS NOT NULL", "bulk"))
def ctrl_norm(s: SparkSession, d: str) -> DataFrame:
    return P.control_zscore(A.bulk(s, d), "gene", F.col("sample_id") < "S00003").withColumn("value", F.round("value", 3))


GROUPS = "groups AS (SELECT DISTINCT gene, CAST(ord % 5 AS INTEGER) AS group_id FROM use_gene UNION SELECT DISTINCT gene, 5 FROM use_gene WHERE ord % 7 = 0)"


def _groups(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "use_gene")
    return g.select("gene", (F.col("ord") % 5).alias("group_id")).union(g.where("ord % 7 = 0").select("gene", F.lit(5))).distinct()


@add("freq_norm", _more("SELECT sample_id, gene, round(avg(value * coalesce(f, 1)), 6) AS value FROM bulk LEFT JOIN groups USING (gene) LEFT JOIN (SELECT group_id, max(t) OVER () / t AS f FROM (SELECT group_id, sum(value) AS t FROM bulk JOIN groups USING (gene) GROUP BY 1 HAVING sum(value) > 0)) USING (group_id) GROUP BY 1, 2", GROUPS, "bulk"))
def freq_norm(s: SparkSession, d: str) -> DataFrame:
    return P.group_totals_norm(A.bulk(s, d), _groups(s, d)).withColumn("value", F.round("value", 6))


@add("size_norm", _more("SELECT sample_id, gene, group_id, round(value * f, 6) AS value FROM bulk JOIN groups USING (gene) JOIN (SELECT group_id, max(count(*)) OVER () / count(*) FILTER (gene IN (SELECT gene FROM bulk)) AS f FROM groups GROUP BY 1) USING (group_id)", GROUPS, "bulk"))
def size_norm(s: SparkSession, d: str) -> DataFrame:
    return P.group_sizes_norm(A.bulk(s, d), _groups(s, d)).withColumn("value", F.round("value", 6))


@add("impute_median", with_sql("SELECT gene, count(value) AS present, round(median(value), 6) AS fill FROM bulk GROUP BY 1 HAVING count(value) >= CAST(floor(0.5 * (SELECT count(DISTINCT sample_id) FROM bulk)) AS BIGINT)", "bulk"))
def impute_median(s: SparkSession, d: str) -> DataFrame:
    b = A.bulk(s, d)
    return P.impute(b, "gene", count_of(b, "sample_id"), 0.5).withColumn("fill", F.round("fill", 6))


@add("impute_mean", with_sql("SELECT gene, count(value) AS present, round(avg(value), 6) AS fill FROM bulk GROUP BY 1 HAVING count(value) >= CAST(floor(0.5 * (SELECT count(DISTINCT sample_id) FROM bulk)) AS BIGINT)", "bulk"))
def impute_mean(s: SparkSession, d: str) -> DataFrame:
    b = A.bulk(s, d)
    return P.impute(b, "gene", count_of(b, "sample_id"), 0.5, "mean").withColumn("fill", F.round("fill", 6))


@add("impute_mode", with_sql("SELECT gene, any_value(present) AS present, first(value ORDER BY n DESC, value) AS fill FROM (SELECT gene, value, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY gene) AS BIGINT) AS present FROM bulk GROUP BY 1, 2) GROUP BY 1 HAVING any_value(present) >= CAST(floor(0.5 * (SELECT count(DISTINCT sample_id) FROM bulk)) AS BIGINT)", "bulk"))
def impute_mode(s: SparkSession, d: str) -> DataFrame:
    b = A.bulk(s, d)
    return P.impute(b, "gene", count_of(b, "sample_id"), 0.5, "mode")


@add("topic_grid", with_sql("SELECT unnest(range(count(*), 3 * count(*) + 1)) AS ntopics FROM shares", "shares"))
def topic_grid(s: SparkSession, d: str) -> DataFrame:
    """Numbers of topics to try for the cell types at hand."""
    n = count_of(A.anno(s, d), "main_cell_type")
    return s.range(1).select(F.explode(F.sequence(n, 3 * n)).alias("ntopics"))


DISPERSION = """disp AS (SELECT gene, s1 / n AS mean, (s2 - s1 * s1 / n) / (n - 1) AS variance FROM (SELECT gene, sum(value) AS s1, sum(value * value) AS s2, (SELECT count(DISTINCT cell_id) FROM counts)::DOUBLE AS n FROM counts GROUP BY 1))"""


@add("hvg_topn", _more("SELECT gene, round(mean, 6) AS mean, round(variance, 5) AS variance, round(variance / mean, 5) AS dispersion FROM disp ORDER BY variance / mean DESC, gene LIMIT 500", DISPERSION, "counts"))
def hvg_topn(s: SparkSession, d: str) -> DataFrame:
    c = A.counts(s, d)
    top = P.highly_variable(c, count_of(c, "cell_id"), 500)
    return top.select("gene", F.round("mean", 6).alias("mean"), F.round("variance", 5).alias("variance"), F.round("dispersion", 5).alias("dispersion"))


@add("subsample_celltypes", with_sql("""SELECT cell_id, main_cell_type FROM (SELECT *, row_number() OVER (PARTITION BY main_cell_type ORDER BY md5(cell_id), cell_id) AS r, count(*) OVER (PARTITION BY main_cell_type) AS n, count(*) OVER () AS t FROM anno)
 WHERE r <= CASE main_cell_type WHEN 'naive t4' THEN least(n, greatest(1, round_even((t - n) * 0.05 / (1 - 0.05), 0))) WHEN 'platelet' THEN 0 ELSE n END""", "anno"))
def subsample_celltypes(s: SparkSession, d: str) -> DataFrame:
    return P.subsample(A.anno(s, d), "main_cell_type", {"naive t4": 0.05, "platelet": 0.0, "classic mono": 1.0}, "cell_id").select("cell_id", "main_cell_type")


@add("uniquify_symbols", with_sql('SELECT chr, start, "end", strand, symbol, gene FROM named_genes', "named_genes"))
def uniquify_symbols(s: SparkSession, d: str) -> DataFrame:
    return A.named_genes(s, d)


ANCHORS = "anchors AS (SELECT DISTINCT gene, CAST(ord % 9 AS INTEGER) AS topic_id FROM use_gene WHERE ord < 90 UNION SELECT DISTINCT gene, 3 FROM use_gene WHERE ord < 12), reg AS (SELECT topic_id, gene, CAST(dense_rank() OVER (ORDER BY topic_id) - 1 AS INTEGER) AS seed_topic FROM anchors WHERE gene IN (SELECT gene FROM counts))"


def _registered(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "use_gene")
    anchors = g.where("ord < 90").select("gene", (F.col("ord") % 9).alias("topic_id")).union(g.where("ord < 12").select("gene", F.lit(3)))
    return P.registered_anchors(anchors, A.counts(s, d))


@add("anchors_registered", _more("SELECT * FROM reg", ANCHORS, "counts"))
def anchors_registered(s: SparkSession, d: str) -> DataFrame:
    return _registered(s, d).select("topic_id", "gene", "seed_topic")


@add("anchors_specific", _more("SELECT topic_id, gene, seed_topic FROM reg QUALIFY count(*) OVER (PARTITION BY gene) = 1", ANCHORS, "counts"))
def anchors_specific(s: SparkSession, d: str) -> DataFrame:
    return P.specific_anchors(_registered(s, d)).select("topic_id", "gene", "seed_topic")


@add("seed_topics", _more("SELECT gene, array_to_string(list_sort(list(seed_topic)), ',') AS seeds FROM reg GROUP BY 1", ANCHORS, "counts"))
def seed_topics(s: SparkSession, d: str) -> DataFrame:
    return _registered(s, d).groupBy("gene").agg(F.array_join(F.array_sort(F.collect_list("seed_topic")).cast("array<string>"), ",").alias("seeds"))


@add("low_cut", with_sql("SELECT cell_id, gene, CASE WHEN value > 1 THEN value END AS value FROM counts", "counts"))
def low_cut(s: SparkSession, d: str) -> DataFrame:
    return A.counts(s, d).withColumn("value", F.when(F.col("value") > 1, F.col("value")))


@add("drop_all_missing", "SELECT gene, count(*) AS n FROM rna_counts GROUP BY 1 HAVING max(abs(coalesce(value, 0))) > 0")
def drop_all_missing(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "rna_counts").groupBy("gene").agg(F.count("*").alias("n"), F.max(F.abs(F.coalesce("value", F.lit(0.0)))).alias("top")).where("top > 0").drop("top")


@add("variance_filter", with_sql("SELECT gene, count(*) AS n, round(var_samp(value), 5) AS variance FROM bulk GROUP BY 1 HAVING var_samp(value) > 0 AND count(*) = (SELECT count(DISTINCT sample_id) FROM bulk)", "bulk"))
def variance_filter(s: SparkSession, d: str) -> DataFrame:
    b = A.bulk(s, d)
    return P.complete_features(b, "gene", count_of(b, "sample_id")).withColumn("variance", F.round("variance", 5))


@add("deliveries_dedupe", with_sql("SELECT cell_id, gene, value FROM delivered", "delivered"))
def deliveries_dedupe(s: SparkSession, d: str) -> DataFrame:
    return A.delivered(s, d)


@add("token_class_bins", with_sql("SELECT cell_id, gene, CAST(least(floor(value), 5) AS BIGINT) AS bin FROM counts", "counts"))
def token_class_bins(s: SparkSession, d: str) -> DataFrame:
    return A.counts(s, d).select("cell_id", "gene", F.least(F.floor("value"), F.lit(5)).alias("bin"))


#: The cells of the test tables have some ten genes: screened by five.
RANKSUM = """screened AS (SELECT cell_id, gene, ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * 1e4) AS value FROM (SELECT * FROM (SELECT * FROM counts QUALIFY count(*) OVER (PARTITION BY cell_id) >= 5) QUALIFY count(*) OVER (PARTITION BY gene) >= 10)),
 ranked AS (SELECT * FROM anno WHERE cell_id IN (SELECT cell_id FROM screened)), mtyped AS (SELECT s.*, main_cell_type FROM screened s JOIN ranked USING (cell_id)),
 n AS (SELECT count(*)::DOUBLE AS n FROM ranked), n1 AS (SELECT main_cell_type, count(*)::DOUBLE AS n1 FROM ranked GROUP BY 1),
 g AS (SELECT gene, value, count(*)::DOUBLE AS t FROM mtyped GROUP BY 1, 2), z AS (SELECT gene, any_value(n) - sum(t) AS n0 FROM g, n GROUP BY 1),
 v AS (SELECT gene, value, t, n0, n0 + sum(t) OVER (PARTITION BY gene ORDER BY value ROWS UNBOUNDED PRECEDING) - (t - 1) / 2 AS rk FROM g JOIN z USING (gene)),
 ties AS (SELECT gene, sum(t * t * t - t) + any_value(n0 * n0 * n0 - n0) AS ties, any_value(n0) AS n0 FROM v GROUP BY 1),
 r AS (SELECT gene, main_cell_type, sum(rk) AS r, count(*)::DOUBLE AS k FROM mtyped JOIN v USING (gene, value) GROUP BY 1, 2),
 f AS (SELECT gene, main_cell_type, r + (n1 - k) * (n0 + 1) / 2 AS rs, n1, n, ties FROM r JOIN ties USING (gene) JOIN n1 USING (main_cell_type), n)"""


@add("marker_ranksum", _more("SELECT gene, main_cell_type, round(rs, 3) AS rank_sum, round((rs - n1 * (n + 1) / 2) / sqrt(nullif((1 - ties / (n * n * n - n)) * n1 * (n - n1) * (n + 1) / 12, 0)), 6) AS z FROM f", RANKSUM, "counts", "anno"))
def marker_ranksum(s: SparkSession, d: str) -> DataFrame:
    return P.find_markers(A.counts(s, d), A.anno(s, d), 5, 10).select("gene", "main_cell_type", F.round("rank_sum", 3).alias("rank_sum"), F.round("z", 6).alias("z"))


@add("marker_genes", _more("SELECT DISTINCT gene FROM (SELECT gene, row_number() OVER (PARTITION BY main_cell_type ORDER BY round((rs - n1 * (n + 1) / 2) / sqrt((1 - ties / (n * n * n - n)) * n1 * (n - n1) * (n + 1) / 12), 9) DESC, gene) AS k FROM f) WHERE k <= 20", RANKSUM, "counts", "anno"))
def marker_genes(s: SparkSession, d: str) -> DataFrame:
    return P.take_markers(P.find_markers(A.counts(s, d), A.anno(s, d), 5, 10).withColumn("z", F.round("z", 9)), 20)


#: Moments, priors and the iterated estimates of batch correction over ``src`` (cell_id, gene, value, lane), named with ``t``.
COMBAT = """sz{t} AS (SELECT lane, count(DISTINCT cell_id)::DOUBLE AS n FROM {src} WHERE lane IS NOT NULL GROUP BY 1),
 gr{t} AS (SELECT g.gene, z.lane, z.n, coalesce(s, 0) AS s, coalesce(q, 0) AS q FROM (SELECT DISTINCT gene FROM {src} WHERE lane IS NOT NULL) g CROSS JOIN sz{t} z LEFT JOIN (SELECT gene, lane, sum(value) AS s, sum(value * value) AS q FROM {src} GROUP BY 1, 2) x ON x.gene = g.gene AND x.lane = z.lane),
 m{t} AS (SELECT *, sum(s) OVER w / (SELECT sum(n) FROM sz{t}) AS m, sum(q - s * s / n) OVER w / (SELECT sum(n) FROM sz{t}) AS v FROM gr{t} WINDOW w AS (PARTITION BY gene)),
 z{t} AS (SELECT gene, lane, n, m, sd, (s - n * m) / sd AS z1, (q - 2 * m * s + n * m * m) / (sd * sd) AS z2 FROM (SELECT *, CASE WHEN v > 1e-12 THEN sqrt(v) END AS sd FROM m{t})),
 e{t} AS (SELECT *, z1 / n AS g, (z2 - z1 * (z1 / n)) / nullif(n - 1, 0) AS d FROM z{t}),
 pr{t} AS (SELECT *, dm * (a - 1) AS b FROM (SELECT lane, avg(g) AS gm, var_samp(g) AS gv, avg(d) AS dm, 2 + avg(d) * avg(d) / nullif(var_samp(d), 0) AS a FROM e{t} GROUP BY 1)),
 it{t} AS (SELECT gene, lane, n, z1, z2, e.g AS g0, gm, gv, a, b, 0 AS k, e.g AS g, e.d AS d FROM e{t} e JOIN pr{t} USING (lane) WHERE gv > 0 AND a IS NOT NULL AND e.d > 0
  UNION ALL SELECT gene, lane, n, z1, z2, g0, gm, gv, a, b, k + 1, gn, (b + (z2 - 2 * gn * z1 + n * gn * gn) / 2) / (n / 2 + a - 1) FROM (SELECT *, (n * gv * g0 + d * gm) / (n * gv + d) AS gn FROM it{t} WHERE k < 30)),
 f{t} AS (SELECT e.gene, e.lane, e.m, e.sd, coalesce(i.g, e.g) AS gs, sqrt(coalesce(i.d, CASE WHEN e.d > 0 THEN e.d END, 1)) AS ds FROM e{t} e LEFT JOIN (SELECT * FROM it{t} WHERE k = 30) i ON i.gene = e.gene AND i.lane = e.lane),
 done{t} AS (SELECT cell_id, c.gene, c.lane, coalesce(m + ((value - m) - sd * gs) / ds, value) AS value, coalesce(m + ((0 - m) - sd * gs) / ds, 0) AS zero_value FROM {src} c LEFT JOIN f{t} f ON f.gene = c.gene AND f.lane = c.lane)"""
LANES = "lanes AS (SELECT cell_id, lane_batch AS lane FROM rna_obs WHERE cell_id IS NOT NULL AND lane_batch IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC NULLS LAST, lane_batch DESC) = 1)"


@add("combat", _more("SELECT cell_id, gene, lane, round(value, 5) AS value, round(zero_value, 5) AS zero_value FROM done1", f"{LIBSIZE}, {LANES}, logged AS (SELECT cell_id, gene, log2(value / size * greatest(s, 1) + 1) AS value, lane FROM counts JOIN sizes USING (cell_id) JOIN lanes USING (cell_id), scale), {COMBAT.format(t=1, src='logged')}", "counts").replace("WITH ", "WITH RECURSIVE ", 1))
def combat(s: SparkSession, d: str) -> DataFrame:
    lanes = table(s, d, "rna_obs").where("cell_id IS NOT NULL AND lane_batch IS NOT NULL").groupBy("cell_id").agg(F.max_by("lane_batch", F.struct("loaded_at", "lane_batch")).alias("lane"))
    logged = P.log2p1(P.library_norm(A.counts(s, d), guard=True)).join(lanes, "cell_id")
    out = P.combat(logged, "lane")
    return out.withColumn("value", F.round("value", 5)).withColumn("zero_value", F.round("zero_value", 5))


@add("expressed_share", with_sql("SELECT gene, round(count(*) / (SELECT count(DISTINCT cell_id) FROM counts), 6) AS share, round(avg(log2(value + 1)), 6) AS mean_log FROM counts GROUP BY 1", "counts"))
def expressed_share(s: SparkSession, d: str) -> DataFrame:
    c = A.counts(s, d)
    return c.groupBy("gene").agg(F.round(F.count("*") / count_of(c, "cell_id"), 6).alias("share"), F.round(F.avg(log2p1(F.col("value"))), 6).alias("mean_log"))


@add("stratified_split", with_sql("SELECT cell_id, main_cell_type, percent_rank() OVER (PARTITION BY main_cell_type ORDER BY md5(cell_id), cell_id) < 0.8 AS train FROM anno", "anno"))
def stratified_split(s: SparkSession, d: str) -> DataFrame:
    return P.stratified_split(A.anno(s, d), "main_cell_type", "cell_id", 0.8)


def _two_lanes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "rna_obs").where("cell_id IS NOT NULL").where("lane_batch IS NOT NULL").groupBy("cell_id").agg(F.max_by("lane_batch", F.struct("loaded_at", "lane_batch")).alias("lane_batch"))


@add("prepare_bulk", _more("SELECT sample_id, gene, round(v, 6) AS value FROM pos JOIN ref ON ref.p = pos.r WHERE value > 0", "sizes AS (SELECT sample_id, sum(value) AS size FROM bulk GROUP BY 1), scale AS (SELECT round_even(quantile_cont(size, 0.75) / 1000, 0) * 1000 AS s FROM sizes), logged AS (SELECT sample_id, gene, log2(value / size * greatest(s, 1) + 1) AS value FROM bulk JOIN sizes USING (sample_id), scale), " + QUANTILE.format(f="avg").replace("FROM bulk", "FROM logged").replace("JOIN bulk", "JOIN logged"), "bulk"))
def prepare_bulk(s: SparkSession, d: str) -> DataFrame:
    """The preparation chain of bulk samples, with quantile normalisation."""
    return pipelines.prepare(A.bulk(s, d), to_log=True, cell="sample_id", quantile=True).withColumn("value", F.round("value", 6))


@add("prepare_cells", _more("SELECT cell_id, gene, round(log2(value / size * greatest(s, 1) + 1), 6) AS value FROM counts JOIN sizes USING (cell_id), scale", LIBSIZE, "counts"))
def prepare_cells(s: SparkSession, d: str) -> DataFrame:
    """The preparation chain without batch correction."""
    return pipelines.prepare(A.delivered(s, d), to_log=True).withColumn("value", F.round("value", 6))


@add("prepare_cells_batches", _more("SELECT cell_id, gene, round(log2(value / size * greatest(s, 1) + 1), 5) AS value FROM fixed JOIN sizes USING (cell_id), scale", f"{LANES}, labelled AS (SELECT c.*, lane FROM counts c LEFT JOIN lanes USING (cell_id)), {COMBAT.format(t=1, src='labelled')}, fixed AS (SELECT cell_id, gene, value FROM done1 WHERE value > 0), {LIBSIZE.replace('FROM counts', 'FROM fixed')}", "counts").replace("WITH ", "WITH RECURSIVE ", 1))
def prepare_cells_batches(s: SparkSession, d: str) -> DataFrame:
    """The preparation chain with correction of the lanes."""
    return pipelines.prepare(A.delivered(s, d), _two_lanes(s, d), to_log=True, batch_cols=["lane_batch"]).withColumn("value", F.round("value", 5))


@add("trimming", with_sql("""SELECT s.sample_id, f.gene, round(log2(coalesce(b.value, fill) + 1), 6) AS value FROM (SELECT DISTINCT sample_id FROM bulk) s
 JOIN (SELECT gene, median(value) AS fill FROM bulk WHERE value > 1 GROUP BY 1 HAVING count(*) >= floor(0.6 * (SELECT count(DISTINCT sample_id) FROM bulk))) f ON true LEFT JOIN (SELECT * FROM bulk WHERE value > 1) b ON b.sample_id = s.sample_id AND b.gene = f.gene""", "bulk"))
def trimming(s: SparkSession, d: str) -> DataFrame:
    return pipelines.trimming(A.bulk(s, d), "sample_id", "gene", threshold=0.6).withColumn("value", F.round("value", 6))


@add("choose_variable_or_marker_genes", _more("""SELECT gene FROM (SELECT gene FROM disp ORDER BY variance / mean DESC, gene LIMIT 100) UNION SELECT gene FROM (SELECT gene, row_number() OVER (PARTITION BY main_cell_type ORDER BY round((rs - n1 * (n + 1) / 2) / sqrt((1 - ties / (n * n * n - n)) * n1 * (n - n1) * (n + 1) / 12), 9) DESC, gene) AS k FROM f) WHERE k <= 10""", f"{DISPERSION}, {RANKSUM}", "counts", "anno"))
def choose_variable_or_marker_genes(s: SparkSession, d: str) -> DataFrame:
    return pipelines.choose_genes(A.counts(s, d), A.anno(s, d), "BOTH", 10, 100, 5, 10)


@add("foundation_input", with_sql("""SELECT cell_id, gene, round(ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * 1e4), 6) AS value FROM (SELECT * FROM counts QUALIFY count(*) OVER (PARTITION BY cell_id) >= 8) WHERE gene IN (SELECT gene FROM use_gene)""", "counts"))
def foundation_input(s: SparkSession, d: str) -> DataFrame:
    return pipelines.foundation_input(A.counts(s, d), table(s, d, "use_gene"), 8)[0].withColumn("value", F.round("value", 6))


@add("anchor_matrix", with_sql("SELECT CAST(ord % 9 AS INTEGER) AS topic_id, gene, 2.0::DOUBLE AS strength FROM use_gene WHERE ord < 90 AND gene IN (SELECT gene FROM counts)", "counts"))
def anchor_matrix(s: SparkSession, d: str) -> DataFrame:
    anchors = table(s, d, "use_gene").where("ord < 90").select((F.col("ord") % 9).alias("topic_id"), "gene")
    return anchors.join(A.counts(s, d).select("gene").distinct(), "gene", "left_semi").withColumn("strength", F.lit(2.0))


@add("anchor_sizes", _more("SELECT topic_id, count(*) AS size, count(*) FILTER (u = 1) AS unique_genes FROM (SELECT *, count(*) OVER (PARTITION BY gene) AS u FROM reg) GROUP BY 1", ANCHORS, "counts"))
def anchor_sizes(s: SparkSession, d: str) -> DataFrame:
    r = _registered(s, d).withColumn("u", F.count("*").over(Window.partitionBy("gene")))
    return r.groupBy("topic_id").agg(F.count("*").alias("size"), F.count(F.when(F.col("u") == 1, 1)).alias("unique_genes"))


@add("cumulative_choice", with_sql("SELECT gene, n FROM (SELECT gene, n, sum(n) OVER (ORDER BY n DESC, gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT gene, count(*) AS n FROM counts GROUP BY 1)) WHERE coalesce(before, 0) < 0.5 * (SELECT count(*) FROM counts)", "counts"))
def cumulative_choice(s: SparkSession, d: str) -> DataFrame:
    """The most frequent genes that together make up half of all counts."""
    c = A.counts(s, d)
    n = c.groupBy("gene").agg(F.count("*").alias("n"))
    return pipelines.cumulative_choice(n, "n", 0.5 * c.agg(F.count("*")).scalar(), ["gene"])
