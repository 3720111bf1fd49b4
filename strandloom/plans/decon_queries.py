"""Queries of deconvolution, predicted signal and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.columns import sample_of
from strandloom.operators import deconvolve as D
from strandloom.operators import intervals as I
from strandloom.operators import metrics as M
from strandloom.operators import pipelines
from strandloom.operators.matrix import argmax, matmul, share
from strandloom.plans import adapters as A
from strandloom.plans.adapters import with_sql
from strandloom.plans.registry import Catalog
from strandloom.session import cut

CATALOG = Catalog()
add = CATALOG.add


def _more(sql: str, ctes: str, *views: str) -> str:
    return f"{with_sql('', *views).rstrip()}, {ctes} {sql}"


def _r(df: DataFrame, n: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


def _topic_type(s: SparkSession, d: str, cells: DataFrame | None = None) -> DataFrame:
    return D.type_means(A.cell_topic(s, d, cells), A.anno(s, d))


@add("pseudobulk_sum", with_sql("SELECT main_cell_type, gene, sum(value) AS value FROM typed GROUP BY 1, 2", "typed"))
def pseudobulk_sum(s: SparkSession, d: str) -> DataFrame:
    return A.typed(s, d).groupBy("main_cell_type", "gene").agg(F.sum("value").alias("value"))


@add("celltype_proportions", with_sql("SELECT main_cell_type, n_cells, round(proportion, 9) AS proportion FROM shares", "shares"))
def celltype_proportions(s: SparkSession, d: str) -> DataFrame:
    return _r(D.type_shares(A.anno(s, d)), 9, "proportion")


SCENARIO = """kept AS (SELECT cell_id, main_cell_type FROM (SELECT *, row_number() OVER (PARTITION BY main_cell_type ORDER BY md5(cell_id), cell_id) AS r, count(*) OVER (PARTITION BY main_cell_type) AS n FROM anno), (SELECT min_by(main_cell_type, (n_cells, main_cell_type)) AS rare FROM shares) WHERE main_cell_type <> rare OR r <= greatest(1, floor(n * 0.3)))"""


@add("pseudobulk_scenario", _more("SELECT main_cell_type, gene, sum(value) * 0.5::DOUBLE AS value FROM counts JOIN kept USING (cell_id) GROUP BY 1, 2", SCENARIO, "counts", "shares"))
def pseudobulk_scenario(s: SparkSession, d: str) -> DataFrame:
    return D.scenario(A.counts(s, d), A.anno(s, d), 0.3, 0.5)[0]


@add("scenario_truth", _more("SELECT main_cell_type, count(*) AS n_cells, round(count(*) / sum(count(*)) OVER (), 9) AS proportion FROM kept GROUP BY 1", SCENARIO, "counts", "shares"))
def scenario_truth(s: SparkSession, d: str) -> DataFrame:
    return _r(D.scenario(A.counts(s, d), A.anno(s, d), 0.3, 0.5)[1], 9, "proportion")


@add("topic_celltype_mean", with_sql("SELECT topic_id, main_cell_type, round(weight, 9) AS weight FROM topic_type", "topic_type"))
def topic_celltype_mean(s: SparkSession, d: str) -> DataFrame:
    return _r(_topic_type(s, d), 9, "weight")


@add("bayes_invert", with_sql("SELECT topic_id, main_cell_type, round(p, 9) AS p FROM bayes", "bayes"))
def bayes_invert(s: SparkSession, d: str) -> DataFrame:
    return _r(D.bayes(_topic_type(s, d), D.type_shares(A.anno(s, d))), 9, "p")


RULES = {
    "raw": "SELECT topic_id, main_cell_type, weight FROM topic_type",
    "norm": "SELECT topic_id, main_cell_type, weight / sum(weight) OVER (PARTITION BY topic_id) AS weight FROM topic_type",
    "norm_sd": "SELECT topic_id, main_cell_type, weight / sqrt(sum(weight * weight) OVER w / n - (sum(weight) OVER w / n) * (sum(weight) OVER w / n)) AS weight FROM topic_type, (SELECT count(*) AS n FROM shares) WINDOW w AS (PARTITION BY topic_id)",
    "bayes": "SELECT topic_id, main_cell_type, p AS weight FROM bayes",
    "bayes_norm": "SELECT topic_id, main_cell_type, p / sum(p) OVER (PARTITION BY topic_id) AS weight FROM bayes",
}
FRACTION = "rule AS ({rule}), fr AS (SELECT {unit}, main_cell_type, sum(t.weight * r.weight) / sum(sum(t.weight * r.weight)) OVER (PARTITION BY {unit}) AS fraction FROM {src} t JOIN rule r USING (topic_id) GROUP BY 1, 2)"


def _register_rule(rule: str) -> None:
    name = "decon_" + rule.replace("bayes_norm", "bayesnorm")

    @add(name, _more("SELECT sample_id, main_cell_type, round(fraction, 8) AS fraction FROM fr", FRACTION.format(rule=RULES[rule], unit="sample_id", src="topic_sample"), "topic_sample", "topic_type", "bayes", "shares"))
    def decon(s: SparkSession, d: str) -> DataFrame:
        return _r(D.fractions(A.topic_sample(s, d), D.rule_weights(rule, _topic_type(s, d), D.type_shares(A.anno(s, d)))), 8, "fraction")

    @add("accuracy_" + rule, _more("""SELECT avg(CAST(fr.main_cell_type = anno.main_cell_type AS INTEGER)) AS accuracy, count(*) AS n FROM (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY round(fraction, 9) DESC, main_cell_type) = 1) fr JOIN anno USING (cell_id)""", FRACTION.format(rule=RULES[rule], unit="cell_id", src="cell_topic"), "cell_topic", "topic_type", "bayes", "shares", "anno"))
    def accuracy(s: SparkSession, d: str) -> DataFrame:
        kinds = A.anno(s, d)
        f = D.fractions(A.cell_topic(s, d), D.rule_weights(rule, _topic_type(s, d), D.type_shares(kinds)), "cell_id").withColumn("value", F.round("fraction", 9))
        pred = argmax(f, ["cell_id"], "main_cell_type").withColumnRenamed("main_cell_type", "predicted")
        return pred.join(kinds, "cell_id").agg(F.avg((F.col("predicted") == F.col("main_cell_type")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


for _rule in RULES:
    _register_rule(_rule)


@add("e_ref", with_sql("SELECT main_cell_type, gene, round(value, 6) AS value FROM profile", "profile"))
def e_ref(s: SparkSession, d: str) -> DataFrame:
    return _r(D.reference_profile(A.counts(s, d), A.anno(s, d)), 6, "value")


WEIGHTS = """raww AS (SELECT main_cell_type, peak_id, sum(value * weight) AS w FROM profile JOIN links USING (gene) GROUP BY 1, 2),
 pw AS (SELECT main_cell_type, peak_id, w / (sum(w) OVER (PARTITION BY peak_id) / (SELECT count(DISTINCT main_cell_type) FROM profile)) AS value FROM raww)"""


def _links(s: SparkSession, d: str, sites: DataFrame | None = None) -> DataFrame:
    """Weights of all peaks within the library's reach of a gene, of several sites of a symbol the largest."""
    g = (A.genes(s, d) if sites is None else sites).withColumnRenamed("symbol", "gene")
    return I.gene_peaks(g, A.peaks(s, d, sites)).groupBy("gene", "peak_id").agg(F.max("weight").alias("weight"))


@add("celltype_peak_weight", _more("SELECT main_cell_type, peak_id, round(value, 6) AS value FROM pw", WEIGHTS, "profile", "links"))
def celltype_peak_weight(s: SparkSession, d: str) -> DataFrame:
    return _r(D.peak_weights(D.reference_profile(A.counts(s, d), A.anno(s, d)), _links(s, d)), 6, "value")


def _prediction(s: SparkSession, d: str, cells: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fractions, peak signals and weights that signal is predicted from."""
    kinds = A.anno(s, d)
    f = D.fractions(A.topic_sample(s, d, cells), D.rule_weights("bayes_norm", _topic_type(s, d, cells), D.type_shares(kinds)))
    profile = cut(D.reference_profile(cells, kinds))  # counted
    return f, A.peak_counts(s, d, cells, sites), D.peak_weights(profile, _links(s, d, sites), profile.count() <= D.MOST_PROFILE)


def _predicted(s: SparkSession, d: str) -> DataFrame:
    return D.predict_peaks(*_prediction(s, d, cut(A.counts(s, d)), cut(A.genes(s, d))))  # read several times


PREDICTED = f"{WEIGHTS}, {FRACTION.format(rule=RULES['bayes_norm'], unit='sample_id', src='topic_sample')}"
PREDICTED_VIEWS = ("profile", "links", "peak_counts", "topic_sample", "bayes")


@add("peak_predict", _more("SELECT sample_id, main_cell_type, peak_id, round(fraction * c.value * pw.value, 5) AS value FROM peak_counts c JOIN pw USING (peak_id) JOIN fr USING (sample_id, main_cell_type)", PREDICTED, *PREDICTED_VIEWS))
def peak_predict(s: SparkSession, d: str) -> DataFrame:
    return _r(_predicted(s, d), 5, "value")


TRUTH = "truth AS (SELECT split_part(cell_id, '_', 1) AS sample_id, main_cell_type, count(*) / sum(count(*)) OVER (PARTITION BY split_part(cell_id, '_', 1)) AS proportion FROM anno GROUP BY 1, 2), pairs AS (SELECT sample_id, main_cell_type, fraction AS p, coalesce(proportion, 0) AS t FROM fr LEFT JOIN truth USING (sample_id, main_cell_type))"
PAIRS = FRACTION.format(rule=RULES["bayes_norm"], unit="sample_id", src="topic_sample") + ", " + TRUTH
PAIR_VIEWS = ("topic_sample", "bayes", "anno")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    kinds = A.anno(s, d)
    f = D.fractions(A.topic_sample(s, d), D.rule_weights("bayes_norm", _topic_type(s, d), D.type_shares(kinds)))
    truth = share(kinds.groupBy(sample_of("cell_id").alias("sample_id"), "main_cell_type").agg(F.count("*").alias("proportion")), ["sample_id"], "proportion")
    return f.join(truth, ["sample_id", "main_cell_type"], "left").select("sample_id", "main_cell_type", F.col("fraction").alias("p"), F.coalesce("proportion", F.lit(0.0)).alias("t"))


REGRESSION = "count(*) AS n, round(corr(p, t), 6) AS pcc, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(avg((p - t) * (p - t)), 6) AS mse, round(avg(abs(p - t)), 6) AS mae"


@add("eval_pcc_rmse", _more(f"SELECT {REGRESSION}, round(1 - avg((p - t) * (p - t)) / var_pop(t), 4) AS r2 FROM pairs", PAIRS, *PAIR_VIEWS))
def eval_pcc_rmse(s: SparkSession, d: str) -> DataFrame:
    return _r(_r(M.regression(_pairs(s, d), "p", "t"), 6, "pcc", "rmse", "mse", "mae"), 4, "r2")


@add("eval_by_celltype", _more(f"SELECT main_cell_type, {REGRESSION} FROM pairs GROUP BY 1", PAIRS, *PAIR_VIEWS))
def eval_by_celltype(s: SparkSession, d: str) -> DataFrame:
    return _r(M.regression(_pairs(s, d), "p", "t", ["main_cell_type"]).drop("r2"), 6, "pcc", "rmse", "mse", "mae")


@add("eval_regression", _more("SELECT sample_id, main_cell_type, round(abs(p - t), 8) AS abs_error, round(abs(p - t) / nullif(t, 0), 6) AS rel_error FROM pairs", PAIRS, *PAIR_VIEWS))
def eval_regression(s: SparkSession, d: str) -> DataFrame:
    e = F.abs(F.col("p") - F.col("t"))
    return _pairs(s, d).select("sample_id", "main_cell_type", F.round(e, 8).alias("abs_error"), F.round(e / F.nullif("t", F.lit(0.0)), 6).alias("rel_error"))


@add("eval_variation", _more("SELECT main_cell_type, round(avg(p), 8) AS mean, round(stddev_pop(p), 8) AS sd, round(stddev_pop(p) / nullif(avg(p), 0), 5) AS cv FROM pairs GROUP BY 1", PAIRS, *PAIR_VIEWS))
def eval_variation(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).groupBy("main_cell_type").agg(F.round(F.avg("p"), 8).alias("mean"), F.round(F.stddev_pop("p"), 8).alias("sd"), F.round(F.stddev_pop("p") / F.nullif(F.avg("p"), F.lit(0.0)), 5).alias("cv"))


@add("eval_grouping_sets", _more("SELECT sample_id, main_cell_type, count(*) AS n, round(avg(abs(p - t)), 8) AS mae FROM pairs GROUP BY GROUPING SETS ((sample_id), (main_cell_type), ())", PAIRS, *PAIR_VIEWS))
def eval_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).groupingSets([["sample_id"], ["main_cell_type"], []], "sample_id", "main_cell_type").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("p") - F.col("t"))), 8).alias("mae"))


@add("rare_rank", with_sql("SELECT main_cell_type, row_number() OVER (ORDER BY proportion, main_cell_type) AS rare_rank FROM shares", "shares"))
def rare_rank(s: SparkSession, d: str) -> DataFrame:
    return D.type_shares(A.anno(s, d)).select("main_cell_type", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("proportion", "main_cell_type")).cast("bigint").alias("rare_rank"))


BOOT = """un AS (SELECT main_cell_type, row_number() OVER (ORDER BY main_cell_type) - 1 AS u, count(*) OVER () AS n FROM (SELECT DISTINCT main_cell_type FROM pairs)),
 dr AS (SELECT r, u, count(*) AS w FROM (SELECT r, CAST('0x' || left(md5(r || '-' || u || '-42'), 8) AS BIGINT) % n AS u FROM un, (SELECT unnest(range(1000)) AS r)) GROUP BY 1, 2),
 sm AS (SELECT r, sum(w) AS n, sum(w * p) AS p, sum(w * t) AS t, sum(w * p * p) AS pp, sum(w * t * t) AS tt, sum(w * p * t) AS pt, sum(w * (p - t) * (p - t)) AS ee FROM dr JOIN un USING (u) JOIN pairs USING (main_cell_type) GROUP BY 1),
 sd AS (SELECT stddev_pop(CASE WHEN pp - p * p / n > 1e-15 AND tt - t * t / n > 1e-15 THEN (pt - p * t / n) / sqrt((pp - p * p / n) * (tt - t * t / n)) END) AS pcc_sd, stddev_pop(sqrt(ee / n)) AS rmse_sd FROM sm)"""


@add("bootstrap_ci", _more("SELECT count(*) AS n, round(corr(p, t), 6) AS pcc, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(any_value(pcc_sd), 6) AS pcc_sd, round(any_value(rmse_sd), 6) AS rmse_sd FROM pairs, sd", f"{PAIRS}, {BOOT}", *PAIR_VIEWS))
def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    return _r(M.bootstrap(_pairs(s, d), "main_cell_type", "p", "t"), 6, "pcc", "rmse", "pcc_sd", "rmse_sd")


@add("topic_best_celltype", _more("SELECT topic_id, main_cell_type, round(weight, 9) AS weight FROM topic_type QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 9) DESC, main_cell_type) = 1", "x AS (SELECT 1)", "topic_type"))
def topic_best_celltype(s: SparkSession, d: str) -> DataFrame:
    """The cell type that is heaviest in each topic."""
    best = _r(_topic_type(s, d), 9, "weight")
    return argmax(best, ["topic_id"], "main_cell_type", "weight").join(best, ["topic_id", "main_cell_type"])


@add("celltype_topics", _more("SELECT topic_id, main_cell_type FROM taken UNION ALL SELECT DISTINCT topic_id, 'unsure' FROM topic_type WHERE topic_id NOT IN (SELECT topic_id FROM taken)", "taken AS (SELECT topic_id, main_cell_type FROM topic_type QUALIFY row_number() OVER (PARTITION BY main_cell_type ORDER BY round(weight, 9) DESC, topic_id) = 1)", "topic_type"))
def celltype_topics(s: SparkSession, d: str) -> DataFrame:
    """The topic of each cell type; topics that no type takes are unsure."""
    return pipelines.topics_of_types(_r(_topic_type(s, d), 9, "weight"))


@add("external_topic_align", with_sql("SELECT sample_id, topic_id, round(weight, 9) AS weight FROM topic_sample WHERE topic_id IN (SELECT topic_id FROM topic_type WHERE topic_id > 1)", "topic_sample", "topic_type"))
def external_topic_align(s: SparkSession, d: str) -> DataFrame:
    return _r(D.external_topics(A.topic_sample(s, d), _topic_type(s, d).where("topic_id > 1"))[0], 9, "weight")


@add("backend_metadata", with_sql("SELECT (SELECT count(DISTINCT gene) FROM gene_topic) AS n_genes, (SELECT count(DISTINCT topic_id) FROM gene_topic) AS n_topics, (SELECT count(DISTINCT cell_id) FROM cell_topic) AS n_cells, (SELECT count(DISTINCT main_cell_type) FROM topic_type) AS n_celltypes", "gene_topic", "cell_topic", "topic_type"))
def backend_metadata(s: SparkSession, d: str) -> DataFrame:
    from strandloom.sources.sinks import metadata

    return metadata(A.gene_topic(s, d), A.cell_topic(s, d), _topic_type(s, d))


@add("mean_peak_by_type", with_sql("SELECT main_cell_type, peak_id, round(weight, 9) AS value FROM peak_means", "peak_means"))
def mean_peak_by_type(s: SparkSession, d: str) -> DataFrame:
    return A.peak_means(s, d).select("main_cell_type", "peak_id", F.round("weight", 9).alias("value"))


@add("nnls_project", _more("SELECT sample_id, topic_id, round(w / sum(w) OVER (PARTITION BY sample_id), 6) AS weight FROM (SELECT sample_id, topic_id, sum(value * weight) / any_value(gg) AS w FROM bulk JOIN gene_topic USING (gene) JOIN (SELECT topic_id, sum(weight * weight) AS gg FROM gene_topic GROUP BY 1) USING (topic_id) GROUP BY 1, 2) WHERE w > 0", "x AS (SELECT 1)", "bulk", "gene_topic"))
def nnls_project(s: SparkSession, d: str) -> DataFrame:
    return _r(D.nnls(A.gene_topic(s, d), A.bulk(s, d), "topic_id"), 6, "weight")


@add("nnls_conditions", with_sql("SELECT DISTINCT sample_id, CAST(0 AS BIGINT) AS n_negative, CAST(0 AS BIGINT) AS n_improvable, 0.0::DOUBLE AS slack FROM bulk JOIN profile USING (gene)", "bulk", "profile"))
def nnls_conditions(s: SparkSession, d: str) -> DataFrame:
    """Whether the cell types' weights are a minimum: none negative, no type whose weight could grow to a better fit, and no gradient along a positive weight (relative to the sample's largest product)."""
    cells, kinds = cut(A.counts(s, d)), A.anno(s, d)
    profile, bulk = D.reference_profile(cells, kinds).withColumnRenamed("value", "weight"), A.bulk(s, d, cells)
    x = D.nnls(profile, bulk, "main_cell_type", normal=False)
    fitted = matmul(x, profile, ["sample_id"], ["main_cell_type"], ["gene"], "weight", "weight").withColumn("value", -F.col("value"))
    products = lambda df, name: matmul(df, profile, ["sample_id"], ["gene"], ["main_cell_type"], "value", "weight", name)
    rhs = products(bulk, "b")
    grad = rhs.join(products(fitted, "f"), ["sample_id", "main_cell_type"], "left").join(x, ["sample_id", "main_cell_type"], "left").na.fill(0.0, ["f", "weight"])
    size, left = F.max(F.abs("b")).over(Window.partitionBy("sample_id")), F.col("b") + F.col("f")
    rel = grad.withColumn("g", F.try_divide(left, size))
    return rel.groupBy("sample_id").agg(F.count(F.when(F.col("weight") < 0, 1)).alias("n_negative"), F.count(F.when(F.col("g") > 1e-6, 1)).alias("n_improvable"), F.abs(F.round(F.max(F.when(F.col("weight") > 0, F.abs("g")).otherwise(0.0)), 5)).alias("slack"))


@add("no_topic_baseline")
def no_topic_baseline(s: SparkSession, d: str) -> DataFrame:
    profile = D.reference_profile(A.counts(s, d), A.anno(s, d)).withColumnRenamed("value", "weight")
    return _r(D.nnls(profile, A.bulk(s, d), "main_cell_type", uniform_if_zero=False), 6, "weight")


@add("no_gas_baseline")
def no_gas_baseline(s: SparkSession, d: str) -> DataFrame:
    """Topics in the space of peaks, combined with the cell types of the topics."""
    peak_topic = matmul(A.gene_topic(s, d), _links(s, d), ["topic_id"], ["gene"], ["peak_id"], "weight", "weight", "weight")
    theta = D.nnls(peak_topic, A.peak_counts(s, d), "topic_id", "peak_id")
    return _r(D.fractions(theta, _topic_type(s, d)), 6, "fraction")


TAIL = """cp AS (SELECT main_cell_type, corr(p, t) AS r, count(*) AS n FROM pairs GROUP BY 1 HAVING count(*) >= 3 AND stddev_pop(p) > 0 AND stddev_pop(t) > 0),
 tl AS (SELECT main_cell_type, r, CASE WHEN abs(r) >= 1 THEN 0 WHEN (n - 2) % 2 = 0 THEN 1 - abs(r) * list_sum(list_transform(range(0, (n - 2) // 2), lambda j: exp(lgamma(2 * j + 1) - 2 * j * ln(2) - 2 * lgamma(j + 1)) * pow(1 - r * r, j)))
 ELSE 1 - 2 / pi() * (asin(abs(r)) + abs(r) * coalesce(list_sum(list_transform(range(0, (n - 3) // 2), lambda j: exp(2 * j * ln(2) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)) * pow(1 - r * r, j + 0.5))), 0)) END AS p FROM cp)"""


@add("correlation_p", _more("SELECT main_cell_type, round(r, 6) AS pcc, abs(round(p, 9)) AS p_value, CASE WHEN p < 0.01 THEN printf('%.2e', p) ELSE printf('%.2f', p) END AS text FROM tl", f"{PAIRS}, {TAIL}", *PAIR_VIEWS))
def correlation_p(s: SparkSession, d: str) -> DataFrame:
    """Correlation of fractions and truth per cell type, with its p value as text."""
    by = M.regression(_pairs(s, d), "p", "t", ["main_cell_type"]).where("pcc IS NOT NULL")
    p = pipelines.pearson_p(F.col("pcc"), F.col("n").cast("double"))
    return by.withColumn("p_value", p).select("main_cell_type", F.round("pcc", 6).alias("pcc"), F.round("p_value", 9).alias("p_value"), pipelines.p_text(F.col("p_value")).alias("text"))


#: Mean signals in thousands, so that some peaks of the test tables reach ten thousand.
TRUTH_SIGNAL = "scaled AS (SELECT main_cell_type, peak_id, value / CASE WHEN round_even(t / 10000, 0) = 0 THEN 1 ELSE round_even(t / 10000, 0) END AS value FROM (SELECT *, sum(value) OVER (PARTITION BY peak_id) AS t FROM (SELECT main_cell_type, peak_id, round(weight * 1000, 6) AS value FROM peak_means)))"


def _truth_signal(s: SparkSession, d: str, cells: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    return pipelines.scaled_truth(A.peak_means(s, d, cells, sites).select("main_cell_type", "peak_id", F.round(F.col("weight") * 1000, 6).alias("value")))


@add("scaled_truth", _more("SELECT main_cell_type, peak_id, round(value, 6) AS value FROM scaled", TRUTH_SIGNAL, "peak_means"))
def scaled_truth(s: SparkSession, d: str) -> DataFrame:
    return _r(_truth_signal(s, d), 6, "value")


SCORES = """pred AS (SELECT sample_id, main_cell_type, peak_id, fraction * c.value * pw.value AS p FROM peak_counts c JOIN pw USING (peak_id) JOIN fr USING (sample_id, main_cell_type)),
 tot AS (SELECT sample_id, peak_id, sum(p) AS p FROM pred GROUP BY 1, 2 HAVING sum(p) > 0), both_ AS (SELECT tot.*, coalesce(t.t, 0) AS t, coalesce(c.value, 0) AS b FROM tot LEFT JOIN (SELECT peak_id, sum(value) AS t FROM scaled GROUP BY 1) t USING (peak_id) LEFT JOIN peak_counts c USING (sample_id, peak_id)),
 sc AS (SELECT sample_id, count(*) AS n, avg(abs(p - t)) AS mae, avg((p - t) * (p - t)) AS mse, sqrt(avg((p - t) * (p - t))) AS rmse, CASE WHEN stddev_pop(t) > 0 THEN 1 - avg((p - t) * (p - t)) / var_pop(t) END AS r2,
 avg(abs(p - b)) AS mae_bulk, avg((p - b) * (p - b)) AS mse_bulk, sqrt(avg((p - b) * (p - b))) AS rmse_bulk, CASE WHEN stddev_pop(b) > 0 THEN 1 - avg((p - b) * (p - b)) / var_pop(b) END AS r2_bulk FROM both_ GROUP BY 1),
 grid AS (SELECT tot.sample_id, k.main_cell_type, tot.peak_id, coalesce(pred.p, 0) AS p, coalesce(s.value, 0) AS t FROM tot CROSS JOIN (SELECT main_cell_type FROM shares) k LEFT JOIN pred USING (sample_id, main_cell_type, peak_id) LEFT JOIN scaled s USING (main_cell_type, peak_id)),
 cr AS (SELECT sample_id, avg(r) AS peak_cor FROM (SELECT sample_id, main_cell_type, CASE WHEN stddev_pop(p) > 0 AND stddev_pop(t) > 0 THEN corr(p, t) END AS r FROM grid GROUP BY 1, 2) GROUP BY 1)"""


@add("eval_signal", _more("SELECT sample_id, n, round(mae, 3) AS mae, round(rmse, 3) AS rmse, round(r2, 4) AS r2, round(mae_bulk, 3) AS mae_bulk, round(rmse_bulk, 3) AS rmse_bulk, round(r2_bulk, 4) AS r2_bulk, round(peak_cor, 5) AS peak_cor FROM sc LEFT JOIN cr USING (sample_id)", f"{PREDICTED}, {TRUTH_SIGNAL}, {SCORES}", *PREDICTED_VIEWS, "peak_means", "shares"))
def eval_signal(s: SparkSession, d: str) -> DataFrame:
    """Predicted against measured signal of each sample."""
    cells, sites = cut(A.counts(s, d)), cut(A.genes(s, d))  # read several times
    f, peaks, weights = _prediction(s, d, cells, sites)
    out = D.predicted_scores(cut(f), peaks, weights, _truth_signal(s, d, cells, sites)).drop("mse", "mse_bulk")
    return _r(_r(_r(out, 3, "mae", "rmse", "mae_bulk", "rmse_bulk"), 4, "r2", "r2_bulk"), 5, "peak_cor")


@add("e_ref_scale", with_sql("SELECT main_cell_type, round(sum(value) / 1e4, 6) AS scale FROM typed GROUP BY 1", "typed"))
def e_ref_scale(s: SparkSession, d: str) -> DataFrame:
    return _r(D.reference_scale(A.counts(s, d), A.anno(s, d)), 6, "scale")


@add("sample_celltypes", _more("SELECT sample_id, main_cell_type, round(w / sum(w) OVER (PARTITION BY sample_id), 8) AS weight FROM (SELECT sample_id, main_cell_type, sum(t.weight * c.weight) AS w FROM topic_sample t JOIN col c USING (topic_id) GROUP BY 1, 2)", "col AS (SELECT topic_id, main_cell_type, weight / (sum(weight) OVER (PARTITION BY main_cell_type) + 1e-10) AS weight FROM topic_type)", "topic_sample", "topic_type"))
def sample_celltypes(s: SparkSession, d: str) -> DataFrame:
    """Samples to topics to cell types, each type's column of topics normalised."""
    return _r(D.sample_types(A.topic_sample(s, d), _topic_type(s, d)), 8, "weight")


@add("celltype_stretched", _more("SELECT topic_id, main_cell_type, CAST(floor(round(5 * coalesce((weight - min(weight) OVER w) / nullif(max(weight) OVER w - min(weight) OVER w, 0), 0), 9)) AS BIGINT) AS weight FROM topic_type WINDOW w AS (PARTITION BY main_cell_type)", "x AS (SELECT 1)", "topic_type"))
def celltype_stretched(s: SparkSession, d: str) -> DataFrame:
    """Each type's topic weights as whole numbers from 0 to 5."""
    return D.stretched(_topic_type(s, d))


@add("best_rule", _more("""SELECT CASE WHEN b >= a THEN 'bayes_norm' ELSE 'bayes' END AS rule FROM (SELECT avg(CAST(fr.main_cell_type = anno.main_cell_type AS INTEGER)) AS a FROM (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY round(fraction, 9) DESC, main_cell_type) = 1) fr JOIN anno USING (cell_id)),
 (SELECT avg(CAST(f2.main_cell_type = anno.main_cell_type AS INTEGER)) AS b FROM (SELECT * FROM f2 QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY round(fraction, 9) DESC, main_cell_type) = 1) f2 JOIN anno USING (cell_id))""", FRACTION.format(rule=RULES["bayes"], unit="cell_id", src="cell_topic") + ", " + FRACTION.format(rule=RULES["bayes_norm"], unit="cell_id", src="cell_topic").replace("rule AS", "r2 AS").replace("JOIN rule", "JOIN r2").replace("fr AS", "f2 AS"), "cell_topic", "topic_type", "bayes", "shares", "anno"))
def best_rule(s: SparkSession, d: str) -> DataFrame:
    """Of two combination rules the one that names more cells' types rightly."""
    scores = [CATALOG.queries["accuracy_" + r](s, d).select(F.lit(r).alias("rule"), "accuracy") for r in ("bayes", "bayes_norm")]
    return pipelines.prefer(scores[0].unionAll(scores[1])).select("rule")
