"""Queries of terms, embeddings and topic models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.columns import count_of, dot, norm
from strandloom.operators import ctfidf as C
from strandloom.operators import learners as L
from strandloom.operators import metrics as M
from strandloom.operators.matrix import best, share
from strandloom.operators.prefix import ranks
from strandloom.operators.pipelines import map_ids, term_title
from strandloom.operators.topics import choose, corex, guided, lda, tree
from strandloom.plans import adapters as A
from strandloom.plans.adapters import with_sql
from strandloom.plans.registry import Catalog, table
from strandloom.session import cut

CATALOG = Catalog()
add = CATALOG.add


def _more(sql: str, ctes: str, *views: str) -> str:
    return f"{with_sql('', *views).rstrip()}, {ctes} {sql}"


def _r(df: DataFrame, n: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


@add("doc_term_counts", with_sql("SELECT lang, term, n FROM terms", "terms"))
def doc_term_counts(s: SparkSession, d: str) -> DataFrame:
    return C.term_counts(A.docs(s, d), ["lang"])


CT = "sizes AS (SELECT lang, sum(n) AS size FROM terms GROUP BY 1), a AS (SELECT floor(avg(size)) AS a FROM sizes), f AS (SELECT term, sum(n)::DOUBLE AS f FROM terms GROUP BY 1)"


@add("ctfidf", _more("SELECT lang, term, round(n / size * ln(a / f + 1), 9) AS weight FROM terms JOIN sizes USING (lang) JOIN f USING (term), a", CT, "terms"))
def ctfidf(s: SparkSession, d: str) -> DataFrame:
    return _r(C.ctfidf(doc_term_counts(s, d), "lang"), 9, "weight")


@add("ctfidf_bm25_seed", _more("SELECT lang, term, round(sqrt(n / size) * ln(1 + (a - f + 0.5) / (f + 0.5)) * CASE WHEN term IN ('court', 'klage', 'appel') THEN 20 ELSE 1 END, 9) AS weight FROM terms JOIN sizes USING (lang) JOIN f USING (term), a", CT, "terms"))
def ctfidf_bm25_seed(s: SparkSession, d: str) -> DataFrame:
    return _r(C.ctfidf(doc_term_counts(s, d), "lang", True, True, ["court", "klage", "appel"], 20.0), 9, "weight")


@add("topic_top_words", _more("SELECT lang, term, weight, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank FROM (SELECT lang, term, round(n / size * ln(a / f + 1), 9) AS weight FROM terms JOIN sizes USING (lang) JOIN f USING (term), a) QUALIFY rank <= 10", CT, "terms"))
def topic_top_words(s: SparkSession, d: str) -> DataFrame:
    return C.top_terms(ctfidf(s, d), "lang", 10).withColumn("rank", F.col("rank").cast("bigint"))


UMASS = """tops AS (SELECT topic_id, gene, row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 9) DESC, gene) AS rank FROM gene_topic QUALIFY rank <= 30), hits AS (SELECT DISTINCT cell_id, topic_id, rank FROM counts JOIN tops USING (gene)),
 d AS (SELECT topic_id, rank, count(*) AS d FROM hits GROUP BY 1, 2), dd AS (SELECT a.topic_id, a.rank AS ra, b.rank AS rb, count(*) AS dd FROM hits a JOIN hits b ON a.cell_id = b.cell_id AND a.topic_id = b.topic_id AND b.rank > a.rank GROUP BY 1, 2, 3)"""


@add("umass_coherence", _more("SELECT topic_id, round(sum(ln((coalesce(dd, 0) + 1e-12) / (coalesce(d, 0) + 1e-12))), 4) AS coherence FROM (SELECT a.topic_id, a.rank AS ra, b.rank AS rb FROM tops a JOIN tops b ON a.topic_id = b.topic_id AND b.rank > a.rank) LEFT JOIN dd USING (topic_id, ra, rb) LEFT JOIN (SELECT topic_id, rank AS rb, d FROM d) USING (topic_id, rb) GROUP BY 1", UMASS, "gene_topic", "counts"))
def umass_coherence(s: SparkSession, d: str) -> DataFrame:
    tops = C.top_terms(_r(A.gene_topic(s, d), 9, "weight"), "topic_id", 30, "gene").select("topic_id", F.col("gene").alias("term"), "rank")
    docs = A.counts(s, d).select(F.col("cell_id").alias("doc_id"), F.col("gene").alias("term"))
    return _r(C.umass(tops, docs, "topic_id"), 4, "coherence")


COSINE = """tops AS (SELECT topic_id, gene, row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 9) DESC, gene) AS rank FROM gene_topic QUALIFY rank <= 10),
 mem AS (SELECT gene, ascii(right(cell_id, 3)) % 4 AS t, sum(value) AS weight FROM counts GROUP BY 1, 2), nn AS (SELECT gene, sum(weight * weight) AS nn FROM mem GROUP BY 1),
 pairs AS (SELECT a.topic_id, a.gene AS g1, b.gene AS g2 FROM tops a JOIN tops b ON a.topic_id = b.topic_id AND a.gene < b.gene),
 dots AS (SELECT topic_id, g1, g2, sum(x.weight * y.weight) AS d FROM pairs JOIN mem x ON x.gene = g1 JOIN mem y ON y.gene = g2 AND y.t = x.t GROUP BY 1, 2, 3)"""


@add("cosine_coherence", _more("SELECT topic_id, round(avg(coalesce(d, 0) / sqrt(a.nn * b.nn)), 6) AS coherence FROM pairs LEFT JOIN dots USING (topic_id, g1, g2) JOIN nn a ON a.gene = g1 JOIN nn b ON b.gene = g2 GROUP BY 1", COSINE, "gene_topic", "counts"))
def cosine_coherence(s: SparkSession, d: str) -> DataFrame:
    """Mean cosine of the vectors of each two top genes of a topic."""
    tops = C.top_terms(_r(A.gene_topic(s, d), 9, "weight"), "topic_id", 10, "gene").select("topic_id", "gene")
    mem = A.counts(s, d).groupBy("gene", (F.ascii(F.right("cell_id", F.lit(3))) % 4).alias("position")).agg(F.sum("value").alias("weight"))  # four columns stand in for an embedding of the genes
    return _r(M.cosine_coherence(tops, mem), 6, "coherence")


CROSS = "top AS (SELECT cell_id, topic_id FROM cell_topic QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY round(weight, 9) DESC, topic_id) = 1)"


def _dominant(s: SparkSession, d: str) -> DataFrame:
    return best(_r(A.cell_topic(s, d), 9, "weight"), ["cell_id"], [F.desc("weight"), F.asc("topic_id")]).select("cell_id", "topic_id")


@add("topic_celltype_crosstab", _more("SELECT topic_id, main_cell_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY main_cell_type), 9) AS share FROM top JOIN anno USING (cell_id) GROUP BY 1, 2", CROSS, "cell_topic", "anno"))
def topic_celltype_crosstab(s: SparkSession, d: str) -> DataFrame:
    return _r(M.crosstab(_dominant(s, d).join(A.anno(s, d), "cell_id"), "topic_id", "main_cell_type"), 9, "share")


@add("nmi", _more("SELECT round(2 * sum(p * ln(p / (pa * pb))) / (-sum(p * ln(pa)) - sum(p * ln(pb))), 8) AS nmi FROM (SELECT p, sum(p) OVER (PARTITION BY topic_id) AS pa, sum(p) OVER (PARTITION BY main_cell_type) AS pb FROM (SELECT topic_id, main_cell_type, count(*) / sum(count(*)) OVER () AS p FROM top JOIN anno USING (cell_id) GROUP BY 1, 2))", CROSS, "cell_topic", "anno"))
def nmi(s: SparkSession, d: str) -> DataFrame:
    return _r(M.nmi(_dominant(s, d).join(A.anno(s, d), "cell_id"), "topic_id", "main_cell_type"), 8, "nmi")


VECS = "vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), cent AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS pos FROM vecs) GROUP BY 1, 2)"


def _centroids(s: SparkSession, d: str) -> DataFrame:
    parts = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))


@add("embed_centroid", f"WITH {VECS} SELECT label, CAST(pos AS INTEGER) AS pos, round(x, 6) AS x FROM cent")
def embed_centroid(s: SparkSession, d: str) -> DataFrame:
    return _r(_centroids(s, d), 6, "x")


def _to_centroids(s: SparkSession, d: str, score) -> DataFrame:
    c = _centroids(s, d).groupBy(F.col("label").alias("topic_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("c"))
    rows = c.orderBy("topic_id").limit(2001).collect()  # one vector a topic
    if len(rows) > 2000:
        raise ValueError("more than 2000 topics")
    grid = F.array(*[F.struct(F.lit(r["topic_id"]).alias("topic_id"), F.array(*[F.lit(float(x)) for x in r["c"]]).alias("c")) for r in rows])
    return table(s, d, "embeddings").select("vec_id", "embedding", F.explode(grid).alias("t")).select("vec_id", F.col("t.topic_id").alias("topic_id"), score(F.col("embedding"), F.col("t.c")).alias("weight"))


@add("embed_cosine_topic", f"WITH {VECS}, cv AS (SELECT label AS topic_id, list(x ORDER BY pos) AS c FROM cent GROUP BY 1) SELECT vec_id, topic_id, round(coalesce(list_cosine_similarity(e, c), 0), 6) AS weight FROM vecs, cv")
def embed_cosine_topic(s: SparkSession, d: str) -> DataFrame:
    return _r(_to_centroids(s, d, lambda a, b: F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))), 6, "weight")


@add("embed_euclid_topic", f"WITH {VECS}, cv AS (SELECT label AS topic_id, list(x ORDER BY pos) AS c FROM cent GROUP BY 1), w AS (SELECT vec_id, topic_id, 1 / (list_distance(e, c) + 1e-10) AS w FROM vecs, cv) SELECT vec_id, topic_id, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS weight FROM w")
def embed_euclid_topic(s: SparkSession, d: str) -> DataFrame:
    dist = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda t, x: t + x))
    w = _to_centroids(s, d, lambda a, b: 1 / (dist(a, b) + 1e-10))
    return _r(share(w, ["vec_id"], "weight"), 6, "weight")


DAYS = "days AS (SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS batch, count(*) AS n FROM events GROUP BY 1, 2)"


def _days(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("event_type", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("batch")).agg(F.count("*").alias("n"))


@add("bow_decay", f"WITH {DAYS} SELECT event_type, round(sum(n * pow(0.9, (SELECT max(batch) FROM days) - batch)), 6) AS value FROM days GROUP BY 1")
def bow_decay(s: SparkSession, d: str) -> DataFrame:
    days = _days(s, d)
    return _r(C.decayed(days, "batch", "event_type", 0.1, days.agg(F.max("batch")).scalar()), 6, "value")


@add("bow_prune", f"""WITH RECURSIVE {DAYS}, every AS (SELECT event_type, batch, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type FROM days) CROSS JOIN (SELECT unnest(range((SELECT min(batch) FROM days), (SELECT max(batch) FROM days) + 1)) AS batch) LEFT JOIN days USING (event_type, batch)),
 r AS (SELECT event_type, batch, CASE WHEN n < 30 THEN 0 ELSE n END::DOUBLE AS v FROM every WHERE batch = (SELECT min(batch) FROM days)
 UNION ALL SELECT e.event_type, e.batch, CASE WHEN v * 0.9::DOUBLE + n < 30 THEN 0 ELSE v * 0.9::DOUBLE + n END FROM r JOIN every e ON e.event_type IS NOT DISTINCT FROM r.event_type AND e.batch = r.batch + 1)
 SELECT event_type, round(v, 6) AS value FROM r WHERE batch = (SELECT max(batch) FROM days) AND v > 0""")
def bow_prune(s: SparkSession, d: str) -> DataFrame:
    days = _days(s, d)
    return _r(C.decayed(days, "batch", "event_type", 0.1, days.agg(F.max("batch")).scalar(), min_total=30), 6, "value")


LDAC = "numbered AS (SELECT cell_id, dense_rank() OVER (ORDER BY gene) - 1 AS number, CAST(floor(value) AS BIGINT) AS n FROM counts WHERE value >= 1)"


def numbered_genes(s: SparkSession, d: str) -> DataFrame:
    c = A.counts(s, d).where("value >= 1")
    numbers = ranks(c.select("gene").distinct(), [], F.left("gene", F.lit(4)), [F.col("gene")], "number").withColumn("number", F.col("number") - 1)
    return c.join(numbers, "gene").select("cell_id", "number", F.floor("value").alias("n"))


@add("ldac_export", _more("SELECT cell_id, count(*) || ' ' || string_agg(number || ':' || n, ' ' ORDER BY number) AS line FROM numbered GROUP BY 1", LDAC, "counts"))
def ldac_export(s: SparkSession, d: str) -> DataFrame:
    return C.to_ldac(numbered_genes(s, d), "cell_id", "number")


@add("ldac_import", _more("SELECT cell_id, CAST(number AS BIGINT) AS number, n FROM numbered", LDAC, "counts"))
def ldac_import(s: SparkSession, d: str) -> DataFrame:
    return C.from_ldac(ldac_export(s, d), "cell_id")


@add("token_lists", with_sql("SELECT cell_id, CAST(sum(floor(value)) AS BIGINT) AS n_tokens, string_agg(repeat(gene || ' ', CAST(floor(value) AS BIGINT)), '' ORDER BY gene) AS tokens FROM counts WHERE value >= 1 GROUP BY 1", "counts"))
def token_lists(s: SparkSession, d: str) -> DataFrame:
    """Cells as documents in which each gene is repeated as often as it was counted."""
    b = lda.bags(A.counts(s, d))
    words = F.zip_with("genes", "values", lambda g, v: F.repeat(F.concat(g, F.lit(" ")), v.cast("int")))
    return b.select("cell_id", F.aggregate("values", F.lit(0).cast("bigint"), lambda t, x: t + x).alias("n_tokens"), F.concat_ws("", words).alias("tokens"))


SETS = "sets AS (SELECT DISTINCT CAST(length(symbol) * 7 + ascii(symbol) AS INTEGER) % 25 AS set_id, symbol AS gene FROM gene_anno WHERE symbol IS NOT NULL), hits AS (SELECT topic_id, gene FROM (SELECT topic_id, gene, row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 9) DESC, gene) AS r FROM gene_topic) WHERE r <= 60)"


def _enriched(s: SparkSession, d: str) -> DataFrame:
    sets = table(s, d, "gene_anno").where("symbol IS NOT NULL").select(((F.length("symbol") * 7 + F.ascii("symbol")) % 25).alias("set_id"), F.col("symbol").alias("gene")).distinct()
    hits = C.top_terms(_r(A.gene_topic(s, d), 9, "weight"), "topic_id", 60, "gene").select("topic_id", "gene")
    return M.over_representation(hits, sets, count_of(sets, "gene"), 5, 2000)


@add("go_ora_counts", _more("SELECT topic_id, set_id, count(*) AS k, any_value(n) AS n, any_value(m) AS m, round(count(*) / any_value(n) / (any_value(m) / (SELECT count(DISTINCT gene) FROM sets)), 6) AS fold FROM (SELECT *, count(*) OVER (PARTITION BY topic_id) AS n FROM hits) JOIN (SELECT *, count(*) OVER (PARTITION BY set_id) AS m FROM sets) USING (gene) WHERE m BETWEEN 5 AND 2000 GROUP BY 1, 2", SETS, "gene_topic"))
def go_ora_counts(s: SparkSession, d: str) -> DataFrame:
    return _enriched(s, d).select("topic_id", "set_id", "k", "n", "m", F.round("fold", 6).alias("fold"))


BH = SETS + """, u AS (SELECT count(DISTINCT gene) AS u FROM sets), c AS (SELECT topic_id, set_id, count(*) AS k, any_value(n) AS n, any_value(m) AS m, any_value(u) AS u FROM (SELECT *, count(*) OVER (PARTITION BY topic_id) AS n FROM hits) JOIN (SELECT *, count(*) OVER (PARTITION BY set_id) AS m FROM sets) USING (gene), u WHERE m BETWEEN 5 AND 2000 GROUP BY 1, 2),
 p AS (SELECT *, CASE WHEN k <= greatest(0, n + m - u) THEN 1 ELSE least(1, list_sum(list_transform(range(k, least(n, m) + 1), lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(u - m + 1) - lgamma(n - i + 1) - lgamma(u - m - n + i + 1) - lgamma(u + 1) + lgamma(n + 1) + lgamma(u - n + 1))))) END AS p FROM c),
 q AS (SELECT *, p * count(*) OVER (PARTITION BY topic_id) / count(*) OVER (PARTITION BY topic_id ORDER BY p) AS q FROM p),
 bh AS (SELECT *, least(1, min(q) OVER (PARTITION BY topic_id ORDER BY p DESC)) AS p_adjusted, (k / n) / (m / u) AS fold FROM q)"""


@add("go_ora_bh", _more("SELECT topic_id, set_id, round(p, 9) AS p, round(p_adjusted, 9) AS p_adjusted FROM bh", BH, "gene_topic"))
def go_ora_bh(s: SparkSession, d: str) -> DataFrame:
    return _enriched(s, d).select("topic_id", "set_id", F.round("p", 9).alias("p"), F.round("p_adjusted", 9).alias("p_adjusted"))


@add("go_top_terms", _more("SELECT topic_id, set_id, round(p_adjusted, 8) AS p_adjusted, round(fold, 6) AS fold FROM bh QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY round(p_adjusted, 8), round(fold, 6) DESC, set_id) <= 10", BH, "gene_topic"))
def go_top_terms(s: SparkSession, d: str) -> DataFrame:
    """The ten most enriched sets of each topic, by adjusted p value and fold."""
    scored = _r(_enriched(s, d), 8, "p_adjusted").withColumn("fold", F.round("fold", 6))
    return best(scored, ["topic_id"], [F.asc("p_adjusted"), F.desc("fold"), F.asc("set_id")], 10).select("topic_id", "set_id", "p_adjusted", "fold")


@add("term_titles", r"SELECT DISTINCT docket, upper(left(c, 1)) || substr(c, 2) AS title FROM (SELECT docket, trim(regexp_replace(replace(docket, '_', ' '), '\s+', ' ', 'g')) AS c FROM documents WHERE docket IS NOT NULL)")
def term_titles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("docket IS NOT NULL").select("docket", term_title(F.col("docket")).alias("title")).distinct()


@add("symbol_ids", r"""WITH m AS (SELECT DISTINCT symbol AS gene, genome || ':' || start AS id FROM gene_anno WHERE symbol IS NOT NULL AND genome IS NOT NULL AND start IS NOT NULL) SELECT DISTINCT u.gene, m.id FROM use_gene u JOIN m USING (gene)""")
def symbol_ids(s: SparkSession, d: str) -> DataFrame:
    """Ids of the whitelisted genes in another naming, one row for each of several."""
    ids = table(s, d, "gene_anno").where("symbol IS NOT NULL AND genome IS NOT NULL AND start IS NOT NULL").select(F.col("symbol").alias("gene"), F.concat_ws(":", "genome", F.col("start").cast("string")).alias("id"))
    return map_ids(table(s, d, "use_gene").select("gene").distinct(), ids, "gene", "id")[0]


@add("topics_per_class", _more("SELECT klass, gene, round(n / size * ln(a / f + 1), 9) AS weight FROM k JOIN (SELECT klass, sum(n) AS size FROM k GROUP BY 1) USING (klass) JOIN (SELECT gene, sum(n) AS f FROM k GROUP BY 1) USING (gene), (SELECT floor(avg(size)) AS a FROM (SELECT klass, sum(n) AS size FROM k GROUP BY 1))", CROSS + ", k AS (SELECT topic_id || ' ' || main_cell_type AS klass, gene, sum(value) AS n FROM top JOIN typed USING (cell_id) GROUP BY 1, 2)", "cell_topic", "typed"))
def topics_per_class(s: SparkSession, d: str) -> DataFrame:
    """Class-based term weights of the genes in the cells of each topic and cell type."""
    n = A.typed(s, d).join(_dominant(s, d), "cell_id").groupBy(F.concat_ws(" ", "topic_id", "main_cell_type").alias("klass"), F.col("gene").alias("term")).agg(F.sum("value").alias("n"))
    return _r(C.ctfidf(n, "klass"), 9, "weight").withColumnRenamed("term", "gene")


@add("lda_topics")
def lda_topics(s: SparkSession, d: str) -> DataFrame:
    return _r(lda.fit_lda(A.counts(s, d), 6, 30).gene_topic, 6, "weight")


@add("lda_cells")
def lda_cells(s: SparkSession, d: str) -> DataFrame:
    return _r(lda.fit_lda(A.counts(s, d), 6, 30).cell_topic, 6, "weight")


@add("lda_infer")
def lda_infer(s: SparkSession, d: str) -> DataFrame:
    """Topic weights of the bulk samples under a model of the cells."""
    b = A.bulk(s, d).withColumnRenamed("sample_id", "cell_id")
    return _r(lda.infer_lda(lda.fit_lda(A.counts(s, d), 6, 30), b), 6, "weight").withColumnRenamed("cell_id", "sample_id")


def _seeds(s: SparkSession, d: str) -> dict[str, int]:
    return {r["gene"]: r["topic_id"] for r in table(s, d, "use_gene").where("ord < 30").groupBy("gene").agg((F.min("ord") % 6).alias("topic_id")).collect()}  # thirty anchors


@add("guided_lda")
def guided_lda(s: SparkSession, d: str) -> DataFrame:
    return _r(guided.fit_guided(A.counts(s, d), 6, _seeds(s, d)).gene_topic, 6, "weight")


@add("guided_lda_infer")
def guided_lda_infer(s: SparkSession, d: str) -> DataFrame:
    b = A.bulk(s, d).withColumnRenamed("sample_id", "cell_id")
    return _r(guided.infer_guided(guided.fit_guided(A.counts(s, d), 6, _seeds(s, d)), b), 6, "weight").withColumnRenamed("cell_id", "sample_id")


@add("corex_topics")
def corex_topics(s: SparkSession, d: str) -> DataFrame:
    return _r(corex.fit_corex(A.counts(s, d), 6, _seeds(s, d)).gene_topic, 6, "weight").where("weight > 0")


@add("corex_hierarchy")
def corex_hierarchy(s: SparkSession, d: str) -> DataFrame:
    return _r(corex.hierarchy(corex.fit_corex(A.counts(s, d), 6), [3, 2])[1], 6, "weight")


@add("corex_infer")
def corex_infer(s: SparkSession, d: str) -> DataFrame:
    """Topics of the bulk samples by the fitted factors of the cells."""
    return _r(corex.infer_corex(corex.fit_corex(A.counts(s, d), 6, _seeds(s, d)), A.bulk(s, d), "sample_id"), 6, "weight")


@add("corex_selection")
def corex_selection(s: SparkSession, d: str) -> DataFrame:
    """Two numbers of topics with two seeds each, the most accurate chosen."""
    cells = cut(A.counts(s, d))
    return _r(choose.select_topics(lambda k, seed: corex.fit_corex(cells, k, _seeds(s, d), seed=seed), cells, A.anno(s, d), (5, 6), (1, 2)), 6, "metric")


@add("lda_selection")
def lda_selection(s: SparkSession, d: str) -> DataFrame:
    """Two numbers of topics, the one whose topics agree best with the cell types."""
    cells = cut(A.counts(s, d))
    return _r(choose.select_topics(lambda k, seed: lda.fit_lda(cells, k, 30, seed), cells, A.anno(s, d), (5, 6), (9,), "nmi"), 6, "metric")


@add("guided_tokens", with_sql("SELECT gene, CAST(sum(floor(value)) AS BIGINT) AS tokens FROM counts WHERE value >= 1 GROUP BY 1", "counts"))
def guided_tokens(s: SparkSession, d: str) -> DataFrame:
    """Tokens of each gene over all topics after all sweeps: as many as were counted."""
    fit = guided.fit_guided(A.counts(s, d), 6, _seeds(s, d))
    sums = lda.gene_weights(s, fit.about["genes"], fit.about["counts"]).groupBy("gene").agg(F.round(F.sum("weight")).cast("bigint").alias("tokens"))
    return sums.where("tokens > 0")


@add("guided_cells")
def guided_cells(s: SparkSession, d: str) -> DataFrame:
    """Weights of the cells in each topic, summing to 1 over the cells."""
    return _r(guided.cells_by_topic(guided.fit_guided(A.counts(s, d), 6, _seeds(s, d)).cell_topic), 9, "weight")


@add("topic_hierarchy_ward")
def topic_hierarchy_ward(s: SparkSession, d: str) -> DataFrame:
    return _r(tree.topic_tree(A.gene_topic(s, d)), 6, "distance")


@add("kmeans_gene_clusters")
def kmeans_gene_clusters(s: SparkSession, d: str) -> DataFrame:
    """K-means of the genes over their weights in the topics, scaled per gene."""
    return L.gene_clusters(A.gene_topic(s, d), 6, 6)


@add("lr_accuracy")
def lr_accuracy(s: SparkSession, d: str) -> DataFrame:
    """Accuracy and mean F1 of logistic regression of the cell type on the topics, on a held-out fifth."""
    return _r(M.confusion_scores(L.predicted_types(A.cell_topic(s, d), A.anno(s, d), 6), "prediction", "label"), 6, "accuracy", "macro_f1")


@add("kmeans_nmi")
def kmeans_nmi(s: SparkSession, d: str) -> DataFrame:
    """How K-means clusters of the cells' topic weights agree with the cell types."""
    kinds = A.anno(s, d)
    found = L.clusters(L.topic_arrays(A.cell_topic(s, d), "cell_id", 6), "x", 12)
    return _r(M.nmi(found.join(kinds, "cell_id"), "cluster", "main_cell_type"), 6, "nmi")


@add("embed_chain")
def embed_chain(s: SparkSession, d: str) -> DataFrame:
    """Embedded cells into clusters, and the class-based weights of the genes of each cluster's cells."""
    rows = table(s, d, "cell_embedding").where("cell_id IS NOT NULL AND size(embedding) = 64 AND array_contains(embedding, CAST('NaN' AS FLOAT)) = false")
    latest = rows.groupBy("cell_id").agg(F.max_by("embedding", F.struct("embedded_at", "vec_id")).alias("embedding"))
    n = L.clusters(latest, "embedding", 10).join(A.counts(s, d), "cell_id").groupBy("cluster", F.col("gene").alias("term")).agg(F.sum("value").alias("n"))
    return _r(C.ctfidf(n, "cluster"), 9, "weight").withColumnRenamed("term", "gene")


@add("embed_kmeans")
def embed_kmeans(s: SparkSession, d: str) -> DataFrame:
    """K-means of the embeddings in place of graph clustering, and how it agrees with the labels."""
    return _r(M.nmi(L.clusters(table(s, d, "embeddings"), "embedding", 10), "cluster", "label"), 6, "nmi")


@add("embed_pca")
def embed_pca(s: SparkSession, d: str) -> DataFrame:
    return L.main_axes(table(s, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.round(F.abs(F.col("pc")[0]), 4).alias("pc1"), F.round(F.abs(F.col("pc")[1]), 4).alias("pc2"))


@add("classes_per_topic", _more("SELECT topic_id, main_cell_type, n, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, main_cell_type) AS rank FROM (SELECT topic_id, main_cell_type, count(*) AS n FROM top JOIN anno USING (cell_id) GROUP BY 1, 2)", CROSS, "cell_topic", "anno"))
def classes_per_topic(s: SparkSession, d: str) -> DataFrame:
    n = _dominant(s, d).join(A.anno(s, d), "cell_id").groupBy("topic_id", "main_cell_type").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("n"), "main_cell_type")).cast("bigint"))


@add("bag_length_lgamma", with_sql("SELECT cell_id, round(lgamma(sum(value) + 0.1), 6) AS lg FROM counts GROUP BY 1", "counts"))
def bag_length_lgamma(s: SparkSession, d: str) -> DataFrame:
    """The gamma term of each cell's likelihood."""
    return A.counts(s, d).groupBy("cell_id").agg(F.sum("value").alias("t")).select("cell_id", F.round(M.lgamma(F.col("t") + 0.1), 6).alias("lg"))
