"""The given tables as the tables of the domain: in Spark, and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.columns import chrom_name, sample_of, trimmed
from strandloom.operators.intervals import at_positions, overlap_join
from strandloom.operators.preprocess import drop_zeros, latest, uniquify
from strandloom.plans.cells import ANNO_SQL, anno_types
from strandloom.plans.registry import table

#: Name -> (needed names, SQL). ``with_sql`` puts together what a query needs.
VIEWS: dict[str, tuple[list[str], str]] = {
    "delivered": ([], "SELECT cell_id, gene, value FROM rna_counts WHERE cell_id IS NOT NULL AND gene IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cell_id, gene ORDER BY loaded_at DESC NULLS LAST, value DESC NULLS LAST) = 1"),
    "counts": (["delivered"], "SELECT * FROM delivered WHERE value > 0"),
    "anno": ([], f"WITH {ANNO_SQL} SELECT * FROM anno_type WHERE main_cell_type IS NOT NULL"),
    "typed": (["counts", "anno"], "SELECT c.*, main_cell_type FROM counts c JOIN anno USING (cell_id)"),
    "bulk": (["counts"], "SELECT split_part(cell_id, '_', 1) AS sample_id, gene, sum(value) AS value FROM counts GROUP BY 1, 2"),
    "genes": ([], r"""SELECT DISTINCT genome || ':' || regexp_replace(lower(regexp_replace(chr, '^\s+|\s+$', '', 'g')), '^chr', '') AS chr, start, "end", regexp_replace(strand, '^\s+|\s+$', '', 'g') AS strand, symbol
 FROM gene_anno WHERE start < "end" AND regexp_replace(strand, '^\s+|\s+$', '', 'g') IN ('+', '-') AND symbol IS NOT NULL AND genome IS NOT NULL AND chr IS NOT NULL"""),
    "named_genes": (["genes"], """SELECT chr, start, "end", strand, symbol, CASE WHEN r > 1 THEN symbol || '-' || r ELSE symbol END AS gene FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY chr, start, "end", strand) AS r FROM genes)"""),
    "peaks": (["genes"], """SELECT DISTINCT chr, p AS start, p + 400 AS "end", chr || '_' || p || '_' || (p + 400) AS peak_id FROM (SELECT chr, greatest(start - 3000, 1) + ("end" * 7919) % 9000 AS p FROM genes)"""),
    "sites": (["genes"], "SELECT symbol AS gene, chr, start FROM genes QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY chr, start) = 1"),
    "fragments": (["counts", "sites"], """SELECT chr, start + CAST(value AS BIGINT) * 137 % 5000 AS start, start + CAST(value AS BIGINT) * 137 % 5000 + 180 AS "end", cell_id AS name, value AS score FROM counts JOIN sites USING (gene)"""),
    "peak_counts": (["peaks", "fragments"], """SELECT split_part(name, '_', 1) AS sample_id, peak_id, sum(score) AS value FROM peaks p JOIN fragments f ON p.chr = f.chr AND p.start < f."end" AND f.start < p."end" GROUP BY 1, 2"""),
    "gene_topic_seed": ([], "SELECT gene, CAST(min(ord) % 6 AS INTEGER) AS topic_id FROM use_gene GROUP BY gene"),
    "cell_topic": (["counts", "gene_topic_seed"], "SELECT cell_id, topic_id, sum(value) / sum(sum(value)) OVER (PARTITION BY cell_id) AS weight FROM counts JOIN gene_topic_seed USING (gene) GROUP BY 1, 2"),
    "gene_topic": (["counts", "gene_topic_seed"], "SELECT topic_id, gene, sum(value) / sum(sum(value)) OVER (PARTITION BY topic_id) AS weight FROM counts JOIN gene_topic_seed USING (gene) GROUP BY 1, 2"),
    "topic_sample": (["bulk", "gene_topic_seed"], "SELECT sample_id, topic_id, sum(value) / sum(sum(value)) OVER (PARTITION BY sample_id) AS weight FROM bulk JOIN gene_topic_seed USING (gene) GROUP BY 1, 2"),
    "shares": (["anno"], "SELECT main_cell_type, count(*) AS n_cells, count(*) / sum(count(*)) OVER () AS proportion FROM anno GROUP BY 1"),
    "topic_type": (["cell_topic", "anno", "shares"], "SELECT topic_id, main_cell_type, sum(weight) / any_value(n_cells) AS weight FROM cell_topic JOIN anno USING (cell_id) JOIN shares USING (main_cell_type) GROUP BY 1, 2"),
    "bayes": (["topic_type", "shares"], "SELECT topic_id, main_cell_type, weight * proportion / (sum(weight) OVER (PARTITION BY topic_id) / sum(weight) OVER ()) AS p FROM topic_type JOIN shares USING (main_cell_type)"),
    "links": (["genes", "peaks"], """SELECT gene, peak_id, max(exp(-dist / 5000.0::DOUBLE)) AS weight FROM (SELECT g.symbol AS gene, p.peak_id, CAST(CASE WHEN p.start < body_end AND body_start < p."end" THEN 0
 WHEN strand = '+' THEN least(abs(p.start - g."end"), abs(p."end" - greatest(0, g.start - 5000))) ELSE least(abs(p.start - (g."end" + 5000)), abs(p."end" - g.start)) END AS DOUBLE) AS dist
 FROM (SELECT *, CASE WHEN strand = '+' THEN greatest(start - 100000, 0) ELSE greatest(least(start, "end" - 100000), 0) END AS tss_start, CASE WHEN strand = '+' THEN greatest("end", greatest(start - 100000, 0) + 100000) ELSE "end" + 100000 END AS tss_end,
 CASE WHEN strand = '+' THEN greatest(start - 5000, 0) ELSE start END AS body_start, CASE WHEN strand = '+' THEN "end" ELSE "end" + 5000 END AS body_end FROM genes) g JOIN peaks p ON p.chr = g.chr AND p.start < tss_end AND tss_start < p."end") GROUP BY 1, 2"""),
    "peak_means": (["peaks", "fragments", "shares"], "SELECT main_cell_type, peak_id, sum(score) / any_value(n_cells) AS weight FROM peaks p JOIN fragments f ON p.chr = f.chr AND p.start < f.\"end\" AND f.start < p.\"end\" JOIN anno ON cell_id = name JOIN shares USING (main_cell_type) GROUP BY 1, 2"),
    "profile": (["typed"], "SELECT main_cell_type, gene, sum(value) / (sum(sum(value)) OVER (PARTITION BY main_cell_type) / 1e4) AS value FROM typed GROUP BY 1, 2"),
    "terms": ([], r"SELECT lang, term, count(*) AS n FROM (SELECT coalesce(lang, 'none') AS lang, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM documents) WHERE term <> '' GROUP BY 1, 2"),
}


def with_sql(select: str, *views: str) -> str:
    """``select`` behind the definitions of ``views`` and of all that they need."""
    order: list[str] = []

    def need(v: str) -> None:
        for x in VIEWS[v][0]:
            need(x)
        if v not in order:
            order.append(v)

    for v in views:
        need(v)
    return "WITH " + ", ".join(f"{v} AS MATERIALIZED ({VIEWS[v][1]})" for v in order) + " " + select


def delivered(spark: SparkSession, folder: str) -> DataFrame:
    """The value last delivered of each cell and gene."""
    return latest(table(spark, folder, "rna_counts"), ["cell_id", "gene"], "value", "loaded_at")


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """``cell_id, gene, value`` without zeros, nulls and negative values."""
    return drop_zeros(delivered(spark, folder))


def anno(spark: SparkSession, folder: str) -> DataFrame:
    return anno_types(spark, folder).where("main_cell_type IS NOT NULL")


def typed(spark: SparkSession, folder: str) -> DataFrame:
    return counts(spark, folder).join(anno(spark, folder), "cell_id")


def bulk(spark: SparkSession, folder: str, cells: DataFrame | None = None) -> DataFrame:
    """Counts summed over the cells of each sample. ``cells`` here and below: ``counts``, if the caller has written them down."""
    cells = counts(spark, folder) if cells is None else cells
    return cells.groupBy(sample_of("cell_id").alias("sample_id"), "gene").agg(F.sum("value").alias("value"))


def genes(spark: SparkSession, folder: str) -> DataFrame:
    """``chr, start, end, strand, symbol``; chr is ``genome:chromosome``."""
    rows = table(spark, folder, "gene_anno").where("genome IS NOT NULL AND symbol IS NOT NULL AND chr IS NOT NULL")
    return rows.select(F.concat_ws(":", "genome", chrom_name("chr")).alias("chr"), "start", "end", trimmed("strand").alias("strand"), "symbol").where("start < end AND strand IN ('+', '-')").distinct()


def named_genes(spark: SparkSession, folder: str) -> DataFrame:
    return uniquify(genes(spark, folder), "symbol", [F.col("chr"), F.col("start"), F.col("end"), F.col("strand")], "gene", F.struct("chr", F.floor(F.col("start") / 5_000_000)))


def peaks(spark: SparkSession, folder: str, sites: DataFrame | None = None) -> DataFrame:
    """Peaks of 400 bases near the starts of the genes. ``sites`` here and below: ``genes``, if the caller has written them down."""
    p = F.greatest(F.col("start") - 3000, F.lit(1)) + (F.col("end") * 7919) % 9000
    sites = genes(spark, folder) if sites is None else sites
    return sites.select("chr", p.alias("start"), (p + 400).alias("end")).distinct().withColumn("peak_id", F.concat_ws("_", "chr", "start", "end"))


def fragments(spark: SparkSession, folder: str, cells: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    """A fragment of 180 bases for each count, near the first site of its gene."""
    sites, cells = genes(spark, folder) if sites is None else sites, counts(spark, folder) if cells is None else cells
    first = sites.groupBy(F.col("symbol").alias("gene")).agg(F.min(F.struct("chr", "start")).alias("x")).select("gene", "x.chr", F.col("x.start").alias("site"))
    at = F.col("site") + F.col("value").cast("bigint") * 137 % 5000
    return cells.join(first, "gene").select("chr", at.alias("start"), (at + 180).alias("end"), F.col("cell_id").alias("name"), F.col("value").alias("score"))


def peak_counts(spark: SparkSession, folder: str, cells: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    f = at_positions(fragments(spark, folder, cells, sites).withColumn("sample_id", sample_of("name")), ["sample_id"], "score")
    return overlap_join(peaks(spark, folder, sites), f, ["chr"], 20_000, salts=4).groupBy("sample_id", "peak_id").agg(F.sum("score").alias("value"))


def peak_means(spark: SparkSession, folder: str, cells: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    """``main_cell_type, peak_id, weight``: mean signal of a peak over the cells of a type."""
    kinds = anno(spark, folder)
    f = at_positions(fragments(spark, folder, cells, sites).join(kinds.withColumnRenamed("cell_id", "name"), "name"), ["main_cell_type"], "score")
    hits = overlap_join(peaks(spark, folder, sites), f, ["chr"], 20_000, salts=4).groupBy("peak_id", "main_cell_type").agg(F.sum("score").alias("__s"))
    sizes = kinds.groupBy("main_cell_type").agg(F.count("*").alias("__n"))
    return hits.join(sizes, "main_cell_type").select("main_cell_type", "peak_id", (F.col("__s") / F.col("__n")).alias("weight"))


def gene_topic_seed(spark: SparkSession, folder: str) -> DataFrame:
    """Six topics over the whitelisted genes."""
    return table(spark, folder, "use_gene").groupBy("gene").agg((F.min("ord") % 6).cast("int").alias("topic_id"))


def _topic_sums(df: DataFrame, seed: DataFrame, keys: list[str], within: str) -> DataFrame:
    sums = df.join(seed, "gene").groupBy(*keys).agg(F.sum("value").alias("__s"))
    return sums.select(*keys, (F.col("__s") / F.sum("__s").over(Window.partitionBy(within))).alias("weight"))


def cell_topic(spark: SparkSession, folder: str, cells: DataFrame | None = None) -> DataFrame:
    return _topic_sums(counts(spark, folder) if cells is None else cells, gene_topic_seed(spark, folder), ["cell_id", "topic_id"], "cell_id")


def gene_topic(spark: SparkSession, folder: str, cells: DataFrame | None = None) -> DataFrame:
    return _topic_sums(counts(spark, folder) if cells is None else cells, gene_topic_seed(spark, folder), ["topic_id", "gene"], "topic_id")


def topic_sample(spark: SparkSession, folder: str, cells: DataFrame | None = None) -> DataFrame:
    return _topic_sums(bulk(spark, folder, cells), gene_topic_seed(spark, folder), ["sample_id", "topic_id"], "sample_id")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), "text")
