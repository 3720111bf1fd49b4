"""Queries of the two general problems: hot keys (p1) and intervals (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.columns import chrom_name, trimmed
from strandloom.operators.skew import compress, percentiles, totals
from strandloom.operators.sweep import periods_and_gaps
from strandloom.plans.cells import ANNO_SQL, OBS_SQL, both_types
from strandloom.plans.registry import Catalog, table

CATALOG = Catalog()
LABELS_SQL = f"WITH {OBS_SQL}, {ANNO_SQL}, both_types AS (SELECT 'rna_obs' AS labeling, * FROM obs_type WHERE main_cell_type IS NOT NULL UNION ALL SELECT 'main_celltype', * FROM anno_type WHERE main_cell_type IS NOT NULL)"


def _typed(spark: SparkSession, folder: str, value: str) -> DataFrame:
    """Weighted values of rna_counts by labeling and type: compressed by cell and value before the join, by type and value after it."""
    by_cell = compress(table(spark, folder, "rna_counts").where("cell_id IS NOT NULL"), ["cell_id"], value)
    return compress(by_cell.join(both_types(spark, folder), "cell_id"), ["labeling", "main_cell_type"], "value", "weight")


@CATALOG.add(
    "p1_found",
    LABELS_SQL + """ SELECT labeling, main_cell_type FROM rna_counts JOIN both_types USING (cell_id) GROUP BY 1, 2
 HAVING count(*) >= 0.1 * (SELECT count(*) FROM rna_counts)""",
)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "rna_counts")
    by_cell = compress(counts.where("cell_id IS NOT NULL"), ["cell_id"], "cell_id").withColumnRenamed("value", "cell")
    rows = totals(compress(by_cell.join(both_types(spark, folder), "cell_id"), ["labeling", "main_cell_type"], "cell", "weight"), ["labeling", "main_cell_type"])
    return rows.where(F.col("n_rows") >= F.lit(0.1 * counts.count())).select("labeling", "main_cell_type")


@CATALOG.add(
    "p1_type_genes",
    LABELS_SQL + """, g AS (SELECT labeling, main_cell_type, gene, count(*) AS n FROM rna_counts JOIN both_types USING (cell_id) GROUP BY ALL)
 SELECT labeling, main_cell_type, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (gene IS NOT NULL), 0) AS BIGINT) AS n_values, count(gene) AS n_distinct,
 first(gene ORDER BY n DESC, gene) FILTER (gene IS NOT NULL) AS mode FROM g GROUP BY 1, 2""",
)
def p1_type_genes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct genes and most frequent gene of each cell type."""
    return totals(_typed(spark, folder, "gene"), ["labeling", "main_cell_type"])


@CATALOG.add(
    "p1_type_values",
    LABELS_SQL + """, v AS (SELECT labeling, main_cell_type, value FROM rna_counts JOIN both_types USING (cell_id)),
 w AS (SELECT labeling, main_cell_type, value, count(*) AS n FROM v GROUP BY ALL)
 SELECT labeling, main_cell_type, CAST(sum(n) AS BIGINT) AS n_rows, count(value) AS n_distinct, first(value ORDER BY n DESC, value) FILTER (value IS NOT NULL) AS mode,
 round(any_value(p25), 6) AS p25, round(any_value(p50), 6) AS p50, round(any_value(p75), 6) AS p75, round(any_value(p99), 6) AS p99
 FROM w LEFT JOIN (SELECT labeling, main_cell_type, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.99) AS p99
 FROM v WHERE value IS NOT NULL GROUP BY 1, 2) USING (labeling, main_cell_type) GROUP BY 1, 2""",
)
def p1_type_values(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct values, most frequent value and exact percentiles of the counts of each cell type."""
    keys, points = ["labeling", "main_cell_type"], [0.25, 0.5, 0.75, 0.99]
    packed = _typed(spark, folder, "value")
    cut = percentiles(packed, keys, points)
    at = [F.round(F.element_at("percentiles", i + 1), 6).alias(f"p{round(100 * p)}") for i, p in enumerate(points)]
    return totals(packed, keys).join(cut, keys, "left").select(*keys, "n_rows", "n_distinct", "mode", *at)


GENES_SQL = r"""genes AS (SELECT DISTINCT genome, regexp_replace(lower(regexp_replace(chr, '^\s+|\s+$', '', 'g')), '^chr', '') AS chrom, regexp_replace(strand, '^\s+|\s+$', '', 'g') AS strand, start AS s, "end" AS e
 FROM gene_anno WHERE start < "end" AND regexp_replace(strand, '^\s+|\s+$', '', 'g') IN ('+', '-'))"""

PERIODS_SQL = f"""WITH {GENES_SQL},
 o AS (SELECT *, max(e) OVER (PARTITION BY genome, chrom, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM genes),
 i AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY genome, chrom, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o),
 p AS (SELECT genome, chrom, strand, min(s) AS start_pos, max(e) AS end_pos FROM i GROUP BY genome, chrom, strand, island),
 n AS (SELECT *, lead(start_pos) OVER (PARTITION BY genome, chrom, strand ORDER BY start_pos) AS later FROM p)
 SELECT 'period' AS kind, genome, chrom, strand, start_pos, end_pos FROM p UNION ALL SELECT 'gap', genome, chrom, strand, end_pos, later FROM n WHERE later IS NOT NULL"""


def stranded_genes(spark: SparkSession, folder: str) -> DataFrame:
    """Usable rows of gene_anno: ``genome, chrom, strand, start, end`` and the symbol."""
    rows = table(spark, folder, "gene_anno").select("genome", chrom_name("chr").alias("chrom"), trimmed("strand").alias("strand"), "start", "end", "symbol")
    return rows.where("start < end AND strand IN ('+', '-')")


@CATALOG.add("p4_found", PERIODS_SQL)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return periods_and_gaps(stranded_genes(spark, folder), ["genome", "chrom", "strand"], "start", "end")


@CATALOG.add(
    "p4_coverage",
    f"""SELECT genome, chrom, strand, CAST(count(*) FILTER (kind = 'period') AS BIGINT) AS periods, CAST(coalesce(sum(end_pos - start_pos) FILTER (kind = 'period'), 0) AS BIGINT) AS covered,
 CAST(count(*) FILTER (kind = 'gap') AS BIGINT) AS gaps, CAST(coalesce(sum(end_pos - start_pos) FILTER (kind = 'gap'), 0) AS BIGINT) AS uncovered FROM ({PERIODS_SQL}) GROUP BY 1, 2, 3""",
)
def p4_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Covered and uncovered length of each genome, chromosome and strand."""
    width, period = F.col("end_pos") - F.col("start_pos"), F.col("kind") == "period"
    return p4_found(spark, folder).groupBy("genome", "chrom", "strand").agg(
        F.count(F.when(period, 1)).alias("periods"), F.coalesce(F.sum(F.when(period, width)), F.lit(0)).alias("covered"), F.count(F.when(~period, 1)).alias("gaps"), F.coalesce(F.sum(F.when(~period, width)), F.lit(0)).alias("uncovered")
    )
