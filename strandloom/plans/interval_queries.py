"""Queries of genomic intervals and enhancers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.columns import count_of
from strandloom.operators import intervals as I
from strandloom.plans import adapters as A
from strandloom.plans.adapters import with_sql
from strandloom.plans.registry import Catalog, table
from strandloom.session import cut

CATALOG = Catalog()
add = CATALOG.add

TSS = """CASE WHEN strand = '+' THEN greatest(start - 100000, 0) ELSE greatest(least(start, "end" - 100000), 0) END AS tss_start, CASE WHEN strand = '+' THEN greatest("end", greatest(start - 100000, 0) + 100000) ELSE "end" + 100000 END AS tss_end"""
BODY = """CASE WHEN strand = '+' THEN greatest(start - 5000, 0) ELSE start END AS body_start, CASE WHEN strand = '+' THEN "end" ELSE "end" + 5000 END AS body_end"""


def _more(sql: str, ctes: str, *views: str) -> str:
    return f"{with_sql('', *views).rstrip()}, {ctes} {sql}"


@add("tss_extend", with_sql(f"SELECT chr, gene, {TSS} FROM named_genes", "named_genes"))
def tss_extend(s: SparkSession, d: str) -> DataFrame:
    return I.extend_tss(A.named_genes(s, d)).select("chr", "gene", "tss_start", "tss_end")


@add("genebody_extend", with_sql(f"SELECT chr, gene, {BODY} FROM named_genes", "named_genes"))
def genebody_extend(s: SparkSession, d: str) -> DataFrame:
    return I.extend_body(A.named_genes(s, d)).select("chr", "gene", "body_start", "body_end")


@add("interval_overlap", with_sql("""SELECT peak_id, name, count(*) AS n, sum(score) AS score FROM peaks p JOIN fragments f ON p.chr = f.chr AND p.start < f."end" AND f.start < p."end" GROUP BY 1, 2""", "peaks", "fragments"))
def interval_overlap(s: SparkSession, d: str) -> DataFrame:
    f = A.fragments(s, d).withColumnsRenamed({"start": "start_b", "end": "end_b"})
    return I.overlap_join(A.peaks(s, d), f, ["chr"], 20_000, salts=4).groupBy("peak_id", "name").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


LINKS = f"""ext AS (SELECT *, {TSS}, {BODY} FROM named_genes), links AS (SELECT g.gene, p.peak_id, CAST(CASE WHEN p.start < body_end AND body_start < p."end" THEN 0
 WHEN strand = '+' THEN least(abs(p.start - g."end"), abs(p."end" - greatest(0, g.start - 5000))) ELSE least(abs(p.start - (g."end" + 5000)), abs(p."end" - g.start)) END AS DOUBLE) AS dist
 FROM ext g JOIN peaks p ON p.chr = g.chr AND p.start < tss_end AND tss_start < p."end")"""


@add("gene_peak_distance", _more("SELECT gene, count(*) AS peaks, sum(dist) AS dist, min(dist) AS nearest FROM links GROUP BY 1", LINKS, "named_genes", "peaks"))
def gene_peak_distance(s: SparkSession, d: str) -> DataFrame:
    return I.gene_peaks(A.named_genes(s, d), A.peaks(s, d)).groupBy("gene").agg(F.count("*").alias("peaks"), F.sum("dist").alias("dist"), F.min("dist").alias("nearest"))


@add("gene_peak_weight", _more("SELECT gene, peak_id, round(CASE WHEN exp(-dist / 5000) < 0.1 THEN 0 ELSE exp(-dist / 5000) END, 9) AS weight FROM links", LINKS, "named_genes", "peaks"))
def gene_peak_weight(s: SparkSession, d: str) -> DataFrame:
    return I.gene_peaks(A.named_genes(s, d), A.peaks(s, d), cutoff=0.1).select("gene", "peak_id", F.round("weight", 9).alias("weight"))


WEIGHT = """lens AS (SELECT gene, 1.0::DOUBLE / ("end" - start) AS w FROM named_genes), gw AS (SELECT gene, 1 + 4 * (w - (SELECT min(w) FROM lens)) / ((SELECT max(w) FROM lens) - (SELECT min(w) FROM lens)) AS gene_weight FROM lens)"""


@add("gene_weight_minmax", _more("SELECT gene, round(gene_weight, 9) AS gene_weight FROM gw", WEIGHT, "named_genes"))
def gene_weight_minmax(s: SparkSession, d: str) -> DataFrame:
    return I.length_weight(A.named_genes(s, d)).select("gene", F.round("gene_weight", 9).alias("gene_weight"))


@add("gene_activity_score", _more("SELECT sample_id, gene, round(sum(value * exp(-dist / 5000)) * any_value(gene_weight), 4) AS score FROM links JOIN peak_counts USING (peak_id) JOIN gw USING (gene) WHERE exp(-dist / 5000) > 0 GROUP BY 1, 2", f"{LINKS}, {WEIGHT}", "named_genes", "peaks", "peak_counts"))
def gene_activity_score(s: SparkSession, d: str) -> DataFrame:
    return I.gene_activity(A.named_genes(s, d), A.peaks(s, d), A.peak_counts(s, d)).withColumn("score", F.round("score", 4))


@add("gene_activity_body", _more("SELECT sample_id, gene, CAST(floor(sum(value) * any_value(gene_weight)) AS BIGINT) AS score FROM links JOIN peak_counts USING (peak_id) JOIN gw USING (gene) WHERE dist = 0 GROUP BY 1, 2", f"{LINKS}, {WEIGHT}", "named_genes", "peaks", "peak_counts"))
def gene_activity_body(s: SparkSession, d: str) -> DataFrame:
    return I.gene_activity(A.named_genes(s, d), A.peaks(s, d), A.peak_counts(s, d), cutoff=1.0, whole=True)


MERGE = """o AS (SELECT *, max("end") OVER (PARTITION BY chr ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
 i AS (SELECT *, sum(CASE WHEN start {test} THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM o)"""


@add("feature_counts", _more("""SELECT chr, min(start) AS start, max("end") AS "end", sum(score) AS count FROM i GROUP BY chr, island""", """hits AS (SELECT p.chr, p.start, p."end", sum(score) AS score FROM peaks p JOIN fragments f ON p.chr = f.chr AND p.start < f."end" AND f.start < p."end" GROUP BY 1, 2, 3), """ + MERGE.format(src="hits", test="<= reach"), "peaks", "fragments"))
def feature_counts(s: SparkSession, d: str) -> DataFrame:
    return I.feature_counts(A.peaks(s, d), A.fragments(s, d))


@add("fragments_selected", with_sql("SELECT chr, count(*) AS n, sum(score) AS score FROM fragments WHERE split_part(chr, ':', 2) IN ('1', '2', 'x') AND name IN (SELECT cell_id FROM anno WHERE main_cell_type = 'naive t4') GROUP BY 1", "fragments", "anno"))
def fragments_selected(s: SparkSession, d: str) -> DataFrame:
    """Fragments of chosen chromosomes and barcodes."""
    cells = A.anno(s, d).where("main_cell_type = 'naive t4'").select(F.col("cell_id").alias("name"))
    return A.fragments(s, d).where(F.split_part("chr", F.lit(":"), F.lit(2)).isin("1", "2", "x")).join(cells, "name", "left_semi").groupBy("chr").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@add("interval_merge_gap", _more("""SELECT chr, min(start) AS start, max("end") AS "end" FROM i GROUP BY chr, island""", MERGE.format(src="peaks", test="- reach - 1 < 2000 - 1"), "peaks"))
def interval_merge_gap(s: SparkSession, d: str) -> DataFrame:
    """Peaks with gaps of up to 2000 merged."""
    return I.stitch(A.peaks(s, d), 2000 - 1)


REGIONS = MERGE.format(src="peaks", test="- reach - 1 < 12500") + """, regions AS (SELECT chr, min(start) AS start, max("end") AS "end", chr || '_' || min(start) || '_' || max("end") AS region_id FROM i GROUP BY chr, island),
 tops AS (SELECT region_id, sample_id, max(value) AS v FROM regions r JOIN peaks p ON p.chr = r.chr AND p.start <= r."end" AND r.start <= p."end" JOIN peak_counts USING (peak_id) GROUP BY 1, 2),
 signal AS (SELECT region_id, coalesce(sum(v), 0) / (SELECT count(DISTINCT sample_id) FROM peak_counts) AS signal FROM regions LEFT JOIN tops USING (region_id) GROUP BY 1)"""


def enhancer_signal(s: SparkSession, d: str) -> DataFrame:
    sites = cut(A.genes(s, d))
    peaks, counts = A.peaks(s, d, sites), cut(A.peak_counts(s, d, sites=sites))  # read several times
    regions = I.stitch(peaks, 12_500 + 1).withColumn("region_id", F.concat_ws("_", "chr", "start", "end"))
    return I.region_max(regions, peaks.join(counts, "peak_id"), count_of(counts, "sample_id"))


@add("stitch_region_max", _more("SELECT region_id, round(signal, 6) AS signal FROM signal", REGIONS, "peaks", "peak_counts"))
def stitch_region_max(s: SparkSession, d: str) -> DataFrame:
    return enhancer_signal(s, d).withColumn("signal", F.round("signal", 6))


SUPER = REGIONS + """, srt AS (SELECT *, row_number() OVER (ORDER BY signal, region_id) AS i, (max(signal) OVER () - min(signal) OVER ()) / count(*) OVER () AS slope, count(*) OVER () AS n FROM (SELECT region_id, round(signal, 6) AS signal FROM signal)),
 cut AS (SELECT signal AS cutoff FROM srt ORDER BY round(signal - slope * i, 9), i LIMIT 1)"""


@add("super_enhancer_cutoff", _more("SELECT cutoff, (SELECT count(*) FROM srt WHERE signal > cutoff) AS n_super FROM cut", SUPER, "peaks", "peak_counts"))
def super_enhancer_cutoff(s: SparkSession, d: str) -> DataFrame:
    return I.enhancers(enhancer_signal(s, d).withColumn("signal", F.round("signal", 6))).groupBy("cutoff").agg(F.count(F.when(F.col("is_super"), 1)).alias("n_super"))


@add("super_enhancer_rank", _more("SELECT region_id, signal, n - i + 1 AS rank, signal > cutoff AS is_super FROM srt, cut", SUPER, "peaks", "peak_counts"))
def super_enhancer_rank(s: SparkSession, d: str) -> DataFrame:
    return I.enhancers(enhancer_signal(s, d).withColumn("signal", F.round("signal", 6))).select("region_id", "signal", F.col("rank").cast("bigint").alias("rank"), "is_super")


@add("peak_id_parse", r"""SELECT id, chrom, s AS start, e AS "end", coalesce(n = 3 AND s > 0 AND s <= e, false) AS valid FROM (SELECT *, len(string_split(id, '_')) AS n, string_split(id, '_')[1] AS chrom, TRY_CAST(string_split(id, '_')[2] AS BIGINT) AS s, TRY_CAST(string_split(id, '_')[3] AS BIGINT) AS e
 FROM (SELECT DISTINCT coalesce(chr, 'none') || '_' || coalesce(start::VARCHAR, 'x') || '_' || coalesce("end"::VARCHAR, 'x') AS id FROM gene_anno))""")
def peak_id_parse(s: SparkSession, d: str) -> DataFrame:
    text = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    ids = table(s, d, "gene_anno").select(F.concat_ws("_", text("chr", "none"), text("start", "x"), text("end", "x")).alias("id")).distinct()
    chrom, start, end, valid = I.peak_parts(F.col("id"))
    return ids.select("id", chrom.alias("chrom"), start.alias("start"), end.alias("end"), valid.alias("valid"))


@add("peak_names_cleaned", r"""SELECT DISTINCT replace(replace(genome || ':' || chr || '-' || strand, ':', '_'), '-', '_') AS name FROM gene_anno""")
def peak_names_cleaned(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "gene_anno").select(F.translate(F.concat(F.col("genome"), F.lit(":"), F.col("chr"), F.lit("-"), F.col("strand")), ":-", "__").alias("name")).distinct()
