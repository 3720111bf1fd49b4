"""Queries through files and streams, over whole tables: what a writer wrote, its reader reads back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import ctfidf as C
from strandloom.operators import deconvolve as D
from strandloom.operators import intervals as I
from strandloom.operators.pipelines import ratio
from strandloom.plans import adapters as A
from strandloom.plans.adapters import with_sql
from strandloom.plans.interval_queries import SUPER, enhancer_signal
from strandloom.plans.registry import Catalog, table
from strandloom.plans.topic_queries import DAYS, LDAC, numbered_genes
from strandloom.session import cut, shared_folder
from strandloom.sources import readers as R
from strandloom.sources import sinks as W
from strandloom.streaming import bow

CATALOG = Catalog()
add = CATALOG.add


def _more(sql: str, ctes: str, *views: str) -> str:
    return f"{with_sql('', *views).rstrip()}, {ctes} {sql}"


@add("dense_counts_read", with_sql("SELECT sample_id AS cell_id, gene, value FROM bulk", "bulk"))
def dense_counts_read(s: SparkSession, d: str) -> DataFrame:
    """The bulk table as dense text, a column for each sample, and back."""
    at = shared_folder(s, ".tsv")
    W.write_dense(cut(A.bulk(s, d)), at, "gene", "sample_id", "value")
    return R.read_counts(s, at)


@add("annotation_read", with_sql("SELECT cell_id, main_cell_type FROM anno", "anno"))
def annotation_read(s: SparkSession, d: str) -> DataFrame:
    at = shared_folder(s)
    W.write_tsv(A.anno(s, d).select("cell_id", "main_cell_type"), at, header=False)
    return R.read_annotation(s, at)


@add("gene_annotation_read", with_sql('SELECT chr, start, "end", symbol, strand FROM genes', "genes"))
def gene_annotation_read(s: SparkSession, d: str) -> DataFrame:
    at = shared_folder(s)
    W.write_tsv(A.genes(s, d).select("chr", "start", "end", "symbol", "strand"), at, header=False)
    return R.read_gene_annotation(s, at)


@add("gene_list_read", with_sql("SELECT DISTINCT gene FROM counts WHERE trim(gene) <> ''", "counts"))
def gene_list_read(s: SparkSession, d: str) -> DataFrame:
    at = shared_folder(s)
    W.write_tsv(A.counts(s, d).select(F.col("gene").alias("gene_name")).distinct(), at)
    return R.read_gene_list(s, at).select("gene")


@add("peaks_read", with_sql('SELECT peak_id, chr, start, "end", CAST(sum(value) AS DOUBLE) AS score FROM peaks JOIN peak_counts USING (peak_id) GROUP BY ALL', "peaks", "peak_counts"))
def peaks_read(s: SparkSession, d: str) -> DataFrame:
    """Peaks with the counts of all samples, as BED of four columns and back."""
    at = shared_folder(s)
    sums = A.peak_counts(s, d).groupBy("peak_id").agg(F.sum("value").alias("score"))
    W.write_tsv(A.peaks(s, d).join(sums, "peak_id").select("chr", "start", "end", "score"), at, header=False)
    return R.read_peaks(s, at)


@add("fragments_read", with_sql('SELECT chr, count(*) AS n, count(DISTINCT name) AS cells, sum("end" - start)::BIGINT AS width, sum(score) AS score FROM fragments GROUP BY 1', "fragments"))
def fragments_read(s: SparkSession, d: str) -> DataFrame:
    """Fragments as gzipped BED of five columns and back, summed by chromosome."""
    at = shared_folder(s)
    W.write_tsv(A.fragments(s, d).select("chr", "start", "end", "name", "score"), at, header=False, compression="gzip")
    back = R.read_fragments(s, at)
    return back.groupBy("chr").agg(F.count("*").alias("n"), F.count_distinct("name").alias("cells"), F.sum(F.col("end") - F.col("start")).alias("width"), F.sum("score").alias("score"))


@add("gene_topic_read", with_sql("SELECT gene, CAST(topic_id AS VARCHAR) AS topic_id, round(weight, 12) AS weight FROM gene_topic", "gene_topic"))
def gene_topic_read(s: SparkSession, d: str) -> DataFrame:
    """Topics as a matrix of text with a row for each gene, and back."""
    at = shared_folder(s)
    W.write_dense(cut(A.gene_topic(s, d)), at, "gene", "topic_id", "weight")
    return R.read_matrix(s, at, "gene", "topic_id").withColumn("weight", F.round("weight", 12))


@add("topic_sample_read", with_sql("SELECT sample_id, CAST(topic_id AS VARCHAR) AS topic_id, round(weight, 12) AS weight FROM topic_sample", "topic_sample"))
def topic_sample_read(s: SparkSession, d: str) -> DataFrame:
    """Topic weights of the samples as a matrix of text, and back."""
    at = shared_folder(s)
    W.write_dense(cut(A.topic_sample(s, d)), at, "sample_id", "topic_id", "weight")
    return R.read_matrix(s, at, "sample_id", "topic_id").withColumn("weight", F.round("weight", 12))


@add("ldac_read", _more("SELECT CAST(number AS BIGINT) AS number, count(*) AS docs, CAST(sum(n) AS BIGINT) AS n FROM numbered GROUP BY 1", LDAC, "counts"))
def ldac_read(s: SparkSession, d: str) -> DataFrame:
    """Cells as a file of LDA-C lines, read back and summed by term."""
    at = shared_folder(s)
    C.to_ldac(numbered_genes(s, d), "cell_id", "number").select("line").write.text(at)
    return C.from_ldac(R.read_ldac(s, at), "doc_id").groupBy("number").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))


@add("transfer_read", with_sql("SELECT topic_id, main_cell_type, round(weight, 9) AS weight, (SELECT count(DISTINCT cell_id) FROM cell_topic) AS n_cells FROM topic_type", "topic_type", "cell_topic"))
def transfer_read(s: SparkSession, d: str) -> DataFrame:
    """A transfer object written and read: the cell types of its topics, and the number of cells from its metadata."""
    at, cells = shared_folder(s), cut(A.cell_topic(s, d))
    W.write_transfer(at, A.gene_topic(s, d), cells, D.type_means(cells, A.anno(s, d)))
    back = W.read_transfer(s, at)
    return back["topic_celltype"].select("topic_id", "main_cell_type", F.round("weight", 9).alias("weight"), back["meta"].select("n_cells").scalar().alias("n_cells"))


@add("scenario_json_read", with_sql("SELECT main_cell_type, n_cells, round(proportion, 12) AS proportion FROM shares", "shares"))
def scenario_json_read(s: SparkSession, d: str) -> DataFrame:
    """Counts and shares of the cell types as JSON, and back."""
    at = shared_folder(s)
    W.scenario_json(D.type_shares(A.anno(s, d)), random_state=42).write.text(at)
    told = s.read.text(at).select(F.from_json("value", "n_cells map<string, bigint>, proportions map<string, double>").alias("j"))
    return told.select(F.explode("j.n_cells").alias("main_cell_type", "n_cells"), "j.proportions").select("main_cell_type", "n_cells", F.round(F.element_at("proportions", F.col("main_cell_type")), 12).alias("proportion"))


PLACED = SUPER + r""", placed AS (SELECT regexp_extract(region_id, '^(.*)_(\d+)_(\d+)$', 1) AS chr, regexp_extract(region_id, '^(.*)_(\d+)_(\d+)$', 2) AS start, regexp_extract(region_id, '^(.*)_(\d+)_(\d+)$', 3) AS "end", region_id, n - i + 1 AS rank, signal > cutoff AS is_super FROM srt, cut),
 lines AS (SELECT concat_ws(chr(9), placed.chr, start, "end", region_id, rank) AS value, is_super FROM placed)"""


def _ranked(s: SparkSession, d: str) -> DataFrame:
    part = lambda i: F.regexp_extract("region_id", r"^(.*)_(\d+)_(\d+)$", i)
    ranked = cut(I.enhancers(enhancer_signal(s, d).withColumn("signal", F.round("signal", 6))))
    return ranked.select(part(1).alias("chr"), part(2).cast("bigint").alias("start"), part(3).cast("bigint").alias("end"), "region_id", F.col("rank").cast("bigint").alias("rank"), "is_super")


@add(
    "enhancer_bed_lines",
    _more("""SELECT value FROM lines UNION ALL SELECT value FROM lines WHERE is_super UNION ALL SELECT 'track name="all_regions" description="all regions" itemRGB=On color=0,0,0' WHERE EXISTS (FROM lines) UNION ALL SELECT 'track name="Super_all_regions" description="Super all regions" itemRGB=On color=255,0,0' WHERE EXISTS (FROM lines WHERE is_super)""", PLACED, "peaks", "peak_counts"),
)
def enhancer_bed_lines(s: SparkSession, d: str) -> DataFrame:
    """Two BED tracks in one file, written and read as lines."""
    at = shared_folder(s)
    W.enhancer_bed(_ranked(s, d), "all regions").write.text(at)
    return s.read.text(at)


@add("enhancer_gateway_lines", _more("SELECT value || chr(9) || '.' AS value FROM lines WHERE is_super", PLACED, "peaks", "peak_counts"))
def enhancer_gateway_lines(s: SparkSession, d: str) -> DataFrame:
    at = shared_folder(s)
    W.enhancer_gateway(_ranked(s, d), only_super=True).write.text(at)
    return s.read.text(at)


@add("enhancer_table_read", _more('SELECT chr AS "CHROM", CAST(start AS BIGINT) AS "START", CAST("end" AS BIGINT) AS "STOP", region_id AS "REGION_ID", rank AS "enhancerRank", CAST(is_super AS INTEGER) AS "isSuper" FROM placed', PLACED, "peaks", "peak_counts"))
def enhancer_table_read(s: SparkSession, d: str) -> DataFrame:
    at, rows = shared_folder(s), W.enhancer_table(_ranked(s, d))
    W.write_tsv(rows, at)
    return s.read.csv(at, sep="\t", header=True, schema=rows.schema)


@add("gene_ratio", "SELECT DISTINCT symbol, start, \"end\", start::DOUBLE / nullif(\"end\", 0) AS ratio FROM gene_anno")
def gene_ratio(s: SparkSession, d: str) -> DataFrame:
    """Ratios given as text, ``a/b``, as numbers."""
    rows = table(s, d, "gene_anno").select("symbol", "start", "end").distinct()
    return rows.withColumn("ratio", ratio(F.concat(F.col("start").cast("string"), F.lit("/"), F.col("end").cast("string"))))


def _streamed(s: SparkSession, d: str, make: Callable[[DataFrame], DataFrame], mode: str, key: str) -> DataFrame:
    """The last row of each ``key`` of a stream over the events, run to their end.

    Each batch is written into a folder of its own, which a repeated batch overwrites, beside the checkpoint of the stream; both are in the shared folder.
    """
    at, path = shared_folder(s), f"{d}/{{events.parquet}}"  # as a pattern, which may name a file

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/rows/batch_no={batch}")

    stream = make(s.readStream.schema(table(s, d, "events").schema).parquet(path))
    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = s.read.parquet(f"{at}/rows")
    others = [c for c in rows.columns if c not in (key, "batch_no")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch_no").alias("x")).select(key, "x.*")


@add("stream_vocabulary", "SELECT event_type AS term, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def stream_vocabulary(s: SparkSession, d: str) -> DataFrame:
    """The vocabulary of a stream with its counts, as it stands at the stream's end."""
    return _streamed(s, d, lambda e: bow.stream_term_counts(e, "event_type"), "complete", "term")


@add("stream_decayed_bag", f"WITH {DAYS} SELECT event_type AS term, round(sum(n * pow(0.9, last_batch - batch)), 6) AS value, CAST(any_value(last_batch) AS BIGINT) AS last_batch FROM (SELECT *, max(batch) OVER (PARTITION BY event_type) AS last_batch FROM days WHERE event_type IS NOT NULL) GROUP BY 1")
def stream_decayed_bag(s: SparkSession, d: str) -> DataFrame:
    """The fading bag of words of a stream, each term as of the last day it was seen."""

    def bag(events: DataFrame) -> DataFrame:
        day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
        return bow.stream_decayed_counts(events.withColumn("batch", day), "event_type", "batch", 0.1)

    return _streamed(s, d, bag, "update", "term").withColumn("value", F.round("value", 6))
