"""Writing results: transfer objects, matrices as text, enhancer tracks, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def metadata(gene_topic: DataFrame, cell_topic: DataFrame, topic_type: DataFrame) -> DataFrame:
    """One row: distinct genes, topics, cells and cell types of a transfer object."""
    one = lambda df, col, name: df.agg(F.count_distinct(col).alias(name)).withColumn("__one", F.lit(1))
    return one(gene_topic, "gene", "n_genes").join(one(gene_topic, "topic_id", "n_topics"), "__one").join(one(cell_topic, "cell_id", "n_cells"), "__one").join(one(topic_type, "main_cell_type", "n_celltypes"), "__one").drop("__one")


def write_transfer(folder: str, gene_topic: DataFrame, cell_topic: DataFrame, topic_type: DataFrame, backend: str = "unknown", hierarchy_mode: str = "posthoc") -> None:
    """A model's three matrices and its metadata as Parquet."""
    for name, df in (("gene_topic", gene_topic), ("cell_topic", cell_topic), ("topic_celltype", topic_type)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    about = metadata(gene_topic, cell_topic, topic_type).withColumn("backend", F.lit(backend)).withColumn("hierarchy_mode", F.lit(hierarchy_mode))
    about.write.mode("overwrite").parquet(f"{folder}/meta")


def read_transfer(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("gene_topic", "cell_topic", "topic_celltype", "meta")}


def write_tsv(df: DataFrame, folder: str, header: bool = True, **options) -> None:
    """Tab-separated text, blanks at the ends of values kept. ``options`` are those of Spark's CSV writer, such as ``compression``."""
    kept = {"sep": "\t", "header": header, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**{**kept, **options}).csv(folder)


def write_dense(df: DataFrame, folder: str, row: str, col: str, value: str, most_columns: int = 20_000) -> None:
    """A matrix as tab-separated text with a column for each value of ``col``; an error beyond ``most_columns``."""
    names = [r[0] for r in df.select(col).distinct().orderBy(col).limit(most_columns + 1).collect()]
    if len(names) > most_columns:
        raise ValueError(f"more than {most_columns} columns")
    write_tsv(df.groupBy(row).pivot(col, names).agg(F.sum(value)).na.fill(0.0), folder)


def enhancer_table(df: DataFrame) -> DataFrame:
    """``CHROM, START, STOP, REGION_ID, enhancerRank, isSuper`` of ranked regions."""
    return df.select(F.col("chr").alias("CHROM"), F.col("start").alias("START"), F.col("end").alias("STOP"), F.col("region_id").alias("REGION_ID"), F.col("rank").alias("enhancerRank"), F.col("is_super").cast("int").alias("isSuper"))


def _track(df: DataFrame, number: int, title: str, description: str, color: str) -> DataFrame:
    """The lines of one track: its header, if it has regions, and the regions by rank."""
    head = f'track name="{title}" description="{description}" itemRGB=On color={color}'
    line = F.concat_ws("\t", "chr", "start", "end", "region_id", "rank")
    place = F.lit(number).alias("t")
    first = df.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(head).alias("value"), place, F.lit(0).cast("bigint").alias("o"))
    return first.unionAll(df.select(line.alias("value"), place, F.col("rank").cast("bigint").alias("o")))


def enhancer_bed(df: DataFrame, name: str, description: str | None = None, color: str = "0,0,0", super_color: str = "255,0,0") -> DataFrame:
    """Lines of a BED file: a track of all ranked regions (chrom, start, end, id, rank), and with ``is_super`` among the columns a second one of the super-enhancers. No regions, no lines."""
    title, text = name.replace(" ", "_"), (name if description is None else description).replace("\n", "\t")
    lines = _track(df, 0, title, text, color)
    if "is_super" in df.columns:
        lines = lines.unionAll(_track(df.where("is_super"), 1, f"Super_{title}", f"Super {text}", super_color))
    return lines.orderBy("t", "o").select("value")


def enhancer_gateway(df: DataFrame, only_super: bool = False) -> DataFrame:
    """Lines of six columns without a header: chrom, start, end, id, rank and a dot for the strand, by rank."""
    rows = df.where("is_super") if only_super else df
    return rows.orderBy("rank").select(F.concat_ws("\t", "chr", "start", "end", "region_id", "rank", F.lit(".")).alias("value"))


def scenario_json(shares: DataFrame, **settings) -> DataFrame:
    """One row ``value``: settings, cell counts and proportions as JSON. One entry a cell type."""
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("main_cell_type", c))))
    packed = shares.agg(entries("n_cells").alias("n_cells"), entries("proportion").alias("proportions"))
    return packed.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in settings.items()], "n_cells", "proportions")).alias("value"))
