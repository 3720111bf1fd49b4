"""Reading counts, annotations, intervals and matrices from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandloom.operators.prefix import ranks
from strandloom.schema import checked

SEPARATORS = {"tab": "\t", "space": " ", "comma": ","}


def read_count_text(spark: SparkSession, path: str, separator: str = "tab", most_columns: int = 200_000) -> DataFrame:
    """``cell_id, gene, value`` from a dense table whose header names the cells, with or without a corner cell; zeros have no row.

    ``path`` may be a folder of parts that all begin with the same header: lines equal to it are headers. No lines, no rows.
    """
    sep = SEPARATORS[separator]
    lines = spark.read.text(path).where("value <> ''")
    top = lines.head()
    if top is None:
        return spark.createDataFrame([], "cell_id string, gene string, value double")
    header = top[0].split(sep)
    if len(header) > most_columns:
        raise ValueError(f"more than {most_columns} columns")
    body = lines.where(F.col("value") != sep.join(header)).select(F.split("value", sep).alias("p"))
    width = len((body.head() or [[]])[0])
    cells = header[1:] if len(header) == width else header
    names = F.array(*[F.lit(c) for c in cells])
    long = body.select(F.col("p")[0].alias("gene"), F.explode(F.arrays_zip(names.alias("c"), F.slice("p", 2, len(cells)).alias("v"))).alias("x"))
    return long.select(F.col("x.c").alias("cell_id"), "gene", F.col("x.v").try_cast("double").alias("value")).where("value <> 0")


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """``cell_id, main_cell_type`` from a headerless table of two columns; of a repeated cell the last line of its file holds."""
    raw = spark.read.csv(path, sep="\t", schema="cell_id string, main_cell_type string").withColumn("o", F.monotonically_increasing_id())
    return raw.where("cell_id IS NOT NULL").groupBy("cell_id").agg(F.max_by("main_cell_type", "o").alias("main_cell_type"))


def read_gene_list(spark: SparkSession, path: str, column: str = "gene_name", sep: str = "\t") -> DataFrame:
    """``ord, gene`` from a table with a header, in the order of its lines; nulls and blanks are left out."""
    raw = spark.read.csv(path, sep=sep, header=True).select(F.col(f"`{column}`").alias("gene"), F.monotonically_increasing_id().alias("o")).where("trim(gene) <> ''")
    return ranks(raw, [], F.floor(F.col("o") / 65536), [F.col("o")], "ord").select((F.col("ord") - 1).cast("int").alias("ord"), "gene")


def read_gene_annotation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chr string, start bigint, end bigint, symbol string, strand string")


def peak_id(chrom: str | Column = "chr", start: str | Column = "start", end: str | Column = "end") -> Column:
    return F.concat_ws("_", chrom, start, end)


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """``peak_id, chr, start, end, score`` from a BED file of four columns."""
    return spark.read.csv(path, sep="\t", schema="chr string, start bigint, end bigint, score double", comment="#").select(peak_id().alias("peak_id"), "*")


def read_fragments(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """``chr, start, end, name, score, strand`` from a BED file of 4 to 12 columns, gzipped or not, comment lines left out.

    A gzipped file can't be split: give ``partitions`` to spread its rows after reading.
    """
    raw = spark.read.text(path).where("value <> '' AND NOT startswith(value, '#')")
    parts = raw.select(F.split("value", "\t").alias("p"))
    first = parts.head()
    if first is not None and len(first[0]) < 4:
        raise ValueError("fragments need at least four columns")
    at = lambda i: F.try_element_at("p", F.lit(i))
    out = parts.select(at(1).alias("chr"), at(2).try_cast("bigint").alias("start"), at(3).try_cast("bigint").alias("end"), at(4).alias("name"), F.coalesce(at(5).try_cast("double"), F.lit(1.0)).alias("score"), at(6).alias("strand"))
    return out.repartition(partitions) if partitions else out


def read_matrix(spark: SparkSession, path: str, row: str, col: str, value: str = "weight") -> DataFrame:
    """``row, col, value`` from a tab-separated matrix with a header; the first column names the rows."""
    wide = spark.read.csv(path, sep="\t", header=True)
    first, rest = wide.columns[0], wide.columns[1:]
    long = wide.select(F.col(f"`{first}`").alias(row), F.explode(F.array(*[F.struct(F.lit(c).alias(col), F.col(f"`{c}`").cast("double").alias(value)) for c in rest])).alias("x"))
    return long.select(row, f"x.{col}", f"x.{value}").where(F.col(value) != 0)


def read_predicted_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """``sample_id, main_cell_type, peak_id, value`` from all files ``<sample>_...predicted_filtered_peaks.csv`` below a folder: cell types in rows, peaks in columns.

    Files differ in their columns, so lines are split and matched with the header of their own file.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*predicted_filtered_peaks.csv").text(folder)
    named = lines.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.split(F.regexp_replace("value", '"', ""), ",").alias("p"), F.col("_metadata.file_block_start").alias("o"), F.monotonically_increasing_id().alias("n"))
    heads = named.groupBy("path").agg(F.min_by("p", F.struct("o", "n")).alias("h"))
    body = named.join(heads, "path").where("p <> h")
    cells = body.select(F.split_part("file", F.lit("_"), F.lit(1)).alias("sample_id"), F.col("p")[0].alias("main_cell_type"), F.explode(F.arrays_zip(F.slice("h", 2, 2**30).alias("k"), F.slice("p", 2, 2**30).alias("v"))).alias("x"))
    return cells.select("sample_id", "main_cell_type", F.col("x.k").alias("peak_id"), F.col("x.v").try_cast("double").alias("value")).where("value IS NOT NULL")


def read_ldac(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, line`` of an LDA-C file."""
    return spark.read.text(path).where("value <> ''").select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("line"))


class _Slice(InputPartition):
    def __init__(self, begin: int, end: int) -> None:
        self.begin, self.end = begin, end


class TenXSource(DataSource):
    """``spark.read.format("tenx_h5")``: the sparse matrix of a 10x HDF5 file as ``cell_id, gene, value``, one task for some cells each. Needs h5py on the executors."""

    @classmethod
    def name(cls) -> str:
        return "tenx_h5"

    def schema(self) -> str:
        return "cell_id string, gene string, value double"

    def reader(self, schema):
        return _TenXReader(self.options["path"], int(self.options.get("cells_per_task", 2000)))


class _TenXReader(DataSourceReader):
    def __init__(self, path: str, step: int) -> None:
        self.path, self.step = path, step

    def partitions(self):
        import h5py

        with h5py.File(self.path) as f:
            n = f["matrix/barcodes"].shape[0]
        return [_Slice(i, min(n, i + self.step)) for i in range(0, n, self.step)]

    def read(self, part):
        import h5py

        with h5py.File(self.path) as f:
            m = f["matrix"]
            names = [x.decode() for x in m["features/name"][:]]
            cells = [x.decode() for x in m["barcodes"][part.begin : part.end]]
            ends = m["indptr"][part.begin : part.end + 1]
            rows, values = m["indices"][ends[0] : ends[-1]], m["data"][ends[0] : ends[-1]]
            for c, (a, b) in zip(cells, zip(ends[:-1] - ends[0], ends[1:] - ends[0])):
                for g, v in zip(rows[a:b], values[a:b]):
                    yield c, names[g], float(v)


def read_counts(spark: SparkSession, path: str, separator: str = "tab") -> DataFrame:
    """``cell_id, gene, value`` by the kind of file: Parquet, 10x HDF5 (``.h5``) or dense text. Negative values count as zeros, which have no row, and so do cells that have nothing else."""
    if path.endswith(".h5"):
        spark.dataSource.register(TenXSource)
        raw = spark.read.format("tenx_h5").load(path)
    elif path.endswith((".txt", ".tsv", ".csv", ".gz")):
        raw = read_count_text(spark, path, separator)
    else:
        raw = checked(spark.read.parquet(path), "counts")
    return raw.where("value > 0")
