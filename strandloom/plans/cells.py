"""Cell types as the given annotation tables have them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.columns import type_name
from strandloom.plans.registry import table

#: The same name rule as ``type_name``, for DuckDB.
TYPE_SQL = r"nullif(trim(regexp_replace(lower(main_cell_type), '[\s_]+', ' ', 'g')), '')"

OBS_SQL = f"obs_type AS (SELECT cell_id, {TYPE_SQL} AS main_cell_type FROM rna_obs WHERE cell_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC NULLS LAST, {TYPE_SQL} DESC NULLS LAST) = 1)"
ANNO_SQL = f"anno_type AS (SELECT cell_id, {TYPE_SQL} AS main_cell_type FROM main_celltype WHERE cell_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY line_no DESC NULLS LAST) = 1)"


def obs_types(spark: SparkSession, folder: str) -> DataFrame:
    """``cell_id, main_cell_type`` of rna_obs: the type of the cell's latest row; null if that row has none."""
    kind = type_name("main_cell_type")
    return table(spark, folder, "rna_obs").where("cell_id IS NOT NULL").groupBy("cell_id").agg(F.max_by(kind, F.struct(F.col("loaded_at"), kind)).alias("main_cell_type"))


def anno_types(spark: SparkSession, folder: str) -> DataFrame:
    """``cell_id, main_cell_type`` of main_celltype: the type in the cell's last line; null if that line has none."""
    kind = type_name("main_cell_type")
    return table(spark, folder, "main_celltype").where("cell_id IS NOT NULL").groupBy("cell_id").agg(F.max_by(kind, F.struct(F.col("line_no"), kind)).alias("main_cell_type"))


def both_types(spark: SparkSession, folder: str) -> DataFrame:
    """``labeling, cell_id, main_cell_type`` of the cells that have a type, in either table."""
    a = obs_types(spark, folder).select(F.lit("rna_obs").alias("labeling"), "cell_id", "main_cell_type")
    b = anno_types(spark, folder).select(F.lit("main_celltype").alias("labeling"), "cell_id", "main_cell_type")
    return a.unionAll(b).where("main_cell_type IS NOT NULL")
