"""Schemas of the domain's tables, checked where tables come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SCHEMAS: dict[str, str] = {
    "counts": "cell_id string, gene string, value double",
    "anno": "cell_id string, main_cell_type string",
    "anchors": "topic_id int, gene string",
    "genes": "chr string, start bigint, end bigint, symbol string, strand string",
    "peaks": "peak_id string, chr string, start bigint, end bigint",
    "peak_counts": "sample_id string, peak_id string, value double",
    "fragments": "chr string, start bigint, end bigint, name string, score double",
    "bulk": "sample_id string, gene string, value double",
    "gene_peak": "gene string, peak_id string, dist double, weight double",
    "gene_topic": "gene string, topic_id int, weight double",
    "cell_topic": "cell_id string, topic_id int, weight double",
    "topic_celltype": "topic_id int, main_cell_type string, weight double",
    "truth": "sample_id string, main_cell_type string, proportion double",
}


def checked(df: DataFrame, name: str) -> DataFrame:
    """The columns of schema ``name``, cast to its types; an error that names the columns that ``df`` lacks."""
    want = StructType.fromDDL(SCHEMAS[name])
    missing = [f.name for f in want if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name}: no column {', '.join(missing)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in want])
