"""Compares a query with its SQL in DuckDB: columns by name, rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings rna_counts rna_obs main_celltype gene_anno cell_embedding use_gene sample_targets mix_targets pack_limits".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(folder, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, con) -> str:
    """Empty if equal, else what differs."""
    cur = con.execute(sql)
    theirs_cols = [d[0] for d in cur.description]
    ours_cols, ours = df.columns, [tuple(r) for r in df.collect()]
    if sorted(ours_cols) != sorted(theirs_cols):
        return f"columns {sorted(ours_cols)} against {sorted(theirs_cols)}"
    a, b = rows_of(ours_cols, ours), rows_of(theirs_cols, cur.fetchall())
    if a == b:
        return ""
    sa, sb = set(map(repr, a)), set(map(repr, b))
    return f"{len(a)} rows against {len(b)}; only ours {sorted(sa - sb)[:3]}; only theirs {sorted(sb - sa)[:3]}"
