"""Queries keep all rows where filters would be easy."""

import re

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_no_query_samples_by_modulo():
    for name in ("dup_symbol_median", "ctrl_norm"):
        assert not re.search(r"% [23] [=>]|1e12", entry.oracle_sql()[name])


def test_ctrl_norm_keeps_genes_with_constant_controls(spark):
    df = entry.queries()["ctrl_norm"](spark, FOLDER)
    assert compare(df, entry.oracle_sql()["ctrl_norm"], connect(FOLDER)) == ""
    assert df.where("abs(value) >= 1e12").count() > 0
