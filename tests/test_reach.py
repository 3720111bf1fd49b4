"""Gene-peak weights of cell types over the whole reach of a gene, against SQL of their own."""

from oracle import compare, connect
from strandloom.plans import decon_queries, interval_queries
from strandloom.plans.adapters import with_sql

FOLDER = "/root/testdata/sf0.001"


def test_links_reach_as_far_as_the_gene_peaks(spark):
    links = interval_queries.LINKS.replace("links AS", "far AS", 1)
    sql = f"""{with_sql("", "genes", "peaks").rstrip()}, named_genes AS (SELECT *, symbol AS gene FROM genes), {links}
 SELECT gene, peak_id, max(exp(-dist / 5000.0::DOUBLE)) AS weight FROM far GROUP BY 1, 2"""
    df = decon_queries._links(spark, FOLDER)
    assert compare(df, sql, connect(FOLDER)) == ""
    assert df.where("weight < exp(-20000 / 5000.0)").count() > 0
