"""Queries over the training-data operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.columns import sample_of, type_name
from strandloom.llm.clusters import density_peaks, descriptions, groups
from strandloom.llm.languages import disputed, segments, train
from strandloom.llm.mixing import Mix, mix
from strandloom.llm.neighbours import mutual_pairs, nearest_above, search
from strandloom.llm.packing import cut_documents, fill_report, pack
from strandloom.llm.sampling import balanced_sample
from strandloom.plans.cells import OBS_SQL, TYPE_SQL
from strandloom.plans.registry import Catalog, table
from strandloom.session import cut

CATALOG = Catalog()

UNITS_SQL = """usable AS (SELECT vec_id, embedding FROM cell_embedding WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM usable a JOIN usable b ON a.vec_id <> b.vec_id)"""


@CATALOG.add(
    "p2_found",
    f"""WITH {UNITS_SQL}, near AS MATERIALIZED (SELECT a, b, c FROM pairs WHERE c >= 0.9),
 hood AS (SELECT a, list_sort(list_append(list(b), a)) AS members, avg(c) AS mean FROM near GROUP BY a),
 grp AS (SELECT members, list(a) AS who, list(mean) AS means, max(mean) AS top FROM hood GROUP BY members HAVING count(*) = len(members) AND count(*) >= 3),
 best AS (SELECT g.members, min(h.a) AS typical_id FROM grp g JOIN hood h ON h.members = g.members AND h.mean >= g.top - 1e-6 GROUP BY g.members)
 SELECT typical_id, unnest(members) AS vec_id FROM best""",
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups(density_peaks(table(spark, folder, "cell_embedding")))


@CATALOG.add("p2_clusters")
def p2_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every cluster of two or more vectors with its size and most typical members."""
    return descriptions(density_peaks(table(spark, folder, "cell_embedding")))


@CATALOG.add(
    "p5_found",
    f"""WITH {UNITS_SQL}, near AS (SELECT a, b FROM pairs WHERE c >= 0.9 QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
 SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM near""",
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return mutual_pairs(nearest_above(table(spark, folder, "cell_embedding"), 5, 0.9))


@CATALOG.add("p5_nearest")
def p5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50, searched among all."""
    return search(table(spark, folder, "cell_embedding"), 5).withColumn("cosine", F.round("cosine", 5))


def _drawn(spark: SparkSession, folder: str):
    kind = type_name("main_cell_type")
    latest = table(spark, folder, "rna_obs").where("cell_id IS NOT NULL").groupBy("cell_id").agg(F.max(F.struct("loaded_at", kind.alias("main_cell_type"), "lane_batch")).alias("x"))
    cells = latest.select("cell_id", sample_of("cell_id").alias("sample_id"), "x.main_cell_type", "x.lane_batch")
    return balanced_sample(cells, table(spark, folder, "sample_targets"), balance="lane_batch")


WANTED_SQL = f"""WITH {OBS_SQL}, stock AS (SELECT split_part(cell_id, '_', 1) AS sample_id, main_cell_type, count(*) AS available FROM obs_type WHERE main_cell_type IS NOT NULL GROUP BY 1, 2),
 goal AS (SELECT sample_id, {TYPE_SQL} AS main_cell_type, greatest(CAST(round(coalesce(target_share, 0) * sample_size) AS BIGINT), coalesce(min_cells, 0)) AS wanted FROM sample_targets),
 plan AS (SELECT sample_id, main_cell_type, wanted, CAST(coalesce(available, 0) AS BIGINT) AS available FROM goal LEFT JOIN stock USING (sample_id, main_cell_type))"""


@CATALOG.add("p3_found", f"{WANTED_SQL} SELECT sample_id, main_cell_type FROM plan WHERE available < wanted")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _drawn(spark, folder).report.where("missing > 0").select("sample_id", "main_cell_type")


@CATALOG.add("p3_report", f"{WANTED_SQL} SELECT sample_id, main_cell_type, wanted, available, least(wanted, available) AS drawn, wanted - least(wanted, available) AS missing FROM plan")
def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many cells of each type were wanted, exist, and were drawn."""
    return _drawn(spark, folder).report.select("sample_id", "main_cell_type", "wanted", "available", "drawn", "missing")


@CATALOG.add("p3_sample")
def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn cells."""
    return _drawn(spark, folder).cells


@CATALOG.add("p3_balance")
def p3_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Residual imbalance of the drawn cells by lane."""
    return _drawn(spark, folder).balance


LANES_SQL = f"""{WANTED_SQL}, lanes AS (SELECT cell_id, split_part(cell_id, '_', 1) AS sample_id, {TYPE_SQL} AS main_cell_type, CAST(lane_batch AS VARCHAR) AS lane_batch FROM rna_obs WHERE cell_id IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC NULLS LAST, {TYPE_SQL} DESC NULLS LAST, rna_obs.lane_batch DESC NULLS LAST) = 1)"""


@CATALOG.add("p3_expected", f"{LANES_SQL} SELECT sample_id, lane_batch, round(sum(least(wanted, available) / available), 6) AS expected FROM lanes JOIN plan USING (sample_id, main_cell_type) WHERE least(wanted, available) > 0 GROUP BY 1, 2")
def p3_expected(spark: SparkSession, folder: str) -> DataFrame:
    """How many cells of each lane are to be expected in the drawn sample, and so the base of ``p3_balance``."""
    return _drawn(spark, folder).balance.select("sample_id", "lane_batch", F.round("expected", 6).alias("expected"))


#: Words and marks of a text, for SQL: the cases of p6 and p7 are the same for any usual tokenizer.
WORDS_SQL = r"coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')), 0)"
SOURCE_SQL = r"nullif(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '')"


def _limits(spark: SparkSession, folder: str) -> list:
    limits = table(spark, folder, "pack_limits").where("capacity_tokens > 0").select("container", "capacity_tokens").distinct().orderBy("container", "capacity_tokens").limit(101).collect()
    if len(limits) > 100:
        raise ValueError("more than 100 kinds of containers")
    return limits


def _for_each_limit(spark: SparkSession, folder: str, result) -> DataFrame:
    """``result(packed, capacity)`` for each kind of container, all documents being packed into each."""
    docs, limits = table(spark, folder, "documents"), _limits(spark, folder)
    if not limits:
        return result(pack(docs.where("false"), 1), 1).withColumn("container", F.lit(None).cast("string"))
    return reduce(DataFrame.unionAll, [result(pack(docs, r["capacity_tokens"]), r["capacity_tokens"]).withColumn("container", F.lit(r["container"])) for r in limits])


@CATALOG.add("p6_found", f"SELECT DISTINCT doc_id FROM documents, pack_limits WHERE {WORDS_SQL} > capacity_tokens")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _for_each_limit(spark, folder, lambda packed, _: cut_documents(packed)).select("doc_id").distinct()


@CATALOG.add("p6_packed")
def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document and piece."""
    return _for_each_limit(spark, folder, lambda packed, _: packed)


@CATALOG.add("p6_containers")
def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Items, used and free tokens of every container."""
    return _for_each_limit(spark, folder, fill_report)


@CATALOG.add("p6_checked", "SELECT container, (SELECT count(*) FROM documents WHERE length(text) > 0) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS cut_in_vain FROM (SELECT DISTINCT container FROM pack_limits WHERE capacity_tokens > 0)")
def p6_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Of each kind of container: the documents packed, the containers that hold too much, and the documents that were cut although they fit, or not into as few pieces as can be."""

    def check(packed: DataFrame, capacity: int) -> DataFrame:
        placed = cut(packed.where("container_id IS NOT NULL"))
        over = fill_report(placed, capacity).agg(F.count(F.when(F.col("free_tokens") < 0, 1))).scalar()
        docs = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
        return docs.agg(F.count("*").alias("documents"), F.count(F.when(F.col("n") != F.ceil(F.col("t") / capacity), 1)).alias("cut_in_vain")).withColumn("overfull", over)

    return _for_each_limit(spark, folder, check)


def _mixed(spark: SparkSession, folder: str) -> Mix:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


@CATALOG.add(
    "p7_found",
    f"""WITH d AS (SELECT {SOURCE_SQL} AS source, {WORDS_SQL} AS n FROM documents), s AS (SELECT source, sum(n) AS n FROM d GROUP BY 1),
 g AS (SELECT {SOURCE_SQL} AS source, sum(coalesce(target_share, 0)) AS share, max(coalesce(max_repeat, 0)) AS uses FROM mix_targets GROUP BY 1)
 SELECT g.source FROM g LEFT JOIN s USING (source) WHERE g.source IS NOT NULL AND coalesce(s.n, 0) * uses < share * (SELECT sum(n) FROM d)""",
)
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder).report.where("out_of_reach").select("source")


@CATALOG.add("p7_shares")
def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source, and what is missing."""
    return _mixed(spark, folder).report


@CATALOG.add("p7_plan")
def p7_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Every use of a document in the mix."""
    return _mixed(spark, folder).plan


@CATALOG.add("p7_checked", f"SELECT DISTINCT {SOURCE_SQL} AS source, CAST(0 AS BIGINT) AS overused, true AS near_target FROM mix_targets WHERE {SOURCE_SQL} IS NOT NULL")
def p7_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source: the documents used more than ``max_repeat`` times, and whether its slots are as near its target as golden-ratio points are."""
    mixed = _mixed(spark, folder)
    uses = mixed.plan.groupBy("source", "doc_id").agg(F.count("*").alias("n")).join(mixed.report.select("source", "max_repeat"), "source")
    uses = uses.groupBy("source").agg(F.count(F.when(F.col("n") > F.col("max_repeat"), 1)).alias("overused"))
    every = Window.partitionBy(F.lit(0))  # one row a source
    slots = F.sum("slots_wanted").over(every)
    stray = 3 + 2 * F.log2(F.greatest(slots, F.lit(1))) / F.log2(F.lit((1 + 5**0.5) / 2))
    near = F.abs(F.col("slots_wanted") - slots * F.try_divide("target_share", F.sum("target_share").over(every))) <= stray
    both = mixed.report.withColumn("near_target", near).join(uses, "source", "left")
    return both.select("source", F.coalesce("overused", F.lit(0)).alias("overused"), "near_target")


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return segments(docs, train(docs), lang_col="lang")


@CATALOG.add("p8_found")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return disputed(_passages(spark, folder))


@CATALOG.add("p8_passages")
def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of every passage of every document."""
    return _passages(spark, folder).withColumn("confidence", F.round("confidence", 4))
