"""Clustering and classification over topic weights and vectors, through pyspark.ml."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.topics.lda import vectors_of


def topic_arrays(weights: DataFrame, row: str, topics: int, out: str = "x") -> DataFrame:
    """``row, out``: an array with the weight of each of ``topics`` topics (numbered from 0), 0 where a row is absent."""
    at = F.map_from_entries(F.collect_list(F.struct("topic_id", "weight")))
    packed = weights.groupBy(row, "topic_id").agg(F.sum("weight").alias("weight")).groupBy(row).agg(at.alias("__m"))
    return packed.select(row, F.transform(F.sequence(F.lit(0), F.lit(topics - 1)), lambda t: F.coalesce(F.try_element_at("__m", t), F.lit(0.0))).alias(out))


def clusters(df: DataFrame, array: str, k: int, seed: int = 1, out: str = "cluster") -> DataFrame:
    """Adds the number of the K-means cluster of each row's array."""
    x = vectors_of(df, array)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol=out).fit(x).transform(x).drop("features")


def gene_clusters(gene_topic: DataFrame, topics: int, k: int, seed: int = 1) -> DataFrame:
    """``gene, cluster``: K-means of the genes over their weights in the topics, brought to mean 0 and deviation 1 per gene; genes of one weight throughout are left out."""
    x = topic_arrays(gene_topic, "gene", topics).withColumn("m", F.aggregate("x", F.lit(0.0), lambda t, v: t + v) / topics)
    x = x.withColumn("sd", F.sqrt(F.aggregate("x", F.lit(0.0), lambda t, v: t + (v - F.col("m")) * (v - F.col("m"))) / max(topics - 1, 1)))
    return clusters(x.where("sd > 0").select("gene", F.transform("x", lambda v: (v - F.col("m")) / F.col("sd")).alias("x")), "x", k, seed).select("gene", "cluster")


def predicted_types(cell_topic: DataFrame, kinds: DataFrame, topics: int, max_iter: int = 20) -> DataFrame:
    """``cell_id, label, prediction`` of a held-out fifth of the cells (by hash): logistic regression of the cell type, as a number, on the topic weights."""
    x = vectors_of(topic_arrays(cell_topic, "cell_id", topics), "x").join(kinds, "cell_id").withColumn("o", F.pmod(F.xxhash64("cell_id"), F.lit(5)))
    coded = StringIndexer(inputCol="main_cell_type", outputCol="label", handleInvalid="keep").fit(x).transform(x)
    return LogisticRegression(maxIter=max_iter).fit(coded.where("o > 0")).transform(coded.where("o = 0")).select("cell_id", "label", "prediction")


def main_axes(df: DataFrame, key: str, array: str, k: int = 2) -> DataFrame:
    """``key, pc``: coordinates on the ``k`` main axes."""
    x = vectors_of(df, array)
    return PCA(k=k, inputCol="features", outputCol="pc").fit(x).transform(x).select(key, vector_to_array("pc").alias("pc"))
