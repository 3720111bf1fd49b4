"""A hierarchy of given topics: cosine distances in Spark, Ward linkage over the few topics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.matrix import matmul

MOST_TOPICS = 2_000


def cosine_distances(gene_topic: DataFrame, topic: str = "topic_id", gene: str = "gene", weight: str = "weight") -> DataFrame:
    """``topic, other, distance``: 1 - cosine of each two topics; 1 from a topic of zeros."""
    norms = gene_topic.groupBy(topic).agg(F.sqrt(F.sum(F.col(weight) ** 2)).alias("__n"))
    prod = matmul(gene_topic, gene_topic.withColumnRenamed(topic, "other"), [topic], [gene], ["other"], weight, weight, "p")
    far = prod.join(norms, topic).join(norms.withColumnsRenamed({topic: "other", "__n": "__m"}), "other")
    return far.select(topic, "other", F.greatest(F.lit(0.0), 1 - F.coalesce(F.col("p") / F.nullif(F.col("__n") * F.col("__m"), F.lit(0.0)), F.lit(0.0))).alias("distance"))


def ward(distances: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges ``(left, right, height, size)`` by Ward's criterion; cluster n + i is the i-th merge."""
    n = len(distances)
    d = {(i, j): float(distances[i, j]) for i in range(n) for j in range(i + 1, n)}
    size = dict.fromkeys(range(n), 1)
    out = []
    for step in range(n - 1):
        (a, b), h = min(d.items(), key=lambda kv: (kv[1], kv[0]))
        new, na, nb = n + step, size.pop(a), size.pop(b)
        for c, nc in size.items():
            ac, bc = d[tuple(sorted((a, c)))], d[tuple(sorted((b, c)))]
            d[(c, new)] = float(np.sqrt(max(((na + nc) * ac**2 + (nb + nc) * bc**2 - nc * h**2) / (na + nb + nc), 0)))
        d = {k: x for k, x in d.items() if a not in k and b not in k}
        size[new] = na + nb
        out.append((a, b, h, na + nb))
    return out


def topic_tree(gene_topic: DataFrame, top_names: int = 5) -> DataFrame:
    """``parent, left, right, distance, topics, name``: one row for each merge; the name joins the heaviest genes of the merged topics by
    summed weight times ln((N + 1) / (df + 1)) + 1, df being the number of topics with the gene."""
    spark = gene_topic.sparkSession
    ids = [r[0] for r in gene_topic.select("topic_id").distinct().orderBy("topic_id").limit(MOST_TOPICS + 1).collect()]
    if len(ids) > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} topics")
    at = {t: i for i, t in enumerate(ids)}
    m = np.ones((len(ids), len(ids)))
    for a, b, x in cosine_distances(gene_topic).select("topic_id", "other", "distance").collect():
        m[at[a], at[b]] = x
    np.fill_diagonal(m, 0)
    members: dict[int, list[int]] = {i: [t] for i, t in enumerate(ids)}
    rows = []
    for i, (a, b, h, _) in enumerate(ward(m)):
        members[len(ids) + i] = sorted(members[a] + members[b])
        rows.append((len(ids) + i, a, b, h, members[len(ids) + i]))
    tree = spark.createDataFrame(rows, "parent int, left int, right int, distance double, topics array<int>")
    idf = gene_topic.where("weight > 0").groupBy("gene").agg((F.ln((F.lit(len(ids)) + 1) / (F.count("*") + 1)) + 1).alias("idf"))
    weights = tree.select("parent", F.explode("topics").alias("topic_id")).join(gene_topic, "topic_id").groupBy("parent", "gene").agg(F.sum("weight").alias("w")).join(idf, "gene")
    best = weights.groupBy("parent").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct((F.col("w") * F.col("idf")).alias("x"), "gene")))), 1, top_names).alias("g"))
    return tree.join(best, "parent").select("parent", "left", "right", "distance", "topics", F.array_join(F.transform("g", lambda e: e["gene"]), "_").alias("name"))
