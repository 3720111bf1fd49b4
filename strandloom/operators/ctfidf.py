"""Terms of documents and classes: counts, class-based TF-IDF, decayed bags of words, co-occurrence, the LDA-C text format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_counts(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """``*keys, term, n``: tokens between white space, in lower case; null and blank texts have no rows."""
    tokens = docs.select(*keys, F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("term")).where("term <> ''")
    return tokens.groupBy(*keys, "term").agg(F.count("*").alias("n"))


def ctfidf(counts: DataFrame, klass: str, bm25: bool = False, reduce_frequent: bool = False, seeds: Sequence[str] = (), seed_weight: float = 2.0) -> DataFrame:
    """``klass, term, weight``: share of the term in its class (its root, if ``reduce_frequent``) times ln(A / f + 1), or ln(1 + (A - f + 0.5) / (f + 0.5)) with ``bm25``.

    f is the term's count over all classes, A the whole part of the classes' mean length. Seed terms weigh ``seed_weight`` times as much.
    """
    sizes = counts.groupBy(klass).agg(F.sum("n").alias("__size"))
    a = sizes.agg(F.floor(F.avg("__size")).cast("double")).scalar()
    f = counts.groupBy("term").agg(F.sum("n").alias("__f"))
    tf = F.col("n") / F.col("__size")
    df = F.col("__f").cast("double")
    idf = F.ln(1 + (a - df + 0.5) / (df + 0.5)) if bm25 else F.ln(a / df + 1)
    boost = F.when(F.col("term").isin(list(seeds)), seed_weight).otherwise(1.0) if seeds else F.lit(1.0)
    return counts.join(sizes, klass).join(f, "term").select(klass, "term", ((F.sqrt(tf) if reduce_frequent else tf) * idf * boost).alias("weight"))


def top_terms(weights: DataFrame, klass: str, n: int, term: str = "term") -> DataFrame:
    """The ``n`` heaviest terms of each class with their ``rank``; of equal ones the first by name."""
    return weights.withColumn("rank", F.row_number().over(Window.partitionBy(klass).orderBy(F.desc("weight"), term))).where(F.col("rank") <= n)


def umass(tops: DataFrame, docs: DataFrame, topic: str, term: str = "term", doc: str = "doc_id", epsilon: float = 1e-12) -> DataFrame:
    """``topic, coherence``: sum over pairs of top terms, in ascending weight, of ln((D(later, earlier) + e) / (D(earlier) + e)).

    ``tops`` has ``rank`` 1 for the heaviest. Only documents' top terms take part, and pairs are counted within the few of them in a document.
    """
    hits = docs.select(doc, term).distinct().join(tops.select(topic, term, "rank"), term)
    single = hits.groupBy(topic, "rank").agg(F.count("*").alias("__d"))
    grouped = hits.groupBy(doc, topic).agg(F.array_sort(F.collect_list("rank")).alias("__r"))
    later, earlier = F.col("__p.a"), F.col("__p.b")
    pairs = grouped.select(topic, F.explode(F.flatten(F.transform("__r", lambda a: F.transform(F.filter("__r", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("__p"))
    both = pairs.groupBy(topic, later.alias("rank_a"), earlier.alias("rank_b")).agg(F.count("*").alias("__dd"))
    grid = tops.select(topic, F.col("rank").alias("rank_a")).join(tops.select(topic, F.col("rank").alias("rank_b")), topic).where("rank_b > rank_a")
    full = grid.join(both, [topic, "rank_a", "rank_b"], "left").join(single.withColumnRenamed("rank", "rank_b"), [topic, "rank_b"], "left")
    term_ = F.ln((F.coalesce("__dd", F.lit(0)) + epsilon) / (F.coalesce("__d", F.lit(0)) + epsilon))
    return full.groupBy(topic).agg(F.sum(term_).alias("coherence"))


def decayed(counts: DataFrame, batch: str, term: str, decay: float, last_batch: int | Column, count: str = "n", min_total: float | None = None) -> DataFrame:
    """``term, value``: the sum of counts, each less by (1 - decay) for every batch since.

    With ``min_total`` a term whose value is below it after any batch is forgotten then, and starts anew when it comes back; only terms that are remembered at the end have a row."""
    if min_total is not None:
        last = last_batch if isinstance(last_batch, Column) else F.lit(last_batch)
        steps = counts.groupBy(term, F.col(batch).alias("b")).agg(F.sum(count).cast("double").alias("n")).groupBy(term).agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("x"))
        fade = lambda now, upto: now["v"] * F.pow(F.lit(1.0 - decay), (upto - now["b"]).cast("double"))
        kept = lambda v: F.when(v < min_total, 0.0).otherwise(v)
        first = F.struct(F.element_at("x", 1)["b"].alias("b"), F.lit(0.0).alias("v"))
        end = F.aggregate("x", first, lambda now, e: F.struct(e["b"].alias("b"), kept(F.when(fade(now, F.greatest(now["b"], e["b"] - 1)) < min_total, 0.0).otherwise(fade(now, e["b"])) + e["n"]).alias("v")))
        return steps.select(term, kept(fade(end, last)).alias("value")).where("value > 0")
    return counts.groupBy(term).agg(F.sum(F.col(count) * F.pow(F.lit(1.0 - decay), (last_batch if isinstance(last_batch, Column) else F.lit(last_batch)) - F.col(batch))).alias("value"))


def to_ldac(counts: DataFrame, doc: str, number: str, count: str = "n", offset: int = 0) -> DataFrame:
    """``doc, line``: number of distinct terms and ``term:count`` in order of the terms' numbers."""
    packed = counts.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(number), F.col(count).alias("c")))).alias("__x"))
    items = F.transform("__x", lambda e: F.concat_ws(":", (e[number] + offset).cast("string"), e["c"].cast("string")))
    return packed.select(doc, F.concat_ws(" ", F.size("__x").cast("string"), F.concat_ws(" ", items)).alias("line"))


def from_ldac(lines: DataFrame, doc: str, offset: int = 0) -> DataFrame:
    """``doc, number, n`` from lines in the LDA-C format; the query fails where a line's count or a term below ``offset`` contradicts it."""
    parts = lines.select(doc, F.split("line", " ").alias("__p"))
    said = F.element_at("__p", 1).try_cast("int")
    terms = F.when(said.isNull() | (said != F.size("__p") - 1), F.raise_error(F.lit("a line's number of terms is wrong"))).otherwise(F.slice("__p", 2, F.size("__p") - 1))
    out = parts.select(doc, F.explode(terms).alias("__t")).select(doc, (F.split_part("__t", F.lit(":"), F.lit(1)).cast("bigint") - offset).alias("number"), F.split_part("__t", F.lit(":"), F.lit(2)).cast("bigint").alias("n"))
    return out.withColumn("number", F.when(F.col("number") < 0, F.raise_error(F.lit("a term number is below the offset"))).otherwise(F.col("number")))
