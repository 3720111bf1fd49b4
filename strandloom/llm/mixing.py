"""Mixing sources to target weights: a low-discrepancy schedule over stretches of shuffled documents."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.columns import trimmed
from strandloom.llm.tokens import VOCABULARY, with_tokens
from strandloom.operators.prefix import prefix_sums
from strandloom.session import cut

GOLDEN = 0.6180339887498949
#: Targets are settings, not data; more sources than this are refused, as they are broadcast and written into the plan.
MOST_SOURCES = 10_000


def source_name(c: str) -> Column:
    """Trimmed and in lower case; null if nothing is left."""
    name = F.lower(trimmed(c))
    return F.when(name != "", name)


@dataclass
class Mix:
    """``report``: one row for each source. ``plan``: one row for each use of a document: ``slot, source, repeat_no, block, doc_id, n_tokens``."""

    report: DataFrame
    plan: DataFrame


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = 4096, seed: int = 17, vocabulary: str = VOCABULARY) -> Mix:
    """A mix as large as all documents together in which each source of ``targets`` (``source, target_share, max_repeat``) has its share of the tokens.

    The mix has as many slots as blocks of ``block_tokens`` go into all documents' tokens, those without source included. Slot i takes the
    source into whose stretch of the cumulative weights the point frac((i + 1) * golden ratio) falls, so any run of slots is close to the
    targets. A source's documents are shuffled by hash of the id and laid end to end, ``max_repeat`` times; its r-th slot takes the documents that start
    within the r-th ``block_tokens`` tokens, none being split. A document longer than that thus pays for the slots it runs through, which have no rows
    in the plan but count as filled. ``block`` is the number of the stretch of the source in which a document starts. Slots beyond ``max_repeat`` rounds stay
    empty and are reported as missing; the report gives each source's share of the mix as delivered (``actual_share``) and of the size the mix should have had (``share_of_whole``). A source
    whose slots outrun its documents is ``out_of_reach`` if an exact check says the same of its target.

    Sums along a source's documents and slots run in slices (``prefix_sums``), so a source with a third of all rows is spread over many tasks.

    Sources are compared trimmed and in lower case; several target rows of one name add up, with the largest ``max_repeat``; null shares and
    repeats count as 0; a target without name is ignored. Documents whose source has no target only count in the total. Documents with
    null or empty text have no tokens and are in no block. Repeated rows are documents of their own. Empty documents give a report of zeros and an empty plan.
    """
    goal = targets.select(source_name("source").alias("source"), "target_share", "max_repeat").where("source IS NOT NULL").groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeat", F.lit(0))).cast("bigint").alias("max_repeat"))
    goals = goal.orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(goals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sized = cut(with_tokens(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), source_name(source_col).alias("source"), F.col(text_col).alias("text")), "text", "n_tokens", ["doc_id", "source"], vocabulary))
    whole = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).head()["t"]
    slots = -(-whole // block_tokens)

    mark = F.xxhash64("doc_id", F.lit(seed))
    in_goal = sized.where(F.col("source").isin([g["source"] for g in goals]) & (F.col("n_tokens") > 0)).select("source", "doc_id", "n_tokens", mark.alias("__o"), F.shiftright(mark, 56).alias("__slice"))
    placed = prefix_sums(in_goal, ["source"], "__slice", [F.col("__o"), F.col("doc_id")], "n_tokens", "__end")
    placed = cut(placed.select("source", "doc_id", "n_tokens", (F.col("__end") - F.col("n_tokens")).alias("__start")))
    have = placed.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).withColumn("blocks", F.ceil(F.col("tokens") / block_tokens))

    weight = sum(g["target_share"] for g in goals)
    names, upto = [g["source"] for g in goals], np.cumsum([g["target_share"] for g in goals]) / (weight or 1.0)

    def take_turns(batches):
        for b in batches:
            point = b.column("id").to_numpy().astype(np.float64) * GOLDEN + GOLDEN
            at = np.minimum(np.searchsorted(upto, point - np.floor(point), side="right"), len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(names, pa.string()).take(pa.array(at))], names=["slot", "source"])

    drawn = docs.sparkSession.range(slots if weight else 0).mapInArrow(take_turns, "slot bigint, source string")
    drawn = drawn.select("slot", "source", F.floor(F.col("slot") / 65536).alias("__slice"), F.lit(1).cast("bigint").alias("__one"))
    ranked = prefix_sums(drawn, ["source"], "__slice", [F.col("slot")], "__one", "__r").withColumn("__r", F.col("__r") - 1)

    stock = goal.join(have, "source", "left").select("source", "target_share", "max_repeat", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    asked = ranked.groupBy("source").agg(F.count("*").alias("slots_wanted"))
    both = stock.join(asked, "source", "left").na.fill(0, ["slots_wanted"])
    # whole rounds through the source, and the position up to which a last one goes
    both = both.withColumn("slots", F.least("slots_wanted", F.ceil(F.col("tokens") * F.col("max_repeat") / block_tokens)))
    both = both.withColumn("__full", F.when(F.col("tokens") > 0, F.least("max_repeat", F.floor(F.col("slots") * block_tokens / F.col("tokens")))).otherwise(0))
    both = cut(both.withColumn("__rest", F.when(F.col("__full") < F.col("max_repeat"), F.col("slots") * block_tokens - F.col("__full") * F.col("tokens")).otherwise(0)))
    inside = placed.join(F.broadcast(both.select("source", "tokens", "__full", "__rest")), "source")
    last = inside.where("__start < __rest").groupBy("source").agg(F.sum("n_tokens").alias("__last"))
    both = both.join(last, "source", "left").na.fill(0, ["__last"]).withColumn("mixed_tokens", F.col("__full") * F.col("tokens") + F.col("__last")).withColumn("rounds", F.col("__full") + (F.col("__last") > 0).cast("bigint"))
    # Golden-ratio points miss a source's share of the slots by fewer than this; whom the schedule asks for less than it has, even so, can reach its target
    stray = 3 + 2 * math.log(max(slots, 1)) / math.log((1 + math.sqrt(5)) / 2)
    short = (F.col("slots_wanted") + stray) * max(weight, 1.0) * block_tokens > F.col("tokens") * F.col("max_repeat")
    report = both.withColumn("__mixed", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))).select(  # at most MOST_SOURCES rows
        "source", "target_share", "max_repeat", "tokens", "blocks", "slots_wanted", "slots", "rounds", "mixed_tokens",
        F.when(F.col("__mixed") > 0, F.col("mixed_tokens") / F.col("__mixed")).otherwise(0.0).alias("actual_share"),
        (F.col("mixed_tokens") / F.lit(max(whole, 1))).alias("share_of_whole"),
        (F.col("slots_wanted") - F.col("slots")).alias("slots_missing"),
        (short & (F.col("tokens") * F.col("max_repeat") < F.col("target_share") * F.lit(whole))).alias("out_of_reach"),
    )
    times = F.col("__full") + (F.col("__start") < F.col("__rest")).cast("bigint")
    uses = inside.where(times > 0).withColumn("repeat_no", F.explode(F.sequence(F.lit(0).cast("bigint"), times - 1)))
    uses = uses.withColumn("__r", F.floor((F.col("repeat_no") * F.col("tokens") + F.col("__start")) / block_tokens))
    plan = uses.join(ranked, ["source", "__r"]).select("slot", "source", "repeat_no", F.floor(F.col("__start") / block_tokens).alias("block"), "doc_id", "n_tokens")
    return Mix(report, plan)
