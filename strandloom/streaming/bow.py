"""Bags of words that grow and fade with every batch, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_term_counts(stream: DataFrame, term: str) -> DataFrame:
    """``term, n``: the vocabulary so far with its counts, as a complete-mode aggregation of a stream."""
    return stream.where(F.col(term).isNotNull()).groupBy(F.col(term).alias("term")).agg(F.count("*").alias("n"))


def stream_windowed_counts(stream: DataFrame, time: str, term: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """``window_start, term, n`` per tumbling window; rows later than ``delay`` are dropped from closed windows."""
    w = F.window(F.col(time), width)
    return stream.withWatermark(time, delay).groupBy(w.alias("w"), F.col(term).alias("term")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "term", "n")


def _summed(stream: DataFrame) -> DataFrame:
    """``term, batch, n`` with repeats counted within each Arrow batch of a task, before anything is shuffled."""

    def count(batches):
        for b in batches:
            t = pa.Table.from_batches([b]).group_by(["term", "batch"]).aggregate([("n", "sum")])
            yield from pa.table({"term": t["term"], "batch": t["batch"], "n": t["n_sum"]}).to_batches()

    return stream.mapInArrow(count, "term string, batch bigint, n bigint")


def stream_decayed_counts(stream: DataFrame, term: str, batch: str, decay: float, min_total: float | None = None) -> DataFrame:
    """``term, value, last_batch`` in update mode: a term's count of earlier batches times (1 - decay) for each batch since, and the new count.

    A batch without the term decays it too: the state keeps the number of the last batch seen and makes up for those between when the term comes back; readers
    bring the value to a later batch with ``value * (1 - decay) ** (batch - last_batch)``. Tasks count the repeats of a term before the shuffle, so a term with a third of
    all rows reaches its state as a few rows, and the state of a term is two numbers. Rows of a batch older than the state are added with the decay they would have had.
    With ``min_total`` a term that falls below it after a batch is forgotten: its state is removed, and it starts anew when it comes back.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, last = state.get if state.exists else (0.0, None)
        added: dict[int, int] = {}
        for pdf in frames:
            for b, n in zip(pdf["batch"], pdf["n"]):
                added[int(b)] = added.get(int(b), 0) + int(n)
        for b, n in sorted(added.items()):
            if last is None or b >= last:
                gap = b - last if last is not None else 0
                if min_total is not None and gap > 0 and value * (1 - decay) ** (gap - 1) < min_total:
                    value = 0.0
                value, last = value * (1 - decay) ** gap + n, b
            else:
                value += n * (1 - decay) ** (last - b)
            if min_total is not None and value < min_total:
                value = 0.0
        if value == 0.0 and min_total is not None:
            if state.exists:
                state.remove()
        else:
            state.update((float(value), int(last)))
        yield pd.DataFrame({"term": [key[0]], "value": [value], "last_batch": [last]})

    rows = stream.where(F.col(term).isNotNull()).select(F.col(term).alias("term"), F.col(batch).cast("bigint").alias("batch"), F.lit(1).cast("bigint").alias("n"))
    return _summed(rows).groupBy("term").applyInPandasWithState(update, "term string, value double, last_batch bigint", "value double, last_batch bigint", "update", GroupStateTimeout.NoTimeout)


def prune(counts: DataFrame, min_total: float) -> DataFrame:
    """Terms whose value is at least ``min_total``."""
    return counts.where(F.col("value") >= min_total)
