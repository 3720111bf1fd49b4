"""Filling containers of fixed capacity: bounded-space online best fit."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.tokens import VOCABULARY, Tokenizer

PIECES = "doc_id bigint, piece_no int, n_pieces int, start_token bigint, n_tokens bigint, container_id string"


class OpenBins:
    """A fixed number of open bins, found by their free space through the set bits of one integer."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.bits, self.count, self.made = 0, 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
            del self.by_free[free]
        self.count -= 1
        return b

    def put(self, size: int) -> int:
        """The bin that an item of 1 to capacity tokens goes to: the fullest that holds it, else a new one.

        If all places are taken, the fullest bin is closed for the new one. A bin without free space is closed at once.
        """
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.count >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            b, free = self.made, self.capacity
            self.made += 1
        left = free - size
        if left:
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.count += 1
        return b


def pack(df: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", open_bins: int = 64, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows ``doc_id, piece_no, n_pieces, start_token, n_tokens, container_id``: where each document, or each piece of one that is
    larger than ``capacity``, goes.

    Every partition packs its rows as they come, with at most ``open_bins`` open containers, so the memory of a task does not
    depend on its rows and nothing is shuffled; per partition at most ``open_bins`` containers end only partly full. Only a text of more
    than ``capacity`` tokens is cut: into full containers of its own and a last piece that is packed like any item. Null and empty
    texts have 0 tokens, one row and no container. Repeated rows are packed as often as they occur; other columns are left out.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")

    def fill(batches):
        tokenizer, bins = Tokenizer.at(vocabulary), OpenBins(capacity, open_bins)
        part = TaskContext.get().partitionId()
        for b in batches:
            rows: list[tuple] = []
            for doc, n in zip(b.column(0).to_pylist(), tokenizer.counts(b.column(1)).tolist()):
                if n == 0:
                    rows.append((doc, 0, 1, 0, 0, None))
                    continue
                pieces = -(-n // capacity)
                for p in range(pieces):
                    size = min(capacity, n - p * capacity)
                    rows.append((doc, p, pieces, p * capacity, size, f"{part}-{bins.put(size)}"))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=[f.split()[0] for f in PIECES.split(", ")])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(fill, PIECES)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row for each container: ``container_id, n_items, used_tokens, free_tokens``."""
    by = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("used_tokens"))
    return by.withColumn("free_tokens", F.lit(capacity) - F.col("used_tokens"))


def cut_documents(packed: DataFrame) -> DataFrame:
    """``doc_id`` of the documents that had to be cut."""
    return packed.where("n_pieces > 1 AND piece_no = 0").select("doc_id").distinct()
