"""Sizes of texts in tokens of a public tokenizer.

The tokenizer's vocabulary file is a parameter. A text is cut at its blanks, each piece but the first keeping the
blank before it; the tokenizer's own rule cuts there too, so the pieces' counts add up to the text's.
Pieces recur: Arrow finds the distinct ones of a batch, and only those not met before are encoded.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

VOCABULARY = os.environ.get("STRANDLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: The split rule that belongs to the vocabulary files: a fixed value, published with them.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept between batches by a Python worker.
KEPT = 1_000_000


class Tokenizer:
    _made: dict[str, Tokenizer] = {}

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    @classmethod
    def at(cls, path: str) -> Tokenizer:
        """One per worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _size(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encode(piece))
            if len(self.known) < KEPT and len(piece) < 64:
                self.known[piece] = n
        return n

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; 0 for null."""
        out = np.zeros(len(texts), np.int64)
        texts = texts.cast(pa.large_string())
        # three blanks in a row, or blanks at the end, may make one token of two pieces: such texts are encoded whole
        whole = pc.fill_null(pc.or_(pc.match_substring(texts, "   "), pc.ends_with(texts, " ")), False).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(whole):
            out[i] = len(self.encode(texts[int(i)].as_py()))
        rest = np.flatnonzero(~whole & (pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > 0))
        if not len(rest):
            return out
        some = texts.take(pa.array(rest))
        lists = pc.split_pattern(some, " ")
        pieces = lists.flatten().dictionary_encode()
        sizes = np.fromiter((self._size(" " + p) for p in pieces.dictionary.to_pylist()), np.int64, len(pieces.dictionary))
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        sums = np.r_[0, np.cumsum(sizes[pieces.indices.to_numpy(zero_copy_only=False)])]
        begins = np.r_[0, ends[:-1]]
        total = sums[ends] - sums[begins]
        first = pieces.indices.to_numpy(zero_copy_only=False)[begins]
        words = pieces.dictionary.take(pa.array(first)).to_pylist()
        out[rest] = total - sizes[first] + np.fromiter((self._size(w) if w else 0 for w in words), np.int64, len(words))
        return out


def with_tokens(df: DataFrame, text_col: str, out: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``out``, the tokens of ``text_col`` (0 for null and empty texts). Whole texts are read; no shuffle."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.select(*keep).dtypes), f"`{out}` bigint"])

    def count(batches):
        tokenizer = Tokenizer.at(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(tokenizer.counts(b.column(len(keep))))], names=[*keep, out])

    return df.select(*keep, df[text_col].alias("__text")).mapInArrow(count, schema)
