"""Token counts by an exact length histogram.

Every document is encoded by a byte-pair vocabulary; documents are aggregated by encoded length, and
suffix sums over the histogram answer totals, quantiles and truncated totals for every context limit
exactly, without another look at the documents.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where the vocabulary is read, on the driver; tasks get it from there.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's byte-level BPE parts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts whose length a worker remembers, and the longest such part in characters.
REMEMBERED, LONGEST = 400_000, 48


class Counter:
    """Exact encoded lengths. Merges never cross parts, so the length of a text is the sum of its
    parts' lengths, and those repeat."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.parts, self.known = regex.compile(pattern).findall, {}

    def _length(self, part: str) -> int:
        n = len(self.encoding._encode_single_piece(part.encode()))
        if len(part) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[part] = n
        return n

    def count(self, text: str) -> int:
        parts = self.parts(text)
        got = list(map(self.known.get, parts))
        if None in got:
            got = [self._length(p) if n is None else n for p, n in zip(parts, got)]
        return sum(got)


def _counter(vocabulary: bytes) -> Counter:
    """One counter for each worker process and vocabulary, whatever task asks."""
    kept = sys.modules.setdefault("_token_counters", types.ModuleType("_token_counters")).__dict__
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in kept:
        kept[key] = Counter(vocabulary)
    return kept[key]


def encoded_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens (long) of every row; null and empty texts have 0."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # of one vocabulary's size

    def run(batches):
        counter = _counter(sent.value)
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                out[i] = counter.count(text) if text else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "n_tokens"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row for each length that occurs, ascending in meaning, with sums over the histogram.

    n_tokens; n_docs and tokens at this length; docs_at_least, tokens_at_least (suffix sums);
    docs_at_most; share_at_most (the quantile rank); truncated_total: all tokens left if every
    document is cut at n_tokens. The windows run over distinct lengths, at most as many as the
    longest document has tokens. Null lengths count for nothing; no rows give an empty result.
    """
    n = F.col(length_col)
    by = lengths.where(n.isNotNull()).groupBy(n.cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    by = by.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    one = Window.partitionBy(F.lit(1))
    suffix = one.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = by.withColumns({"docs_at_least": F.sum("n_docs").over(suffix), "tokens_at_least": F.sum("tokens").over(suffix)})
    docs, tokens = F.sum("n_docs").over(one), F.sum("tokens").over(one)
    at_most = docs - F.col("docs_at_least") + F.col("n_docs")
    return by.withColumns(
        {
            "docs_at_most": at_most,
            "share_at_most": at_most / docs,
            "truncated_total": tokens - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"),
        }
    )


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, total, whole_docs, cut_docs) for any context limits, from the suffix sums."""
    h = histogram.select("n_tokens", "n_docs", "tokens")
    asked = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    met = h.join(F.broadcast(asked))  # the stated limits against the histogram
    return met.groupBy("context_limit").agg(
        F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("total"),
        F.sum(F.when(F.col("n_tokens") <= F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("whole_docs"),
        F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("cut_docs"),
    )


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least that share of the documents does not exceed."""
    asked = histogram.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    met = histogram.join(F.broadcast(asked), F.col("share_at_most") >= F.col("share"))
    return met.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
