"""Token counts by an exact length histogram.

Every document is encoded once; documents are aggregated by encoded length, and suffix sums over
the histogram answer totals, quantiles and truncated totals for every context limit without
another look at the texts. The histogram has one row per distinct length, however many documents
there are; equal lengths are combined in the map tasks before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of
from .encoders import encoder, in_runs, public_path

#: Lengths per block of the two-level suffix sums.
BLOCK = 4096


def encoded_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text", extra_tokens: int = 0) -> DataFrame:
    """One ``length`` per document. Null and empty texts have length ``extra_tokens``."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"length": pa.array([len(x) + extra_tokens for run in in_runs(batch.column(0).to_pylist()) for x in enc.many(run)], pa.int64())})

    return docs.select(text_of(text_col).alias("t")).mapInArrow(lengths, "length long")


def length_histogram(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text", extra_tokens: int = 0) -> DataFrame:
    """(length, n_docs): how many documents have each encoded length."""
    tokenizer = tokenizer or public_path("byte_bpe_50k.json")
    return encoded_lengths(docs, tokenizer, text_col, extra_tokens).groupBy("length").agg(F.count("*").alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """Suffix sums for every context limit at which an answer changes.

    Per distinct ``length`` L, with L as the context limit:

    * ``n_docs``: documents of exactly that length; ``n_longer``: longer ones (those that L truncates);
    * ``tokens_longer``: tokens of the longer ones; ``n_up_to``/``tokens_up_to``: the rest;
    * ``truncated_total``: tokens left when every document is cut at L;
    * ``rank_from``/``rank_to``: ranks of these documents by length, so any quantile is one lookup.

    Between two lengths a limit answers by the next longer row (see :func:`at_limit`). Sums are taken
    in blocks of lengths, then over blocks, so no task holds all lengths. An empty input gives no rows.
    """
    h = histogram.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("bd").over(everything).alias("all_docs"),
        F.sum("bt").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    longer = h.select(
        "block",
        "length",
        "n_docs",
        F.coalesce(F.sum("n_docs").over(inside), F.lit(0)).alias("d"),
        F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("t"),
    ).join(blocks, "block")
    n_longer, tokens_longer = F.col("d") + F.col("docs_after"), F.col("t") + F.col("tokens_after")
    return longer.select(
        "length",
        "n_docs",
        n_longer.alias("n_longer"),
        tokens_longer.alias("tokens_longer"),
        (F.col("all_docs") - n_longer).alias("n_up_to"),
        (F.col("all_tokens") - tokens_longer).alias("tokens_up_to"),
        (F.col("all_tokens") - tokens_longer + F.col("length") * n_longer).alias("truncated_total"),
        (F.col("all_docs") - n_longer - F.col("n_docs") + 1).alias("rank_from"),
        (F.col("all_docs") - n_longer).alias("rank_to"),
    )


def at_limit(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, n_truncated, total_tokens, kept_tokens) for given limits, from the histogram alone."""
    wanted = F.array(*[F.lit(int(x)) for x in limits]).cast("array<long>")
    return histogram.select("*", F.explode(wanted).alias("context_limit")).groupBy("context_limit").agg(
        F.sum(F.when(F.col("length") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("n_truncated"),
        F.sum(F.col("length") * F.col("n_docs")).alias("total_tokens"),
        F.sum(F.least("length", "context_limit") * F.col("n_docs")).alias("kept_tokens"),
    )


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The ``q`` quantile (lower) of the length, one row, from :func:`context_table`."""
    ranked = table.select("length", "rank_from", "rank_to", (F.col("n_up_to") + F.col("n_longer")).alias("n"))
    at = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(float(q))))
    return ranked.where((at >= F.col("rank_from")) & (at <= F.col("rank_to"))).select(F.lit(float(q)).alias("q"), "length")


def token_counts(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text", extra_tokens: int = 0) -> DataFrame:
    """Histogram and suffix sums of ``docs`` in one table (see :func:`context_table`).

    The histogram is written once, as the sums read it twice and encoding is the expensive part.
    Null text: length 0 (plus ``extra_tokens``). Repeated rows count each. Other columns are never read.
    """
    return context_table(materialize(length_histogram(docs, tokenizer, text_col, extra_tokens), "length-histogram"))
