"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two (the sequence length as often
as it fits, then the binary digits of the rest, longest first). Each piece is a sequence of its own
and equal lengths form one bucket, so batches need no padding and no sequence crosses documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_of
from .encoders import encoder, in_runs, public_path

#: Rows of piece counts (20 bytes each) that are broadcast at most.
BROADCAST_ROWS = 500_000


def piece_lengths(n: int, sequence: int) -> list[int]:
    """Powers of two, longest first, that add up to ``n``, none above ``sequence`` (itself a power of two)."""
    whole, rest = divmod(n, sequence)
    return [sequence] * whole + [1 << b for b in range(sequence.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most ``sequence`` ids.

    Returns one row per piece: ``doc_id``, ``start`` and ``length`` of the piece in its document's ids,
    ``ids`` (little-endian unsigned 32-bit), ``doc_tokens`` (with the end id), ``bucket`` (log2 of the
    length), ``sequence_id`` (dense, bucket after bucket) and ``offset`` (0: a piece starts its sequence).
    A null or empty text is the end id alone. Repeated rows and null ids are documents of their own;
    other columns are not read. An empty table gives an empty result.

    Texts are encoded where they are read, without a shuffle. Sequence ids come from the number of pieces
    per task and bucket, a table as long as the number of tasks times the number of buckets.
    """
    if sequence < 1 or sequence & (sequence - 1):
        raise ValueError("sequence must be a power of two")
    tokenizer = tokenizer or public_path("byte_bpe_50k.json")
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("nth", T.LongType()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        seen = [0] * sequence.bit_length()
        for batch in batches:
            rows, starts, lengths, ids, totals, buckets, nth = [], [], [], [], [], [], []
            texts = batch.column(1).to_pylist()
            for row, found in enumerate(x for run in in_runs(texts) for x in enc.many(run)):
                data = np.append(found, np.uint32(end_id)).astype("<u4").tobytes()
                n, at = len(data) // 4, 0
                for k in piece_lengths(n, sequence):
                    b = k.bit_length() - 1
                    rows.append(row)
                    starts.append(at)
                    lengths.append(k)
                    ids.append(data[4 * at : 4 * (at + k)])
                    totals.append(n)
                    buckets.append(b)
                    nth.append(seen[b])
                    seen[b] += 1
                    at += k
            longs = (pa.array(x, pa.int64()) for x in (starts, lengths, totals, nth))
            s, n, d, k = longs
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), s, n, pa.array(ids, pa.binary()), d, pa.array(buckets, pa.int32()), k], names=schema.names)

    pieces = docs.select(F.col(id_col), text_of(text_col).alias("t")).mapInArrow(cut, schema)
    pieces = materialize(pieces.withColumn("task", F.spark_partition_id()), "pieces")
    counts = materialize(pieces.groupBy("bucket", "task").agg(F.count("*").alias("n")), "piece-counts")
    before = Window.orderBy("bucket", "task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("bucket", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # tasks times buckets rows; beyond the bound the pieces are dealt out by task and bucket
    first = F.broadcast(first) if counts.count() <= BROADCAST_ROWS else first
    return pieces.join(first, ["bucket", "task"]).select(
        "doc_id", "start", "length", "ids", "doc_tokens", "bucket",
        (F.col("first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
