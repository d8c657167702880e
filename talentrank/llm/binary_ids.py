"""Token ids as files: frequency-ranked ids in byte-aligned variable-length coding.

An id is replaced by its rank by frequency (0: the most frequent) and written in one to four bytes,
little-endian. The lengths stand apart, in control bytes: two bits per id, four ids per byte, the
first id in the lowest bits. Decoding is table lookup: a control byte gives the places of its data
bytes, so numpy fills all ids of a batch at once.

The files are Parquet, one row per document in ascending order of its id, written by Spark's
committer (a lost executor leaves no half files): ``shard``, ``pos``, ``doc_id``, ``n_tokens``,
``control``, ``data``. ``ranks`` beside them holds the id of each rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop_path, new_path, text_of
from .encoders import encoder, in_runs, public_path

#: Bytes of waiting ids in a range of documents that one task writes.
RANGE_BYTES = 128 << 20
#: By control byte: which of the 4 x 4 byte places of its ids are filled.
PLACES = np.array([[place <= (c >> 2 * i & 3) for i in range(4) for place in range(4)] for c in range(256)], dtype=bool)
#: By control byte: the bytes of its longest id.
WIDEST = PLACES.reshape(256, 4, 4).sum(2).max(1)


def code(ranks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, their ends per document, data bytes, their ends) of some documents' ranks (below 2**32) in a row."""
    quads = -(-lengths // 4)
    filled = _filled(quads, lengths)
    r = np.zeros(len(filled), "<u4")
    r[filled] = ranks
    codes = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    q = codes.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    wide = int(codes.max(initial=0)) + 1  # places that any rank here fills
    data = r.view(np.uint8).reshape(-1, 4)[:, :wide][(np.arange(wide, dtype=np.uint8) <= codes[:, None]) & filled[:, None]]
    widths = np.concatenate([[0], np.cumsum((codes + 1) * filled, dtype=np.int64)])
    ends = np.cumsum(quads)
    return control, ends, data, widths[4 * ends]


def decode(control: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranks of some documents in a row, by table lookup; places after a document's last id hold no byte."""
    filled = _filled(-(-lengths // 4), lengths)
    wide = int(WIDEST[control].max(initial=1))
    places = PLACES[control].reshape(-1, 4)[:, :wide] & filled[:, None]
    out = np.zeros((len(filled), 4), np.uint8)
    out[:, :wide][places] = data
    return out.view("<u4").ravel()[filled]


def _filled(quads: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which places of all quads hold an id: all but up to three after each document's last."""
    out = np.ones(4 * int(quads.sum()), bool)
    last = 4 * np.cumsum(quads)
    for k in (1, 2, 3):
        out[last[4 * quads - lengths >= k] - k] = False
    return out


def encode_ranks(ranks: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """(control, data) per document."""
    control, control_ends, data, data_ends = code(ranks, lengths)
    cut = lambda x, ends: [x[i:j].tobytes() for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]
    return cut(control, control_ends), cut(data, data_ends)


def decode_ranks(control: list[bytes], data: list[bytes], lengths: np.ndarray) -> np.ndarray:
    return decode(np.frombuffer(b"".join(control), np.uint8), np.frombuffer(b"".join(data), np.uint8), lengths)


def flat(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column without nulls, without a copy."""
    wide = pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of bytes in a row, without a copy."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def short(batch: pa.RecordBatch, ids: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many ids, which bounds what a worker holds at once."""
    runs = np.cumsum(batch.column("n_tokens").to_numpy()) // ids
    cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if i < j:
            yield batch.slice(i, j - i)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write them to ``path`` in ascending order of their ids.

    A null or empty text is the end id alone; null ids come first; repeated ids lie side by side.
    Each text is encoded once: its ids wait in a written table while all ids are counted. The counts,
    one row per task, are one number per vocabulary entry, which bounds what goes to the driver and back.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or public_path("word_bpe_49k.json")
    id_type = docs.schema[id_col].dataType
    raw = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = "<u2" if enc.vocab_size <= 1 << 16 else "<u4"
        total = np.zeros(max(enc.vocab_size, end_id + 1), np.int64)
        for batch in batches:
            ids, sizes = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
            for run in in_runs(batch.column(1).to_pylist()):
                found, n = enc.joined(run, end_id)
                total += np.bincount(found, minlength=len(total))
                ids.append(found.astype(kind))
                sizes.append(n)
            data, n = np.concatenate(ids), np.concatenate(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), binary(data, np.cumsum(n) * data.itemsize), pa.nulls(len(n), pa.binary())], names=raw.names)
        # the last row has how often the task met each id
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind_of), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=raw.names)

    kind_of = to_arrow_type(id_type)
    encoded_path = new_path(spark, "encoded")
    docs.select(F.col(id_col), text_of(text_col).cast("binary").alias("t")).mapInArrow(encode, raw).write.option("compression", "snappy").parquet(encoded_path)
    encoded = spark.read.schema(raw).parquet(encoded_path)

    def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch in a row, and the documents' lengths."""
        ids, n = flat(batch.column("ids")), batch.column("n_tokens").to_numpy()
        return ids.view("<u2" if len(ids) == 2 * n.sum() else "<u4"), n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for c in batch.column(0).to_pylist():
                total = total + np.frombuffer(c, np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    counted = encoded.where("counts is not null").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values(["n", "id"], ascending=[False, True])
    by_rank = counted["id"].to_numpy(np.int64)
    spark.createDataFrame(counted.reset_index(drop=True).rename_axis("rank").reset_index(), "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros((int(by_rank.max()) if len(by_rank) else 0) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    shared = spark.sparkContext.broadcast(rank_of)
    form = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for whole in batches:
            for batch in short(whole):
                ids, n = unpack(batch)
                control, control_ends, data, data_ends = code(ranks[ids], n)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), binary(control, control_ends), binary(data, data_ends)], names=form.names)

    # ranges follow the bytes to be written, so a task's share stays the same at any size
    id_bytes = int(counted["n"].sum()) * (2 if len(rank_of) <= 1 << 16 else 4)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-id_bytes // RANGE_BYTES))
    # ranges are drawn from the plain scan, before any id is coded
    dealt = encoded.where("counts is null").drop("counts").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "n_tokens")
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens").mapInArrow(write, form)
    placed = ordered.select(F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("pos"), *form.names)
    placed.write.option("compression", "none").parquet(f"{path}/ids")
    drop_path(spark, encoded_path)


def _decoded(spark: SparkSession, path: str, column: T.StructField, finish: Callable[[bytes], object]) -> DataFrame:
    """doc_id, start, n_tokens and what ``finish`` makes of each document's ids, from the files."""
    stored = spark.read.parquet(f"{path}/ids")
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").toLocalIterator()], "<u4")
    shared = spark.sparkContext.broadcast(by_rank)
    kept = ["shard", "pos", "doc_id", "n_tokens"]
    form = T.StructType([*(stored.schema[c] for c in kept), column])
    kind = pa.binary() if isinstance(column.dataType, T.BinaryType) else pa.int64()

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for whole in batches:
            for batch in short(whole):
                n = batch.column("n_tokens").to_numpy()
                found = memoryview(ids[decode(flat(batch.column("control")), flat(batch.column("data")), n)].tobytes())
                ends = (4 * np.cumsum(n)).tolist()
                made = [finish(found[i:j]) for i, j in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, kind)], names=form.names)

    read = stored.mapInArrow(read_back, form)
    shards = stored.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    within = read.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return within.join(shards, "shard").select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", column.name)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    return _decoded(spark, path, T.StructField("ids", T.BinaryType()), bytes)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_ids`, with ``ids_crc32`` in place of the ids, which never leave the task that decodes them."""
    return _decoded(spark, path, T.StructField("ids_crc32", T.LongType()), zlib.crc32)
