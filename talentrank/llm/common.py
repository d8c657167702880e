"""Shared plumbing: the shared working folder, written intermediate tables, null-safe columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row numbers that are broadcast at most.
FEW_ROWS = 1_000_000
#: Spark's setting by which a query's shuffle files are deleted as it ends, not when the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ASCII white space of the word contract: a word is a run of other characters.
WORD = r"[^\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a local master gets a temporary folder, and a cluster, whose machines don't share one, an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="talentrank-work-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses; Hadoop deletes it as the application ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once as a compressed table in the shared folder and read back, and its path. The write's shuffle files go as it ends."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a compressed table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read, never a recomputation,
    and makes what follows independent of how the input happened to be dealt out.
    """
    return written(df, name)[0]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a finished intermediate table early."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _places(df: DataFrame) -> Column | None:
    """struct<file_path, row_index> of each row if ``df`` is a plain scan of Parquet files, each read once, with projections and filters at most; else none."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic() or plan.isStreaming():
        return None
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation" or plan.relation().fileFormat().toString() != "Parquet":
        return None
    files = list(plan.relation().location().inputFiles())
    return df.metadataColumn("_metadata") if len(set(files)) == len(files) else None


def with_row_ids(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` with a number per row that each reading gives again, and that column's name, which no column of ``df`` has.

    Rows of Parquet files are numbered by file and place, and stay where they are; of anything else a numbered copy is written.
    """
    row = "_row"
    while row.lower() in {c.lower() for c in df.columns}:
        row = f"_{row}"
    place = _places(df)
    if place is None:
        return materialize(df.withColumn(row, F.monotonically_increasing_id()), name), row
    spark, own = df.sparkSession, [F.col(f"`{c}`") for c in df.columns]
    files = sorted(r[0] for r in df.select(place["file_path"]).distinct().collect())  # no more than the scan's own list of files
    path, number = f"{row}_path", f"{row}_file"
    numbers = spark.createDataFrame(list(zip(files, range(len(files)), strict=True)), f"{path} string, {number} long")
    placed = df.select(*own, place["file_path"].alias(path), place["row_index"].alias(row))
    return placed.join(F.broadcast(numbers), path).select(*own, (F.shiftleft(number, 40) + F.col(row)).alias(row)), row


def without(held: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """``held`` without the rows whose number ``row`` is in ``gone``.

    The numbers are written and counted: up to FEW_ROWS of them (8 bytes each) are broadcast, so no text is dealt out; more are joined by number.
    """
    gone = materialize(gone.select(row), "gone")
    return held.join(F.broadcast(gone) if gone.count() <= FEW_ROWS else gone, row, "left_anti")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(key: str, modulus: int, remainder: int = 2) -> Column:
    """crc32(key as text) mod ``modulus`` = ``remainder``; a null key counts as the text ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
