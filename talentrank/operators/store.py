"""Mutations as new snapshots: upsert, partial update, delete with cascade, invalidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], now: Column, new_values: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``changes`` over those of ``table``: null keeps the old value; new rows get ``new_values`` where null; changed rows get ``updated_at`` = now."""
    columns = table.columns
    have = [c for c in columns if c in changes.columns and c not in keys]
    incoming = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in have], F.lit(True).alias("_changed"))
    joined = table.withColumn("_old", F.lit(True)).join(incoming, keys, "full")

    def value(c: str) -> Column:
        if c == "updated_at":
            return F.when(F.col("_changed"), now).otherwise(F.col(c))
        out = F.coalesce(f"_new_{c}", c) if c in have else F.col(c)
        return F.when(F.col("_old").isNull(), F.coalesce(out, new_values[c])).otherwise(out) if new_values and c in new_values else out

    return joined.select(*keys, *[value(c).alias(c) for c in columns if c not in keys])


def last_write_wins(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row per key (ties by the last order column); combines in the map tasks."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def delete(table: DataFrame, ids: DataFrame, key: str, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """The table and its child tables without the ids."""
    gone = ids.select(F.col(key).alias("_gone")).distinct()
    return [t.join(gone, t[c] == gone["_gone"], "left_anti") for t, c in ((table, key), *children)]


def invalidate(edges: DataFrame, changed_jobs: DataFrame) -> DataFrame:
    """Edges of changed jobs without any stage-two result."""
    hit = edges.join(changed_jobs.select("job_id").distinct().withColumn("_hit", F.lit(True)), "job_id", "left")
    return hit.select(*[F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(c)).cast(edges.schema[c].dataType).alias(c) if c in ("match_score", "llm_score", "analysis") else F.col(c) for c in edges.columns])


def needs_analysis(old_description: Column, new_description: Column, old_free: Column, new_free: Column, manual: Column) -> Column:
    """The text changed and no manual analysis came with it."""
    return (~old_description.eqNullSafe(new_description) | ~old_free.eqNullSafe(new_free)) & manual.isNull()


def replace(table: DataFrame, path: str) -> None:
    """Write a new snapshot beside the old one and swap them by two renames, between which (or after a crash there) only ``path``.old exists; see :func:`publish`."""
    spark = table.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    table.write.mode("overwrite").parquet(f"{path}.next")
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop(f"{path}.old"), True)
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(f"{path}.old"))
    fs.rename(hadoop(f"{path}.next"), hadoop(path))
    fs.delete(hadoop(f"{path}.old"), True)


def publish(table: DataFrame, path: str) -> str:
    """Write a new version under ``path`` and make it the current one; returns its folder.

    Readers (:func:`current`) always find a whole version: the pointer is a file that names a version that is written, and
    a newer pointer has a larger number. A crash leaves the former version current. Old versions stay until removed.
    """
    spark = table.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    number = _newest(spark, path) + 1
    target = f"{path}/version={number}"
    while fs.exists(hadoop(target)):  # of a writer that crashed before its pointer
        number += 1
        target = f"{path}/version={number}"
    table.write.parquet(target)
    fs.mkdirs(hadoop(f"{path}/_pointers"))
    if not fs.createNewFile(hadoop(f"{path}/_pointers/{number}")):
        raise FileExistsError(f"{path}: version {number} was published by another writer")
    return target


def _newest(spark, path: str) -> int:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(f"{path}/_pointers")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max((int(f.getPath().getName()) for f in fs.listStatus(folder)), default=0) if fs.exists(folder) else 0


def current(spark, path: str) -> DataFrame:
    """The current version of a table that :func:`publish` writes."""
    number = _newest(spark, path)
    if not number:
        raise FileNotFoundError(f"{path}: nothing published")
    return spark.read.parquet(f"{path}/version={number}")
