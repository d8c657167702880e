"""Table scans with predicates and columns that reach the Parquet reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 100_000


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def ready(resumes: DataFrame) -> DataFrame:
    """Records with an extraction whose status is neither duplicate nor error (null statuses drop out, as in SQL)."""
    return resumes.where(F.col("extraction").isNotNull() & ~F.col("status").isin("duplicate", "error"))


def ids(resumes: DataFrame) -> DataFrame:
    return ready(resumes).select("id")


def by_keys(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Point lookups of many keys at once; the keys are broadcast while they are few."""
    keys = wanted.select(key).distinct()
    few = keys.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return table.join(F.broadcast(keys) if few else keys, key, "left_semi")


def in_order(table: DataFrame, wanted: list, key: str) -> DataFrame:
    """Rows of the wanted keys in the order asked for; keys without a row are left out."""
    pos = table.sparkSession.createDataFrame([(k, i) for i, k in enumerate(wanted)], f"{key} {table.schema[key].dataType.simpleString()}, pos int")
    return table.join(F.broadcast(pos), key).orderBy("pos")


def paged(table: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page, newest first or by whatever order that ends in a unique key."""
    return table.orderBy(*order).offset(offset).limit(limit)


def paged_with_total(table: DataFrame, order: list[Column], offset: int, limit: int) -> tuple[DataFrame, int]:
    return paged(table, order, offset, limit), table.count()
