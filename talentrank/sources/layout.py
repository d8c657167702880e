"""Reading order of positioned text: lines from words, columns from blocks. Pure DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bind


def lines_from_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, text): words of one rounded y, left to right."""
    return words.groupBy(*keys, F.round("y0").alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("text"))


def split_columns(blocks: DataFrame, width: str = "page_width") -> DataFrame:
    """The column split of each (doc, page): the first x from 25 % to 75 % of the width, by 5, that fewest blocks cross."""
    pages = blocks.groupBy("doc", "page").agg(F.max(width).alias("w"), F.collect_list(F.struct("x0", "x1")).alias("b"), F.count("*").alias("n"))
    tries = F.transform(F.sequence(F.floor(F.col("w") * 0.25), F.floor(F.col("w") * 0.75), F.lit(5).cast("long")), lambda x: F.struct(F.size(F.filter("b", lambda e: (e["x0"] < x) & (e["x1"] > x))).alias("crossings"), x.alias("split")))
    best = pages.select("doc", "page", "n", bind(tries, F.array_min).alias("best"))
    return best.select("doc", "page", F.col("best.split").alias("split"), F.col("best.crossings").alias("crossings"), "n")


def reading_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` (doc, page, x0, y0, x1, y1, text, page_width) with their ``position`` in reading order.

    Many crossings: rows by rounded y. Else bands between blocks that span the split (a block is in a band
    by its vertical centre), and in each band the left column before the right one.
    """
    b = blocks.join(split_columns(blocks), ["doc", "page"])
    single = F.col("crossings") > F.greatest(F.lit(3), F.col("n") * 0.1)
    spanning = (F.col("x0") < F.col("split")) & (F.col("x1") > F.col("split"))
    centre = (F.col("y0") + F.col("y1")) / 2
    w = Window.partitionBy("doc", "page").orderBy(centre, "x0")
    b = b.withColumn("spanning", spanning & ~single).withColumn("band", F.sum(F.col("spanning").cast("int")).over(w))
    column = F.when(F.col("spanning"), 0).when((F.col("x0") + F.col("x1")) / 2 < F.col("split"), 1).otherwise(2)
    order = F.when(single, F.struct(F.lit(0).cast("long").alias("a"), (F.round(F.col("y0") / 10) * 10).alias("b"), F.col("x0").alias("c"), F.lit(0.0).alias("d"))).otherwise(F.struct(F.col("band").alias("a"), column.cast("double").alias("b"), F.col("y0").alias("c"), F.col("x0").alias("d")))
    placed = b.withColumn("position", F.row_number().over(Window.partitionBy("doc", "page").orderBy(order)))
    return placed.select("doc", "page", "position", "text")


def page_text(ordered: DataFrame) -> DataFrame:
    pages = ordered.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda t: t["text"]), "\n").alias("text"))
    return pages.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda t: t["text"]), "\n").alias("parsed_text"))
