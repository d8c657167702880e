"""Aggregates over a result: buckets, bands, facets, top metrics. Each is one pass with map-side combination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORE_BUCKETS = ("90-100", "80-89", "70-79", "60-69", "<60")


def score_bucket(score: Column) -> Column:
    return F.when(score >= 90, "90-100").when(score >= 80, "80-89").when(score >= 70, "70-79").when(score >= 60, "60-69").otherwise("<60")


def _all_buckets(rows: DataFrame, bucket: Column, names) -> DataFrame:
    """(bucket, n) with every bucket, in one aggregation row unpivoted."""
    counted = rows.agg(*[F.count_if(bucket == n).alias(f"c{i}") for i, n in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(f"c{i}").alias("n")) for i, n in enumerate(names)])
    return counted.select(F.explode(pairs).alias("x")).select("x.bucket", "x.n")


def score_histogram(rows: DataFrame, score: str) -> DataFrame:
    """All five score buckets with their counts."""
    return _all_buckets(rows.where(F.col(score).isNotNull()), score_bucket(F.col(score)), SCORE_BUCKETS)


def verdict(text: Column, score: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.contains("recommend") | (score >= 85), "recommended").when(score >= 75, "shortlist").when(low.contains("reject") | (score < 60), "reject").otherwise("review")


def shares(rows: DataFrame, bucket: Column) -> DataFrame:
    """(bucket, n, percent) of buckets that occur."""
    counted = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select("bucket", "n", F.round(F.col("n") * 100.0 / F.col("total"), 0).cast("long").alias("percent"))


def verdict_distribution(rows: DataFrame, text: str, score: str) -> DataFrame:
    return shares(rows, verdict(F.col(text), F.col(score)))


def experience_band(years_text: Column) -> Column:
    y = F.regexp_extract(years_text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(y < 3, "<3").when(y < 6, "3-6").when(y < 10, "6-10").when(y >= 10, "10+")


def experience_distribution(rows: DataFrame, years_text: str) -> DataFrame:
    return shares(rows.where(experience_band(F.col(years_text)).isNotNull()), experience_band(F.col(years_text)))


def top5_metrics(rows: DataFrame, score: str, years: str, stability: str, name: str, key: str) -> DataFrame:
    """Over the five best: average years (one decimal) and stability (rounded, halves up), best score and its name."""
    top = rows.orderBy(F.desc(score), F.asc(key)).limit(5)
    return top.agg(F.round(F.avg(years), 1).alias("avg_years"), F.floor(F.avg(stability) + 0.5).cast("long").alias("avg_stability"), F.max(score).alias("best_score"), F.max_by(name, F.struct(F.col(score), -F.col(key))).alias("top_name"))


def status_facets(rows: DataFrame, status: str, names) -> DataFrame:
    """Counts of all and of each status (null: new), one row."""
    s = F.coalesce(F.col(status), F.lit("new"))
    return rows.agg(F.count("*").alias("all"), *[F.count_if(s == n).alias(n) for n in names])


def by_source(rows: DataFrame, source: str, name: str, order) -> DataFrame:
    """Names per source in a fixed order of sources, unknown sources last (999)."""
    rank = reduce(lambda e, x: e.when(F.col(source) == x[1], x[0]), enumerate(order), F.when(F.lit(False), 0)).otherwise(999)
    return rows.groupBy(source).agg(F.array_sort(F.collect_set(name)).alias("names"), F.min(rank).alias("rank"))


def completeness(*flags: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("double") for f in flags]) / len(flags)
