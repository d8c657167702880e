"""Ranking: top-k, the bounded judge loop, final order, identity dedup, insights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import GOOD_SCORE


def top_k(scored: DataFrame, k: int, score: str = "rag_score", key: str = "resume_id") -> DataFrame:
    """The k best by score, ties by key; a bounded heap per task, no full sort."""
    return scored.orderBy(F.desc(score), F.asc(key)).limit(k)


def bucket(score: Column) -> Column:
    """0 good, 1 bad, 2 unknown."""
    return F.when(score.isNull(), 2).when(score >= GOOD_SCORE, 0).otherwise(1)


def identity(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")))


def final_ranking(rows: DataFrame, top_n: int, by: str = "job_id", final: str = "llm_score", first: str = "rag_score", name: str = "name", key: str = "resume_id") -> DataFrame:
    """Good, bad, unknown; by final score (unknown: by first score); one row per identity (blank ones all stay); the first ``top_n`` per job, with rank and total.

    Rows without a name, and those named unknown, are left out; ``total`` counts the job's ranked rows.
    """
    known = rows.where(F.coalesce((F.col(name) != "") & (F.lower(F.trim(F.col(name))) != "unknown"), F.lit(False)))
    b = bucket(F.col(final))
    order = [F.asc("bucket"), F.desc("order_score"), F.asc(key)]
    keyed = known.withColumn("bucket", b).withColumn("order_score", F.when(b == 2, F.col(first)).otherwise(F.col(final))).withColumn("identity", identity(F.col(name)))
    # blank identities are told apart by their keys, so that they form no hot group
    who = F.when(F.col("identity") == "", F.concat(F.lit("#"), F.col(key).cast("string"))).otherwise(F.col("identity"))
    once = keyed.withColumn("nth", F.row_number().over(Window.partitionBy(by, who).orderBy(*order))).where("nth = 1")
    totals = once.groupBy(by).agg(F.count("*").alias("total"))
    # the rank is filtered right above its window, so that each task hands on the first top_n alone
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= top_n)
    return ranked.join(totals, by).drop("nth", "identity", "order_score")


def judge_batches(rows: DataFrame, size: int = 3, by: str = "job_id", score: str = "rag_score", key: str = "resume_id") -> DataFrame:
    """Rank, total and batch number (``size`` candidates each) per job."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(key))
    return rows.withColumn("rank", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy(by))).withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("long"))


def merge_evaluations(rows: DataFrame, evaluations: DataFrame, key: str = "resume_id") -> DataFrame:
    """Evaluations (resume_id, pos, final_score, strengths, concerns) onto candidates: of repeated ones the last counts, missing ones score 0 with the fallback text."""
    last = evaluations.groupBy(key).agg(*[F.max_by(c, "pos").alias(c) for c in ("final_score", "strengths", "concerns")])
    out = rows.join(last, key, "left")
    return out.withColumn("llm_score", F.coalesce("final_score", F.lit(0)).cast("int")).withColumn("concerns", F.coalesce("concerns", F.lit("Evaluation missing"))).drop("final_score")


def backfill(scored: DataFrame, judge: Callable[[DataFrame], DataFrame], top_n: int, rounds: int = 3, write: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Judge candidates in rounds until ``top_n`` are good or none is left.

    ``scored``: resume_id, rag_score, status and llm_score (null: not judged). A round takes the next
    max(5, 3 * missing) unjudged new candidates by rag_score, so rounds take disjoint ranges of one order.
    Each round is one bounded action; ``write`` (a table in a shared folder by default nothing) cuts lineage.
    """
    new = scored.where(F.coalesce("status", F.lit("new")) == "new")
    good = new.where(F.col("llm_score") >= GOOD_SCORE).count()
    waiting = new.where("llm_score is null").orderBy(F.desc("rag_score"), F.asc("resume_id"))
    taken, judged = 0, None
    for _ in range(rounds):
        if good >= top_n:
            break
        n = max(5, 3 * (top_n - good))
        part = waiting.offset(taken).limit(n)
        result = judge(part)
        result = write(result) if write else result
        found = result.agg(F.count("*").alias("n"), F.count_if(F.col("llm_score") >= GOOD_SCORE).alias("good")).first()
        judged = result if judged is None else judged.unionByName(result)
        taken, good = taken + n, good + found["good"]
        if found["n"] < n:
            break
    if judged is None:
        return scored
    scores = judged.select("resume_id", F.col("llm_score").alias("new_score"))
    return scored.join(scores, "resume_id", "left").withColumn("llm_score", F.coalesce("new_score", "llm_score")).drop("new_score")


def delta_candidates(resumes: DataFrame, edges: DataFrame, job_id) -> DataFrame:
    """Resumes without a scored edge to the job."""
    return resumes.join(edges.where((F.col("job_id") == job_id) & F.col("rag_score").isNotNull()).select("resume_id"), "resume_id", "left_anti")


def insights(rows: DataFrame) -> DataFrame:
    """Bottleneck skill and pool strength of a result (title_score 0-100, missing array, llm_score): type, related_skill, affected_count."""
    pool = rows.agg(F.count("*").alias("n"), F.count_if(F.col("title_score") >= 50).alias("relevant"), F.max("llm_score").alias("best"), F.count_if(F.col("llm_score") >= GOOD_SCORE).alias("strong"))
    skills = rows.where("title_score >= 50").select(F.explode("missing").alias("skill")).groupBy("skill").count().orderBy(F.desc("count"), "skill").limit(1)
    bottleneck = skills.join(pool).where((F.col("n") >= 5) & (F.col("relevant") >= 3) & (F.col("count") >= 3) & (F.col("count") >= 0.5 * F.col("relevant")))
    strength = pool.where("n >= 5").select(F.when(F.col("best") < 55, "weak_pool").when(F.col("strong") >= 1, "strong_pool").alias("type"), F.lit(None).cast("string").alias("related_skill"), F.col("strong").alias("affected_count")).where("type is not null")
    return bottleneck.select(F.lit("bottleneck").alias("type"), F.col("skill").alias("related_skill"), F.col("count").alias("affected_count")).unionByName(strength)
