"""The match run: score, judge in rounds, order, insights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranking, scoring
from . import providers


def run_match(candidates: DataFrame, jobs: DataFrame, edges: DataFrame | None = None, top_n: int = 10, write: Callable[[DataFrame], DataFrame] | None = None, judge=providers.rubric_judge) -> tuple[DataFrame, DataFrame]:
    """(ranking, insights) of one job over its candidates.

    ``candidates`` as in :func:`scoring.score_candidates` plus ``name``; ``edges`` (resume_id, status,
    llm_score) hold what is known of earlier runs. The scored table is written once and read by all rounds.
    """
    scored = scoring.score_candidates(candidates, jobs)
    if edges is not None:
        scored = scored.join(edges.select("resume_id", "status", "llm_score"), "resume_id", "left")
    else:
        scored = scored.withColumns({"status": F.lit("new"), "llm_score": F.lit(None).cast("int")})
    names = candidates.select("resume_id", "name")
    scored = scored.join(names, "resume_id")
    scored = write(scored) if write else scored

    def ask(part: DataFrame) -> DataFrame:
        rows = ranking.judge_batches(part).select(
            "resume_id", "batch", F.col("skills.score").alias("skills_score"), F.coalesce(F.col("best_title.score"), F.lit(0.0)).alias("title_score"),
            F.col("experience.score").alias("experience_score"), (F.col("skills.simple") / 100).alias("content_overlap"),
        )
        return part.drop("llm_score").join(providers.judge(rows, judge), "resume_id")

    judged = ranking.backfill(scored, ask, top_n, write=write)
    ranked = ranking.final_ranking(judged, top_n)
    facts = judged.select(F.coalesce(F.col("best_title.score"), F.lit(0.0)).alias("title_score"), F.col("skills.missing").alias("missing"), "llm_score")
    return ranked, ranking.insights(facts)
