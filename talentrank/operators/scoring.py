"""Candidate scores: skills, experience, stability, title and their ensemble. All are expressions; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.arrays import bind, difference_ci, max_wins
from ..functions.dates import years_stability
from ..functions.rules import features_boost, has_led, title_features
from ..functions.text import hard_skills, normalize_skill
from ..functions.vector import cosine100

#: Jobs that are scored at a time.
MOST_JOBS = 1000


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def skill_weight(source: Column) -> Column:
    """1 for skills used at work, else 0.6."""
    return F.when(source.isin("work_experience", "experience"), 1.0).otherwise(dims.LISTED_SKILL_WEIGHT)


def skill_weights(skills: Column, weighed: bool = False) -> Column:
    """array<struct<name,source,..>> to map of lower canonical name to the largest weight. ``weighed``: a skill's own ``weight`` counts, its source only where that is null."""
    by_source = lambda s: skill_weight(F.coalesce(s["source"], F.lit("")))
    weight = (lambda s: F.coalesce(s["weight"], by_source(s))) if weighed else by_source
    pairs = F.transform(F.filter(skills, lambda s: F.trim(s["name"]) != ""), lambda s: F.struct(F.lower(normalize_skill(s["name"])).alias("k"), weight(s).alias("w")))
    return F.map_from_entries(F.transform(max_wins(pairs, lambda x: x["k"], lambda x: x["w"]), lambda x: F.struct(x["k"], x["w"])))


def prepare_requirements(analysis: Column) -> Column:
    """struct<required, nice, bonus>: hard skills of must-haves and the tech stack less the nice-to-haves; bonus = nice and additional skills."""
    stack = lambda k: F.coalesce(F.try_element_at(analysis["tech_stack"], F.lit(k)), _no_strings())
    nice = F.coalesce(analysis["skills"]["nice_to_have"], _no_strings())
    wanted = F.array_distinct(F.concat(F.coalesce(analysis["skills"]["must_have"], _no_strings()), *[stack(k) for k in ("languages", "frameworks", "databases", "cloud", "tools", "business")]))
    return F.struct(
        difference_ci(hard_skills(wanted), nice).alias("required"), nice.alias("nice"),
        F.array_sort(F.array_distinct(F.concat(nice, F.coalesce(analysis["additional_skills"], _no_strings())))).alias("bonus"),
    )


def skills_score(required: Column, bonus: Column, weights: Column, text: Column | None = None) -> Column:
    """struct<score, base, bonus, simple, matched, missing>.

    A required skill counts its weight; one that only the text has counts 1; bonus skills add up to 15.
    """
    text = F.lit(None).cast("string") if text is None else text
    key = lambda s: F.lower(normalize_skill(s))
    escaped = lambda s: F.regexp_replace(F.regexp_replace(F.trim(s), r"([\\.\[\]{}()*+?^$|])", r"\\$1"), r"\s+", r"\\s+")
    in_text = lambda s: F.rlike(text, F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])"), escaped(s), F.lit(r"(?![\p{L}\p{N}_])")))
    each = F.transform(F.array_distinct(required), lambda s: F.struct(s.alias("skill"), F.coalesce(F.try_element_at(weights, key(s)), F.when(in_text(s), 1.0)).alias("w")))
    extra = F.aggregate(F.transform(F.array_distinct(bonus), lambda s: F.coalesce(F.try_element_at(weights, key(s)), F.lit(0.0))), F.lit(0.0), lambda a, x: a + 0.5 * x)

    def score(e: Column) -> Column:
        n = F.size(e)
        have = F.filter(e, lambda x: x["w"].isNotNull())
        total = F.aggregate(have, F.lit(0.0), lambda a, x: a + x["w"])
        base, plus = F.when(n == 0, 100.0).otherwise(100.0 * total / n), F.least(10.0 * extra, F.lit(15.0))
        return F.struct(
            F.least(base + plus, F.lit(100.0)).alias("score"), base.alias("base"), plus.alias("bonus"), F.when(n == 0, 100.0).otherwise(100.0 * F.size(have) / n).alias("simple"),
            F.transform(have, lambda x: x["skill"]).alias("matched"), F.transform(F.filter(e, lambda x: x["w"].isNull()), lambda x: x["skill"]).alias("missing"),
        )

    return bind(each, score)


def experience_score(years: Column, required: Column) -> Column:
    ratio = years / required
    return (
        F.when(years.isNull() | (years <= 0), F.when(F.coalesce(required, F.lit(0)) <= 0, 0.5).otherwise(0.0)).when(F.coalesce(required, F.lit(0)) <= 0, 1.0)
        .when(ratio < 0.5, 0.05).when(ratio < 1, 0.2 + 1.6 * (ratio - 0.5)).when((required < 5) & (years > 3 * required), 0.75).otherwise(1.0)
    )


def experience_verdict(years: Column, required: Column) -> Column:
    return (
        F.when(F.coalesce(required, F.lit(0)) <= 0, "no_requirement").when(years < 0.5 * required, "significantly_under_qualified").when(years < required, "slightly_under_qualified")
        .when(years <= 1.5 * required, "perfect_match").when(years <= 1.5 * required + 2, "moderately_over_qualified").otherwise("significantly_over_qualified")
    )


def primary_years(meta: Column, is_tech: Column, fallback: Column) -> Column:
    """Years in the job's bucket; where these are none or 0, 0.7 of the largest other bucket; where no bucket says anything, the stated years."""
    at = lambda m, k: F.try_element_at(meta[m], F.lit(k))
    stated = lambda k: F.coalesce(at("recommended_primary_years", k), at("totals_by_category", k))
    held = lambda k: F.coalesce(F.nullif(at("recommended_primary_years", k), F.lit(0.0)), at("totals_by_category", k), F.lit(0.0))
    tech = F.coalesce(is_tech, F.lit(True))
    own = F.when(tech, stated("tech")).otherwise(stated("other"))
    second = F.when(tech, F.greatest(held("other"), held("military"))).otherwise(held("tech"))
    return F.when(F.coalesce(own, F.lit(0.0)) != 0, own).when(second > 0, 0.7 * second).otherwise(F.coalesce(own, fallback, F.lit(0.0)))


def experience_detail(years: Column, required: Column, has_history: Column) -> Column:
    """struct<score, verdict, years, required>: unknown (no) years with a work history count one half, whatever is required."""
    known, needed = F.coalesce(years, F.lit(0.0)), F.coalesce(required, F.lit(0)).cast("double")
    unknown = (known == 0) & has_history
    return F.struct(
        F.round(F.when(unknown, 0.5).otherwise(experience_score(known, needed)), 3).alias("score"),
        F.when(unknown, "years_unknown").otherwise(experience_verdict(known, needed)).alias("verdict"), F.round(known, 1).alias("years"), F.round(needed, 1).alias("required"),
    )


def cluster_keys(clusters: Column) -> Column:
    """title|start of the members of tech clusters, lower-cased titles."""
    members = F.flatten(F.transform(F.filter(F.coalesce(clusters, F.array()), lambda c: c["category"] == "tech"), lambda c: F.coalesce(c["members"], F.array())))
    return F.transform(F.filter(members, lambda m: F.trim(m["title"]) != ""), lambda m: role_key(m["title"], m["start_date"]))


def role_key(title: Column, start: Column) -> Column:
    return F.concat(F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lit("|"), F.trim(F.coalesce(start, F.lit(""))))


def tenures(experience: Column, clusters: Column, now: Column) -> Column:
    """Durations in years, in the roles' order, of tech roles (with technologies, or members of a tech cluster); of all roles if none of these has one."""

    def chosen(keys: Column) -> Column:
        roles = F.transform(F.coalesce(experience, F.array()), lambda e: F.struct(
            F.coalesce(e["duration_years"], years_stability(e["start_date"], e["end_date"], now)).alias("y"),
            (F.coalesce(F.size(e["tech"]) > 0, F.lit(False)) | F.array_contains(keys, role_key(e["title"], e["start_date"]))).alias("tech"),
        ))
        held = lambda r: F.filter(r, lambda x: x["y"].isNotNull())
        years = lambda r: F.transform(r, lambda x: x["y"])
        return bind(held(roles), lambda r: bind(F.filter(r, lambda x: x["tech"]), lambda t: years(F.when(F.size(t) > 0, t).otherwise(r))))

    return bind(cluster_keys(clusters), chosen)


def stability_score(durations: Column, experience: Column) -> Column:
    """Employment stability from durations in years (oldest first) and total experience: 0.5 without durations, else penalties and bonuses on 1, within 0 and 1."""
    d = F.filter(durations, lambda x: x.isNotNull())
    exp = F.coalesce(experience, F.lit(0.0))

    def score(x: Column) -> Column:
        n = F.size(x)
        avg = F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / n
        count = lambda p: F.size(F.filter(x, p))
        expected = F.when(exp < 3, 2.0).when(exp < 6, 3.0).otherwise(4.0)
        short, medium, tiny = count(lambda y: y < 1.5), count(lambda y: (y >= 1.5) & (y < 2.5)), count(lambda y: y < 0.5)
        junior_many, junior_two = (exp <= 2) & (n >= 3), (exp <= 2.5) & (n == 2) & (avg < 1.3)
        not_junior = exp >= 3
        parts = [
            F.when(junior_many, -0.25).when(junior_two, -0.20).otherwise(0.0), F.when(not_junior & (avg < 1.8), -0.15).otherwise(0.0),
            F.when(short >= 3, -0.25).when(short == 2, -0.20).when(short == 1, -0.10).otherwise(0.0), F.when(medium >= 2, -0.10).otherwise(0.0), -0.10 * tiny,
            F.when(avg >= expected, 0.0).when(avg / expected <= 0.5, -0.25).when(avg / expected <= 0.7, -0.15).otherwise(0.0),
            F.when((n >= 3) & (exp > 0) & (exp / n < 2), -0.15).otherwise(0.0), F.when(count(lambda y: y >= 4) > 0, 0.10).otherwise(0.0),
            F.when((n >= 2) & F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(x, i - 1) <= F.coalesce(F.get(x, i), F.get(x, i - 1))), 0.10).otherwise(0.0),
            F.when(count(lambda y: (y >= 2) & (y <= 4)) >= 2, 0.05).otherwise(0.0), F.when(avg >= 1.2 * expected, 0.05).otherwise(0.0),
        ]
        total = F.lit(1.0)
        for p in parts:
            total = total + p
        return F.when(n == 0, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))

    return F.when(durations.isNull(), 0.5).otherwise(bind(d, score))


def stability_verdict(score: Column) -> Column:
    return (
        F.when(score >= 0.9, "excellent_stability").when(score >= 0.8, "good_stability").when(score >= 0.7, "acceptable_stability").when(score >= 0.6, "moderate_concerns")
        .when(score >= 0.5, "significant_concerns").otherwise("severe_stability_issues")
    )


def stability(extraction: Column, now: Column) -> Column:
    """struct<score, verdict, average_tenure_years, total_jobs, short_stints, long_tenures> of an extracted record."""
    meta = extraction["experience_meta"]
    of = lambda m: F.try_element_at(meta[m], F.lit("tech"))
    total = F.coalesce(of("recommended_primary_years"), of("totals_by_category"), extraction["years_of_experience"], F.lit(0.0))
    roles = F.coalesce(F.size(extraction["experience"]), F.lit(0))

    def detail(d: Column) -> Column:
        n, some = F.size(d), F.size(d) > 0
        score = stability_score(d, total)
        count = lambda p: F.size(F.filter(d, p))
        return F.struct(
            score.alias("score"), F.when(roles <= 0, "no_experience_data").when(~some, "no_duration_data").otherwise(stability_verdict(score)).alias("verdict"),
            F.when(some, F.round(F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / n, 1)).otherwise(0.0).alias("average_tenure_years"), F.when(some, n).otherwise(F.greatest(roles, F.lit(0))).alias("total_jobs"),
            count(lambda x: x < 1.5).alias("short_stints"), count(lambda x: x >= 4).alias("long_tenures"),
        )

    return bind(tenures(extraction["experience"], meta["experience_clusters"], now), detail)


def title_scores(job_title: Column, job_vector: Column, titles: Column) -> Column:
    """struct<score, title, source> of the best of array<struct<title, vector, weight, source>>: (cosine + boost, within 0 and 100) * weight, the first on ties."""

    def scored(job: Column, led: Column) -> Column:
        value = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(100.0), cosine100(job_vector, t["vector"]) + bind(title_features(t["title"]), lambda own: features_boost(job, own, led)))) * t["weight"]
        return F.array_max(F.transform(titles, lambda t, i: F.struct(F.round(value(t), 1).alias("score"), (-i).alias("i"), t["title"].alias("title"), t["source"].alias("source"))))

    # the job's features and the history's are the same for all titles
    led = F.coalesce(has_led(F.transform(titles, lambda t: t["title"])), F.lit(False))
    return bind(title_features(job_title), lambda job: bind(led, lambda past: scored(job, past)))


def title_candidates(profession: Column, history: Column) -> Column:
    """The profession (weight 1) and up to six earlier titles not listed yet, weighted by how recent: array<struct<title, weight, source>>."""
    other = F.filter(history, lambda t, i: (F.lower(t) != F.lower(F.coalesce(profession, F.lit("")))) & (F.array_position(F.transform(history, F.lower), F.lower(t)) == i + 1))
    listed = F.transform(F.slice(other, 1, 6), lambda t, i: F.struct(t.alias("title"), F.greatest(F.lit(0.85), 1.0 - 0.05 * i).alias("weight"), F.lit("history").alias("source")))
    own = F.when(profession.isNotNull(), F.array(F.struct(profession.alias("title"), F.lit(1.0).alias("weight"), F.lit("primary_profession").alias("source"))))
    return F.concat(F.coalesce(own, F.slice(listed, 1, 0)), listed)


def ensemble(title: Column, experience: Column, skills: Column) -> Column:
    """0.55 title + 0.25 experience + 0.20 skills / 100, gently lowered below a title score of 0.75; times 100, truncated."""
    f = dims.W_TITLE * title + dims.W_EXPERIENCE * experience + dims.W_SKILLS * skills / 100.0
    f = F.when(title < dims.TITLE_GENTLE, f * (0.6 + 0.4 * title / dims.TITLE_GENTLE)).otherwise(f)
    return (100.0 * f).cast("int")


def score_candidates(candidates: DataFrame, jobs: DataFrame, keep: int | None = None) -> DataFrame:
    """Jobs against all candidates: job_id, resume_id, best_title, experience, skills, stability, rag_score.

    ``jobs`` (job_id, title, vector, required, bonus, years_min) must be a run's few jobs: over MOST_JOBS it is refused,
    since all pairs are scored; a larger set goes through :func:`score_in_blocks`. ``candidates`` (resume_id, skills, text, years,
    has_history, durations, titles) are read once. ``keep``: only the best so many per job (ties by id), which are chosen
    within each task before anything is shuffled.
    """
    if jobs.limit(MOST_JOBS + 1).count() > MOST_JOBS:
        raise ValueError(f"more than {MOST_JOBS} jobs at once: use score_in_blocks")
    pairs = candidates.join(F.broadcast(jobs))  # at most MOST_JOBS rows, checked
    weights = skill_weights(F.col("skills"), "weight" in candidates.schema["skills"].dataType.elementType.names)
    scored = pairs.select(
        "job_id", "resume_id",
        title_scores(F.col("title"), F.col("vector"), F.col("titles")).alias("best_title"),
        experience_detail(F.col("years"), F.col("years_min"), F.col("has_history")).alias("experience"),
        skills_score(F.col("required"), F.col("bonus"), weights, F.col("text")).alias("skills"),
        stability_score(F.col("durations"), F.col("years")).alias("stability"),
    )
    title = F.coalesce(F.col("best_title.score"), F.lit(0.0)) / 100.0
    scored = scored.withColumn("rag_score", ensemble(title, F.col("experience.score"), F.col("skills.score"))).withColumn("stability_verdict", stability_verdict(F.col("stability")))
    if keep is None:
        return scored
    w = Window.partitionBy("job_id").orderBy(F.desc("rag_score"), F.asc("resume_id"))
    return scored.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= keep).drop("nth")


def score_in_blocks(candidates: DataFrame, jobs: DataFrame, keep: int, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As :func:`score_candidates` for any number of jobs: the best ``keep`` candidates per job, MOST_JOBS jobs at a time, each block's result written by ``write``."""
    numbered = write(jobs.withColumn("_block", F.floor((F.row_number().over(Window.orderBy("job_id")) - 1) / MOST_JOBS)))
    blocks = (numbered.agg(F.max("_block")).first()[0] or 0) + 1
    parts = [write(score_candidates(candidates, numbered.where(F.col("_block") == b).drop("_block"), keep)) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)
