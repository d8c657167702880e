"""Classification rules over titles, companies, bullets and technologies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .arrays import bind, constant_map, contained, contains_any, literal
from .text import norm_text


def banned_title(title: Column) -> Column:
    return F.coalesce(F.lower(F.trim(title)).isin(*dims.BANNED_ROLE_TITLES), F.lit(False))


def looks_military(company: Column) -> Column:
    return bind(norm_text(company), lambda n: F.coalesce(contains_any(n, dims.MILITARY_WORDS) | company.contains("צהל") | (n.contains("unit") & n.rlike(r"\b\d{2,4}\b")), F.lit(False)))


def is_tech_role(title: Column, company: Column, tech: Column, bullets: Column) -> Column:
    """Whether a role is technical: see the order of the rules; weak titles at military or academic places need strong technology."""
    t, c = norm_text(F.coalesce(title, F.lit(""))), norm_text(F.coalesce(company, F.lit("")))
    tech = F.coalesce(tech, F.array().cast("array<string>"))
    text = F.lower(F.array_join(F.coalesce(bullets, F.array().cast("array<string>")), " "))
    strict = looks_military(company) | contains_any(c, dims.ACADEMIC_WORDS)
    weak = (contains_any(t, dims.WEAK_TECH_TITLES) | t.contains("project")) & ~contains_any(t, dims.STRONG_TECH_TITLES)
    strong_tech = F.exists(tech, lambda x: norm_text(x).isin(*dims.STRONG_TECH))
    return (
        F.when(strict & weak & ~strong_tech, False).when(F.exists(tech, lambda x: F.trim(x) != ""), True)
        .when(contains_any(t, dims.TECH_TITLE_WORDS), True).when(contains_any(c, dims.TECH_COMPANY_WORDS), True).otherwise(contains_any(text, dims.TECH_WORK_WORDS))
    )


def role_kind(title: Column, company: Column, tech: Column, bullets: Column) -> Column:
    """tech, military or other."""
    return F.when(is_tech_role(title, company, tech, bullets), "tech").when(looks_military(company), "military").otherwise("other")


def infer_title(bullets: Column, tech: Column) -> Column:
    """A title from bullets and technologies, null without bullets."""
    text = F.lower(F.array_join(bullets, " "))
    low = F.transform(F.coalesce(tech, F.array().cast("array<string>")), F.lower)
    hits = lambda name: F.size(contained(text, dims.INFERRED_TITLES[name].split("|")))
    any_of = lambda ws: F.size(F.array_intersect(low, literal(ws))) > 0
    out = F.when(bullets.isNull() | (F.size(bullets) == 0), F.lit(None).cast("string")).when(hits("AI Developer") > 0, "AI Developer")
    out = out.when(any_of(["react", "angular", "vue", "html", "css"]) & any_of(["node.js", "express", "django", "flask", "spring"]), "Full Stack Developer")
    for name in list(dims.INFERRED_TITLES)[1:]:
        out = out.when(hits(name) >= 2, name)
    return out.when(contains_any(text, ["develop", "built", "implement", "code", "software"]), "Software Developer")


def real_work(title: Column, company: Column) -> Column:
    """Work with a company that is no project, personal or voluntary entry."""
    both = F.lower(F.concat_ws(" ", company, title))
    return F.coalesce(F.trim(company) != "", F.lit(False)) & ~contains_any(both, ["project", "personal", "volunteer", "פרויקט"])


def currently_student(education: Column, now: Column) -> Column:
    """array<struct<end date>>: an end that is missing, ahead or under 180 days ago."""
    return F.coalesce(F.exists(education, lambda e: e["end"].isNull() | (F.datediff(now, e["end"]) < 180)), F.lit(False))


def management_mismatch(job_title: Column, title: Column, history: Column) -> Column:
    """The job asks for leadership and neither the current nor any past title has it."""
    lead = lambda c: contains_any(F.lower(c), dims.LEADERSHIP_TERMS)
    past = F.exists(F.coalesce(history, F.array().cast("array<string>")), lambda h: lead(h))
    return lead(job_title) & ~lead(title) & ~past


def hr_against_tech(job_title: Column, title: Column) -> Column:
    return contains_any(F.lower(job_title), dims.TECH_JOB_TERMS) & contains_any(F.lower(title), dims.HR_TERMS)


def key_terms(title: Column) -> Column:
    return contained(F.lower(title), dims.TITLE_TERMS)


def role_category(title: Column, strict: bool = False) -> Column:
    """The first category with a synonym in the title (as a substring, or as whole words if ``strict``)."""
    low = F.lower(F.trim(title))
    out = F.lit(None).cast("string")
    for name, synonyms in reversed(dims.ROLE_SYNONYMS.items()):
        terms = synonyms.split("|")
        hit = low.rlike("|".join(rf"\b{t}\b" for t in terms)) if strict else contains_any(low, terms)
        out = F.when(hit, name).otherwise(out)
    return out


def role_boost(job_category: Column, category: Column) -> Column:
    """15 for the same category, 10 for a neighbour, else 0."""
    near = constant_map({k: v.split("|") for k, v in dims.ROLE_NEIGHBOURS.items()}, "array<string>")
    return F.coalesce(F.when(job_category == category, 15.0).when(F.array_contains(F.try_element_at(near, job_category), category), 10.0), F.lit(0.0))


def title_features(title: Column, strict: bool = False) -> Column:
    """What the boost looks at in a title: its key terms, whether one is strong, its category, and signs of leadership, technology and recruiting."""
    low = F.lower(title)
    return bind(key_terms(title), lambda terms: F.struct(
        terms.alias("terms"), F.arrays_overlap(terms, literal(dims.STRONG_TITLE_TERMS)).alias("strong"), role_category(title, strict).alias("category"),
        contains_any(low, dims.LEADERSHIP_TERMS).alias("lead"), contains_any(low, dims.TECH_JOB_TERMS).alias("tech"), contains_any(low, dims.HR_TERMS).alias("hr"),
    ))


def has_led(history: Column) -> Column:
    return F.exists(history, lambda h: contains_any(F.lower(h), dims.LEADERSHIP_TERMS))


def features_boost(job: Column, own: Column, led: Column) -> Column:
    """-100 for recruiting against tech, -30 for missing leadership, else the larger of the keyword and the category boost, 0 to 30."""
    n = F.size(F.array_intersect(job["terms"], own["terms"]))
    keyword = F.when(job["strong"] & own["strong"], F.least(F.lit(30.0), 20.0 + 2.0 * n)).when(n > 0, F.least(F.lit(20.0), 10.0 + 2.0 * n)).otherwise(0.0)
    best = F.greatest(role_boost(job["category"], own["category"]), F.coalesce(keyword, F.lit(0.0)))
    return F.when(job["tech"] & own["hr"], -100.0).when(job["lead"] & ~own["lead"] & ~led, -30.0).otherwise(best)


def title_boost(job_title: Column, title: Column, history: Column | None = None, strict: bool = False) -> Column:
    """Keyword and category boost of a title; see :func:`features_boost`. ``history``: past titles, of which one with leadership is enough."""
    history = F.array().cast("array<string>") if history is None else F.coalesce(history, F.array().cast("array<string>"))
    return bind(title_features(job_title, strict), lambda j: bind(title_features(title, strict), lambda o: features_boost(j, o, has_led(history))))


def analysis_has_content(role_title: Column, *lists: Column) -> Column:
    out = F.coalesce(F.trim(role_title) != "", F.lit(False))
    for x in lists:
        out = out | F.coalesce(F.size(x) > 0, F.lit(False))
    return out
