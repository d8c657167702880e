"""Faceted search: a filter state becomes one predicate, a relevance order and a page."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import age_days
from ..functions.text import edge_pattern, quoted


@dataclass(frozen=True)
class FilterState:
    profession: tuple[str, ...] = ()
    min_experience: float | None = None
    max_experience: float | None = None
    skills: tuple[str, ...] = ()
    skills_mode: str = "any"
    free_text: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    recent: str | None = None
    query: str | None = None
    ranking: tuple[str, ...] = field(default=())


def alternatives(chip: str) -> list[str]:
    """'a OR b | c, d' to its lower-cased alternatives."""
    return [p.strip().lower() for p in re.split(r"(?i)\s+or\s+|\s+או\s+|\||,", chip) if p.strip()]


def any_pattern(text: Column, terms) -> Column:
    terms = list(terms)
    return F.coalesce(text.rlike("|".join(f"(?:{edge_pattern(t)})" for t in terms)), F.lit(False)) if terms else F.lit(False)


def profession_filter(profession: Column, terms) -> Column:
    return any_pattern(profession, terms)


def experience_filter(years: Column, low=None, high=None) -> Column:
    y, out = F.coalesce(years, F.lit(0.0)), F.lit(True)
    if low is not None:
        out = out & (y >= low)
    return out & (y <= high) if high is not None else out


def skills_filter(skills: Column, chips, mode: str = "any") -> Column:
    """Any or all chips; a chip is met if some skill contains one of its alternatives."""

    def has(chip: str) -> Column:
        pattern = "|".join(map(quoted, alternatives(chip)))
        return F.coalesce(F.exists(skills, lambda s: F.lower(s).rlike(pattern)), F.lit(False)) if pattern else F.lit(False)

    met = [has(c) for c in chips]
    out = F.lit(mode == "all")
    for m in met:
        out = (out & m) if mode == "all" else (out | m)
    return out


def free_text_filter(text: Column, chips) -> Column:
    """Every chip, any of its alternatives; a chip without any is never met."""
    out = F.lit(True)
    for c in chips:
        out = out & any_pattern(text, alternatives(c))
    return out


def exclude_filter(text: Column, keywords) -> Column:
    """Rows without any of the keywords as a whole word."""
    terms = [k.strip() for k in keywords if k.strip()]
    return ~any_pattern(text, terms) if terms else F.lit(True)


def recent_filter(ts: Column, span: str, now: Column) -> Column:
    return F.coalesce(age_days(ts, now) <= {"today": 1, "week": 7, "month": 30}[span], F.lit(False))


def searchable_text(summary: Column, experience: Column, education: Column, contacts: Column) -> Column:
    """Everything a free-text search looks at, lower-cased."""
    roles = F.transform(experience, lambda e: F.concat_ws(" ", e["company"], e["title"], e["location"], F.array_join(e["bullets"], " "), F.array_join(e["tech"], " ")))
    schools = F.transform(education, lambda e: F.concat_ws(" ", e["degree"], e["field"], e["institution"]))
    return F.lower(F.concat_ws(" ", summary, F.array_join(roles, " "), F.array_join(schools, " "), F.array_join(contacts, " ")))


def quick_search(query: str, *fields: Column) -> Column:
    out = F.lit(False)
    for f in fields:
        out = out | F.coalesce(F.lower(f).contains(query.lower()), F.lit(False))
    return out


def text_search(query: str, *fields: Column) -> Column:
    """Job search: one text of all fields contains the query."""
    return F.lower(F.concat_ws(" ", *fields)).contains(query.lower())


def status_filter(status: Column, wanted: str) -> Column:
    return F.coalesce(status, F.lit("new")) == wanted


def predicate(state: FilterState, name: Column, profession: Column, years: Column, skills: Column, text: Column, created: Column, now: Column) -> Column:
    """The conjunction of all filters set; Catalyst pushes what it can to the scan."""
    blob = F.lower(F.concat_ws(" ", text, name, profession, F.array_join(skills, " ")))
    out = experience_filter(years, state.min_experience, state.max_experience)
    if state.query:
        out = out & quick_search(state.query, name, profession)
    if state.profession:
        out = out & profession_filter(profession, state.profession)
    if state.skills:
        out = out & skills_filter(skills, state.skills, state.skills_mode)
    if state.free_text:
        out = out & free_text_filter(blob, state.free_text)
    if state.exclude:
        out = out & exclude_filter(blob, state.exclude)
    return out & recent_filter(created, state.recent, now) if state.recent else out


def relevance(title: Column, skills: Column, titles, wanted) -> Column:
    """100 for a title that is wanted, 60 for one that contains one, else 0; plus 2 per wanted skill, 10 at most counted."""
    low = F.lower(F.trim(title))
    base = F.when(low.isin(*[t.lower() for t in titles]), 100).when(any_substring(low, titles), 60).otherwise(0)
    hits = F.size(F.filter(F.array(*[F.lit(w.lower()) for w in wanted]), lambda w: F.exists(skills, lambda s: F.lower(s).contains(w)))) if wanted else F.lit(0)
    return (base + 2 * F.least(hits, F.lit(10))).cast("int")


def any_substring(text: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.coalesce(text.contains(t.lower()), F.lit(False))
    return out


def page(rows: DataFrame, order: list[Column], number: int = 0, size: int = 30) -> DataFrame:
    """One page of an order that ends in a unique key."""
    return rows.orderBy(*order).offset(number * size).limit(size)


#: Words that make a skill a description, and words of titles that say nothing. Fixed values.
GENERIC_WORDS = ("experience", "scripting", "knowledge", "skills", "platforms", "tools", "proficiency", "familiarity", "ability", "strong", "excellent", "good")
TITLE_STOP = ("and", "of", "the", "with", "for", "a", "in", "to", "senior", "junior", "lead", "principal", "staff", "engineer", "developer", "specialist", "expert", "manager", "role", "position")


def filters_from_job(title: str, is_tech: bool | None, must_have: list[str], years_min: float | None, stack: list[str] = ()) -> FilterState:
    """Tech jobs (unless said otherwise): concrete must-haves and technologies, any of them; others: the title's telling words as one alternative chip; plus the least years.

    Concrete: at most 3 words, not all of them generic. ``stack``: languages, frameworks, databases, cloud and tools, in this order.
    """
    if is_tech is not False:
        concrete = [s.strip() for s in (*must_have, *stack) if 0 < len(s.split()) <= 3 and any(w.lower() not in GENERIC_WORDS for w in s.split())]
        return FilterState(skills=tuple(dict.fromkeys(concrete)), skills_mode="any", min_experience=years_min)
    words = dict.fromkeys(w for w in re.split(r"[^A-Za-z/]+", title or "") if len(w) > 1 and w.lower() not in TITLE_STOP)
    return FilterState(free_text=(" OR ".join(words),) if words else (), min_experience=years_min)


def job_filter_columns(title: Column, is_tech: Column, must_have: Column, stack: Column) -> Column:
    """struct<skills, free_text>: :func:`filters_from_job` for a table of jobs, as expressions."""
    words = lambda s: F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != "")
    concrete = F.filter(F.concat(must_have, stack), lambda s: F.size(words(s)).between(1, 3) & F.exists(words(s), lambda w: ~F.lower(w).isin(*GENERIC_WORDS)))
    tokens = F.array_distinct(F.filter(F.split(F.coalesce(title, F.lit("")), "[^A-Za-z/]+"), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*TITLE_STOP)))
    tech, none = F.coalesce(is_tech, F.lit(True)), F.array().cast("array<string>")
    return F.struct(
        F.when(tech, F.array_distinct(F.transform(concrete, lambda x: F.trim(x)))).otherwise(none).alias("skills"),
        F.when(~tech & (F.size(tokens) > 0), F.array(F.array_join(tokens, " OR "))).otherwise(none).alias("free_text"),
    )


def processed_only(llm_score: Column) -> Column:
    """Rows that a judge has scored."""
    return llm_score.isNotNull()


def matched_only(match: Column) -> Column:
    """Rows with a match above 0."""
    return F.coalesce(match > 0, F.lit(False))


def contains_contact(person: Column, kind: str, value: Column) -> Column:
    """JSON containment: some element of the person's ``kind`` (emails, phones) has exactly this value."""
    return F.coalesce(F.exists(person[kind], lambda e: e["value"] == value), F.lit(False))


def suggestions(options: list[str], chosen: list[str], typed: str = "") -> list[str]:
    """Options not chosen yet that contain what was typed; the first five when nothing was."""
    left = [o for o in options if o not in chosen and typed.lower() in o.lower()]
    return left if typed else left[:5]
