"""Clusters of roles: rebuilt from the roles themselves, with totals by category, and what a model's answer needs before that."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as tx
from ..functions.arrays import bind, fill_categories, finite_non_negative, literal, max_wins
from ..functions.dates import parse_multilingual, years_by_months
from ..functions.rules import role_kind
from .extraction import sanitize_roles
from .jobs import best_role

#: Categories of work, and the keys under which a model may give a part of its answer, in order. Fixed values.
CATEGORIES = ("tech", "military", "hospitality", "other")
KEY_ALIASES = {
    "experience": ("work_experience", "workExperience", "professional_experience", "professionalExperience", "experiences", "jobs", "positions"),
    "education": ("educations", "studies"), "person": ("candidate",),
}


def role_years(role: Column, now: Column) -> Column:
    return years_by_months(parse_multilingual(role["start_date"], now), parse_multilingual(role["end_date"], now), now)


def _stepwise(years: Column) -> Column:
    """A sum that is rounded to one decimal at every addition."""
    return F.aggregate(years, F.lit(0.0), lambda a, y: F.round(a + y, 1))


def category_totals(items: Column, category, years) -> Column:
    """map category -> years, rounded at every addition in the items' order; all categories are there."""
    of = lambda c: _stepwise(F.transform(F.filter(items, lambda x: category(x) == c), years))
    return F.map_from_arrays(literal(CATEGORIES), F.array(*[of(c) for c in CATEGORIES]))


def fallback_totals(experience: Column, now: Column) -> Column:
    """Totals without clusters: each role's years under tech, military or other by its own words; headings and roles without a duration don't count."""
    timed = F.transform(sanitize_roles(F.coalesce(experience, F.array())), lambda e: F.struct(role_kind(e["title"], e["company"], e["tech"], e["bullets"]).alias("c"), role_years(e, now).alias("y")))
    return bind(F.filter(timed, lambda x: x["y"] > 0), lambda t: category_totals(t, lambda x: x["c"], lambda x: x["y"]))


def rebuild(experience: Column, education: Column, clusters: Column, now: Column) -> Column:
    """struct<experience_clusters, totals_by_category, recommended_primary_years>, strictly from the record's own roles.

    A member is the role of equal title and company, else the most similar one; roles at education institutions and without
    a duration go, clusters of unknown categories or without members too. Years are summed per cluster, then per
    category with one decimal at every addition. If nothing is left, totals are those of :func:`fallback_totals`.
    Primary years are given for tech alone, where it has any. Null arrays are empty, null members match nothing.
    """
    roles = sanitize_roles(F.filter(F.coalesce(experience, F.array()), lambda e: e.isNotNull()))
    norm = lambda c: tx.norm_text(F.coalesce(c, F.lit("")))
    schools = F.transform(F.filter(F.coalesce(education, F.array()), lambda e: e["institution"] != ""), lambda e: norm(e["institution"]))

    def cleaned(own: Column, away: Column) -> Column:
        def one(c: Column) -> Column:
            matched = best_role(F.filter(F.coalesce(c["members"], F.array()), lambda m: m.isNotNull()), own, away)
            held = F.filter(F.transform(matched, lambda m: F.struct(m["role"].alias("role"), role_years(m["role"], now).alias("y"))), lambda m: (m["y"] > 0) & ~F.array_contains(away, norm(m["role"]["company"])))
            return bind(held, lambda h: F.struct(
                c["category"].alias("category"), F.transform(h, lambda m: F.struct(*[m["role"][k].alias(k) for k in ("title", "company", "start_date", "end_date")])).alias("members"),
                F.round(F.aggregate(h, F.lit(0.0), lambda a, m: a + m["y"]), 1).alias("total_years"), F.coalesce(c["confidence"], F.lit(0.7)).alias("confidence"),
                F.coalesce(c["normalized_roles"], F.array().cast("array<string>")).alias("normalized_roles"), F.coalesce(c["original_roles"], F.array().cast("array<string>")).alias("original_roles"),
                F.coalesce(tx.clean(c["reasoning"]), F.lit("recomputed from extraction.experience (with soft matching)")).alias("reasoning"),
            ))

        known = F.filter(F.coalesce(clusters, F.array()), lambda c: c["category"].isin(*CATEGORIES))
        return F.filter(F.transform(known, one), lambda c: F.size(c["members"]) > 0)

    def totalled(cs: Column) -> Column:
        def result(own: Column) -> Column:
            empty = (F.size(cs) == 0) | F.forall(F.map_values(own), lambda v: v == 0)
            totals = F.when(empty, fallback_totals(experience, now)).otherwise(own)
            return bind(totals, lambda t: F.struct(cs.alias("experience_clusters"), t.alias("totals_by_category"), F.map_filter(t, lambda k, v: (k == "tech") & (v > 0)).alias("recommended_primary_years")))

        return bind(category_totals(cs, lambda c: c["category"], lambda c: c["total_years"]), result)

    return bind(roles, lambda own: bind(schools, lambda away: bind(cleaned(own, away), totalled)))


def merge_skills(model: Column, deterministic: Column) -> Column:
    """A model's skills, then the deterministic ones, by canonical name: work weighs 1, all else 0.6; the larger weight stays, the first on ties."""
    none = F.array().cast(deterministic_type())
    every = F.filter(F.concat(F.coalesce(model, none), F.coalesce(deterministic, none)), lambda s: s["name"].isNotNull())
    source = lambda s: F.coalesce(s["source"], F.lit("unknown"))
    plain = F.transform(every, lambda s: F.struct(tx.normalize_skill(s["name"]).alias("name"), source(s).alias("source"), F.when(source(s) == "work_experience", 1.0).otherwise(0.6).alias("weight"), s["category"].alias("category")))
    return max_wins(plain, lambda s: s["name"], lambda s: s["weight"])


def deterministic_type():
    return schema.EXTRACTION["skills"].dataType


def years_by_category(totals: Column) -> Column:
    """Finite totals of at least 0; see :func:`fill_categories` for all categories."""
    return finite_non_negative(totals)


def all_categories(totals: Column) -> Column:
    return fill_categories(finite_non_negative(F.coalesce(totals, F.create_map().cast("map<string,double>"))), CATEGORIES)


def read_payload(answer: Column) -> Column:
    """A model's JSON answer as a record (EXTRACTION without its meta parts): other names of keys count where the own key is missing, list elements that are no objects go.

    struct<valid, person, education, experience, skills, summary>. Valid: an object with lists where lists belong. 'start' and
    'end' of roles count as their dates; open ends become 'present'. Null and broken answers are not valid and have nulls.
    """
    keys = [*KEY_ALIASES, "skills", "summary", *(a for names in KEY_ALIASES.values() for a in names)]
    raw = F.from_json(answer, ", ".join(f"`{k}` string" for k in keys))
    part = lambda k: F.coalesce(raw[k], *[raw[a] for a in KEY_ALIASES.get(k, ())])
    record = schema.EXTRACTION
    objects = lambda text: F.filter(F.from_json(text, "array<string>"), lambda e: F.trim(e).startswith("{"))
    is_list = lambda text: text.isNull() | F.trim(text).startswith("[")

    def role(e: Column) -> Column:
        own = F.from_json(e, record["experience"].dataType.elementType)
        start = F.trim(F.coalesce(own["start_date"], F.get_json_object(e, "$.start")))
        end = F.coalesce(own["end_date"], F.get_json_object(e, "$.end"))
        tech = F.when(own["tech"].isNotNull(), tx.normalize_skill_list(own["tech"]))
        return own.withField("start_date", start).withField("end_date", F.when(F.lower(F.trim(end)).isin("present", "current", "now"), "present").otherwise(end)).withField("tech", tech)

    school = lambda e: F.from_json(e, record["education"].dataType.elementType)
    valid = F.coalesce(F.trim(answer).startswith("{") & F.json_object_keys(answer).isNotNull() & is_list(part("experience")) & is_list(part("education")), F.lit(False))
    return F.struct(
        valid.alias("valid"), F.from_json(part("person"), record["person"].dataType).alias("person"), F.when(valid, F.transform(F.coalesce(objects(part("education")), F.array().cast("array<string>")), school)).alias("education"),
        F.when(valid, F.transform(F.coalesce(objects(part("experience")), F.array().cast("array<string>")), role)).alias("experience"),
        F.when(valid, F.transform(F.coalesce(objects(raw["skills"]), F.array().cast("array<string>")), lambda e: F.from_json(e, record["skills"].dataType.elementType))).alias("skills"), raw["summary"].alias("summary"),
    )


def merge_json(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects as text: keys of ``new`` replace those of ``old``; null counts as an empty object."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return bind(read(new), lambda n: F.to_json(F.map_concat(F.map_filter(read(old), lambda k, _: ~F.array_contains(F.map_keys(n), k)), n)))


def base_signals(person: Column, base: Column) -> Column:
    """The model's person with the deterministic contacts, links, profiles and languages where it has none."""
    out = person
    for k in ("emails", "phones", "links", "profiles", "languages"):
        out = out.withField(k, F.when(F.coalesce(F.size(person[k]) > 0, F.lit(False)), person[k]).otherwise(base[k]))
    return out

