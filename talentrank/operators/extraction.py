"""Deterministic extraction from text, candidate skills and the candidate's projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as tx
from ..functions.arrays import bind, first_by_key, max_wins, trimmed
from ..functions.dates import parse_loose, years_simple
from ..functions.rules import banned_title, real_work


def extract(docs: DataFrame, id_col: str = "id", text_col: str = "parsed_text") -> DataFrame:
    """emails, phones, urls, profiles, languages, skills (canonical, deterministic) and a name guess per text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    skill = lambda raw: F.struct(tx.normalize_skill(raw).alias("name"), F.lit("deterministic").alias("source"), F.lit(dims.LISTED_SKILL_WEIGHT).alias("weight"))
    return docs.select(
        id_col, tx.name_heuristic(t).alias("name"), tx.emails(t).alias("emails"), tx.phones(t).alias("phones"), tx.urls(t).alias("urls"), tx.profiles(t).alias("profiles"),
        tx.spoken_languages(t).alias("languages"), F.array_distinct(F.transform(tx.scan_skills(t), skill)).alias("skills"),
    )


def sections(docs: DataFrame, id_col: str = "id", text_col: str = "parsed_text") -> DataFrame:
    """(id, title, start, end): a text's parts, the first one 'general'. A heading line ends one part, and its end begins the next; offsets in characters.

    Null and empty texts are one part of no length. Rows with equal ids are told apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # places come from running lengths within the row's own array, so nothing is shuffled
    lines = F.split(text, "\n")
    step = lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + F.length(x))).alias("ends"))
    ends = F.aggregate(lines, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")), step, lambda acc: acc["ends"])
    heads = F.filter(F.zip_with(lines, ends, lambda x, e: F.struct(F.when(F.trim(x).rlike(dims.HEADING), F.lower(F.regexp_extract(F.trim(x), dims.HEADING, 1))).alias("title"), e.alias("at"))), lambda h: h["title"].isNotNull())
    marks = F.concat(F.array(F.struct(F.lit("general").alias("title"), F.lit(0).alias("at"))), heads)
    rows = docs.select(id_col, F.length(text).alias("_length"), marks.alias("_marks"))
    parts = F.transform("_marks", lambda m, i: F.struct(m["title"].alias("title"), m["at"].alias("start"), F.coalesce(F.get("_marks", i + 1)["at"], F.col("_length")).alias("end")))
    return rows.select(id_col, F.explode(parts).alias("p")).select(id_col, "p.title", "p.start", "p.end")


def _stored(name: Column) -> Column:
    """The name as it is kept: capitalized if it is all lower-case and longer than a letter."""
    return F.when((name == F.lower(name)) & (F.length(name) > 1), tx.title_case(name)).otherwise(name)


def candidate_skills(experience: Column, education: Column, skills: Column) -> Column:
    """array<struct<name, source, weight, category>>: experience technologies, then education's, then listed skills.

    A technology or listed skill is from work (weight 1) if its name or canonical name is in the text of the
    bullets, whatever role it is given for; all others weigh 0.6. Education's skills are only added where no
    technology has the name. Per name the larger weight stays, the first on ties, where the name came first.
    """
    none = F.array().cast("array<string>")
    corpus = F.lower(F.concat(F.lit(" "), F.array_join(F.flatten(F.transform(F.coalesce(experience, F.array()), lambda e: F.coalesce(e["bullets"], none))), " ")))

    def build(text: Column) -> Column:
        def entry(name: Column, source: Column, category: Column) -> Column:
            at_work = text.contains(F.lower(F.trim(name))) | text.contains(F.lower(tx.normalize_skill(name)))
            return F.struct(name.alias("name"), F.when(at_work, "work_experience").otherwise(source).alias("source"), F.when(at_work, 1.0).otherwise(dims.LISTED_SKILL_WEIGHT).alias("weight"), category.alias("category"))

        nothing = F.lit(None).cast("string")
        tech = F.transform(trimmed(F.flatten(F.transform(F.coalesce(experience, F.array()), lambda e: F.coalesce(e["tech"], none)))), _stored)
        school = F.transform(trimmed(F.flatten(F.transform(F.coalesce(education, F.array()), lambda e: F.concat(F.coalesce(e["tech"], none), F.coalesce(e["skills"], none), F.coalesce(e["courses"], none))))), _stored)
        listed = F.filter(F.coalesce(skills, F.array()), lambda s: F.trim(s["name"]) != "")
        source = lambda s: F.when(s["source"] == "experience", "work_experience").otherwise(F.coalesce(s["source"], F.lit("skills_list")))
        return F.concat(
            F.transform(tech, lambda n: entry(n, F.lit("skills_list"), nothing)),
            F.transform(school, lambda n: F.struct(n.alias("name"), F.lit("education").alias("source"), F.lit(dims.LISTED_SKILL_WEIGHT).alias("weight"), F.lit("education").alias("category"))),
            F.transform(listed, lambda s: entry(_stored(F.trim(s["name"])), source(s), s["category"])),
        )

    return max_wins(bind(corpus, build), lambda x: F.lower(x["name"]), lambda x: x["weight"])


def sanitize_roles(experience: Column) -> Column:
    """Roles without those whose title is a section heading."""
    return F.filter(experience, lambda e: ~banned_title(e["title"]))


def contacts(person: Column) -> Column:
    """E-mails, then phones, blanks dropped."""
    values = lambda k: F.transform(F.coalesce(person[k], F.array()), lambda c: c["value"])
    return trimmed(F.concat(values("emails"), values("phones")))


def student_title(education: Column, now: Column) -> Column:
    """'<field> Student', else '<degree> Student', else 'Student', of the first education that goes on or ended under 180 days ago; null without one."""
    going = lambda e: F.datediff(now, parse_loose(e["end_date"], now, True)) < 180
    first = F.get(F.filter(F.coalesce(education, F.array()), lambda e: e.isNotNull() & going(e)), F.lit(0))
    field = F.trim(F.replace(F.replace(tx.clean(first["field"]), F.lit("Bachelor of Science in"), F.lit("")), F.lit("B.Sc"), F.lit("")))
    return F.when(first.isNotNull(), F.when(field.isNotNull(), F.concat(field, F.lit(" Student"))).when(tx.clean(first["degree"]).isNotNull(), F.concat(tx.clean(first["degree"]), F.lit(" Student"))).otherwise("Student"))


def profession(person: Column, experience: Column, education: Column, now: Column) -> Column:
    """Self-declared title; else the latest title of real work, unless a student's ended over a year ago; else the student title; else any latest title; else by the first field of study.

    Latest: by end date (open ends are now), the first of equal ones.
    """
    roles = F.transform(F.coalesce(experience, F.array()), lambda e, i: F.struct(parse_loose(e["end_date"], now, True).alias("end"), (-i).alias("i"), tx.clean(e["title"]).alias("title"), real_work(e["title"], e["company"]).alias("real")))
    field = F.get(trimmed(F.transform(F.coalesce(education, F.array()), lambda e: e["field"])), F.lit(0))
    low = F.lower(field)
    by_field = F.when(low.contains("computer") | low.contains("software") | low.contains("מחשב"), "Software Developer").when(low.contains("data") & low.contains("science"), "Data Scientist").when(low.contains("engineer"), "Engineer").otherwise(field)

    def choose(rs: Column) -> Column:
        titled = F.filter(rs, lambda r: r["title"].isNotNull())
        real = F.filter(titled, lambda r: r["real"])
        last, student = F.array_max(real), student_title(education, now)
        stale = student.isNotNull() & (F.datediff(now, last["end"]) > 365)
        return F.coalesce(tx.clean(person["self_declared_title"]), F.when(F.size(real) > 0, F.when(stale, student).otherwise(last["title"])), student, F.array_max(titled)["title"], by_field)

    return bind(roles, choose)


def merged_years(experience: Column, now: Column) -> Column:
    """Years covered by all roles, overlaps once, one decimal, null if none."""
    from ..functions.arrays import interval_union_days

    spans = F.transform(F.coalesce(experience, F.array()), lambda e: F.struct(parse_loose(e["start_date"], now).alias("s"), parse_loose(e["end_date"], now, True).alias("e")))
    y = F.round(interval_union_days(spans) / 365.0, 1)
    return F.when(y > 0, y)


def summaries(resumes: DataFrame, now: Column) -> DataFrame:
    """List projection: id, name (else from the path), profession, years (stated primary else merged), years by category, skills, summary, created_at."""
    x = F.col("extraction")
    return resumes.select(
        "id", F.coalesce(tx.clean(x["person"]["name"]), tx.name_from_path(F.col("file_path"))).alias("name"), profession(x["person"], x["experience"], x["education"], now).alias("profession"),
        F.coalesce(x["primary_years"], merged_years(x["experience"], now)).alias("years"), x["years_by_category"].alias("years_by_category"),
        candidate_skills(x["experience"], x["education"], x["skills"]).alias("skills"), x["summary"].alias("summary"), "status", "created_at",
    )


def details(resumes: DataFrame, now: Column) -> DataFrame:
    """Detail projection: the summary with contacts, trimmed experience and education, languages and the file."""
    x = F.col("extraction")
    role = lambda e: F.struct(
        tx.clean(e["title"]).alias("title"), tx.clean(e["company"]).alias("company"), tx.clean(e["location"]).alias("location"), tx.clean(e["start_date"]).alias("start_date"), tx.clean(e["end_date"]).alias("end_date"),
        years_simple(parse_loose(e["start_date"], now), parse_loose(e["end_date"], now, True)).alias("duration_years"), trimmed(e["bullets"]).alias("bullets"), trimmed(e["tech"]).alias("tech"),
    )
    school = lambda e: F.struct(tx.clean(e["degree"]).alias("degree"), tx.clean(e["field"]).alias("field"), tx.clean(e["institution"]).alias("institution"), tx.clean(e["start_date"]).alias("start_date"), tx.clean(e["end_date"]).alias("end_date"))
    more = resumes.select(
        "id", contacts(x["person"]).alias("contacts"), F.transform(F.coalesce(x["experience"], F.array()), role).alias("experience"), F.transform(F.coalesce(x["education"], F.array()), school).alias("education"),
        first_by_key(trimmed(x["person"]["languages"]), F.lower).alias("languages"), "file_path", "mime_type", "file_size",
    )
    return summaries(resumes, now).join(more, "id")


def judge_text(name: Column, years: Column, skills: Column, education: Column, experience: Column) -> Column:
    """A candidate as readable text: NAME, EXPERIENCE, SKILLS, EDUCATION, WORK EXPERIENCE with the current role marked; roles by end year, current ones first."""
    year = lambda e: F.when(F.lower(F.trim(e["end_date"])).isin("present", "current", "now") | e["end_date"].isNull(), 9999).otherwise(F.coalesce(F.regexp_extract(e["end_date"], r"(\d{4})", 1).try_cast("int"), F.regexp_extract(e["start_date"], r"(\d{4})", 1).try_cast("int"), F.lit(0)))
    ordered = F.transform(F.array_sort(F.transform(F.coalesce(experience, F.array()), lambda e, i: F.struct((-year(e)).alias("y"), i.alias("i"), e.alias("e")))), lambda s: s["e"])
    roles = F.transform(ordered, lambda e: F.concat_ws("\n", F.concat(F.coalesce(e["title"], F.lit("?")), F.lit(" at "), F.coalesce(e["company"], F.lit("?")), F.when(year(e) == 9999, " [CURRENT]").otherwise("")), F.array_join(F.transform(F.coalesce(e["bullets"], F.array().cast("array<string>")), lambda b: F.concat(F.lit("- "), b)), "\n")))
    schools = F.transform(F.coalesce(education, F.array()), lambda e: F.concat_ws(", ", e["degree"], e["field"], e["institution"]))
    return F.concat_ws(
        "\n", F.concat(F.lit("NAME: "), F.coalesce(name, F.lit("Unknown"))), F.concat(F.lit("EXPERIENCE: "), tx.format_years(years)), F.concat(F.lit("SKILLS: "), F.array_join(skills, ", ")),
        F.concat(F.lit("EDUCATION: "), F.array_join(schools, "; ")), F.lit("WORK EXPERIENCE:"), F.array_join(roles, "\n"),
    )
