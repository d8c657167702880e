"""Validation report and the status of a record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind
from ..functions.dates import parse_strict
from .stats import completeness


def _issues(rules: list[tuple[str, Column, str]]) -> Column:
    """rules: (severity, condition, message)."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for s, c, m in rules]), lambda x: x.isNotNull())


def quality_score(issues: Column) -> Column:
    """1 less 0.2 per error and 0.1 per warning, at least 0."""
    count = lambda s: F.size(F.filter(issues, lambda i: i["severity"] == s))
    return F.greatest(F.lit(0.0), F.round(1.0 - 0.2 * count("error") - 0.1 * count("warning"), 4))


def quality_label(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.75, "good").when(score >= 0.6, "fair").when(score >= 0.4, "poor").otherwise("very_poor")


def _each(items: Column, rules: Callable[[Column, Column], list[tuple[str, Column, Column]]]) -> Column:
    """The issues of every item of an array, from rules over the item and its place."""
    one = lambda x, i: F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), m.alias("message"))) for s, c, m in rules(x, i)]), lambda y: y.isNotNull())
    return F.flatten(F.transform(items, one))


def extraction_issues(x: Column, now: Column) -> Column:
    """array<struct<severity, message>> of an extracted record: person, roles, education, skills, completeness, years."""
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    said = lambda c: F.coalesce(c, F.lit("None"))
    place = lambda i: i.cast("string")
    none = lambda a: F.coalesce(F.size(a) <= 0, F.lit(True))
    person = x["person"]
    exp, edu, skills = F.coalesce(x["experience"], F.array()), F.coalesce(x["education"], F.array()), F.coalesce(x["skills"], F.array())
    nobody = person.isNull() | (person["name"].isNull() & none(person["emails"]) & none(person["phones"]) & none(person["languages"]) & person["self_declared_title"].isNull() & person["location"].isNull())
    who = F.concat(
        _issues([("warning", nobody, "No person information extracted"), ("warning", ~nobody & F.coalesce(F.length(F.trim(person["name"])) < 2, F.lit(True)), "Missing or invalid candidate name"), ("warning", ~nobody & none(person["emails"]) & none(person["phones"]), "No contact information (email/phone) extracted")]),
        _each(F.coalesce(person["emails"], F.array()), lambda e, _: [("warning", (e["value"] != "") & ~e["value"].rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"), F.concat(F.lit("Suspicious email format: "), e["value"]))]),
        _issues([("info", ~nobody & none(person["languages"]), "No languages specified")]),
    )

    def role(e: Column, i: Column) -> list[tuple[str, Column, Column]]:
        real, no_title, no_company = e.isNotNull(), blank(e["title"]), blank(e["company"])
        entry = lambda m: F.concat(F.lit("Experience entry "), place(i), F.lit(m))
        named = lambda t, m: F.concat(F.lit("Experience '"), t, F.lit(m))
        return [
            ("error", ~real, entry(" is not a valid object")), ("error", real & no_title & no_company, entry(": missing both title and company")),
            ("warning", real & no_title & ~no_company, entry(": missing job title")), ("warning", real & ~no_title & no_company, entry(": missing company name")),
            ("warning", real & blank(e["start_date"]), named(F.when(no_title, "Unknown").otherwise(e["title"]), "': missing start date")),
            ("error", real & (parse_strict(e["start_date"], now) > parse_strict(e["end_date"], now)), named(said(e["title"]), "': start date after end date")),
            ("info", real & none(e["tech"]), named(said(e["title"]), "': no technologies specified")), ("info", real & none(e["bullets"]), named(said(e["title"]), "': no detailed description")),
        ]

    names = F.transform(F.filter(skills, lambda s: s["name"].isNotNull() & (s["name"] != "")), lambda s: F.lower(s["name"]))
    complete = completeness(~blank(person["name"]), F.size(exp) > 0, F.size(edu) > 0, F.size(skills) > 0)
    totals = F.map_values(x["experience_meta"]["totals_by_category"])
    found = F.concat(
        who,
        _issues([("error", F.size(exp) == 0, "No work experience extracted - this is critical for matching"), ("warning", F.size(exp) == 1, "Only one experience entry found - resume might be under-parsed")]),
        _each(exp, role),
        _issues([("info", F.size(edu) == 0, "No education information extracted")]),
        _each(edu, lambda e, i: [("warning", e.isNotNull() & blank(e["degree"]) & blank(e["institution"]), F.concat(F.lit("Education entry "), place(i), F.lit(": missing degree and institution")))]),
        _issues([
            ("warning", F.size(skills) == 0, "No skills extracted - this may impact matching quality"), ("warning", F.size(skills).between(1, 2), "Very few skills extracted - resume might be under-parsed"),
            ("info", F.size(names) != F.size(F.array_distinct(names)), "Duplicate skills found - consider deduplication"),
            ("error", complete < 0.5, "Resume extraction is severely incomplete"), ("warning", (complete >= 0.5) & (complete < 0.75), "Resume extraction is partially incomplete"),
            ("info", complete == 0.75, "Extraction completeness: 75%"), ("info", complete == 1.0, "Extraction completeness: 100%"),
            ("warning", none(totals) | F.forall(totals, lambda v: v == 0), "No experience duration calculated - clustering may have failed"),
        ]),
    )
    return F.when(x.isNull(), _issues([("error", F.lit(True), "Extraction is empty")])).otherwise(found)


def report(resumes: DataFrame, now: Column) -> DataFrame:
    """id, issues, score, label, valid, completeness of extracted records. A record without an extraction has one error and completeness 0."""
    x = F.col("extraction")
    size = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    complete = completeness(F.coalesce(x["person"]["name"] != "", F.lit(False)), size(x["experience"]), size(x["education"]), size(x["skills"]))
    scored = resumes.select("id", extraction_issues(x, now).alias("issues"), complete.alias("completeness"))
    return scored.withColumn("score", quality_score(F.col("issues"))).withColumn("label", quality_label(F.col("score"))).withColumn("valid", ~F.exists("issues", lambda i: i["severity"] == "error"))


def overall(extraction_score: Column, embedding_score: Column) -> Column:
    return F.coalesce((extraction_score + embedding_score) / 2, extraction_score)


def next_status(parsed_text: Column, duplicate: Column, llm_failed: Column, valid: Column, error: Column) -> Column:
    """ingested -> error | duplicate | warning | ready; a text under 50 trimmed characters is an error."""
    return bind(F.length(F.trim(F.coalesce(parsed_text, F.lit("")))), lambda n: F.when(error.isNotNull() | (n < 50), "error").when(duplicate, "duplicate").when(llm_failed | ~valid, "warning").otherwise("ready"))


def status_path(parsed_text: Column, duplicate: Column, llm_failed: Column, valid: Column, error: Column) -> Column:
    """All states that a record passes, in order: a text that is too short ends while parsing, anything else that fails while extracting; a good record is parsed, then ready."""
    short = F.length(F.trim(F.coalesce(parsed_text, F.lit("")))) < 50
    last = next_status(parsed_text, duplicate, llm_failed, valid, error)
    more = F.when(short, F.array(F.lit("error"))).when(last == "ready", F.array(F.lit("extracting"), F.lit("parsed"), F.lit("ready"))).otherwise(F.array(F.lit("extracting"), last))
    return F.concat(F.array(F.lit("ingested"), F.lit("parsing")), more)


def status_message(status: Column, master: Column, issues: Column) -> Column:
    """What is noted beside a state: the master of a duplicate, the first three errors of a warning."""
    errors = F.slice(F.transform(F.filter(issues, lambda i: i["severity"] == "error"), lambda i: i["message"]), 1, 3)
    return F.when(status == "duplicate", F.concat(F.lit("Duplicate of Master ID "), master.cast("string"))).when((status == "warning") & (F.size(errors) > 0), F.concat(F.lit("Quality issues: "), F.array_join(errors, ", ")))
