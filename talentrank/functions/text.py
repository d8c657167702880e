"""Text functions: normalization, extraction, labels. Column to Column."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from .arrays import bind, constant_map, literal, ordered_distinct


def quoted(term: str) -> str:
    """A literal as a regular expression that both Java and RE2 read."""
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", term)


def clean(c: Column) -> Column:
    """Trimmed, blank to null."""
    return F.nullif(F.trim(c), F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def approx_token_count(c: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(words(c)), F.lit(0)).cast("long")


def title_case(c: Column) -> Column:
    """Every run of letters capitalized, the rest lower: 'node.js rest-api' to 'Node.Js Rest-Api'."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000)))), "")


def variants_map(variants: dict[str, str] | None = None) -> Column:
    v = dims.skill_variants() if variants is None else variants
    return constant_map(v)


def normalize_skill(c: Column, variants: dict[str, str] | None = None) -> Column:
    """Canonical skill name: a trailing version or year goes, the dictionary decides, then the name without js or ts, else title case. Null and blank stay."""
    table = variants_map(variants)
    base = F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+v?\d+(\.\d+)*\s*$", ""), r"\s+\d{4}\s*$", "")

    def found(name: Column) -> Column:
        low = F.lower(name)
        look = lambda k: F.try_element_at(table, k)
        cut = [F.when(low.endswith(s) & (F.length(low) > len(s)), look(F.trim(F.substring(low, F.lit(1), F.length(low) - len(s))))) for s in (".js", "js", ".ts", "ts")]
        return F.coalesce(look(low), *cut, title_case(name))

    return F.when(c.isNull() | (F.trim(c) == ""), c).otherwise(bind(base, found))


def normalize_skill_list(items: Column, variants: dict[str, str] | None = None) -> Column:
    return ordered_distinct(F.filter(F.transform(items, lambda x: normalize_skill(x, variants)), lambda x: x.isNotNull() & (x != "")))


def same_skill(a: Column, b: Column) -> Column:
    return F.lower(normalize_skill(a)) == F.lower(normalize_skill(b))


def hard_skills(items: Column) -> Column:
    """Concrete technologies: generic words go, items with a soft word or nothing left go; distinct in order."""
    core = F.transform(items, lambda x: F.filter(words(x), lambda w: ~F.lower(w).isin(*dims.GENERIC_SKILL_WORDS)))
    kept = F.filter(core, lambda ws: (F.size(ws) > 0) & ~F.exists(ws, lambda w: F.lower(w).isin(*dims.SOFT_WORDS)))
    return F.array_distinct(F.transform(kept, lambda ws: F.array_join(ws, " ")))


def sentences(c: Column) -> Column:
    """Sentences of collapsed text, cut after . ! ? before white space."""
    return F.filter(F.transform(F.split(collapse(c), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def strip_tags(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"<[^>]+>", " "))


def normalize_text(*parts: Column) -> Column:
    """Parts joined, tags stripped, repeated sentences (case-insensitive) once."""
    joined = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.array_join(ordered_distinct_hash(sentences(strip_tags(joined))), " ")


def ordered_distinct_hash(items: Column) -> Column:
    """As ordered_distinct, in time linear in the items: the first place of each lower form comes from one pass."""

    def first(a: Column) -> Column:
        low = F.transform(a, F.lower)
        return bind(low, lambda lo: bind(F.array_distinct(lo), lambda d: F.when(F.size(d) == F.size(lo), a).otherwise(F.transform(d, lambda k: F.get(a, F.array_position(lo, k).cast("int") - 1)))))

    return bind(items, first)


def detect_language(c: Column) -> Column:
    """he, ar, ru by script, else en."""
    return F.when(c.rlike("[֐-׿]"), "he").when(c.rlike("[؀-ۿ]"), "ar").when(c.rlike("[Ѐ-ӿ]"), "ru").otherwise("en")


def name_from_path(c: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.[^.]*$", "")
    return F.initcap(F.lower(F.translate(stem, "_-", "  ")))


def norm_text(c: Column) -> Column:
    """Lower, & to and, other than a-z 0-9 to one space."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " "))


def person_name(c: Column) -> Column:
    """Latin letters, spaces, hyphens and apostrophes; the name as it is if none is left."""
    return F.coalesce(clean(F.regexp_replace(c, r"[^a-zA-Z\s\-']", "")), c)


def url_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), "/+$", ""))


def phone_il(c: Column) -> Column:
    """International form: + and digits; a leading 0 with 8 or 9 digits after it becomes +972."""
    d = F.regexp_replace(c, r"[^\d+]", "")
    return F.when(d.startswith("+"), F.concat(F.lit("+"), F.regexp_replace(d, r"\D", ""))).when(d.rlike(r"^0\d{8,9}$"), F.concat(F.lit("+972"), F.substring(d, 2, 20))).when(d.rlike(r"\d"), F.concat(F.lit("+"), d)).otherwise(c)


def phone_display(c: Column) -> Column:
    """Local display form: 05x-xxx-xxxx, 0x-xxxxxxx, else by length."""
    d = F.regexp_replace(F.regexp_replace(c, r"[^\d+]", ""), r"^(?:\+972|00972|972)0?", "0")
    group = lambda pattern, form: F.regexp_replace(d, pattern, form)
    return (
        F.when(d.rlike(r"^05\d{8}$"), group(r"^(\d{3})(\d{3})(\d{4})$", "$1-$2-$3")).when(d.rlike(r"^0[23489]\d{7}$"), group(r"^(\d{2})(\d{7})$", "$1-$2"))
        .when(d.rlike(r"^07\d{8}$"), group(r"^(\d{3})(\d{7})$", "$1-$2")).when(d.rlike(r"^\d{10}$"), group(r"^(\d{3})(\d{3})(\d{4})$", "$1-$2-$3"))
        .when(d.rlike(r"^\d{9}$"), group(r"^(\d{2})(\d{7})$", "$1-$2")).otherwise(c)
    )


def emails(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(dims.EMAIL), 0)


def phones(c: Column) -> Column:
    """Phone candidates of 8 to 16 digits that are not year ranges, in international form, distinct."""
    raw = F.filter(F.regexp_extract_all(c, F.lit(dims.PHONE), 0), lambda p: ~p.rlike(dims.YEAR_RANGE) & F.length(F.regexp_replace(p, r"\D", "")).between(8, 16))
    return F.array_distinct(F.transform(raw, phone_il))


def urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(dims.URL), 0)


def profiles(c: Column) -> Column:
    """LinkedIn and GitHub links as array<struct<type,value>>."""
    kind = lambda pattern, name: F.transform(F.regexp_extract_all(c, F.lit(pattern), 0), lambda v: F.struct(F.lit(name).alias("type"), v.alias("value")))
    return F.array_distinct(F.concat(kind(dims.LINKEDIN, "linkedin"), kind(dims.GITHUB, "github")))


def spoken_languages(c: Column) -> Column:
    return F.array_sort(F.transform(F.filter(literal(dims.SPOKEN), lambda w: F.rlike(F.lower(c), F.concat(F.lit(r"\b"), w, F.lit(r"\b")))), F.initcap))


def scan_skills(c: Column, terms=tuple(dims.SCAN_TERMS)) -> Column:
    """Canonical names of the dictionary terms in a text, in dictionary order."""
    return F.array_distinct(F.filter(F.array(*[F.when(c.rlike(rf"(?i)(?<![A-Za-z0-9+]){quoted(t)}(?![A-Za-z0-9+])"), F.lit(t)) for t in terms]), lambda t: t.isNotNull()))


def name_heuristic(c: Column) -> Column:
    """The first of the first three lines that has 2 to 4 words of letters, none of them a heading; none if that line is Hebrew."""
    blocked = ("resume", "cv", "curriculum", "vitae", "profile", "summary", "contact", "phone", "email", "address", "קורות", "חיים")
    lines = F.slice(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 3)
    tidy = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "[-|•]", " ")))
    good = F.filter(tidy, lambda x: x.rlike(r"^\p{L}+(\s+\p{L}+){1,3}$") & ~F.exists(F.split(F.lower(x), r"\s+"), lambda w: w.isin(*blocked)))
    return bind(F.get(good, F.lit(0)), lambda n: F.when(~n.rlike("[֐-׿]"), n))


def is_broken(c: Column) -> Column:
    """Extraction is broken: empty, or over 10 lines of which over 40 % have at most 2 characters."""
    lines = F.split(c, "\n")
    short = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) <= 2))
    return F.coalesce((F.trim(c) == "") | ((F.size(lines) > 10) & (short > 0.4 * F.size(lines))), F.lit(True))


def boundary_match(text: Column, term: str) -> Column:
    """The term or a variant of it (dots and hyphens dropped or spaced, of 3 characters at least) between characters other than a-z 0-9."""
    forms = {term, *(v for v in (term.replace(".", ""), term.replace(".", " "), term.replace("-", ""), term.replace("-", " ")) if len(v.strip()) >= 3)}
    return F.lower(text).rlike("|".join(rf"(?<![a-z0-9]){quoted(f.strip())}(?![a-z0-9])" for f in sorted(forms)))


def ambiguous_term_near_code(text: Column, term: str) -> Column:
    """A short word term within 50 characters of a programming word."""
    context = "|".join(quoted(w) for w in dims.PROGRAMMING_CONTEXT)
    near = rf"(?is)(?:{context}).{{0,50}}\b{quoted(term)}\b|\b{quoted(term)}\b.{{0,50}}(?:{context})"
    return F.lit(False) if len(term) <= 1 else text.rlike(near)


def edge_pattern(term: str) -> str:
    r"""The escaped term with \b only where its edge is a word character."""
    left, right = (r"\b" if re.match(r"\w", term[:1]) else ""), (r"\b" if re.match(r"\w", term[-1:]) else "")
    return f"(?i){left}{quoted(term)}{right}"


def text_has_skill(text: Column, skill: str) -> Column:
    """The text fallback of skill matching: flexible spaces, boundaries where they can be."""
    return text.rlike(edge_pattern(skill).replace(" ", r"\s+"))


def required_years(c: Column) -> Column:
    """struct<years_min, years_max> from 'a-b years' or 'n+ years'."""
    span = r"(?i)(\d+)\s*[-–]\s*(\d+)\s+years?"
    one = r"(?i)(\d+)\s*\+?\s+years?"
    get = lambda p, g: F.regexp_extract(c, p, g).try_cast("int")
    return F.struct(F.coalesce(get(span, 1), get(one, 1)).alias("years_min"), get(span, 2).alias("years_max"))


def valid_icon(c: Column) -> Column:
    return (F.length(c) <= 8) & c.rlike(r"[^\x00-\x7F]")


def format_years(c: Column) -> Column:
    """'0 yrs', '<1 yr', 'n yrs' or one decimal."""
    return F.when(c.isNull() | (c <= 0), "0 yrs").when(c < 1, "<1 yr").when(c == F.floor(c), F.concat(c.cast("long").cast("string"), F.lit(" yrs"))).otherwise(F.concat(F.format_string("%.1f", F.bround(c, 1)), F.lit(" yrs")))


def years_label(low: Column, high: Column) -> Column:
    a, b = F.nullif(low, F.lit(0)), F.nullif(high, F.lit(0))
    s = lambda x: x.cast("string")
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(s(a), F.lit("-"), s(b), F.lit(" yrs"))).when(a.isNotNull(), F.concat(s(a), F.lit("+ yrs"))).when(b.isNotNull(), F.concat(F.lit("Up to "), s(b), F.lit(" yrs")))


def stability_badge(c: Column) -> Column:
    out = F.when(c.isNull() | (c == 0), "Unknown")
    for least, name in ((90, "Excellent"), (80, "Good"), (70, "OK"), (60, "Moderate"), (50, "Concern")):
        out = out.when(c >= least, name)
    return out.otherwise("High Risk")


def score_band(c: Column) -> Column:
    return F.when(c >= 85, "high").when(c >= 75, "good").when(c >= 65, "fair").otherwise("low")


def count_bullets(c: Column) -> Column:
    """Parts between bullet signs that are not blank."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "•"), lambda x: F.regexp_replace(x, r"\s+", "") != "")).cast("long")


def no_concerns(c: Column) -> Column:
    """Empty, or one of the phrases that say so."""
    low = F.lower(collapse(c))
    begins = [low.startswith(p) for p in ("no significant concerns", "לא זוהו חששות", "אין חששות")]
    return F.coalesce((c == "") | low.isin("no concerns", "none") | begins[0] | begins[1] | begins[2], F.lit(True))


def bullets_text(items: Column) -> Column:
    return F.coalesce(F.array_join(items, "\n"), F.lit(""))


def expand_query_skill(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000))


def html_preview(c: Column) -> Column:
    """Escaped text in a pre element, right to left if it has Hebrew."""
    safe = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit('<pre dir="'), F.when(c.rlike("[֐-׿]"), "rtl").otherwise("ltr"), F.lit('">'), safe, F.lit("</pre>"))


def strip_fences(c: Column) -> Column:
    """JSON text without code fences, from its first { to its last }; :func:`try_parse` for the rest."""
    return F.regexp_extract(F.regexp_replace(c, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)


def tag_dates(c: Column) -> Column:
    """Ranges of Hebrew months or of years to [DATE:from..to] (ISO dates, PRESENT for open ends), then every bare year to [YEAR:y]."""
    open_end = "כיום|הווה|נוכחי|present|now"
    year, months = r"(?:20\d{2}|19\d{2})", "|".join(dims.HEBREW_MONTHS)
    edge, end = r"(?U)(?i)\b", r"\b"
    t = F.regexp_replace(c, rf"{edge}({months})\s+({year})\s*[-–]\s*(?:{months})\s+(?:{open_end}){end}", "[DATE:$2-$1-01..PRESENT]")
    t = F.regexp_replace(t, rf"{edge}({months})\s+({year})\s*[-–]\s*({months})\s+({year}){end}", "[DATE:$2-$1-01..$4-$3-01]")
    for i, m in enumerate(dims.HEBREW_MONTHS, 1):  # month names stand inside the tags now
        t = F.regexp_replace(t, rf"(?<=(?:DATE:|\.\.)\d{{4}}-){m}(?=-01)", f"{i:02d}")
    t = F.regexp_replace(t, rf"{edge}(?<!DATE:)(?<!\.\.)({year})\s*[-–]\s*(?:{open_end}){end}", "[DATE:$1-01-01..PRESENT]")
    t = F.regexp_replace(t, rf"{edge}({year})\s*[-–]\s*({year}){end}", "[DATE:$1-01-01..$2-01-01]")
    return F.regexp_replace(t, rf"{edge}({year}){end}", "[YEAR:$1]")


def _plain_letters(s):  # noqa: ANN001, ANN202
    import pandas as pd

    strip = lambda t: "".join(ch for ch in unicodedata.normalize("NFKD", unicodedata.normalize("NFC", t)) if not unicodedata.combining(ch))
    return pd.Series(s).map(strip, na_action="ignore")


def plain_letters(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose column ``name`` is decomposed (NFKD) without combining marks where it has Hebrew.

    Spark SQL has no Unicode normalization, so texts with Hebrew, and these alone, pass through Arrow batches;
    the others stay in the JVM.
    """
    hebrew = F.coalesce(F.col(name).rlike("[֐-׿]"), F.lit(False))
    schema = rows.schema

    def run(frames: Iterator) -> Iterator:
        for f in frames:
            f[name] = _plain_letters(f[name])
            yield f

    return rows.where(~hebrew).unionByName(rows.where(hebrew).mapInPandas(run, schema))


#: Hebrew section headings and the section that each opens, in the order in which they are applied. Fixed values.
HEBREW_HEADINGS = (
    (r"ניסיון", "EXPERIENCE"), (r"ניסיון\s+תעסוקתי", "EXPERIENCE"), (r"ניסיון\s+מקצועי", "EXPERIENCE"), (r"פרויקט(ים)?", "PROJECTS"), (r"פרויקטים", "PROJECTS"),
    (r"תפקיד(ים)?", "EXPERIENCE"), (r"טכנולוגיות", "SKILLS"), (r"מיומנויות", "SKILLS"), (r"כישורים", "SKILLS"), (r"שפות\s*(תכנות)?", "SKILLS"), (r"כלים", "SKILLS"),
    (r"השכלה", "EDUCATION"), (r"לימודים", "EDUCATION"), (r"שפות", "LANGUAGES"), (r"פרופיל", "SUMMARY"), (r"תקציר", "SUMMARY"), (r"סיכום", "SUMMARY"),
    (r"שירות\s+צבאי", "MILITARY"), (r"קורס(ים)?", "COURSES"),
)
#: Signs and what stands for them. Fixed values.
PLAIN_SIGNS = (("[–—]", "-"), ("[“”‟״]", '"'), ("’", "'"), ("‚", ","), ("˙", "."))


def mark_hebrew(c: Column) -> Column:
    """The chain for text of plain letters: signs and bullets unified, headings and dates tagged, direction marks around Latin words and Hebrew lines."""
    t = c
    for pattern, sign in PLAIN_SIGNS:
        t = F.regexp_replace(t, pattern, sign)
    t = F.regexp_replace(F.regexp_replace(t, r"\s*:\s*", ": "), r"[ \t]+", " ")
    t = F.regexp_replace(t, r"(?m)^\s*[\u2022\u2023\u25E6\u2043\u2219\-\*]\s*", "- ")
    for heading, tag in HEBREW_HEADINGS:
        t = F.regexp_replace(t, rf"(?U)(?im)^\s*\b{heading}\b\s*[:\-]?\s*$", f"<<SECTION:{tag}>>")
    hebrew = "[֐-׿]"
    lines = lambda x, f: F.array_join(F.transform(F.split(F.regexp_replace(x, r"(?:\r\n|[\n\r])\z", ""), r"\r\n|[\n\r]"), lambda line: F.when(line.rlike(hebrew), f(line)).otherwise(line)), "\n")
    t = tag_dates(lines(t, lambda line: F.regexp_replace(line, "([A-Za-z]+)", "\u200e$1\u200e")))
    return lines(t, lambda line: F.concat(F.lit("\u200f"), line, F.lit("\u200e")))


def prepare_hebrew(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose column ``name`` went through :func:`plain_letters` and :func:`mark_hebrew` where it has Hebrew; other texts and nulls stay as they are."""
    hebrew = F.col(name).rlike("[֐-׿]")
    return plain_letters(rows, name).withColumn(name, F.when(hebrew, mark_hebrew(F.col(name))).otherwise(F.col(name)))


def first_hebrew_contact(c: Column) -> Column:
    """struct<email, phone>: the first of each; a mobile number without spaces and hyphens, in international form."""
    raw = F.nullif(F.regexp_extract(c, r"(\+972-?\s?\d{8,9}|\+972\d{8,9}|0?5\d-?\s?\d{7})", 0), F.lit(""))
    p = F.translate(raw, " -", "")
    phone = F.when(p.startswith("05"), F.concat(F.lit("+972"), F.substring(p, 2, 20))).when(p.startswith("+9720"), F.concat(F.lit("+972"), F.substring(p, 6, 20))).otherwise(p)
    return F.struct(F.nullif(F.regexp_extract(c, r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", 0), F.lit("")).alias("email"), phone.alias("phone"))


def salary_label(low: Column, high: Column, currency: Column) -> Column:
    """'a-b CUR', 'a+ CUR' or 'Up to b CUR'; 0 counts as absent."""
    a, b = F.nullif(low, F.lit(0)), F.nullif(high, F.lit(0))
    s = lambda x: F.format_number(x, 0)
    sign = F.coalesce(F.concat(F.lit(" "), currency), F.lit(""))
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(s(a), F.lit("-"), s(b), sign)).when(a.isNotNull(), F.concat(s(a), F.lit("+"), sign)).when(b.isNotNull(), F.concat(F.lit("Up to "), s(b), sign))


def spans(c: Column, pattern: str, confidence: float = 0.98) -> Column:
    """array<struct<value, start, end, confidence>> of a pattern's matches; offsets in characters, the end after the last.

    The text is split at its matches once; places are running lengths of what lies between.
    """
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)
    between = F.split(c, pattern, -1)

    def placed(values: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("at"), F.concat(acc["all"], F.array(F.struct(x["value"].alias("value"), (acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("end"), F.lit(confidence).alias("confidence")))).alias("all"))
        pairs = F.transform(values, lambda v, i: F.struct(F.get(between, i).alias("gap"), v.alias("value")))
        empty = F.array().cast("array<struct<value:string,start:int,end:int,confidence:double>>")
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("all")), step, lambda acc: acc["all"])

    return F.coalesce(bind(found, placed), F.array().cast("array<struct<value:string,start:int,end:int,confidence:double>>"))


def email_spans(c: Column) -> Column:
    return spans(c, dims.EMAIL)


def phone_spans(c: Column) -> Column:
    """Phone candidates with their places, in international form; year ranges and other numbers of digits than 8 to 16 go."""
    good = F.filter(spans(c, dims.PHONE), lambda p: ~F.trim(p["value"]).rlike(dims.YEAR_RANGE))
    plain = F.transform(good, lambda p: F.struct(phone_il(p["value"]).alias("value"), p["start"], p["end"], p["confidence"]))
    return F.filter(plain, lambda p: F.length(F.regexp_replace(p["value"], r"\D", "")).between(8, 16))


def skill_counts(c: Column, terms=None) -> Column:
    """map canonical name -> how often the dictionary's terms for it occur in the text."""
    terms = dims.SCAN_TERMS if terms is None else terms
    counted = F.array(*[F.struct(normalize_skill(F.lit(t)).alias("k"), F.regexp_count(c, F.lit(rf"(?i)(?<![A-Za-z0-9+]){quoted(t)}(?![A-Za-z0-9+])")).alias("n")) for t in terms])
    found = F.filter(counted, lambda x: x["n"] > 0)
    return bind(found, lambda a: F.map_from_entries(F.transform(F.array_distinct(F.transform(a, lambda x: x["k"])), lambda k: F.struct(k, F.aggregate(F.filter(a, lambda x: x["k"] == k), F.lit(0), lambda s, x: s + x["n"])))))
