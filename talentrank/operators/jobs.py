"""Job analysis: sanitizing, normalization against the vocabulary, keywords, years, clusters of roles."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as tx
from ..functions.arrays import bind, constant_map, jaccard, literal, ordered_distinct, trimmed

#: Words of list items: noise, short terms that count, signs of a description. Fixed values.
STOP = ("and", "or", "the", "etc", "skills", "knowledge", "tools")
SHORT_ALLOWED = ("c", "r", "go", "js", "ts", "ai", "ml", "dl", "os", "qa", "qc", "std", "ui", "ux", "cx", "pm", "hr", "cv", "od", "cpa", "mba", "pmo", "pr", "seo", "sem", "ppc")
DESCRIPTIVE = ("experience", "years", "background", "proficiency", "familiarity", "knowledge", "demonstrated", "proven", "hands-on", "ability", "capability", "minimum", "mandatory")
STACK_DESCRIPTIVE = ("experience", "proficiency", "familiarity", "demonstrated", "background", "knowledge", "understanding", "ability", "leading", "testing", "managing")
KEYWORD_DESCRIPTIVE = ("experience", "testing", "background", "proficiency", "familiarity", "systems", "methodologies", "processes", "strategy", "engineer", "manual", "automation", "advantage", "mandatory", "years")
CASUAL = ("experience testing", "experience in", "background as", "proficiency with", "familiarity with")
BUSINESS_KEYWORDS = ("b2b", "b2g", "g2g", "go-to-market", "gtm", "negotiation", "tenders")
LOCATIONS = (("Europe", r"(?i)\beurope(an)?\b|\bemea\b"), ("Israel", r"(?i)\bisrael\b|\bil\b"), ("United States", r"(?i)\b(usa|u\.s\.a\.|u\.s\.|us|united states)\b"))
CURRENCIES = ("ILS", "USD", "EUR")


def vocabulary(spark) -> DataFrame:
    """(term, bucket, bucket_order): a small fixed dimension."""
    rows = [(t, b, i) for i, (b, terms) in enumerate(dims.VOCABULARY.items()) for t in terms.split("|")]
    return spark.createDataFrame(rows, "term string, bucket string, bucket_order int")


def bucket_of(skill: Column) -> Column:
    """The first bucket, in the declared order, that has the canonical skill; null for none."""
    first = {t: b for b, terms in reversed(dims.VOCABULARY.items()) for t in terms.split("|")}
    return F.try_element_at(constant_map(first), F.lower(skill))


def sanitize_list(items: Column) -> Column:
    """Trimmed, without blanks, stop words and items under 3 characters that aren't allowed; distinct in order."""
    t = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.array_distinct(F.filter(t, lambda x: x.isNotNull() & (x != "") & ~F.lower(x).isin(*STOP) & ((F.length(x) >= 3) | F.lower(x).isin(*SHORT_ALLOWED))))


def _without(items: Column, signs: tuple[str, ...], most_words: int) -> Column:
    """Items of at most so many words that have none of the signs, which are found within words too."""
    return F.filter(items, lambda x: (F.size(tx.words(x)) <= most_words) & ~F.lower(x).rlike("|".join(signs)))


def concrete(items: Column) -> Column:
    """At most 4 words, none of them descriptive."""
    return _without(items, DESCRIPTIVE, 4)


def deduped(items: Column) -> Column:
    """Trimmed, blanks dropped, case-insensitively distinct in order."""
    return ordered_distinct(trimmed(items))


def canonical(skill: Column) -> Column:
    return F.lower(tx.normalize_skill(skill))


def _forms(term: str) -> list[str]:
    """The spellings under which a term counts as present: itself, and without or with spaces for dots and hyphens, of 3 characters at least."""
    other = (v.strip() for v in (term.replace(".", ""), term.replace(".", " "), term.replace("-", ""), term.replace("-", " ")))
    return list(dict.fromkeys([term, *(v for v in other if len(v) >= 3)]))


def _layers(forms: list[str]) -> list[list[str]]:
    """Forms in layers, none of which begins with another of its layer, so that one alternation finds every form of a layer wherever it stands."""
    layers: list[list[str]] = []
    for f in sorted(forms, key=len):
        depth = sum(f.startswith(g) for g in forms if g != f)
        while len(layers) <= depth:
            layers.append([])
        layers[depth].append(f)
    return [x for x in layers if x]


def terms_of() -> list[str]:
    return list(dict.fromkeys(t for terms in dims.VOCABULARY.values() for t in terms.split("|")))


def present_terms(text: Column, terms: list[str] | None = None) -> Column:
    """Vocabulary terms that a text has between other characters than letters and digits, in vocabulary order.

    The text is searched once per layer of spellings (a few times), not once per term. One-letter terms count here too;
    :func:`valid_terms` leaves them out.
    """
    terms = terms_of() if terms is None else terms
    forms = {t: _forms(t) for t in terms}
    every = list(dict.fromkeys(f for fs in forms.values() for f in fs))
    low = F.lower(text)
    hits = [F.regexp_extract_all(low, F.lit(rf"(?<![a-z0-9])(?=({'|'.join(tx.quoted(f) for f in layer)})(?![a-z0-9]))"), 1) for layer in _layers(every)]
    of = {f: [i for i, t in enumerate(terms) if f in forms[t]] for f in every}
    table = constant_map(of, "array<int>")
    places = lambda found: F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda f: F.try_element_at(table, f)))))
    names = F.from_json(F.lit(json.dumps(terms, ensure_ascii=False)), "array<string>")
    return F.transform(bind(F.array_distinct(F.concat(*hits)), places), lambda i: F.get(names, i))


def valid_terms(terms: Column, text: Column) -> Column:
    """Without one-letter terms, and with ambiguous short ones only near programming words."""
    ambiguous = [t for t in dims.AMBIGUOUS_SHORT_TERMS if len(t) > 1]
    out = F.filter(terms, lambda t: F.length(t) > 1)
    for a in ambiguous:
        near = tx.ambiguous_term_near_code(text, a)
        out = F.when(F.array_contains(terms, a) & ~near, F.array_remove(out, a)).otherwise(out)
    return out


def spelled_out(skill: Column, text: Column) -> Column:
    """Whether a text has the skill's canonical name, or that without or with spaces for dots and hyphens, between other characters than letters and digits."""

    def seen(c: Column) -> Column:
        forms = F.array(c, *[F.trim(F.replace(c, F.lit(a), F.lit(b))) for a in (".", "-") for b in ("", " ")])
        good = F.filter(forms, lambda f: (f == c) | (F.length(f) >= 3))
        quoted = F.transform(F.filter(good, lambda f: f != ""), lambda f: F.regexp_replace(f, r"([^A-Za-z0-9_\s])", r"\\$1"))
        return F.coalesce(F.rlike(F.lower(text), F.concat(F.lit("(?<![a-z0-9])(?:"), F.array_join(quoted, "|"), F.lit(")(?![a-z0-9])"))), F.lit(False)) & (c != "")

    return bind(canonical(skill), seen)


def drop_hallucinated(items: Column, present: Column) -> Column:
    """Without vocabulary skills that are not among the text's ``present`` terms; other skills stay."""
    return F.filter(items, lambda s: bucket_of(canonical(s)).isNull() | F.array_contains(present, canonical(s)))


def mentioned_terms(items: Column, buckets=tuple(dims.VOCABULARY)) -> Column:
    """Vocabulary terms that some item has as a substring, item by item in vocabulary order, distinct."""
    terms = literal(list(dict.fromkeys(t for b in buckets for t in dims.VOCABULARY[b].split("|"))))
    return F.array_distinct(F.flatten(F.transform(items, lambda x: F.filter(terms, lambda t: F.lower(x).contains(t)))))


def top_up_must_have(must: Column, nice: Column, requirements: Column) -> Column:
    """Fewer than two must-haves: up to 3 terms that nice-to-haves mention; still fewer: up to 5 that requirements name as such.

    A requirement names a term if it is no description ('experience in' and the like); terms of business and
    management don't count, nor do one-letter ones. Both lists are in vocabulary order.
    """
    fresh = lambda found, have: F.filter(found, lambda t: ~F.exists(have, lambda m: F.lower(m) == t))
    one = F.when(F.size(must) < 2, F.concat(must, fresh(F.slice(mentioned_terms(nice), 1, 3), must))).otherwise(must)
    technical = tuple(b for b in dims.VOCABULARY if b not in ("business", "management"))

    def more(have: Column) -> Column:
        plain = F.filter(requirements, lambda r: ~F.lower(r).rlike("|".join(CASUAL)))
        order = literal(list(dict.fromkeys(t for b in technical for t in dims.VOCABULARY[b].split("|"))))
        named = mentioned_terms(plain, technical)
        found = valid_terms(F.filter(order, lambda t: F.array_contains(named, t)), F.lower(F.array_join(requirements, " ")))
        return F.when(F.size(have) < 2, F.concat(have, F.slice(fresh(found, have), 1, 5))).otherwise(have)

    return bind(one, more)


def tech_stack(skills: Column, present: Column, valid: Column, text: Column) -> Column:
    """map bucket -> canonical names: of skills that the text spells out (unknown ones are tools) and of the text's valid vocabulary terms.

    Names are sorted, without descriptions; domains are capitalized and in order of appearance in the lists.
    """
    bucketed = F.transform(
        F.filter(skills, lambda s: F.when(bucket_of(canonical(s)).isNotNull(), F.array_contains(present, canonical(s))).otherwise(spelled_out(s, text))),
        lambda s: F.struct(F.coalesce(bucket_of(s), bucket_of(canonical(s)), F.lit("tools")).alias("b"), canonical(s).alias("t")),
    )
    defended = F.lower(text).rlike("defen[sc]e")

    def built(seeds: Column) -> Column:
        def section(b: str) -> Column:
            own = literal(dims.VOCABULARY[b].split("|"))
            names = F.concat(F.transform(F.filter(seeds, lambda x: x["b"] == b), lambda x: x["t"]), F.transform(F.filter(own, lambda t: F.array_contains(valid, t)), canonical))
            if b == "domains":
                return ordered_distinct(F.transform(F.concat(names, F.when(defended, F.array(F.lit("defense"))).otherwise(F.array().cast("array<string>"))), lambda x: tx.normalize_skill(x)))
            return F.array_sort(F.array_distinct(_without(F.transform(names, canonical), STACK_DESCRIPTIVE, 4)))

        return F.map_from_arrays(literal(list(dims.VOCABULARY)), F.array(*[section(b) for b in dims.VOCABULARY]))

    return bind(bucketed, built)


def keywords(stack: Column, skills: Column, present: Column, text: Column, n: int = 20) -> Column:
    """Names of technologies (of the stack's technical sections), some business terms, and skills that the text has; the first ``n``.

    They are ordered by how often the name as it is written occurs in the lower-cased text, then by alphabet;
    so names with capitals, whose count is 0, follow in alphabetical order.
    """
    low = F.lower(text)
    there = lambda t: F.when(bucket_of(t).isNotNull(), F.array_contains(present, t)).otherwise(spelled_out(t, low))
    of = lambda b: F.coalesce(F.try_element_at(stack, F.lit(b)), F.array().cast("array<string>"))
    good = lambda a: F.filter(valid_terms(_without(a, KEYWORD_DESCRIPTIVE, 3), low), lambda t: ~t.isin(*dims.KEYWORD_BLACKLIST) & there(t))
    technical = good(F.concat(*[of(b) for b in ("languages", "frameworks", "databases", "cloud", "tools")]))
    business = F.filter(of("business"), lambda t: t.isin(*BUSINESS_KEYWORDS) & there(t))
    named = good(F.transform(_without(skills, KEYWORD_DESCRIPTIVE, 3), canonical))
    names = ordered_distinct(F.transform(F.concat(technical, business, named), lambda x: tx.normalize_skill(x)))
    count = lambda k: F.size(F.split(low, F.concat(F.lit("\\Q"), k, F.lit("\\E")), -1)) - 1
    return F.slice(F.transform(F.array_sort(F.transform(names, lambda k: F.struct((-count(k)).alias("n"), k.alias("k")))), lambda x: x["k"]), 1, n)


def locations(text: Column) -> Column:
    """Europe, Israel, United States, as far as the text names them."""
    return F.filter(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in LOCATIONS]), lambda x: x.isNotNull())


def languages(text: Column) -> Column:
    """Spoken languages whose name the text contains, capitalized."""
    return F.transform(F.filter(literal(dims.HUMAN_LANGUAGES), lambda w: F.lower(text).contains(w)), F.initcap)


def fallback_summary(places: Column, domains: Column, requirements: Column, responsibilities: Column, business: Column) -> Column:
    """The summary of a job that has none, from places, domain and what requirements and responsibilities mention."""
    says = lambda items, word: F.exists(items, lambda r: F.lower(r).contains(word))
    both = F.concat(requirements, responsibilities)
    bits = F.array(
        F.when(says(both, "tender"), F.lit("tenders")), F.when(says(both, "contract"), F.lit("contracts")), F.when(says(responsibilities, "channel") | says(responsibilities, "partnership"), F.lit("channels/partnerships")),
        F.when(F.exists(business, lambda t: t.rlike("go-to-market|gtm")), F.lit("GTM")), F.when(says(both, "travel"), F.lit("frequent travel")),
    )
    some = F.slice(F.filter(bits, lambda b: b.isNotNull()), 1, 3)
    region = F.when(F.size(places) > 0, F.concat(F.lit(" in "), F.array_join(places, ", "))).otherwise("")
    domain = F.when(F.array_contains(domains, "defense"), " in defense").otherwise("")
    return F.concat(F.lit("Own full-cycle business development and sales"), region, domain, F.when(F.size(some) > 0, F.concat(F.lit(": "), F.array_join(some, ", "))).otherwise(""), F.lit("."))


def normalize_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs with normalized text, language, tokens and an analysis whose skills are concrete, present in the text and bucketed.

    Null texts and analyses are empty. The text's vocabulary terms are found once and serve every rule.
    """
    a = F.col("analysis")
    none = F.array().cast("array<string>")
    text = F.lower(F.concat_ws(" ", "title", "job_description", "free_text"))
    base = jobs.withColumn("normalized_text", tx.normalize_text(F.col("title"), F.col("job_description"), F.col("free_text"))).withColumn("lang", tx.detect_language(text)).withColumn("tokens", tx.approx_token_count(F.col("normalized_text")))
    base = base.withColumns({"_text": text, "_present": present_terms(text), "_requirements": deduped(a["requirements"]), "_responsibilities": deduped(a["responsibilities"]), "_wishes": deduped(sanitize_list(a["skills"]["nice_to_have"]))})
    base = base.withColumns({
        "_valid": valid_terms(F.col("_present"), F.col("_text")), "_nice": drop_hallucinated(concrete(F.col("_wishes")), F.col("_present")),
        "_must": drop_hallucinated(concrete(deduped(sanitize_list(a["skills"]["must_have"]))), F.col("_present")),
    })
    base = base.withColumn("_must", top_up_must_have(F.col("_must"), F.col("_wishes"), F.col("_requirements")))
    skills = F.concat("_must", "_nice")
    base = base.withColumn("_stack", tech_stack(skills, F.col("_present"), F.col("_valid"), F.col("_text")))
    places = F.coalesce(F.when(F.size(a["locations"]) > 0, a["locations"]), locations(F.col("_text")))
    given, read = a["experience"], tx.required_years(F.col("_text"))
    open_ended = given["years_min"].isNull() | given["years_max"].isNull()
    ranged = open_ended & read["years_max"].isNotNull()
    spoken = F.filter(F.transform(F.coalesce(a["languages"], none), lambda x: F.trim(x)), lambda x: x.isNotNull())
    of = lambda b: F.try_element_at(F.col("_stack"), F.lit(b))
    pay = a["salary_range"]
    return base.select(
        *[c for c in jobs.columns if c not in ("analysis", "normalized_text", "lang", "tokens")], "normalized_text", "lang", "tokens", F.struct(
            F.coalesce(a["role_title"], F.col("title")).alias("role_title"), F.when(tx.valid_icon(a["icon"]), a["icon"]).alias("icon"), F.coalesce(a["is_tech_role"], F.lit(True)).alias("is_tech_role"), F.nullif(a["organization"], F.lit("")).alias("organization"),
            F.coalesce(tx.clean(a["summary"]), fallback_summary(places, of("domains"), F.col("_requirements"), F.col("_responsibilities"), of("business"))).alias("summary"), places.alias("locations"),
            F.col("_responsibilities").alias("responsibilities"), F.col("_requirements").alias("requirements"),
            F.struct(F.col("_must").alias("must_have"), F.col("_nice").alias("nice_to_have")).alias("skills"), F.coalesce(a["additional_skills"], none).alias("additional_skills"),
            F.struct(F.when(ranged, read["years_min"]).otherwise(F.coalesce(given["years_min"], read["years_min"])).alias("years_min"), F.when(ranged, read["years_max"]).otherwise(given["years_max"]).alias("years_max")).alias("experience"),
            deduped(a["education"]).alias("education"), F.struct(pay["min"].alias("min"), pay["max"].alias("max"), F.when(pay["currency"].isin(*CURRENCIES), pay["currency"]).alias("currency")).alias("salary_range"),
            F.struct(F.coalesce(a["security_clearance"]["mentioned"], F.lit(False)).alias("mentioned"), F.nullif(a["security_clearance"]["note"], F.lit("")).alias("note")).alias("security_clearance"),
            F.col("_stack").alias("tech_stack"), F.when(F.size(spoken) > 0, spoken).otherwise(languages(F.col("_text"))).alias("languages"),
            keywords(F.col("_stack"), skills, F.col("_present"), F.col("_text")).alias("keywords"), deduped(a["evidence"]).alias("evidence"),
        ).alias("analysis"),
    )


def role_similarity(company: Column, title: Column, other_company: Column, other_title: Column) -> Column:
    """0.6 company + 0.4 title; each the Jaccard of normalized words, raised to 0.9 and 0.85 where one contains the other; a blank first side is 0."""

    def side(a: Column, b: Column, least: float) -> Column:
        x, y = tx.norm_text(F.coalesce(a, F.lit(""))), tx.norm_text(F.coalesce(b, F.lit("")))
        j = jaccard(F.array_distinct(tx.words(x)), F.array_distinct(tx.words(y)))
        return F.when(x == "", 0.0).when(x.contains(y) | y.contains(x), F.greatest(j, F.lit(least))).otherwise(j)

    return 0.6 * side(company, other_company, 0.9) + 0.4 * side(title, other_title, 0.85)


def best_role(members: Column, roles: Column, excluded: Column | None = None, least: float = 0.55) -> Column:
    """For each cluster member the role of equal lower title and company (the last such), else the strictly best one (first on ties) of at least ``least``: array<struct<member, role, score>>.

    ``excluded``: normalized names of education institutions, whose roles are no soft match. An exact match has score 1.
    """
    excluded = F.array().cast("array<string>") if excluded is None else excluded
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))

    def best(m: Column) -> Column:
        same = F.filter(roles, lambda r: (low(r["title"]) == low(m["title"])) & (low(r["company"]) == low(m["company"])))
        each = F.transform(roles, lambda r, i: F.struct(F.when(F.array_contains(excluded, tx.norm_text(F.coalesce(r["company"], F.lit("")))), 0.0).otherwise(role_similarity(m["company"], m["title"], r["company"], r["title"])).alias("score"), (-i).alias("i")))
        soft = bind(F.array_max(each), lambda b: F.when(b["score"] >= least, F.struct(m.alias("member"), F.get(roles, -b["i"]).alias("role"), b["score"].alias("score"))))
        return bind(same, lambda s: F.when(F.size(s) > 0, F.struct(m.alias("member"), F.element_at(s, -1).alias("role"), F.lit(1.0).alias("score"))).otherwise(soft))

    return F.filter(F.transform(members, best), lambda x: x.isNotNull())
