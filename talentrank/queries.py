"""Named queries: the operators bound to the relational and document tables, each with its SQL where SQL can say it.

Bindings: a document is a record, a benchmark item a job post, a customer a candidate whose skills are the
brands bought (used at work where the line is finished), an order an employment with its last shipment as the end.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dims, schema
from .functions import arrays, dates, rules, vector
from .functions import text as tx
from .functions.dates import age_days
from .operators import clusters, dedup, extraction, quality_report, ranking, scoring, search, stats, store
from .operators import jobs as jobs_ops
from .plans import providers
from .plans.tables import shared_table
from .sources import tables
from .streaming import ingest as streams

REQUIRED = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#6"]
BONUS = ["Brand#7", "Brand#8"]
YEARS_MIN = 5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lit_array(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs])


# --- scans, pages, lookups ---------------------------------------------------------------------------------


@query("""SELECT doc_id, source, n_chars, CASE WHEN l.toxic = 1 THEN 'error' WHEN l.doc_id IS NULL THEN 'ingested' ELSE 'ready' END AS status
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE (l.toxic IS NULL OR l.toxic <> 1) AND length(trim(text)) >= 50""")
def q_resume_scan_ready(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "source", "n_chars", (F.length(F.trim("text")) >= 50).alias("long_enough"))
    rows = docs.join(t(spark, sf, "labels").select("doc_id", "toxic", F.lit(True).alias("known")), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "error").when(F.col("known").isNull(), "ingested").otherwise("ready")
    return rows.withColumn("status", status).where("long_enough").where(~F.col("status").isin("duplicate", "error")).select("doc_id", "source", "n_chars", "status")


@query("SELECT doc_id, n_chars, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30 OFFSET 20")
def q_resume_page(spark, sf):
    return tables.paged(t(spark, sf, "documents").select("doc_id", "n_chars", "source"), [F.desc("n_chars"), F.asc("doc_id")], 20, 30)


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def q_content_hash_dedup(spark, sf):
    return t(spark, sf, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""SELECT CAST(v.pos AS INTEGER) AS pos, d.doc_id, d.n_chars FROM (VALUES (0, 5), (1, 3), (2, 99999999), (3, 8), (4, 1)) v(pos, id)
JOIN documents d ON d.doc_id = v.id ORDER BY pos""")
def q_bulk_fetch_order(spark, sf):
    return tables.in_order(t(spark, sf, "documents").select("doc_id", "n_chars"), [5, 3, 99999999, 8, 1], "doc_id").select("pos", "doc_id", "n_chars")


# --- extraction and text -----------------------------------------------------------------------------------


@query(r"""SELECT doc_id, array_to_string(e, ',') AS emails, CAST(len(e) AS INTEGER) AS n
FROM (SELECT doc_id, regexp_extract_all(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}') e FROM documents)""")
def q_email_extract(spark, sf):
    e = t(spark, sf, "documents").select("doc_id", tx.emails(F.col("text")).alias("e"))
    return e.select("doc_id", F.array_join("e", ",").alias("emails"), F.size("e").alias("n"))


@query(r"""WITH raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '(^|[^\d])(\+?\d[\d\s().\-]{7,}\d)', 2)) AS p FROM documents),
plain AS (SELECT doc_id, regexp_replace(p, '[^\d+]', '', 'g') AS d FROM raw WHERE NOT regexp_matches(p, '^\s*\d{4}\s*[-–—]\s*\d{4}\s*$') AND length(regexp_replace(p, '\D', '', 'g')) BETWEEN 8 AND 16),
phone AS (SELECT DISTINCT doc_id, CASE WHEN d LIKE '+%' THEN '+' || regexp_replace(d, '\D', '', 'g') WHEN regexp_matches(d, '^0\d{8,9}$') THEN '+972' || d[2:] ELSE '+' || d END AS phone FROM plain),
loc AS (SELECT *, regexp_replace(phone, '^(?:\+972|00972|972)0?', '0') AS l FROM phone)
SELECT doc_id, phone, CASE WHEN regexp_matches(l, '^05\d{8}$') OR regexp_matches(l, '^\d{10}$') AND NOT regexp_matches(l, '^07\d{8}$') THEN l[1:3] || '-' || l[4:6] || '-' || l[7:] WHEN regexp_matches(l, '^07\d{8}$') THEN l[1:3] || '-' || l[4:]
WHEN regexp_matches(l, '^\d{9}$') THEN l[1:2] || '-' || l[3:] ELSE phone END AS display FROM loc""")
def q_phone_normalize(spark, sf):
    p = t(spark, sf, "documents").select("doc_id", F.explode(tx.phones(F.col("text"))).alias("phone"))
    return p.select("doc_id", "phone", tx.phone_display(F.col("phone")).alias("display"))


@query(r"""SELECT page_id, CAST(len(u) AS INTEGER) AS n, coalesce(u[1], '') AS first_url
FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?i)https?://[^\s)\]]+') u FROM pages)""")
def q_url_extract(spark, sf):
    u = t(spark, sf, "pages").select("page_id", tx.urls(F.coalesce("html", F.lit(""))).alias("u"))
    return u.select("page_id", F.size("u").alias("n"), F.coalesce(F.get("u", F.lit(0)), F.lit("")).alias("first_url"))


def _contacts(spark, sf):
    e = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(tx.emails(F.col("text"))).alias("value"))
    return e.select("id", F.lit("email").alias("kind"), F.lower("value").alias("value")).distinct()


@query(r"""WITH c AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}'))) v FROM documents),
m AS (SELECT v, min(doc_id) b FROM c GROUP BY v HAVING count(*) > 1) SELECT DISTINCT doc_id AS a, b FROM c JOIN m USING (v) WHERE doc_id <> b""")
def q_contact_duplicates(spark, sf):
    return dedup.contact_links(_contacts(spark, sf))


@query(r"""WITH RECURSIVE c AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}'))) v FROM documents),
m AS (SELECT v, min(doc_id) b FROM c GROUP BY v HAVING count(*) > 1), l AS (SELECT DISTINCT doc_id a, b FROM c JOIN m USING (v) WHERE doc_id <> b),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
SELECT node, min(reached) AS master FROM r GROUP BY node""")
def q_contact_masters(spark, sf):
    return dedup.components(dedup.contact_links(_contacts(spark, sf)), shared_table)


@query(r"""WITH every AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations),
c AS (SELECT kind, id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) s FROM every),
l AS (SELECT kind, id, list_filter(list_transform(string_split(regexp_replace(s, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') s FROM c), k AS (SELECT *, list_transform(s, lambda x: lower(x)) AS w FROM l)
SELECT kind, id, md5(array_to_string(list_filter(s, lambda x, i: list_position(w, w[i]) = i), ' ')) AS normalized, CAST(len(s) AS INTEGER) AS n_sentences FROM k""")
def q_text_normalize(spark, sf):
    every = t(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    every = every.unionByName(t(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text")))
    every = every.unionByName(t(spark, sf, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))
    return every.select("kind", "id", F.md5(tx.normalize_text(F.col("text"))).alias("normalized"), F.size(tx.sentences(tx.strip_tags(F.coalesce("text", F.lit(""))))).alias("n_sentences"))


@query(r"""SELECT kind, id, CAST(len(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\s+'), lambda w: w <> '')) AS BIGINT) AS tokens FROM (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages)""")
def q_token_count(spark, sf):
    every = t(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(t(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text")))
    return every.select("kind", "id", tx.approx_token_count(F.col("text")).alias("tokens"))


@query(r"""SELECT CASE WHEN regexp_matches(text, '[\x{0590}-\x{05FF}]') THEN 'he' WHEN regexp_matches(text, '[\x{0600}-\x{06FF}]') THEN 'ar'
WHEN regexp_matches(text, '[\x{0400}-\x{04FF}]') THEN 'ru' ELSE 'en' END AS detected, count(*) AS n FROM documents GROUP BY 1""")
def q_lang_detect(spark, sf):
    return t(spark, sf, "documents").groupBy(tx.detect_language(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) l FROM documents)
SELECT doc_id, trim(text) = '' OR (len(l) > 10 AND len(list_filter(l, lambda x: length(trim(x)) <= 2)) > 0.4 * len(l)) AS broken FROM l""")
def q_broken_text(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.is_broken(F.col("text")).alias("broken"))


@query(rf"""WITH d AS (SELECT doc_id, 'Jane' || chr(10) || 'Work  Experience:' || chr(10) || source || chr(10) || CASE WHEN doc_id % 2 = 0 THEN ' SKILLS - ' ELSE 'skills a' END || chr(10) || text AS x FROM documents),
l AS (SELECT doc_id, x, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS pos FROM d),
e AS (SELECT doc_id, pos, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS spot FROM l), h AS (SELECT doc_id, spot, lower(regexp_extract(trim(line), '{dims.HEADING}', 1)) AS title FROM e WHERE regexp_matches(trim(line), '{dims.HEADING}')),
m AS (SELECT doc_id, 'general' AS title, 0 AS spot FROM d UNION ALL SELECT doc_id, title, spot FROM h), n AS (SELECT doc_id, title, spot, lead(spot) OVER (PARTITION BY doc_id ORDER BY spot) AS nxt FROM m)
SELECT doc_id, title, CAST(spot AS INTEGER) AS start, CAST(coalesce(nxt, length(x)) AS INTEGER) AS "end" FROM n JOIN d USING (doc_id)""")
def q_sections(spark, sf):
    """Whole texts under headings of their own."""
    head = F.concat(F.lit("Jane\nWork  Experience:\n"), "source", F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, " SKILLS - ").otherwise("skills a"), F.lit("\n"), "text")
    return extraction.sections(t(spark, sf, "documents").select("doc_id", head.alias("x")), "doc_id", "x")


@query(r"""WITH p AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Summary ' || p_name || chr(10) || p_type WHEN 2 THEN '12 x' || chr(10) || chr(10) || replace(p_name, ' ', ' - ') ELSE p_brand || chr(10) || 'a' || chr(10) || 'b' || chr(10) || p_name END AS x FROM part),
l AS (SELECT p_partkey, list_filter(list_transform(string_split(x, chr(10)), lambda w: trim(w)), lambda w: w <> '')[1:3] AS l FROM p),
g AS (SELECT p_partkey, list_filter(list_transform(l, lambda w: trim(regexp_replace(w, '[-|•]', ' ', 'g'))), lambda w: regexp_matches(w, '^\pL+(\s+\pL+){1,3}$') AND NOT regexp_matches(lower(w), '(^|\s)(resume|cv|curriculum|vitae|profile|summary|contact|phone|email|address)(\s|$)')) AS g FROM l)
SELECT p_partkey, g[1] AS name FROM g WHERE g[1] IS NOT NULL""")
def q_name_heuristic(spark, sf):
    n = F.col("p_size") % 4
    x = F.when(n == 0, F.col("p_name")).when(n == 1, F.concat(F.lit("Summary "), "p_name", F.lit("\n"), "p_type")).when(n == 2, F.concat(F.lit("12 x\n\n"), F.replace("p_name", F.lit(" "), F.lit(" - ")))).otherwise(F.concat("p_brand", F.lit("\na\nb\n"), "p_name"))
    return t(spark, sf, "part").select("p_partkey", tx.name_heuristic(x).alias("name")).where("name is not null")


def _found_sql(text: str, terms, edge: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '(?i)(^|[^{edge}])(?:{tx.quoted(w)})([^{edge}]|$)') THEN '{w}' END" for w in terms) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({_found_sql('text', dims.SCAN_TERMS, 'A-Za-z0-9+')}, ',') AS found FROM documents")
def q_skill_scan(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_join(tx.scan_skills(F.col("text")), ",").alias("found"))


@query(r"""WITH p AS (SELECT DISTINCT p_name || ' ' || (p_size % 9) AS raw FROM part), b AS (SELECT raw, regexp_replace(trim(raw), '\s+v?\d+(\.\d+)*\s*$', '') n FROM p)
SELECT raw, array_to_string(list_transform(regexp_extract_all(n, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1:1]) || lower(w[2:])), '') AS canonical FROM b
UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"('{x}', '{c}')" for v, c in dims.skill_variants().items() for x in (v, f"{v.upper()} 14")) + """) v(raw, canonical)""")
def q_skill_normalize(spark, sf):
    """Unknown names, and every variant of the dictionary as it is and in capitals with a version."""
    raw = t(spark, sf, "part").select(F.concat_ws(" ", "p_name", (F.col("p_size") % 9).cast("string")).alias("raw")).distinct()
    known = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([x for v in dims.skill_variants() for x in (v, f"{v.upper()} 14")])), "array<string>")).alias("raw"))
    every = raw.unionByName(known)
    return every.select("raw", tx.normalize_skill(F.col("raw")).alias("canonical"))


@query("""WITH r AS (SELECT DISTINCT p_name || CASE p_size % 3 WHEN 0 THEN ' development' WHEN 1 THEN ' analysis' ELSE '' END AS raw FROM part)
SELECT raw, CASE WHEN raw LIKE '% analysis' THEN '' ELSE replace(raw, ' development', '') END AS hard FROM r""")
def q_hard_skills(spark, sf):
    suffix = F.when(F.col("p_size") % 3 == 0, " development").when(F.col("p_size") % 3 == 1, " analysis").otherwise("")
    raw = t(spark, sf, "part").select(F.concat("p_name", suffix).alias("raw")).distinct()
    return raw.select("raw", F.array_join(tx.hard_skills(F.array("raw")), "").alias("hard"))


@query(r"""SELECT conv_id, turn, coalesce(try_cast(nullif(regexp_extract(x, '(?i)(\d+)\s*[-–]\s*(\d+)\s+years?', 1), '') AS INTEGER), try_cast(nullif(regexp_extract(x, '(?i)(\d+)\s*\+?\s+years?', 1), '') AS INTEGER)) AS years_min,
try_cast(nullif(regexp_extract(x, '(?i)(\d+)\s*[-–]\s*(\d+)\s+years?', 2), '') AS INTEGER) AS years_max
FROM (SELECT conv_id, turn, coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' ' || (conv_id % 9) || '-' || (conv_id % 9 + 3) || ' years of work' WHEN 1 THEN ' ' || (conv_id % 12) || '+ years' ELSE '' END AS x FROM conversations)""")
def q_required_years(spark, sf):
    """Whole texts, two thirds of them with a requirement at the end."""
    c = F.col("conv_id")
    more = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" "), (c % 9).cast("string"), F.lit("-"), (c % 9 + 3).cast("string"), F.lit(" years of work"))).when(F.col("turn") % 3 == 1, F.concat(F.lit(" "), (c % 12).cast("string"), F.lit("+ years"))).otherwise("")
    x = F.concat(F.coalesce("text", F.lit("")), more)
    return t(spark, sf, "conversations").select("conv_id", "turn", tx.required_years(x).alias("y")).select("conv_id", "turn", "y.years_min", "y.years_max")


def _present_sql(text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '(^|[^a-z0-9])(?:{'|'.join(tx.quoted(f) for f in jobs_ops._forms(w))})([^a-z0-9]|$)') THEN '{w}' END" for w in jobs_ops.terms_of()) + "], lambda x: x IS NOT NULL)"


_CODE = "|".join(dims.PROGRAMMING_CONTEXT)
_JOBS = "SELECT doc_id, lower(text || CASE doc_id % 4 WHEN 0 THEN ' We use Node.js, PostgreSQL and CI/CD. ' WHEN 1 THEN ' go developer; embedded C or C# and .net ' WHEN 2 THEN ' react native apps, k8s on aws ' ELSE '' END) AS x FROM documents"


def _job_texts(spark, sf) -> DataFrame:
    k = F.col("doc_id") % 4
    more = F.when(k == 0, " We use Node.js, PostgreSQL and CI/CD. ").when(k == 1, " go developer; embedded C or C# and .net ").when(k == 2, " react native apps, k8s on aws ").otherwise("")
    return t(spark, sf, "documents").select("doc_id", F.concat("text", more).alias("x"))


@query(rf"""WITH j AS ({_JOBS}), f AS (SELECT doc_id, x, {_present_sql("x")} AS present FROM j)
SELECT doc_id, array_to_string(present, ',') AS present, array_to_string(list_filter(present, lambda w: length(w) > 1 AND (w <> 'go' OR regexp_matches(x, '(?s)(?:{_CODE}).{{0,50}}\bgo\b|\bgo\b.{{0,50}}(?:{_CODE})'))), ',') AS valid FROM f""")
def q_vocabulary_terms(spark, sf):
    f = _job_texts(spark, sf).withColumn("present", jobs_ops.present_terms(F.col("x")))
    return f.select("doc_id", F.array_join("present", ",").alias("present"), F.array_join(jobs_ops.valid_terms(F.col("present"), F.col("x")), ",").alias("valid"))


CLAIMED = {"Node": "node.js", "Postgres": "postgresql", "C#": "c#", "React Native": "react native", "Stakeholder poetry": None, "K8s": "kubernetes", "Fortran": None, "Scala": "scala"}


@query(rf"""WITH j AS ({_JOBS}), f AS (SELECT doc_id, {_present_sql("x")} AS present FROM j)
SELECT doc_id, skill FROM f, (VALUES {", ".join(f"('{k}', {'NULL' if v is None else repr(v)})" for k, v in CLAIMED.items())}) v(skill, term) WHERE term IS NULL OR list_contains(present, term)""")
def q_hallucination_filter(spark, sf):
    """Skills that a job claims, without those of the vocabulary that its text does not have."""
    f = _job_texts(spark, sf).select("doc_id", jobs_ops.present_terms(F.col("x")).alias("present"))
    return f.select("doc_id", F.explode(jobs_ops.drop_hallucinated(lit_array(CLAIMED), F.col("present"))).alias("skill"))


@query()
def q_job_analysis(spark, sf):
    b = t(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.lit("Python developer").alias("title"), F.col("text").alias("job_description"), F.lit("Docker, Kubernetes and PostgreSQL, 3-5 years").alias("free_text"), F.lit(None).cast(_analysis()).alias("analysis"))
    x = jobs_ops.normalize_jobs(b)
    return x.select("id", "lang", "tokens", F.array_join("analysis.skills.must_have", ",").alias("must_have"), F.array_join("analysis.keywords", ",").alias("keywords"), F.col("analysis.experience.years_min").alias("years_min"))


def _analysis():
    from .schema import ANALYSIS

    return ANALYSIS


# --- candidates --------------------------------------------------------------------------------------------


TITLES = {"1-URGENT": "Backend Engineer", "2-HIGH": "Data Analyst", "3-MEDIUM": "Team Lead", "4-NOT SPECIFIED": "Recruiter", "5-LOW": "Full Stack Developer"}
TODAY = "2002-01-01"


def today() -> Column:
    return F.lit(TODAY).cast("date")


def typed(kind: T.StructType, **parts: Column) -> Column:
    """A struct of a given type from some of its fields; the others are null."""
    return F.struct(*[parts[f.name].cast(f.dataType).alias(f.name) if f.name in parts else F.lit(None).cast(f.dataType).alias(f.name) for f in kind])


def records(spark, sf) -> DataFrame:
    """Customers as extracted records: orders are roles (the latest first), brands the technologies, brands of finished lines stand in the bullets.

    Lines, parts and orders are read and joined once; per order and per customer one aggregation.
    """
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus", F.col("l_shipdate").cast("date").alias("d"))
    lines = lines.join(t(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    last = lines.groupBy("l_orderkey").agg(F.max("d").alias("e"), F.array_sort(F.collect_set("p_brand")).alias("brands"), F.array_sort(F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("p_brand")))).alias("used"))
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("s")).join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    k, status, kinds = F.col("o_orderkey"), F.col("o_orderstatus"), schema.EXTRACTION
    name = F.coalesce(*[F.when(F.col("o_orderpriority") == p, x) for p, x in TITLES.items()])
    role = typed(
        kinds["experience"].dataType.elementType, title=F.when(k % 17 != 0, F.concat(name, F.lit(" "), (k % 8).cast("string"))),
        company=F.when(status == "F", "Acme Software").when(status == "O", "Army Unit 324"), start_date=F.col("s").cast("string"),
        end_date=F.when((status == "O") & (k % 10 == 0), "present").otherwise(F.col("e").cast("string")), bullets=F.transform("used", lambda b: F.concat(F.lit("used "), b)),
        tech=F.when(k % 5 != 0, F.col("brands")).otherwise(F.array().cast("array<string>")),
    )
    careers = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct((-F.unix_date("e")).alias("a"), k.alias("k"), role.alias("r")))).alias("roles"))
    c = t(spark, sf, "customer").select("c_custkey", "c_name").join(careers, F.col("c_custkey") == F.col("o_custkey"), "left")
    i, text = F.col("c_custkey"), F.lit
    school = lambda **p: F.array(typed(kinds["education"].dataType.elementType, **p))
    education = (
        F.when(i % 4 == 0, school(degree=text("BSc"), field=text("B.Sc Computer Science"), institution=text("Technion"), end_date=text("2001-11-01"), tech=lit_array(["Brand#25", "brand#24"])))
        .when(i % 4 == 1, school(degree=text("MBA"), end_date=text("1990"))).when(i % 4 == 2, school(field=text("Data Science"), institution=text("Open University"))).otherwise(F.array().cast(kinds["education"].dataType))
    )
    skill = lambda **p: typed(kinds["skills"].dataType.elementType, **p)
    skills = F.when(i % 3 == 0, F.array(skill(name=text("Brand#1"), source=text("experience")), skill(name=text("cobol")))).when(i % 3 == 1, F.array().cast(kinds["skills"].dataType))
    contact = lambda v: F.array(typed(schema.CONTACT.elementType, value=v))
    none = F.array().cast(schema.CONTACT)
    person = typed(
        kinds["person"].dataType, name=F.when(i % 11 == 0, text(None)).when(i % 13 == 0, "unknown").otherwise(F.col("c_name")), self_declared_title=F.when(i % 29 == 0, " Cook "),
        emails=F.when(i % 7 == 0, none).when(i % 7 == 1, contact(text("bad mail"))).otherwise(contact(F.concat(text("c"), (i % 40).cast("string"), text("@x.io")))), phones=F.when(i % 5 == 0, contact(F.concat(text("052-12345"), (i % 30).cast("string")))).otherwise(none),
    )
    years = lambda **m: F.create_map(*[x for key, v in m.items() for x in (text(key), text(v))])
    meta = typed(kinds["experience_meta"].dataType, totals_by_category=F.when(i % 6 == 0, years(tech=0.0, other=4.0)).when(i % 6 == 1, years(tech=2.5)), recommended_primary_years=F.when(i % 12 == 1, years(tech=2.0)))
    roles = F.coalesce(F.transform("roles", lambda r: r["r"]), F.array().cast(kinds["experience"].dataType))
    x = typed(kinds, person=person, education=education, experience=roles, skills=skills, experience_meta=meta, summary=F.concat(text("Customer "), i.cast("string")))
    added = F.timestamp_seconds(F.lit(1_000_000_000) + (i * 7919 % 1000) * 86400)
    return c.select(i.alias("id"), F.concat(text("/cv/"), F.lower("c_name"), text(".pdf")).alias("file_path"), x.alias("extraction"), text("ready").alias("status"), added.alias("created_at"))


_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
_has = lambda text, words: f"(len(list_filter([{_quoted(words)}], lambda w: contains({text}, w))) > 0)"
REC_SQL = f"""line AS (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) e, list_sort(list_distinct(list(p_brand))) brands, coalesce(list_sort(list_distinct(list(p_brand) FILTER (l_linestatus = 'F'))), []) used
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
role AS (SELECT o_custkey AS id, o_orderkey AS k, CASE WHEN o_orderkey % 17 <> 0 THEN CASE o_orderpriority {" ".join(f"WHEN '{p}' THEN '{x}'" for p, x in TITLES.items())} END || ' ' || (o_orderkey % 8) END AS title,
 CASE o_orderstatus WHEN 'F' THEN 'Acme Software' WHEN 'O' THEN 'Army Unit 324' END AS company, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 10 = 0 THEN DATE '{TODAY}' ELSE e END AS fin,
 CASE WHEN o_orderkey % 5 <> 0 THEN brands ELSE [] END AS tech, used, row_number() OVER (PARTITION BY o_custkey ORDER BY e DESC, o_orderkey) AS pos FROM orders JOIN line ON l_orderkey = o_orderkey),
corpus AS (SELECT id, ' ' || string_agg(lower('used ' || u), ' ') AS bullets FROM (SELECT id, unnest(used) AS u FROM role) GROUP BY 1),
person AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'unknown' ELSE c_name END AS name, coalesce(bullets, ' ') AS bullets FROM customer LEFT JOIN corpus ON corpus.id = c_custkey)"""
#: Technologies (first place), education's where no technology has the name, listed skills where neither has.
CAND_SQL = f"""{REC_SQL}, named AS (SELECT id, t AS name, 1 AS kind, min(pos) AS at FROM (SELECT id, pos, unnest(tech) AS t FROM role) GROUP BY 1, 2
 UNION ALL SELECT c_custkey, x, 2, 1 FROM customer, (VALUES ('Brand#25'), ('Brand#24')) v(x) WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, x, 3, 1 FROM customer, (VALUES ('Brand#1'), ('Cobol')) v(x) WHERE c_custkey % 3 = 0),
cand AS (SELECT id AS resume_id, n.name AS skill, CASE WHEN kind <> 2 AND contains(bullets, lower(n.name)) THEN 'work_experience' WHEN kind = 2 THEN 'education' WHEN kind = 3 AND n.name = 'Brand#1' THEN 'work_experience' ELSE 'skills_list' END AS source,
 CASE WHEN kind <> 2 AND contains(bullets, lower(n.name)) THEN 1.0::double ELSE 0.6::double END AS weight FROM named n JOIN person USING (id)
 QUALIFY row_number() OVER (PARTITION BY id, lower(n.name) ORDER BY CASE WHEN kind <> 2 AND contains(bullets, lower(n.name)) THEN 1.0 ELSE 0.6 END DESC, kind) = 1)"""


def _skills_of(rows: DataFrame) -> DataFrame:
    x = F.col("extraction")
    return rows.withColumn("skills", extraction.candidate_skills(x["experience"], x["education"], x["skills"]))


def candidate_skills(spark, sf) -> DataFrame:
    return _skills_of(records(spark, sf)).select(F.col("id").alias("resume_id"), F.explode("skills").alias("s")).select("resume_id", F.col("s.name").alias("skill"), "s.source", "s.weight")


@query(f"WITH {CAND_SQL} SELECT * FROM cand")
def q_candidate_skills(spark, sf):
    return candidate_skills(spark, sf)


_weight = lambda x: f"coalesce(max(weight) FILTER (lower(skill) = '{x.lower()}'), 0)"
SKILL_SQL = f"""skill AS (SELECT c_custkey AS resume_id, least(100.0::double * ({" + ".join(map(_weight, REQUIRED))}) / {len(REQUIRED)} + least(10.0::double * ({" + ".join(f"0.5::double * {_weight(x)}" for x in BONUS)}), 15), 100) AS score,
 CAST(count(*) FILTER (skill IN ({_quoted(REQUIRED)})) AS INTEGER) AS matched FROM customer LEFT JOIN cand ON resume_id = c_custkey GROUP BY 1)"""
SPAN_SQL = """span AS (SELECT id AS resume_id, k, s, fin AS e FROM role WHERE fin >= s),
mark AS (SELECT *, max(e) OVER (PARTITION BY resume_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM span),
isl AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY resume_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) g FROM mark),
years AS (SELECT resume_id, round(sum(d) / 365.0::double, 1) AS years FROM (SELECT resume_id, g, date_diff('day', min(s), max(e)) d FROM isl GROUP BY 1, 2) GROUP BY 1 HAVING round(sum(d) / 365.0::double, 1) > 0)"""


def skill_rows(spark, sf) -> DataFrame:
    rows = _skills_of(records(spark, sf))
    return rows.select(F.col("id").alias("resume_id"), scoring.skills_score(lit_array(REQUIRED), lit_array(BONUS), scoring.skill_weights(F.col("skills"), True)).alias("s"))


@query(f"WITH {CAND_SQL}, {SKILL_SQL} SELECT resume_id, round(score, 4) AS skills_score, matched FROM skill")
def q_skills_score(spark, sf):
    return skill_rows(spark, sf).select("resume_id", F.round("s.score", 4).alias("skills_score"), F.size("s.matched").alias("matched"))


MISSING_SQL = f"""{CAND_SQL}, missing AS (SELECT c_custkey AS resume_id, r.skill FROM customer CROSS JOIN (VALUES {", ".join(f"('{x}')" for x in REQUIRED)}) r(skill)
WHERE NOT EXISTS (SELECT 1 FROM cand WHERE cand.resume_id = c_custkey AND cand.skill = r.skill))"""


@query(f"WITH {MISSING_SQL} SELECT * FROM missing")
def q_missing_skills(spark, sf):
    return skill_rows(spark, sf).select("resume_id", F.explode("s.missing").alias("skill"))


def years_rows(spark, sf) -> DataFrame:
    return records(spark, sf).select(F.col("id").alias("resume_id"), extraction.merged_years(F.col("extraction.experience"), today()).alias("years")).where("years > 0")


@query(f"WITH {REC_SQL}, {SPAN_SQL} SELECT * FROM years")
def q_years_merged(spark, sf):
    return years_rows(spark, sf)


YEARS_SQL = f"""plain AS (SELECT *, coalesce(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '') AS tn, coalesce(trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')), '') AS cn, date_diff('month', s, fin) AS mo,
 extract('day' FROM fin) - extract('day' FROM s) AS dd FROM role),
military AS (SELECT *, {_has("cn", dims.MILITARY_WORDS)} OR (contains(cn, 'unit') AND regexp_matches(cn, '\\b\\d{{2,4}}\\b')) AS army FROM plain),
kind AS (SELECT id, pos, CASE WHEN fin >= s THEN CAST(printf('%.1f', greatest(((extract('year' FROM fin) - extract('year' FROM s)) * 12 + extract('month' FROM fin) - extract('month' FROM s) + CASE WHEN dd > 0 THEN dd / 30.0::double ELSE 0 END) / 12.0::double, 0)) AS DOUBLE) ELSE 0.0::double END AS y,
 CASE WHEN (army OR {_has("cn", dims.ACADEMIC_WORDS)}) AND ({_has("tn", dims.WEAK_TECH_TITLES)} OR contains(tn, 'project')) AND NOT {_has("tn", dims.STRONG_TECH_TITLES)} THEN CASE WHEN army THEN 'military' ELSE 'other' END
  WHEN len(tech) > 0 OR {_has("tn", dims.TECH_TITLE_WORDS)} OR {_has("cn", dims.TECH_COMPANY_WORDS)} OR {_has("lower(array_to_string(used, ' '))", dims.TECH_WORK_WORDS)} THEN 'tech' WHEN army THEN 'military' ELSE 'other' END AS category FROM military)"""


@query(f"""WITH {REC_SQL}, {YEARS_SQL}, c AS (SELECT c_custkey AS resume_id, x AS category FROM customer, (VALUES ('tech'), ('military'), ('hospitality'), ('other')) v(x))
SELECT resume_id, c.category, coalesce(max(y), 0.0::double) AS years FROM c LEFT JOIN (SELECT id, category, list_reduce(list_prepend(0.0::double, list(y ORDER BY pos)), lambda a, b: round(a + b, 1)) AS y FROM kind WHERE y > 0 GROUP BY 1, 2) k ON k.id = resume_id AND k.category = c.category GROUP BY 1, 2""")
def q_years_by_category(spark, sf):
    """Totals without clusters: roles by their own words, rounded at every addition."""
    totals = records(spark, sf).select(F.col("id").alias("resume_id"), F.explode(clusters.fallback_totals(F.col("extraction.experience"), today())).alias("category", "years"))
    return totals


@query(f"""WITH {REC_SQL}, {YEARS_SQL}, y AS (SELECT r.id, r.k, r.pos, r.title, r.company, k.y FROM role r JOIN kind k ON k.id = r.id AND k.pos = r.pos),
same AS (SELECT id, lower(coalesce(title, '')) t, lower(coalesce(company, '')) c, arg_max(y, pos) AS y FROM y GROUP BY 1, 2, 3),
m AS (SELECT y.id, y.pos, CASE WHEN y.pos % 2 = 0 THEN 'tech' ELSE 'hospitality' END AS category, s.y FROM y JOIN same s ON s.id = y.id AND s.t = lower(coalesce(y.title, '')) AND s.c = lower(coalesce(y.company, '')) WHERE s.y > 0)
SELECT id AS resume_id, category, CAST(count(*) AS INTEGER) AS members, round(list_reduce(list_prepend(0.0::double, list(y ORDER BY pos)), lambda a, b: a + b), 1) AS total_years FROM m GROUP BY 1, 2""")
def q_cluster_years(spark, sf):
    """Clusters whose members are the record's roles in other letters: rebuilt from the roles, the last of equal ones."""
    x = F.col("extraction")
    member = lambda e: F.struct(F.upper(e["title"]).alias("title"), F.upper(e["company"]).alias("company"), e["start_date"].alias("start_date"), e["end_date"].alias("end_date"))
    pick = lambda odd: F.transform(F.filter(x["experience"], lambda e, i: i % 2 == odd), member)
    kind = schema.EXTRACTION["experience_meta"].dataType["experience_clusters"].dataType
    given = F.array(*[typed(kind.elementType, category=F.lit(c), members=pick(odd)) for c, odd in (("hospitality", 0), ("space", 0), ("tech", 1))])
    found = records(spark, sf).select("id", F.explode(clusters.rebuild(x["experience"], x["education"], given, today())["experience_clusters"]).alias("c"))
    return found.select(F.col("id").alias("resume_id"), "c.category", F.size("c.members").alias("members"), "c.total_years")


EXP_SQL = f"""CASE WHEN coalesce(years, 0) = 0 AND has THEN 0.5::double WHEN coalesce(years, 0) <= 0 THEN 0.0::double WHEN years / {YEARS_MIN} < 0.5 THEN 0.05::double
WHEN years / {YEARS_MIN} < 1 THEN 0.2::double + 1.6::double * (years / {YEARS_MIN} - 0.5::double) ELSE 1.0::double END"""
HAS_SQL = "held AS (SELECT c_custkey AS resume_id, c_custkey IN (SELECT id FROM role) AS has, years FROM customer LEFT JOIN years ON years.resume_id = c_custkey)"


@query(f"""WITH {REC_SQL}, {SPAN_SQL}, {HAS_SQL} SELECT resume_id, coalesce(years, 0) AS years, round({EXP_SQL}, 3) AS score, CASE WHEN coalesce(years, 0) = 0 AND has THEN 'years_unknown' WHEN coalesce(years, 0) < 0.5 * {YEARS_MIN} THEN 'significantly_under_qualified'
WHEN years < {YEARS_MIN} THEN 'slightly_under_qualified' WHEN years <= 1.5 * {YEARS_MIN} THEN 'perfect_match' WHEN years <= 1.5 * {YEARS_MIN} + 2 THEN 'moderately_over_qualified' ELSE 'significantly_over_qualified' END AS verdict FROM held""")
def q_experience_score(spark, sf):
    x = F.col("extraction.experience")
    d = records(spark, sf).select(F.col("id").alias("resume_id"), scoring.experience_detail(extraction.merged_years(x, today()), F.lit(YEARS_MIN), F.size(x) > 0).alias("d"))
    return d.select("resume_id", "d.years", "d.score", "d.verdict")


@query(f"""WITH {REC_SQL}, y AS (SELECT id, pos, len(tech) > 0 AS tech, greatest(date_diff('day', s, fin), 0) / 365.25::double AS y FROM role), f AS (SELECT *, bool_or(tech) OVER (PARTITION BY id) AS any_tech FROM y),
d AS (SELECT id, list(y ORDER BY pos) AS d FROM f WHERE tech OR NOT any_tech GROUP BY 1),
a AS (SELECT c_custkey AS id, d, len(d) AS n, list_reduce(list_prepend(0.0::double, d), lambda p, q: p + q) / len(d) AS av, CASE WHEN c_custkey % 12 = 1 THEN 2.0::double WHEN c_custkey % 6 = 1 THEN 2.5::double ELSE 0.0::double END AS total FROM customer LEFT JOIN d ON d.id = c_custkey),
p AS (SELECT *, len(list_filter(d, lambda x: x < 1.5)) AS short, len(list_filter(d, lambda x: x >= 1.5 AND x < 2.5)) AS medium, len(list_filter(d, lambda x: x < 0.5)) AS tiny, len(list_filter(d, lambda x: x >= 4)) AS long4, len(list_filter(d, lambda x: x >= 2 AND x <= 4)) AS mid,
 len(list_filter(list_zip(d, d[2:]), lambda z: z[2] IS NOT NULL AND z[1] > z[2])) = 0 AS up, CASE WHEN total < 3 THEN 2.0::double WHEN total < 6 THEN 3.0::double ELSE 4.0::double END AS x FROM a),
q AS (SELECT id, n, av, long4, short, CASE WHEN n IS NULL THEN 0.5::double ELSE greatest(0, least(1, 1.0::double + CASE WHEN total <= 2 AND n >= 3 THEN -0.25::double WHEN total <= 2.5 AND n = 2 AND av < 1.3 THEN -0.2::double ELSE 0 END
 + CASE WHEN total >= 3 AND av < 1.8 THEN -0.15::double ELSE 0 END + CASE WHEN short >= 3 THEN -0.25::double WHEN short = 2 THEN -0.2::double WHEN short = 1 THEN -0.1::double ELSE 0 END + CASE WHEN medium >= 2 THEN -0.1::double ELSE 0 END - 0.1::double * tiny
 + CASE WHEN av >= x THEN 0 WHEN av / x <= 0.5 THEN -0.25::double WHEN av / x <= 0.7 THEN -0.15::double ELSE 0 END + CASE WHEN n >= 3 AND total > 0 AND total / n < 2 THEN -0.15::double ELSE 0 END + CASE WHEN long4 > 0 THEN 0.1::double ELSE 0 END
 + CASE WHEN n >= 2 AND up THEN 0.1::double ELSE 0 END + CASE WHEN mid >= 2 THEN 0.05::double ELSE 0 END + CASE WHEN av >= 1.2::double * x THEN 0.05::double ELSE 0 END)) END AS s FROM p)
SELECT id AS resume_id, round(s, 4) AS stability, CASE WHEN n IS NULL THEN 'no_experience_data' WHEN s >= 0.9 THEN 'excellent_stability' WHEN s >= 0.8 THEN 'good_stability' WHEN s >= 0.7 THEN 'acceptable_stability' WHEN s >= 0.6 THEN 'moderate_concerns' WHEN s >= 0.5 THEN 'significant_concerns' ELSE 'severe_stability_issues' END AS verdict,
 CAST(coalesce(n, 0) AS INTEGER) AS jobs, CAST(coalesce(short, 0) AS INTEGER) AS short_stints, CAST(coalesce(long4, 0) AS INTEGER) AS long_tenures FROM q""")
def q_stability(spark, sf):
    d = records(spark, sf).select(F.col("id").alias("resume_id"), scoring.stability(F.col("extraction"), today()).alias("d"))
    return d.select("resume_id", F.round("d.score", 4).alias("stability"), "d.verdict", F.col("d.total_jobs").alias("jobs"), "d.short_stints", "d.long_tenures")


@query(f"""WITH {REC_SQL}, best AS (SELECT id, arg_min(title, {{'f': -epoch(fin), 'p': pos}}) AS title, max(fin) AS fin FROM role WHERE title IS NOT NULL AND company IS NOT NULL GROUP BY 1), own AS (SELECT id, arg_min(title, {{'f': -epoch(fin), 'p': pos}}) AS title FROM role WHERE title IS NOT NULL GROUP BY 1),
p AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Computer Science Student' WHEN 2 THEN 'Data Science Student' END AS student FROM customer)
SELECT p.id AS resume_id, coalesce(CASE WHEN p.id % 29 = 0 THEN 'Cook' END, CASE WHEN student IS NOT NULL AND date_diff('day', best.fin, DATE '{TODAY}') > 365 THEN student ELSE best.title END, student, own.title) AS title FROM p LEFT JOIN best USING (id) LEFT JOIN own USING (id)""")
def q_latest_title(spark, sf):
    x = F.col("extraction")
    return records(spark, sf).select(F.col("id").alias("resume_id"), extraction.profession(x["person"], x["experience"], x["education"], today()).alias("title"))


REPORT_SQL = f"""{REC_SQL}, per AS (SELECT id, count(*) AS n, count_if(title IS NULL AND company IS NULL OR s > fin) AS bad, count_if(title IS NULL AND company IS NULL AND s > fin) AS twice, count_if((title IS NULL) <> (company IS NULL)) AS part FROM role GROUP BY 1),
f AS (SELECT p.id, name, coalesce(n, 0) AS n, coalesce(bad + twice, 0) AS bad, coalesce(part, 0) AS part, name IS NULL AND p.id % 7 = 0 AND p.id % 5 <> 0 AND p.id % 29 <> 0 AS nobody,
 (CAST(name IS NOT NULL AS INTEGER) + CAST(coalesce(n, 0) > 0 AS INTEGER) + CAST(p.id % 4 <> 3 AS INTEGER) + CAST(p.id % 3 = 0 AS INTEGER)) / 4.0::double AS complete FROM person p LEFT JOIN per USING (id)),
g AS (SELECT id, complete, bad + CAST(n = 0 AS INTEGER) + CAST(complete < 0.5 AS INTEGER) AS errors, CAST(nobody AS INTEGER) + CAST(NOT nobody AND name IS NULL AS INTEGER) + CAST(NOT nobody AND id % 7 = 0 AND id % 5 <> 0 AS INTEGER) + CAST(id % 7 = 1 AS INTEGER) + CAST(n = 1 AS INTEGER) + part + 1
 + CAST(complete >= 0.5 AND complete < 0.75 AS INTEGER) + CAST(id % 6 > 1 AS INTEGER) AS warnings FROM f), h AS (SELECT *, greatest(0.0::double, round(1.0::double - 0.2::double * errors - 0.1::double * warnings, 4)) AS score FROM g)"""


@query(f"""WITH {REPORT_SQL} SELECT id AS resume_id, CAST(errors AS INTEGER) AS errors, CAST(warnings AS INTEGER) AS warnings, score, complete AS completeness, errors = 0 AS valid,
CASE WHEN score >= 0.9 THEN 'excellent' WHEN score >= 0.75 THEN 'good' WHEN score >= 0.6 THEN 'fair' WHEN score >= 0.4 THEN 'poor' ELSE 'very_poor' END AS label FROM h""")
def q_quality_report(spark, sf):
    r = quality_report.report(records(spark, sf), today())
    count = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s))
    return r.select(F.col("id").alias("resume_id"), count("error").alias("errors"), count("warning").alias("warnings"), "score", "completeness", "valid", "label")


@query(f"""WITH {CAND_SQL}, {SPAN_SQL}, n AS (SELECT resume_id, count(*) AS skills FROM cand GROUP BY 1) SELECT c_custkey AS resume_id, coalesce(name, c_name) AS name, years, coalesce(skills, 0) AS skills FROM customer JOIN person ON person.id = c_custkey
LEFT JOIN years ON years.resume_id = c_custkey LEFT JOIN n ON n.resume_id = c_custkey WHERE c_custkey % 11 <> 0""")
def q_summaries(spark, sf):
    s = extraction.summaries(records(spark, sf).where("id % 11 <> 0"), today())
    return s.select(F.col("id").alias("resume_id"), "name", "years", F.size("skills").cast("long").alias("skills"))


MATE_SQL = """mate AS (SELECT id, added, CASE WHEN id % 7 = 0 THEN [] WHEN id % 7 = 1 THEN ['bad mail'] ELSE ['c' || (id % 40) || '@x.io'] END AS emails, CASE WHEN id % 5 = 0 THEN ['052-12345' || (id % 30)] ELSE [] END AS phones FROM (SELECT c_custkey AS id, c_custkey * 7919 % 1000 AS added FROM customer))"""


@query(f"""WITH {MATE_SQL}, e AS (SELECT emails[1] AS v, arg_min(id, {{'a': added, 'i': id}}) AS m FROM mate WHERE len(emails) > 0 GROUP BY 1), p AS (SELECT phones[1] AS v, arg_min(id, {{'a': added, 'i': id}}) AS m FROM mate WHERE len(phones) > 0 GROUP BY 1)
SELECT id, coalesce(CASE WHEN e.m <> id THEN e.m END, CASE WHEN p.m <> id THEN p.m END) AS master, CASE WHEN e.m <> id THEN 'email' ELSE 'phone' END AS matched_by FROM mate LEFT JOIN e ON e.v = emails[1] LEFT JOIN p ON p.v = phones[1]
WHERE coalesce(CASE WHEN e.m <> id THEN e.m END, CASE WHEN p.m <> id THEN p.m END) IS NOT NULL""")
def q_duplicate_masters(spark, sf):
    values = lambda k: F.transform(F.col(f"extraction.person.{k}"), lambda v: v["value"]).alias(k)
    return dedup.duplicate_masters(records(spark, sf).select("id", "created_at", values("emails"), values("phones")))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 7 NOT IN (0, 1) AND c_custkey % 40 = 5 OR c_custkey % 5 = 0 AND c_custkey % 30 = 10")
def q_json_containment(spark, sf):
    p = F.col("extraction.person")
    return records(spark, sf).where(search.contains_contact(p, "emails", F.lit("c5@x.io")) | search.contains_contact(p, "phones", F.lit("052-1234510"))).select("id")


# --- titles and vectors ------------------------------------------------------------------------------------


def _cosine_to_first(spark, sf) -> DataFrame:
    e = t(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    job = e.where("vec_id = 0").select(F.col("embedding").alias("job"))  # one row by key
    return e.join(F.broadcast(job)).select("vec_id", "label", F.round(vector.cosine100(F.col("embedding"), F.col("job")), 4).alias("cosine"))


COS_SQL = """cos AS (SELECT e.vec_id, e.label, round(greatest(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(j.embedding AS DOUBLE[])) * 100, 0), 4) AS cosine
FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) j)"""


@query(f"WITH {COS_SQL} SELECT vec_id, cosine FROM cos ORDER BY cosine DESC, vec_id LIMIT 20")
def q_title_cosine_topk(spark, sf):
    return _cosine_to_first(spark, sf).select("vec_id", "cosine").orderBy(F.desc("cosine"), "vec_id").limit(20)


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, len(embedding) NOT IN (768, 1536, 3072) AS odd_dimension, len(list_distinct(embedding[1:100])) < 5 AS low_variety FROM embeddings")
def q_embedding_quality(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("dims"), vector.embedding_problems(F.col("embedding")).alias("p"))
    return e.select("vec_id", "dims", F.array_contains("p", "odd_dimension").alias("odd_dimension"), F.array_contains("p", "low_variety").alias("low_variety"))


JOB_TITLE = "Senior Backend Developer"
#: Titles of roles and their vectors: title number n (of 40) has the embedding n.
TITLE_NUMBER = {f"{x} {k}": 8 * n + k for n, x in enumerate(TITLES.values()) for k in range(8)}


def _category_sql(title: str) -> str:
    return "CASE " + " ".join(f"WHEN {_has(f'lower({title})', words.split('|'))} THEN '{name}'" for name, words in dims.ROLE_SYNONYMS.items()) + " END"


def boost_sql(job: str, title: str, history: str) -> str:
    """The boost of a title against a job in SQL, from the rules and word lists."""
    terms = lambda x: f"list_filter([{_quoted(dims.TITLE_TERMS)}], lambda w: contains(lower({x}), w))"
    shared = f"len(list_intersect({terms(job)}, {terms(title)}))"
    strong = lambda x: _has(f"lower({x})", dims.STRONG_TITLE_TERMS)
    near = " ".join(f"WHEN '{k}' THEN {_category_sql(title)} IN ({_quoted(v.split('|'))})" for k, v in dims.ROLE_NEIGHBOURS.items())
    role = f"CASE WHEN {_category_sql(job)} = {_category_sql(title)} THEN 15 WHEN CASE {_category_sql(job)} {near} ELSE false END THEN 10 ELSE 0 END"
    keyword = f"CASE WHEN {strong(job)} AND {strong(title)} THEN least(30, 20 + 2 * {shared}) WHEN {shared} > 0 THEN least(20, 10 + 2 * {shared}) ELSE 0 END"
    lead = lambda x: _has(f"lower({x})", dims.LEADERSHIP_TERMS)
    past = f"len(list_filter({history}, lambda h: {_has('lower(h)', dims.LEADERSHIP_TERMS)})) > 0"
    return f"""CASE WHEN {_has(f"lower({job})", dims.TECH_JOB_TERMS)} AND {_has(f"lower({title})", dims.HR_TERMS)} THEN -100 WHEN {lead(job)} AND NOT {lead(title)} AND NOT ({past}) THEN -30 ELSE greatest({role}, {keyword}) END::double"""


TITLE_SQL = f"""firsts AS (SELECT id, title, pos FROM role WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, lower(title) ORDER BY pos) = 1),
asked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS nth FROM firsts QUALIFY nth <= 7),
weighed AS (SELECT id, title, nth, CASE WHEN nth = 1 THEN 1.0::double ELSE greatest(0.85::double, 1.0::double - 0.05::double * (nth - 2)) END AS weight, list(title) OVER (PARTITION BY id) AS history FROM asked),
tnum AS (SELECT * FROM (VALUES {", ".join(f"('{x}', {n})" for x, n in TITLE_NUMBER.items())}) v(title, vec)),
pairs AS (SELECT DISTINCT title, list_sort(history) AS h FROM weighed), boosts AS (SELECT title, h, {boost_sql(f"'{JOB_TITLE}'", "title", "h")} AS boost FROM pairs),
best AS (SELECT id AS resume_id, max(round(greatest(0, least(100, raw + boost)) * weight, 1)) AS title_score FROM weighed w JOIN tnum USING (title) JOIN (SELECT vec_id, greatest(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(j.embedding AS DOUBLE[])) * 100, 0) AS raw
 FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) j) c ON c.vec_id = tnum.vec JOIN boosts b ON b.title = w.title AND b.h = list_sort(w.history) GROUP BY 1)"""


def candidates(spark, sf) -> DataFrame:
    """Records as what the scorer reads: the latest title and up to six others with their vectors, skills, years, tenures."""
    x = F.col("extraction")
    title_list = F.filter(F.transform(x["experience"], lambda e: e["title"]), lambda c: c.isNotNull())
    vectors = t(spark, sf, "embeddings").where(F.col("vec_id") < len(TITLE_NUMBER)).agg(F.map_from_entries(F.collect_list(F.struct("vec_id", "embedding"))).alias("vectors"))  # 40 rows by key
    number = arrays.constant_map(TITLE_NUMBER, "bigint")
    rows = _skills_of(records(spark, sf)).join(F.broadcast(vectors)).withColumn("asked", scoring.title_candidates(F.get(title_list, F.lit(0)), F.slice(title_list, 2, 1_000_000)))
    titles = F.transform("asked", lambda a: F.struct(a["title"].alias("title"), F.try_element_at(F.col("vectors"), F.try_element_at(number, a["title"])).alias("vector"), a["weight"].alias("weight"), a["source"].alias("source")))
    return rows.select(
        F.col("id").alias("resume_id"), x["person"]["name"].alias("name"), "skills", F.lit(None).cast("string").alias("text"), extraction.merged_years(x["experience"], today()).alias("years"),
        (F.size(x["experience"]) > 0).alias("has_history"), scoring.tenures(x["experience"], x["experience_meta"]["experience_clusters"], today()).alias("durations"), titles.alias("titles"),
    )


def job_row(spark, sf) -> DataFrame:
    e = t(spark, sf, "embeddings").where("vec_id = 0")
    return e.select(F.lit(1).alias("job_id"), F.lit(JOB_TITLE).alias("title"), F.col("embedding").alias("vector"), lit_array(REQUIRED).alias("required"), lit_array(BONUS).alias("bonus"), F.lit(YEARS_MIN).alias("years_min"))


def scored(spark, sf) -> DataFrame:
    rows = scoring.score_candidates(candidates(spark, sf), job_row(spark, sf))
    return rows.select("resume_id", "job_id", F.col("skills.score").alias("skills_score"), F.coalesce("best_title.score", F.lit(0.0)).alias("title_score"), F.col("experience.score").alias("experience_score"), F.col("experience.years").alias("years"), F.col("skills.missing").alias("missing"), (F.col("skills.simple") / 100).alias("content_overlap"), "rag_score")


@query(f"WITH {REC_SQL}, {TITLE_SQL} SELECT * FROM best")
def q_title_history_best(spark, sf):
    rows = candidates(spark, sf).where(F.size("titles") > 0).join(F.broadcast(job_row(spark, sf).select("title", "vector")))
    return rows.select("resume_id", scoring.title_scores(F.col("title"), F.col("vector"), F.col("titles"))["score"].alias("title_score"))


@query(f"""WITH {REC_SQL}, p AS (SELECT DISTINCT p_name, p_type FROM part), x AS (SELECT p_name, p_type, CASE WHEN length(p_name) % 2 = 0 THEN ['Team Lead'] ELSE ['Cook'] END AS past,
 CASE length(p_type) % 4 WHEN 0 THEN 'Senior Backend Engineer ' WHEN 1 THEN 'Recruiter ' WHEN 2 THEN 'Data Scientist ' ELSE 'Product Manager ' END || p_name AS title FROM p)
SELECT DISTINCT title, past[1] AS past, {boost_sql(f"'{JOB_TITLE}'", "title", "past")} AS boost FROM x""")
def q_key_terms_boost(spark, sf):
    kind = F.length("p_type") % 4
    title = F.concat(F.when(kind == 0, "Senior Backend Engineer ").when(kind == 1, "Recruiter ").when(kind == 2, "Data Scientist ").otherwise("Product Manager "), F.col("p_name"))
    rows = t(spark, sf, "part").select(title.alias("title"), F.when(F.length("p_name") % 2 == 0, "Team Lead").otherwise("Cook").alias("past")).distinct()
    return rows.select("title", "past", rules.title_boost(F.lit(JOB_TITLE), F.col("title"), F.array("past")).cast("double").alias("boost"))


@query(f"SELECT p_name, {_category_sql('p_name')} AS category, {_category_sql('title')} AS titled FROM (SELECT DISTINCT p_name, p_type || ' engineer' AS title FROM part)")
def q_role_category(spark, sf):
    rows = t(spark, sf, "part").select("p_name", F.concat("p_type", F.lit(" engineer")).alias("title")).distinct()
    return rows.select("p_name", rules.role_category(F.col("p_name")).alias("category"), rules.role_category(F.col("title")).alias("titled"))


@query("""WITH p AS (SELECT DISTINCT p_name, p_brand FROM part), x AS (SELECT a.p_name AS a, b.p_name AS b, a.p_brand, list_distinct(string_split(a.p_name, ' ')) u, list_distinct(string_split(b.p_name, ' ')) v
FROM p a JOIN p b ON a.p_brand = b.p_brand AND split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1) AND a.p_name < b.p_name)
SELECT a, b, p_brand, round(0.6::double + 0.4::double * len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))), 4) AS score FROM x""")
def q_soft_match(spark, sf):
    p = t(spark, sf, "part").select("p_name", "p_brand").distinct().withColumn("block", F.substring_index("p_name", " ", 1))
    pairs = p.select(F.col("p_name").alias("a"), "p_brand", "block").join(p.select(F.col("p_name").alias("b"), "p_brand", "block"), ["p_brand", "block"]).where("a < b")
    return pairs.select("a", "b", "p_brand", F.round(jobs_ops.role_similarity(F.col("p_brand"), F.col("a"), F.col("p_brand"), F.col("b")), 4).alias("score"))


# --- ranking -----------------------------------------------------------------------------------------------

ENS_SQL = f"""{CAND_SQL}, {SKILL_SQL}, {SPAN_SQL}, {HAS_SQL}, {TITLE_SQL}, ens AS (SELECT skill.resume_id, name, score AS skills_score, coalesce(title_score, 0.0::double) AS title_score, coalesce(years, 0) AS years, round({EXP_SQL}, 3) AS e
FROM skill JOIN held USING (resume_id) JOIN person ON person.id = skill.resume_id LEFT JOIN best ON best.resume_id = skill.resume_id),
f AS (SELECT *, 0.55::double * (title_score / 100.0::double) + 0.25::double * e + 0.2::double * skills_score / 100.0::double AS f0 FROM ens),
ranked AS (SELECT resume_id, name, skills_score, title_score, years, CAST(trunc(100.0::double * CASE WHEN title_score / 100.0::double < 0.75 THEN f0 * (0.6::double + 0.4::double * (title_score / 100.0::double) / 0.75::double) ELSE f0 END) AS INTEGER) AS rag_score FROM f)"""
_RANKED = ("resume_id", "title_score", "years", "rag_score")


@query(f"WITH {ENS_SQL} SELECT resume_id, round(skills_score, 4) AS skills_score, title_score, years, rag_score FROM ranked ORDER BY rag_score DESC, resume_id LIMIT 100")
def q_ensemble_rank(spark, sf):
    return ranking.top_k(scored(spark, sf).select(*_RANKED, F.round("skills_score", 4).alias("skills_score")), 100)


@query(f"WITH {ENS_SQL} SELECT resume_id, round(skills_score, 4) AS skills_score, title_score, years, rag_score FROM ranked")
def q_ensemble_all(spark, sf):
    return scored(spark, sf).select(*_RANKED, F.round("skills_score", 4).alias("skills_score"))


FINAL_SQL = f"""WITH {ENS_SQL}, j AS (SELECT *, CASE WHEN resume_id % 3 = 0 THEN CAST(resume_id * 37 % 101 AS INTEGER) END AS llm_score, CASE WHEN resume_id % 19 = 0 THEN ' ' WHEN resume_id % 23 = 0 THEN 'Person  ' || (resume_id % 400) ELSE name END AS who FROM ranked),
b AS (SELECT *, CASE WHEN llm_score IS NULL THEN 2 WHEN llm_score >= 70 THEN 0 ELSE 1 END AS bucket, coalesce(llm_score, rag_score) AS s, CASE WHEN trim(who) = '' THEN '#' || resume_id ELSE lower(trim(regexp_replace(who, '\\s+', ' ', 'g'))) END AS whom FROM j WHERE who <> '' AND lower(trim(who)) <> 'unknown'),
o AS (SELECT *, row_number() OVER (PARTITION BY whom ORDER BY bucket, s DESC, resume_id) AS nth FROM b)"""


@query(f"{FINAL_SQL} SELECT resume_id, bucket, CAST(row_number() OVER (ORDER BY bucket, s DESC, resume_id) AS INTEGER) AS rank, count(*) OVER () AS total FROM o WHERE nth = 1 ORDER BY rank LIMIT 50")
def q_final_ranking(spark, sf):
    """Ranking of judged rows; some names are blank, shared or unknown, some missing."""
    names = t(spark, sf, "customer").select(F.col("c_custkey").alias("resume_id"), F.when(F.col("c_custkey") % 11 == 0, F.lit(None)).when(F.col("c_custkey") % 13 == 0, "unknown").otherwise(F.col("c_name")).alias("own"))
    k = F.col("resume_id")
    name = F.when(k % 19 == 0, " ").when(k % 23 == 0, F.concat(F.lit("Person  "), (k % 400).cast("string"))).otherwise(F.col("own"))
    rows = scored(spark, sf).join(names, "resume_id").withColumn("llm_score", F.when(k % 3 == 0, (k * 37 % 101).cast("int"))).withColumn("name", name)
    return ranking.final_ranking(rows, 50).select("resume_id", "bucket", "rank", "total")


@query()
def q_backfill_rounds(spark, sf):
    rows = scored(spark, sf).withColumns({"status": F.lit("new"), "llm_score": F.lit(None).cast("int")})

    def ask(part):
        b = ranking.judge_batches(part).select("resume_id", "batch", "skills_score", "title_score", "experience_score", "content_overlap")
        return part.drop("llm_score").join(providers.judge(b), "resume_id")

    return ranking.backfill(shared_table(rows), ask, 10, write=shared_table).where("llm_score is not null").select("resume_id", "rag_score", "llm_score")


@query(f"""WITH {MISSING_SQL}, {SPAN_SQL}, {TITLE_SQL}, rel AS (SELECT resume_id FROM best WHERE title_score >= 50), per AS (SELECT skill, count(*) AS n FROM missing JOIN rel USING (resume_id) GROUP BY 1), top AS (SELECT skill, n FROM per ORDER BY n DESC, skill LIMIT 1)
SELECT 'bottleneck' AS type, skill AS related_skill, n AS affected_count FROM top, (SELECT count(*) AS r FROM rel), (SELECT count(*) AS a FROM customer) WHERE a >= 5 AND r >= 3 AND n >= 3 AND n >= 0.5 * r""")
def q_bottleneck_skill(spark, sf):
    rows = scored(spark, sf).withColumn("llm_score", F.lit(None).cast("int"))
    return ranking.insights(rows).where("type = 'bottleneck'")


@query("SELECT c_custkey AS resume_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01')")
def q_delta_candidates(spark, sf):
    people = t(spark, sf, "customer").select(F.col("c_custkey").alias("resume_id"))
    edges = t(spark, sf, "orders").where(F.col("o_orderdate") >= "2001-01-01").select(F.lit(1).alias("job_id"), F.col("o_custkey").alias("resume_id"), F.lit(1).alias("rag_score"))
    return ranking.delta_candidates(people, edges, 1)


@query("""SELECT o_orderkey, c_name AS name, CASE WHEN y <= 0 THEN '0 yrs' WHEN y < 1 THEN '<1 yr' WHEN y = floor(y) THEN CAST(y AS BIGINT) || ' yrs' ELSE printf('%.1f', round_even(y, 1)) || ' yrs' END AS experience
FROM (SELECT o_orderkey, o_custkey, (o_orderkey % 80) / 8.0::double AS y FROM orders WHERE o_orderpriority = '1-URGENT') JOIN customer ON c_custkey = o_custkey""")
def q_job_candidates(spark, sf):
    o = t(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", ((F.col("o_orderkey") % 80) / 8.0).alias("y"))
    return o.join(t(spark, sf, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_name").alias("name"), tx.format_years(F.col("y")).alias("experience"))


# --- search ------------------------------------------------------------------------------------------------


@query(r"SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)\bbolt\b') OR regexp_matches(p_name, '(?i)\bred\b')")
def q_search_profession(spark, sf):
    return t(spark, sf, "part").where(search.profession_filter(F.col("p_name"), ("bolt", "red"))).select("p_partkey", "p_name")


def _brands(spark, sf):
    return candidate_skills(spark, sf).groupBy("resume_id").agg(F.collect_set("skill").alias("skills"))


@query(f"WITH {CAND_SQL} SELECT resume_id FROM cand GROUP BY 1 HAVING bool_or(lower(skill) LIKE '%#21%' OR lower(skill) LIKE '%#22%') OR bool_or(lower(skill) LIKE '%#23%')")
def q_search_skills_any(spark, sf):
    return _brands(spark, sf).where(search.skills_filter(F.col("skills"), ("#21 OR #22", "#23"), "any")).select("resume_id")


@query(f"WITH {CAND_SQL} SELECT resume_id FROM cand GROUP BY 1 HAVING bool_or(lower(skill) LIKE '%#21%' OR lower(skill) LIKE '%#22%') AND bool_or(lower(skill) LIKE '%#23%')")
def q_search_skills_all(spark, sf):
    return _brands(spark, sf).where(search.skills_filter(F.col("skills"), ("#21 OR #22", "#23"), "all")).select("resume_id")


@query(r"""SELECT doc_id FROM documents WHERE (regexp_matches(lower(text), '(^|[^\pL\pN_])(should|das|this)($|[^\pL\pN_])')) AND regexp_matches(lower(text), '(^|[^\pL\pN_])in($|[^\pL\pN_])')""")
def q_search_free_text(spark, sf):
    return t(spark, sf, "documents").where(search.free_text_filter(F.lower("text"), ("should | das OR this", "in"))).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(text), '(^|[^\pL\pN_])(the|la)($|[^\pL\pN_])')")
def q_search_exclude(spark, sf):
    return t(spark, sf, "documents").where(search.exclude_filter(F.lower("text"), ("the", "la", " "))).select("doc_id")


NOW = "2024-01-31 00:00:00"


@query(f"SELECT event_id, CAST(ceil(abs(epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 86400) AS BIGINT) AS age FROM events WHERE ceil(abs(epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 86400) <= 7")
def q_search_recent(spark, sf):
    now = F.lit(datetime.datetime(2024, 1, 31)).cast("timestamp")
    ev = t(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return ev.where(search.recent_filter(F.col("ts"), "week", now)).select("event_id", age_days(F.col("ts"), now).alias("age"))


@query("""SELECT p_partkey, CAST(CASE WHEN p_name = 'red bolt' THEN 100 WHEN p_name LIKE '%bolt%' THEN 60 ELSE 0 END + 2 * CASE WHEN lower(p_brand) LIKE '%#1%' THEN 1 ELSE 0 END AS INTEGER) AS relevance
FROM part ORDER BY relevance DESC, p_partkey LIMIT 30 OFFSET 30""")
def q_search_relevance(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", search.relevance(F.col("p_name"), F.array("p_brand"), ("red bolt", "bolt"), ("#1",)).alias("r"), "p_name", "p_brand")
    return search.page(p.select("p_partkey", F.col("r").alias("relevance")), [F.desc("relevance"), F.asc("p_partkey")], 1)


# --- statistics --------------------------------------------------------------------------------------------


@query(f"WITH {ENS_SQL} SELECT b.bucket, count(r.resume_id) AS n FROM (VALUES ('90-100', 90, 1000), ('80-89', 80, 90), ('70-79', 70, 80), ('60-69', 60, 70), ('<60', -1, 60)) b(bucket, lo, hi) LEFT JOIN ranked r ON rag_score >= lo AND rag_score < hi GROUP BY 1")
def q_stats_scores(spark, sf):
    return stats.score_histogram(scored(spark, sf), "rag_score")


@query(f"""WITH {ENS_SQL}, v AS (SELECT CASE WHEN rag_score >= 85 THEN 'recommended' WHEN rag_score >= 75 THEN 'shortlist' WHEN rag_score < 60 THEN 'reject' ELSE 'review' END AS bucket FROM ranked)
SELECT bucket, count(*) AS n, CAST(round(count(*) * 100.0::double / sum(count(*)) OVER (), 0) AS BIGINT) AS percent FROM v GROUP BY 1""")
def q_stats_verdict(spark, sf):
    return stats.verdict_distribution(scored(spark, sf).withColumn("verdict", F.lit("")), "verdict", "rag_score")


@query(f"""WITH {REC_SQL}, {SPAN_SQL}, v AS (SELECT CASE WHEN y < 3 THEN '<3' WHEN y < 6 THEN '3-6' WHEN y < 10 THEN '6-10' ELSE '10+' END AS bucket FROM (SELECT CASE WHEN years < 1 THEN 1 ELSE years END AS y FROM years))
SELECT bucket, count(*) AS n, CAST(round(count(*) * 100.0::double / sum(count(*)) OVER (), 0) AS BIGINT) AS percent FROM v GROUP BY 1""")
def q_stats_experience(spark, sf):
    return stats.experience_distribution(years_rows(spark, sf).withColumn("text", tx.format_years(F.col("years"))), "text")


@query(f"""WITH {ENS_SQL}, top AS (SELECT *, CAST(resume_id % 100 AS INTEGER) AS stability FROM ranked ORDER BY rag_score DESC, resume_id LIMIT 5)
SELECT round(avg(years), 1) AS avg_years, CAST(floor(avg(stability) + 0.5) AS BIGINT) AS avg_stability, max(rag_score) AS best_score, arg_max('c' || resume_id, {{'s': rag_score, 'k': -resume_id}}) AS top_name FROM top""")
def q_stats_top5(spark, sf):
    rows = scored(spark, sf).withColumn("stability", (F.col("resume_id") % 100).cast("int")).withColumn("name", F.concat(F.lit("c"), F.col("resume_id").cast("string")))
    return stats.top5_metrics(rows, "rag_score", "years", "stability", "name", "resume_id")


@query("SELECT count(*) AS all, count_if(event_type = 'view') AS view, count_if(event_type = 'click') AS click, count_if(event_type = 'purchase') AS purchase FROM events".replace(" AS all", ' AS "all"'))
def q_status_facets(spark, sf):
    return stats.status_facets(t(spark, sf, "events"), "event_type", ("view", "click", "purchase"))


@query(f"WITH {CAND_SQL} SELECT source, array_to_string(list_sort(list_distinct(list(skill))), ',') AS names, CAST(CASE source WHEN 'work_experience' THEN 0 WHEN 'skills_list' THEN 1 ELSE 999 END AS INTEGER) AS rank FROM cand GROUP BY 1, 3")
def q_skills_by_source(spark, sf):
    return stats.by_source(candidate_skills(spark, sf), "source", "skill", ("work_experience", "skills_list")).select("source", F.array_join("names", ",").alias("names"), "rank")


# --- mutations and events ----------------------------------------------------------------------------------


@query("""SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type, max(event_id) FILTER (true) AS last_event FROM (SELECT * FROM events) GROUP BY 1""".replace("max(event_id) FILTER (true)", "arg_max(event_id, {'t': ts, 'e': event_id})"))
def q_latest_status_upsert(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    return store.last_write_wins(e, "user_id", ["ts", "event_id"]).select("user_id", "event_type", F.col("event_id").alias("last_event"))


@query("""SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -1, NULL, 'NEW'""")
def q_upsert(spark, sf):
    old = t(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    changes = old.where("c_custkey % 5 = 0").select("c_custkey", F.lit(None).cast("double").alias("c_acctbal"), F.lit("CHANGED").alias("c_mktsegment"))
    new = spark.createDataFrame([(-1, None, "NEW")], "c_custkey long, c_acctbal double, c_mktsegment string")
    return store.upsert(old, changes.unionByName(new), ["c_custkey"], F.current_timestamp())


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def q_cascade_delete(spark, sf):
    orders = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    _, lines = store.delete(orders, orders.where("o_orderstatus = 'P'"), "o_orderkey", (t(spark, sf, "lineitem").select("l_orderkey"), "l_orderkey"))
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def q_props_json(spark, sf):
    return t(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_status_windows(spark, sf):
    e = t(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    w = streams.status_windows(e)
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def q_stream_ingest(spark, sf):
    """The events through a file stream that runs until all is read, then the same aggregation as in batch."""
    from .plans.tables import work_path

    schema = t(spark, sf, "events").schema
    out, mark = work_path(spark, "stream-out"), work_path(spark, "stream-checkpoint")
    src = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    streams.run_available(src, out, mark, lambda s: s.select("event_type", "user_id"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


# --- dates, labels, states ---------------------------------------------------------------------------------

_SHAPES = ("yyyy-MM-dd", "yyyy/M/d", "d/M/yyyy", "M/yyyy", "MMM yyyy", "yyyy")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 9 <= 2 THEN d WHEN o_orderkey % 9 <= 4 THEN date_trunc('month', d)::DATE WHEN o_orderkey % 9 IN (5, 6) THEN date_trunc('year', d)::DATE WHEN o_orderkey % 9 = 7 THEN DATE '{TODAY}' END AS parsed FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def q_loose_dates(spark, sf):
    """Order dates written in six formats, as ranges of years, as 'Present' and as no date."""
    k, d = F.col("o_orderkey") % 9, F.col("o_orderdate").cast("date")
    raw = F.coalesce(*[F.when(k == i, F.date_format(d, f)) for i, f in enumerate(_SHAPES)], F.when(k == 6, F.concat(F.year(d).cast("string"), F.lit("-2030"))), F.when(k == 7, " Present"), F.lit("some day"))
    return t(spark, sf, "orders").select("o_orderkey", dates.parse_loose(raw, today()).alias("parsed"))


@query(f"""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(max(l_shipdate) AS DATE) AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2), y AS (SELECT *, extract('day' FROM e) - extract('day' FROM s) AS dd FROM x)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN year(s) = year(e) THEN 0.5::double ELSE greatest(date_diff('day', date_trunc('year', s)::DATE, date_trunc('year', e)::DATE), 0) / 365.25::double END WHEN o_orderkey % 3 = 1 THEN greatest(date_diff('day', s, DATE '{TODAY}'), 0) / 365.25::double ELSE greatest(date_diff('day', date_trunc('month', s)::DATE, make_date(year(e), 6, 30)), 0) / 365.25::double END AS stability,
CASE WHEN round(date_diff('day', s, e) / 365.0::double, 1) > 0 THEN round(date_diff('day', s, e) / 365.0::double, 1) END AS simple, CAST(printf('%.1f', greatest(((year(e) - year(s)) * 12 + month(e) - month(s) + CASE WHEN dd > 0 THEN dd / 30.0::double ELSE 0 END) / 12.0::double, 0)) AS DOUBLE) AS by_months FROM y""")
def q_durations(spark, sf):
    last = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("e"))
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("s")).join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    k, year = F.col("o_orderkey") % 3, lambda c: F.year(c).cast("string")
    start = F.when(k == 0, year("s")).when(k == 1, F.col("s").cast("string")).otherwise(F.date_format("s", "yyyy-MM"))
    end = F.when(k == 0, year("e")).when(k == 1, "present").otherwise(year("e"))
    return o.select("o_orderkey", dates.years_stability(start, end, today()).alias("stability"), dates.years_simple(F.col("s"), F.col("e")).alias("simple"), dates.years_by_months(F.col("s"), F.col("e"), today()).alias("by_months"))


@query("""WITH x AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey % 101 END AS s, c_custkey % 7 AS lo, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 11 END AS hi, c_mktsegment FROM customer)
SELECT k, CASE WHEN coalesce(s, 0) = 0 THEN 'Unknown' WHEN s >= 90 THEN 'Excellent' WHEN s >= 80 THEN 'Good' WHEN s >= 70 THEN 'OK' WHEN s >= 60 THEN 'Moderate' WHEN s >= 50 THEN 'Concern' ELSE 'High Risk' END AS badge,
CASE WHEN lo > 0 AND hi > 0 THEN lo || '-' || hi || ' yrs' WHEN lo > 0 THEN lo || '+ yrs' WHEN hi > 0 THEN 'Up to ' || hi || ' yrs' END AS years,
CASE WHEN lo > 0 AND hi > 0 THEN format('{:,}', lo * 1000) || '-' || format('{:,}', hi * 1000) || ' USD' WHEN lo > 0 THEN format('{:,}', lo * 1000) || '+ USD' WHEN hi > 0 THEN 'Up to ' || format('{:,}', hi * 1000) || ' USD' END AS salary,
CASE WHEN k % 4 = 0 THEN 0 WHEN k % 4 = 1 THEN 1 ELSE 2 END::BIGINT AS bullets, k % 4 = 0 AS calm FROM x""")
def q_badges(spark, sf):
    """Labels of scores, ranges of years and pay, bullets and concerns."""
    k = F.col("c_custkey")
    score, low, high = F.when(k % 17 != 0, k % 101), k % 7, F.when(k % 3 != 0, k % 11)
    text = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("late on "), "c_mktsegment")).otherwise(F.concat(F.lit("• one •  • "), "c_mktsegment"))
    calm = F.when(k % 8 == 0, "No significant concerns for now").otherwise(text)
    return t(spark, sf, "customer").select(
        k.alias("k"), tx.stability_badge(score).alias("badge"), tx.years_label(low, high).alias("years"), tx.salary_label(low * 1000, high * 1000, F.lit("USD")).alias("salary"), tx.count_bullets(text).alias("bullets"), tx.no_concerns(calm).alias("calm"),
    )


@query(r"""SELECT c_custkey, trim(regexp_replace(replace(lower(c_name || ' & ' || c_mktsegment), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS plain, coalesce(nullif(trim(regexp_replace(c_name, '[^a-zA-Z\s\-'']', '', 'g')), ''), c_name) AS person,
'Customer ' || substr(c_name, 10) AS path_name FROM customer""")
def q_name_forms(spark, sf):
    c = t(spark, sf, "customer")
    path = F.concat(F.lit("/in/Customer_"), F.substring("c_name", 10, 20), F.lit(".PDF"))
    return c.select("c_custkey", tx.norm_text(F.concat("c_name", F.lit(" & "), "c_mktsegment")).alias("plain"), tx.person_name(F.col("c_name")).alias("person"), tx.name_from_path(path).alias("path_name"))


@query("""SELECT page_id, lower(regexp_replace(trim(url || '//'), '/+$', '')) AS url_key, '<pre dir="ltr">' || replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</pre>' AS preview FROM pages""")
def q_page_forms(spark, sf):
    return t(spark, sf, "pages").select("page_id", tx.url_key(F.concat("url", F.lit("//"))).alias("url_key"), tx.html_preview(F.col("html")).alias("preview"))


@query("""SELECT doc_id, CASE WHEN length(trim(text)) < 50 THEN 'ingested,parsing,error' WHEN doc_id % 10 = 3 THEN 'ingested,parsing,extracting,error' WHEN doc_id % 10 = 5 THEN 'ingested,parsing,extracting,duplicate' WHEN doc_id % 10 = 7 OR coalesce(quality, 1) = 0 THEN 'ingested,parsing,extracting,warning' ELSE 'ingested,parsing,extracting,parsed,ready' END AS path
FROM documents LEFT JOIN labels USING (doc_id)""")
def q_status_path(spark, sf):
    k = F.col("doc_id") % 10
    rows = t(spark, sf, "documents").select("doc_id", "text").join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    path = quality_report.status_path(F.col("text"), k == 5, k == 7, F.coalesce(F.col("quality"), F.lit(1)) != 0, F.when(k == 3, "broken"))
    return rows.select("doc_id", F.array_join(path, ",").alias("path"))


@query(rf"""WITH p AS (SELECT p_partkey, p_size % 2 = 0 AS tech, 'Senior ' || p_name || ' manager/' || p_type AS title, [p_brand, 'strong skills', p_name || ' in a very long phrase', ' ' || p_type] AS must FROM part),
w AS (SELECT *, list_filter(must, lambda s: len(regexp_split_to_array(trim(s), '\s+')) <= 3 AND len(list_filter(regexp_split_to_array(trim(s), '\s+'), lambda x: lower(x) NOT IN ({_quoted(search.GENERIC_WORDS)}))) > 0) AS good,
 list_distinct(list_filter(regexp_split_to_array(title, '[^A-Za-z/]+'), lambda x: length(x) > 1 AND lower(x) NOT IN ({_quoted(search.TITLE_STOP)}))) AS words FROM p)
SELECT p_partkey, CASE WHEN tech THEN array_to_string(list_transform(good, lambda s: trim(s)), ',') ELSE '' END AS skills, CASE WHEN NOT tech THEN array_to_string(list_sort(words), ',') ELSE '' END AS words FROM w""")
def q_filters_from_job(spark, sf):
    p = t(spark, sf, "part")
    title = F.concat(F.lit("Senior "), "p_name", F.lit(" manager/"), "p_type")
    must = F.array(F.col("p_brand"), F.lit("strong skills"), F.concat("p_name", F.lit(" in a very long phrase")), F.concat(F.lit(" "), "p_type"))
    f = p.select("p_partkey", search.job_filter_columns(title, F.col("p_size") % 2 == 0, must, F.array().cast("array<string>")).alias("f"))
    chip = F.coalesce(F.get("f.free_text", F.lit(0)), F.lit(""))
    return f.select("p_partkey", F.array_join("f.skills", ",").alias("skills"), F.array_join(F.array_sort(F.split(chip, " OR ")), ",").alias("words"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 > 0")
def q_processed_and_matched(spark, sf):
    rows = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1)).alias("llm"), F.when(F.col("o_orderkey") % 8 != 0, F.col("o_orderkey") % 4).alias("match"))
    return rows.where(search.processed_only(F.col("llm")) & search.matched_only(F.col("match"))).select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_shippriority END AS llm_score, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS analysis, o_custkey % 5 = 0 AND o_orderkey % 2 = 0 AS again FROM (SELECT *, CAST(o_orderkey % 90 AS INTEGER) AS o_shippriority FROM orders)""")
def q_invalidate(spark, sf):
    """Edges of changed jobs lose their second stage; a job whose text changed without a manual analysis is analyzed again."""
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), "o_orderkey", (F.col("o_orderkey") % 90).cast("int").alias("llm_score"), F.col("o_orderpriority").alias("analysis"))
    changed = t(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("job_id"))
    hit = F.col("job_id") % 5 == 0
    again = store.needs_analysis(F.lit("old"), F.when(hit, "new").otherwise("old"), F.lit(None), F.lit(None), F.when(F.col("o_orderkey") % 2 != 0, "given"))
    return store.invalidate(o, changed).select("o_orderkey", "llm_score", "analysis", again.alias("again"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'error' ELSE event_type END AS status, CASE WHEN event_type IN ('view', 'click') THEN 'interrupted' END AS error FROM events""")
def q_heal(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "parsing").when(F.col("event_type") == "click", "extracting").otherwise(F.col("event_type")).alias("status"), F.lit(None).cast("string").alias("error"))
    return streams.heal(e)


@query("""WITH v AS (SELECT c_custkey AS k, l.e AS pos, CAST((c_custkey * l.e) % 101 AS INTEGER) AS score FROM customer, (VALUES (1), (2)) l(e) WHERE c_custkey % 4 <> 0 AND (l.e = 1 OR c_custkey % 3 = 0))
SELECT c_custkey AS resume_id, coalesce(arg_max(score, pos), 0) AS llm_score, CASE WHEN count(score) = 0 THEN 'Evaluation missing' ELSE 'c' END AS concerns FROM customer LEFT JOIN v ON k = c_custkey GROUP BY 1""")
def q_merge_evaluations(spark, sf):
    people = t(spark, sf, "customer").select(F.col("c_custkey").alias("resume_id"))
    ev = people.where("resume_id % 4 <> 0").select("resume_id", F.explode(F.when(F.col("resume_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("pos"))
    ev = ev.select("resume_id", "pos", (F.col("resume_id") * F.col("pos") % 101).cast("int").alias("final_score"), F.lit("s").alias("strengths"), F.lit("c").alias("concerns"))
    return ranking.merge_evaluations(people, ev).select("resume_id", "llm_score", "concerns")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE 'new' END AS k, CAST(event_id AS VARCHAR) AS z, CASE WHEN json_extract(props, '$.k') IS NULL AND event_id % 2 = 0 THEN 1 ELSE 2 END AS n FROM events""")
def q_merge_json(spark, sf):
    e = t(spark, sf, "events")
    new = F.concat(F.lit('{"z":'), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "}").otherwise(',"k":"new"}'))
    m = e.select("event_id", clusters.merge_json(F.col("props"), new).alias("m"))
    return m.select("event_id", F.get_json_object("m", "$.k").alias("k"), F.get_json_object("m", "$.z").alias("z"), F.size(F.json_object_keys("m")).alias("n"))
