"""Operators on small records against expectations written from the survey."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from talentrank import schema
from talentrank.operators import dedup, extraction, jobs, quality_report, ranking, scoring, search, stats, store
from talentrank.plans import ingest, match, providers
from talentrank.plans.tables import shared_table
from talentrank.sources import files, layout, tables
from talentrank.streaming import ingest as streams


def now():
    return F.lit(datetime.date(2024, 7, 1))


RESUMES = [
    ("r1", "/cv/jane_doe.pdf", {"person": {"name": "Jane Doe", "emails": [{"value": "j@x.io"}], "phones": [{"value": "052"}], "languages": ["English", "english", " "]}, "education": [{"degree": "BSc", "field": "Computer Science", "institution": "U", "end_date": "2015"}],
      "experience": [{"title": "Backend Developer", "company": "Acme", "start_date": "2020", "end_date": "present", "bullets": ["Built services in Python and Docker"], "tech": ["python", "Flask"]}, {"title": "Engineer", "company": "Beta", "start_date": "2016", "end_date": "2020", "bullets": [], "tech": ["java"]}],
      "skills": [{"name": "docker", "source": "skills_list"}, {"name": "React", "source": "skills_list"}, {"name": "Python", "source": "skills_list"}], "experience_meta": {"totals_by_category": {"tech": 8.0}, "recommended_primary_years": {"tech": 8.0}}, "primary_years": 8.0, "summary": "Backend."}),
    ("r2", "/cv/john-smith.pdf", {"person": {"name": "John Smith", "emails": [{"value": "bad mail"}]}, "experience": [{"title": "", "company": "", "start_date": "2022", "end_date": "2020"}], "education": [], "skills": []}),
    ("r3", "/cv/no.pdf", {"person": {}}),
    ("r4", "/cv/x.pdf", None),
]


@pytest.fixture(scope="module")
def resumes(spark):
    rows = [(i, p, json.dumps(x) if x else None, datetime.datetime(2024, 1, 1 + k)) for k, (i, p, x) in enumerate(RESUMES)]
    df = spark.createDataFrame(rows, "id string, file_path string, raw string, created_at timestamp")
    x = F.from_json("raw", schema.EXTRACTION)
    return df.select("id", "file_path", x.alias("extraction"), F.lit("ready").alias("status"), F.lit("text").alias("parsed_text"), F.lit("application/pdf").alias("mime_type"), F.lit(1).cast("long").alias("file_size"), "created_at").cache()


def test_scans(resumes):
    assert {r.id for r in tables.ids(resumes).collect()} == {"r1", "r2", "r3"}
    assert [r.id for r in tables.in_order(resumes, ["r3", "zz", "r1"], "id").collect()] == ["r3", "r1"]
    page, total = tables.paged_with_total(resumes, [F.desc("created_at"), F.asc("id")], 1, 2)
    assert [r.id for r in page.collect()] == ["r3", "r2"] and total == 4


def test_summaries_and_details(resumes):
    got = {r.id: r for r in extraction.summaries(resumes, now()).collect()}
    assert got["r1"].profession == "Backend Developer" and got["r1"].years == 8.0 and got["r2"].name == "John Smith" and got["r4"].name == "X"
    skills = {s.name: (s.source, s.weight) for s in got["r1"].skills}
    # a role's technology counts as work only where the bullets mention it
    assert skills == {"Python": ("work_experience", 1.0), "Flask": ("skills_list", 0.6), "Java": ("skills_list", 0.6), "Docker": ("work_experience", 1.0), "React": ("skills_list", 0.6)}
    d = {r.id: r for r in extraction.details(resumes, now()).collect()}
    assert d["r1"].contacts == ["j@x.io", "052"] and d["r1"].languages == ["English"] and d["r1"].experience[1].duration_years == 4.0 and d["r3"].contacts == []


def test_quality_report(resumes):
    got = {r.id: r for r in quality_report.report(resumes, now()).collect()}
    of = lambda i, severity: [x.message for x in got[i].issues if x.severity == severity]
    assert got["r1"].valid and got["r1"].score == 1.0 and got["r1"].label == "excellent" and got["r1"].completeness == 1.0 and of("r1", "warning") == []
    assert of("r1", "info") == ["Experience 'Engineer': no detailed description", "Extraction completeness: 100%"]
    assert of("r2", "error") == ["Experience entry 0: missing both title and company", "Experience '': start date after end date"]
    assert of("r2", "warning") == ["Suspicious email format: bad mail", "Only one experience entry found - resume might be under-parsed", "No skills extracted - this may impact matching quality", "Resume extraction is partially incomplete", "No experience duration calculated - clustering may have failed"]
    assert not got["r2"].valid and got["r2"].score == pytest.approx(0.1)
    assert of("r3", "error") == ["No work experience extracted - this is critical for matching", "Resume extraction is severely incomplete"] and "No person information extracted" in of("r3", "warning")
    assert of("r4", "error") == ["Extraction is empty"] and got["r4"].score == pytest.approx(0.8) and got["r4"].completeness == 0.0


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("years", "required", "want"), [(None, 0, 0.5), (0.0, 5, 0.0), (3.0, 0, 1.0), (2.4, 5, 0.05), (2.5, 5, 0.2), (4.9, 5, 0.968), (5.0, 5, 1.0), (13.0, 4, 0.75), (12.0, 4, 1.0), (100.0, 5, 1.0)])
def test_experience_score(spark, years, required, want):
    assert one(spark, scoring.experience_score(F.lit(years).cast("double"), F.lit(required))) == pytest.approx(want)


def test_skills_score(spark):
    weights = F.create_map(F.lit("python"), F.lit(1.0), F.lit("react"), F.lit(0.6), F.lit("docker"), F.lit(0.6))
    s = one(spark, scoring.skills_score(F.array(*map(F.lit, ["Python 3", "reactjs", "Go", "C++"])), F.array(F.lit("Docker")), weights, F.lit("knows C++ well")))
    assert s.base == pytest.approx(65.0) and s.bonus == pytest.approx(3.0) and s.score == pytest.approx(68.0) and s.missing == ["Go"] and s.simple == 75.0
    assert one(spark, scoring.skills_score(F.array().cast("array<string>"), F.array().cast("array<string>"), weights)).score == 100.0


def test_skill_weights(spark):
    # a skill's own weight counts (listed as from experience, but not in the bullets: 0.6), its source only where it has none
    skill = lambda name, source, weight: F.struct(F.lit(name).alias("name"), F.lit(source).cast("string").alias("source"), F.lit(weight).cast("double").alias("weight"))
    skills = F.array(skill("Brand#1", "work_experience", 0.6), skill("Go", "experience", None), skill("Rust", None, None), skill("rust", "skills_list", 1.0))
    assert one(spark, scoring.skill_weights(skills, True)) == {"brand#1": 0.6, "go": 1.0, "rust": 1.0}


@pytest.mark.parametrize(("durations", "years", "want"), [(None, 3.0, 0.5), ([], 3.0, 0.5), ([5.0], 5.0, 1.0), ([0.4, 0.4, 0.4], 1.2, 0.0), ([1.0, 1.2], 2.2, 0.55)])
def test_stability(spark, durations, years, want):
    d = F.lit(None).cast("array<double>") if durations is None else F.array(*map(F.lit, durations)).cast("array<double>")
    assert one(spark, scoring.stability_score(d, F.lit(years))) == pytest.approx(want)


def test_ensemble(spark):
    assert one(spark, scoring.ensemble(F.lit(1.0), F.lit(1.0), F.lit(100.0))) == 100
    assert one(spark, scoring.ensemble(F.lit(0.3), F.lit(1.0), F.lit(50.0))) == int(100 * (0.55 * 0.3 + 0.25 + 0.1) * (0.6 + 0.4 * 0.3 / 0.75))


def test_match_run(spark):
    rnd = random.Random(1)
    names = ["Ann", "Bob", "Cy", "Di", "Ed", "Flo", "Gus", "Ann"]
    rows = [(f"c{i}", n, [{"name": s, "source": "work_experience"} for s in rnd.sample(["python", "docker", "react", "sql"], 3)], "", float(i), True, [2.0, 3.0], "Backend Developer" if i % 2 else "Cook") for i, n in enumerate(names)]
    people = spark.createDataFrame(rows, "resume_id string, name string, skills array<struct<name:string,source:string>>, text string, years double, has_history boolean, durations array<double>, title string")
    people = providers.embed_titles(people, "title").withColumn("titles", F.array(F.struct("title", "vector", F.lit(1.0).alias("weight"), F.lit("primary_profession").alias("source")))).drop("title", "vector")
    job = providers.embed_titles(spark.createDataFrame([("j", "Backend Engineer", ["Python", "Docker"], ["SQL"], 3)], "job_id string, title string, required array<string>, bonus array<string>, years_min int"), "title")
    ranked, facts = match.run_match(people, job, top_n=5, write=shared_table)
    got = ranked.orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and len(got) == 5 and len({r["name"] for r in got}) == 5
    buckets = [r["bucket"] for r in got]
    assert buckets == sorted(buckets) and all(r["best_title"].title == "Backend Developer" for r in got[:2])
    assert {r["type"] for r in facts.collect()} <= {"bottleneck", "weak_pool", "strong_pool"}


def test_final_ranking_and_dedup(spark):
    rows = [(1, "a", "X", 80, 10), (1, "b", " x ", 90, 20), (1, "c", "", None, 99), (1, "d", "", 50, 5), (1, "e", "unknown", 99, 99), (1, "f", None, 71, 1), (1, "g", "  ", None, 9), (1, "h", " ", 50, 5)]
    df = spark.createDataFrame(rows, "job_id int, resume_id string, name string, llm_score int, rag_score int")
    got = ranking.final_ranking(df, 10).orderBy("rank").collect()
    assert [(r.resume_id, r.total) for r in got] == [("b", 3), ("h", 3), ("g", 3)]  # rows without a name go, blank ones all stay


def test_merge_evaluations_and_judge(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "resume_id string")
    ev = spark.createDataFrame([("a", 0, 10, "", ""), ("a", 1, 77, "- ok", "")], "resume_id string, pos int, final_score int, strengths string, concerns string")
    got = {r.resume_id: (r.llm_score, r.concerns) for r in ranking.merge_evaluations(rows, ev).collect()}
    assert got == {"a": (77, ""), "b": (0, "Evaluation missing")}
    assert providers.coerce_score({"score": "81.6"}) == 82 and providers.coerce_score({"rating": "x"}) == 0 and providers.coerce_score({}) == 0
    assert providers.coerce_json('noise ```json\n{"a": {"b": "}"}} tail') == {"a": {"b": "}"}} and "error" in providers.coerce_json("none")
    assert providers.evaluations_of({"results": [1]}) == [1] and providers.expand_titles("Data Scientist")[0] == "Data Scientist"
    assert providers.analyze_query("python developer with 5+ years")["min_experience"] == 5


def test_insights(spark):
    rows = [(60.0, ["go"], 40), (70.0, ["go", "sql"], 50), (80.0, ["go"], 30), (10.0, ["x"], 20), (55.0, [], 10)]
    got = {r.type: r.related_skill for r in ranking.insights(spark.createDataFrame(rows, "title_score double, missing array<string>, llm_score int")).collect()}
    assert got == {"bottleneck": "go", "weak_pool": None}


def test_search(spark):
    rows = [(1, "Ann", "C++ Developer", 5.0, ["C++", "Python"], "writes compilers", 3), (2, "Bob", None, None, [], "cooks", 40), (3, "Cy", "Team Lead", 12.0, ["Node.js", "Go"], "leads go teams", 1)]
    df = spark.createDataFrame([(*r[:6], datetime.datetime(2024, 6, 30) - datetime.timedelta(days=r[6])) for r in rows], "id int, name string, profession string, years double, skills array<string>, text string, created timestamp")

    def ids(**f):
        p = search.predicate(search.FilterState(**f), F.col("name"), F.col("profession"), F.col("years"), F.col("skills"), F.col("text"), F.col("created"), F.lit(datetime.datetime(2024, 6, 30)).cast("timestamp"))
        return [r.id for r in df.where(p).orderBy("id").collect()]

    assert ids(profession=("c++",)) == [1] and ids(min_experience=0) == [1, 2, 3] and ids(min_experience=1, max_experience=6) == [1]
    assert ids(skills=("py OR go", "node")) == [1, 3] and ids(skills=("python", "c++"), skills_mode="all") == [1]
    assert ids(free_text=("go | rust",)) == [3] and ids(free_text=(" , ",)) == [] and ids(exclude=("go",)) == [1, 2] and ids(recent="week") == [1, 3] and ids(query="an") == [1]
    assert search.alternatives("a OR b|c, D או e") == ["a", "b", "c", "d", "e"]
    f = search.filters_from_job("Senior Chef de cuisine", False, ["Python"], 2)
    assert f.skills == () and f.free_text == ("Chef OR de OR cuisine",) and f.min_experience == 2
    assert search.filters_from_job("Dev", None, ["Python", "good strong skills", "a b c d", "good team"], None, ["Python", "AWS "]).skills == ("Python", "good team", "AWS")
    assert search.suggestions(list("abcdefg"), ["a"]) == list("bcdef")


def test_stats(spark):
    df = spark.createDataFrame([(95, "", "3.5 yrs"), (80, "reject", "<1 yr"), (72, "recommend", "12 yrs"), (10, None, "6 yrs"), (None, "", "")], "s int, v string, y string")
    assert {r.bucket: r.n for r in stats.score_histogram(df, "s").collect()} == {"90-100": 1, "80-89": 1, "70-79": 1, "60-69": 0, "<60": 1}
    assert {r.bucket: r.n for r in stats.verdict_distribution(df.where("s is not null"), "v", "s").collect()} == {"recommended": 2, "shortlist": 1, "reject": 1}
    assert {r.bucket: r.percent for r in stats.experience_distribution(df, "y").collect()} == {"<3": 25, "3-6": 25, "6-10": 25, "10+": 25}


def test_dedup(spark):
    contacts = spark.createDataFrame([("a", "email", "x"), ("b", "email", "x"), ("b", "phone", "1"), ("c", "phone", "1"), ("d", "phone", "2")], "id string, kind string, value string")
    masters = dedup.components(dedup.contact_links(contacts), shared_table)
    assert {r.node: r.master for r in masters.collect()} == {"a": "a", "b": "a", "c": "a"}
    rows = spark.createDataFrame([("a", "N", ["x"], "old", "t1", "error", 1), ("b", None, ["x"], "nameless", "t2", "ready", 3), ("c", "N", ["1"], "new", "t3", "ready", 2), ("d", "M", [], "own", "t4", "ready", 1)], "id string, name string, contacts array<string>, extraction string, parsed_text string, status string, created_at int")
    got = {r.id: (r.extraction, r.status) for r in dedup.merge_into_masters(rows, masters).collect()}
    assert got == {"a": ("new", "ready"), "b": ("nameless", "duplicate"), "c": ("new", "duplicate"), "d": ("own", "ready")}
    by = dedup.by_content(spark.createDataFrame([("h", "b", 1), ("h", "a", 1), ("g", "c", 1)], "content_hash string, id string, created_at int"), spark.createDataFrame([("g",)], "content_hash string"))
    assert [(r.id) for r in by.collect()] == ["a"]


def test_store(spark, tmp_path):
    edges = spark.createDataFrame([("j", "r1", "reviewed", 5, "x"), ("j", "r2", None, 7, None), ("k", "r1", "new", 1, None)], "job_id string, resume_id string, status string, match_score int, notes string").withColumns({"llm_score": F.lit(3), "analysis": F.lit("a"), "updated_at": F.lit("then")})
    changes = spark.createDataFrame([("j", "r1", 9), ("j", "r9", 4)], "job_id string, resume_id string, match_score int")
    got = {(r.job_id, r.resume_id): (r.status, r.match_score, r.notes, r.updated_at) for r in store.upsert(edges, changes, ["job_id", "resume_id"], F.lit("now"), {"status": F.lit("new")}).collect()}
    assert got == {("j", "r1"): ("reviewed", 9, "x", "now"), ("j", "r2"): (None, 7, None, "then"), ("k", "r1"): ("new", 1, None, "then"), ("j", "r9"): ("new", 4, None, "now")}
    cleared = {(r.job_id, r.resume_id): r.llm_score for r in store.invalidate(edges, spark.createDataFrame([("j",)], "job_id string")).collect()}
    assert cleared == {("j", "r1"): None, ("j", "r2"): None, ("k", "r1"): 3}
    path = str(tmp_path / "t")
    store.replace(spark.range(3), path)
    store.replace(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def test_layout(spark):
    rows = [("d", 1, 0.0, 0.0, 600.0, 10.0, "title"), ("d", 1, 320.0, 20.0, 590.0, 30.0, "right1"), ("d", 1, 10.0, 25.0, 280.0, 35.0, "left1"), ("d", 1, 10.0, 60.0, 280.0, 70.0, "left2"), ("d", 1, 320.0, 50.0, 590.0, 60.0, "right2"), ("d", 1, 0.0, 100.0, 600.0, 110.0, "footer")]
    b = spark.createDataFrame([(*r, 600.0) for r in rows], "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string, page_width double")
    assert layout.page_text(layout.reading_order(b)).first().parsed_text.split("\n") == ["title", "left1", "left2", "right1", "right2", "footer"]
    w = spark.createDataFrame([("p", 10.1, 50.0, "b"), ("p", 9.9, 5.0, "a"), ("p", 20.0, 1.0, "c")], "p string, y0 double, x0 double, text string")
    assert [r.text for r in layout.lines_from_words(w, ["p"]).orderBy("line").collect()] == ["a b", "c"]


def test_jobs(spark):
    analysis = {"role_title": "Dev", "skills": {"must_have": ["nodejs", "Cobol", "strong communication skills of all kinds", "Docker"], "nice_to_have": ["cloud tools (e.g., Terraform, Ansible)"]}, "requirements": ["SQL"]}
    df = spark.createDataFrame([("1", "Backend dev", "We use Node.js and Docker. 3-5 years of experience. English required.", "", json.dumps(analysis))], "id string, title string, job_description string, free_text string, raw string")
    r = jobs.normalize_jobs(df.withColumn("analysis", F.from_json("raw", schema.ANALYSIS)).drop("raw")).first()
    assert r.analysis.skills.must_have == ["nodejs", "Cobol", "Docker"] and r.analysis.skills.nice_to_have == []  # five words describe
    assert r.analysis.experience.years_min == 3 and r.analysis.experience.years_max == 5 and r.analysis.languages == ["English"] and r.analysis.locations == []
    assert r.analysis.tech_stack["tools"] == ["docker"] and r.analysis.tech_stack["languages"] == ["node.js"] and r.lang == "en" and r.analysis.keywords == ["Docker", "Node.js"]
    assert r.analysis.summary == "Own full-cycle business development and sales."
    assert one(spark, jobs.role_similarity(F.lit("Acme Ltd"), F.lit("Dev"), F.lit("Acme"), F.lit("Senior Dev"))) == pytest.approx(0.6 * 0.9 + 0.4 * 0.85)


def test_files_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    body = "Jane Doe\njane@x.io 052-1234567\nExperience\nPython developer at Acme for many years\n"
    (folder / "a.txt").write_text(body)
    (folder / "copy.txt").write_text(body)
    (folder / "~$a.txt").write_text("lock")
    (folder / "b.tmp").write_text("half")
    (folder / "short.txt").write_text("x")
    found = files.scan(spark, str(folder))
    assert {r.file_path.rsplit("/", 1)[1] for r in found.collect()} == {"a.txt", "copy.txt", "short.txt"} and found.first().mime_type == "text/plain"
    empty = spark.createDataFrame([], "content_hash string")
    batch = {r.status: r for r in ingest.ingest_batch(found, empty, F.current_timestamp()).collect()}
    assert set(batch) == {"ready", "error"} and batch["ready"].name == "Jane Doe" and batch["ready"].emails == ["jane@x.io"]
    out, mark = str(tmp_path / "table"), str(tmp_path / "mark")
    for _ in range(2):  # a restart repeats nothing
        streams.ingest_stream(files.stream(spark, str(folder)), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    (folder / "again.txt").write_text(body)
    streams.ingest_stream(files.stream(spark, str(folder)), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    healed = streams.heal(spark.createDataFrame([("1", "parsing", None), ("2", "ready", None)], "id string, status string, error string"))
    assert {r.id: r.status for r in healed.collect()} == {"1": "error", "2": "ready"}


def test_sections(spark):
    df = spark.createDataFrame([("1", "Jane\nExperience:\nAcme\nBeta\nSkills\nPython"), ("2", None)], "id string, parsed_text string")
    got = [(r.title, r.start, r.end) for r in extraction.sections(df).where("id = '1'").orderBy("start").collect()]
    assert got == [("general", 0, 16), ("experience", 16, 33), ("skills", 33, 40)]  # a part ends with the next heading line
    assert [(r.title, r.start, r.end) for r in extraction.sections(df).where("id = '2'").collect()] == [("general", 0, 0)]


def record(**parts):
    return json.dumps(parts)


def one_record(spark, text, column, kind=None):
    df = spark.createDataFrame([(text,)], "raw string").select(F.from_json("raw", schema.EXTRACTION).alias("x"))
    return df.select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("experience", "education", "want"),
    [
        ([{"title": "Cook", "company": "Inn", "end_date": "2020"}, {"title": "Side project", "company": "Me", "end_date": "present"}], [], "Cook"),
        ([{"title": "Technician", "company": "Army", "end_date": "2021"}], [{"field": "B.Sc Computer Science", "end_date": "present"}], "Computer Science Student"),
        ([{"title": "Technician", "company": "Army", "end_date": "2024-01"}], [{"degree": "MBA", "end_date": "present"}], "Technician"),
        ([{"title": "Volunteer", "company": "Camp"}], [{"degree": "MBA", "end_date": "2024-05-01"}], "MBA Student"), ([{"title": "Volunteer", "company": "Camp"}], [{"end_date": "2010"}], "Volunteer"),
        ([], [{"field": " "}, {"field": "Data and Computer Science", "end_date": "2010"}], "Student"), ([], [{"field": "Data Science", "end_date": "2010"}], "Data Scientist"),
        ([], [{"field": "Civil Engineering", "end_date": "2010"}], "Engineer"), ([], [{"field": "History", "end_date": "2010"}], "History"), ([], [{"field": "Software", "end_date": "2010"}], "Software Developer"), ([], [], None),
    ],
)
def test_profession(spark, experience, education, want):
    assert one_record(spark, record(person={}, experience=experience, education=education), lambda x: extraction.profession(x["person"], x["experience"], x["education"], now())) == want


def test_stability_of_records(spark):
    detail = lambda **k: one_record(spark, record(**k), lambda x: scoring.stability(x, now()))
    assert detail(experience=[]).verdict == "no_experience_data" and detail(experience=[{"title": "x"}]).verdict == "no_duration_data"
    # technologies or a tech cluster make a role count; others only where there is none
    roles = [{"title": "Dev", "start_date": "2019", "duration_years": 1.0}, {"title": "Cook", "duration_years": 9.0}, {"title": "QA", "tech": ["x"], "duration_years": 5.0}]
    meta = {"experience_clusters": [{"category": "tech", "members": [{"title": " DEV ", "start_date": "2019"}]}], "totals_by_category": {"tech": 6.0}}
    got = detail(experience=roles, experience_meta=meta)
    assert (got.total_jobs, got.average_tenure_years, got.short_stints, got.long_tenures) == (2, 3.0, 1, 1) and got.verdict == "excellent_stability"
    assert detail(experience=roles[1:2]).total_jobs == 1
    # mid level begins at three years
    short = [{"title": "a", "duration_years": 1.7}, {"title": "b", "duration_years": 1.6}]
    junior, mid = (detail(experience=short, years_of_experience=y).score for y in (2.9, 3.0))
    assert junior == pytest.approx(1.0 - 0.10) and mid == pytest.approx(1.0 - 0.15 - 0.10 - 0.15)


def test_primary_years_and_verdicts(spark):
    years = lambda meta, tech=True, stated=4.0: one_record(spark, record(experience_meta=meta), lambda x: scoring.primary_years(x["experience_meta"], F.lit(tech), F.lit(stated)))
    assert years({"recommended_primary_years": {"tech": 3.0}, "totals_by_category": {"tech": 9.0}}) == 3.0 and years({"totals_by_category": {"tech": 9.0}}) == 9.0
    assert years({"totals_by_category": {"tech": 0.0, "military": 2.0, "other": 1.0}}) == pytest.approx(1.4) and years({"totals_by_category": {"tech": 2.0}}, False) == pytest.approx(1.4)
    assert years({"totals_by_category": {"tech": 0.0}}) == 0.0 and years({}) == 4.0
    detail = lambda y, r, h: one(spark, scoring.experience_detail(F.lit(y).cast("double"), F.lit(r).cast("int"), F.lit(h)))
    assert detail(0.0, 0, True).verdict == "years_unknown" and detail(None, None, False).verdict == "no_requirement" and detail(0.0, 4, False).verdict == "significantly_under_qualified"
    assert [detail(float(y), 4, True).verdict for y in (1, 3, 6, 8, 9)] == ["significantly_under_qualified", "slightly_under_qualified", "perfect_match", "moderately_over_qualified", "significantly_over_qualified"]


def test_clusters(spark):
    roles = [
        {"title": "Backend Developer", "company": "Meta Platforms", "start_date": "2018", "end_date": "2020"}, {"title": "Waiter", "company": "Cafe", "start_date": "2016", "end_date": "2018-07"},
        {"title": "Student", "company": "Technion", "start_date": "2012", "end_date": "2016"}, {"title": "Projects", "company": "x", "start_date": "2012", "end_date": "2016"}, {"title": "Guide", "company": "Zoo", "start_date": "2020", "end_date": "2019"},
    ]
    school = [{"institution": "TECHNION"}]
    meta = lambda clusters, rs=roles: one_record(spark, record(experience=rs, education=school, experience_meta={"experience_clusters": clusters}), lambda x: clusters_of(x))

    def clusters_of(x):
        from talentrank.operators import clusters

        return clusters.rebuild(x["experience"], x["education"], x["experience_meta"]["experience_clusters"], now())

    got = meta([{"category": "tech", "members": [{"title": "backend developer", "company": "meta"}, {"title": "Student", "company": "Technion"}]}, {"category": "hospitality", "members": [{"title": "WAITER", "company": "cafe"}]}, {"category": "space", "members": [{"title": "Waiter", "company": "Cafe"}]}, {"category": "other", "members": [{"title": "Guide", "company": "Zoo"}]}])
    assert got.totals_by_category == {"tech": 2.0, "military": 0.0, "hospitality": 2.5, "other": 0.0} and got.recommended_primary_years == {"tech": 2.0}
    assert [(c.category, [m.company for m in c.members], c.total_years) for c in got.experience_clusters] == [("tech", ["Meta Platforms"], 2.0), ("hospitality", ["Cafe"], 2.5)]
    bare = meta([])  # by the roles' own words, which are looked for within words: a waiter has an "ai"
    assert bare.experience_clusters == [] and bare.totals_by_category == {"tech": 4.5, "military": 0.0, "hospitality": 0.0, "other": 4.0} and meta(None, None).totals_by_category["tech"] == 0.0


def test_payloads_and_providers(spark):
    from talentrank.operators import clusters

    rows = spark.createDataFrame([("a", "Jane Roe\njane@x.io\nBackend Developer, Acme (2019 - 2021)\n- wrote Python services\nEngineer at Beta 2021 - present"), ("b", "boom"), ("c", None)], "id string, parsed_text string")

    def moody(row):
        if row["parsed_text"] == "boom":
            raise TimeoutError
        return providers.rule_extractor(row)

    got = {r.id: r for r in providers.extract_records(rows, now(), moody).collect()}
    assert [(e.title, e.company, e.start_date, e.end_date) for e in got["a"].extraction.experience] == [("Backend Developer", "Acme", "2019", "2021"), ("Engineer", "Beta", "2021", "present")]
    assert got["a"].llm_enhancement == "ok" and got["a"].extraction.primary_years == 5.5 and [e.value for e in got["a"].extraction.person.emails] == ["jane@x.io"] and [s.name for s in got["a"].extraction.skills] == ["Python"]
    assert got["b"].llm_enhancement == "failed" and got["b"].extraction.experience is None and got["c"].extraction.experience == []
    asked = providers.ask(rows, "id", ["parsed_text"], lambda r: "no JSON here", lambda a: True, attempts=3).collect()
    assert all(r.failed and r.attempts == 3 and r.answer is None for r in asked)

    answer = json.dumps({"workExperience": [{"title": "Dev", "start": " 2019 ", "end": "Current", "tech": ["nodejs", "Node.js", 3]}, "a string", 7], "candidate": {"name": "N"}, "studies": None})
    p = spark.createDataFrame([(answer,), ('{"person": {}, "experience": "no list", "education": []}',), ("nothing",), (None,)], "a string").select(clusters.read_payload(F.col("a")).alias("p")).collect()
    assert [r.p.valid for r in p] == [True, False, False, False] and p[0].p.person.name == "N"
    assert [(e.title, e.start_date, e.end_date, e.tech[:1]) for e in p[0].p.experience] == [("Dev", "2019", "present", ["Node.js"])]
    assert json.loads(one(spark, clusters.merge_json(F.lit('{"a": 1, "b": {"c": 2}}'), F.lit('{"b": [3], "d": "x"}')))) == {"a": 1, "b": [3], "d": "x"}
    assert providers.good_clustering({"totals_by_category": {"tech": 1}}) and not providers.good_clustering({"totals_by_category": {"tech": -1}}) and not providers.good_clustering({"experience_clusters": [{"category": "space"}]})
    jobs_in = spark.createDataFrame([("1", "Data Engineer", "- Python and Spark\n- SQL", None), ("2", "", "", "")], "id string, title string, job_description string, free_text string")
    analyzed = {r.id: r for r in providers.analyze_jobs(jobs_in).collect()}
    assert analyzed["1"].analysis.skills.must_have == ["python", "sql"] and not analyzed["1"].failed and analyzed["2"].failed
    found = {r.id: r for r in providers.analyze_search(spark.createDataFrame([("q", "python developer 3+ years"), ("z", "nice person")], "id string, query string")).collect()}
    assert found["q"].skills == ["Python"] and found["q"].min_experience == 3 and found["z"].free_text == "nice person"


def test_merged_skills(spark):
    from talentrank.operators import clusters

    model = [{"name": "nodejs", "source": "skills_list"}, {"name": "Python", "source": "work_experience"}, {"name": None}]
    rows = spark.createDataFrame([(record(skills=model), record(skills=[{"name": "Node.js", "source": "work_experience"}, {"name": "python", "source": "deterministic"}, {"name": "SQL", "source": "deterministic"}]))], "a string, b string")
    x = lambda c: F.from_json(c, schema.EXTRACTION)["skills"]
    got = rows.select(clusters.merge_skills(x("a"), x("b"))).first()[0]
    assert [(s.name, s.source, s.weight) for s in got] == [("Node.js", "work_experience", 1.0), ("Python", "work_experience", 1.0), ("SQL", "deterministic", 0.6)]


def test_duplicates_by_mail_then_phone(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [("a", day(1), ["x@y", "z@y"], ["1"]), ("b", day(2), ["z@y"], ["2"]), ("c", day(3), ["c@y"], ["2"]), ("d", day(4), ["c@y"], ["1"]), ("e", day(5), [], []), ("f", day(6), None, ["9"]), ("g", day(7), ["X@y"], None)]
    got = dedup.duplicate_masters(spark.createDataFrame(rows, "id string, created_at timestamp, emails array<string>, phones array<string>")).collect()
    assert {r.id: (r.master, r.matched_by) for r in got} == {"b": ("a", "email"), "c": ("b", "phone"), "d": ("c", "email")}


def test_published_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        store.current(spark, path)
    store.publish(spark.range(3), path)
    (tmp_path / "t" / "version=2").mkdir()  # a writer that crashed before its pointer
    assert store.current(spark, path).count() == 3
    store.publish(spark.range(5), path)
    assert store.current(spark, path).count() == 5


def test_pdf_chain():
    from talentrank.sources import pdf

    page = b"%PDF-1.4\n1 0 obj\n<<>>\nstream\nBT (Jane \\(J\\) Roe) Tj T* [(Py) -20 (thon) -300 (dev)] TJ ET\nendstream"
    assert pdf.pdf_text(page) == "Jane (J) Roe\nPython dev" and pdf.pdf_text(b"junk") == ""
    letters = "\n".join("abcdefghijklm")
    assert pdf.chain(b"", [lambda _: letters, lambda _: 1 / 0, lambda _: "whole text"]) == "whole text" and pdf.chain(b"", [lambda _: letters]) == letters


def test_statuses(spark):
    rows = spark.createDataFrame([("x" * 60, False, False, True, None), ("short", False, False, True, None), ("x" * 60, True, False, True, None), ("x" * 60, False, True, True, None), ("x" * 60, False, False, True, "bad")], "t string, d boolean, f boolean, v boolean, e string")
    got = rows.select(quality_report.status_path(*(F.col(c) for c in "tdfve"))).collect()
    assert [r[0] for r in got] == [["ingested", "parsing", "extracting", "parsed", "ready"], ["ingested", "parsing", "error"], ["ingested", "parsing", "extracting", "duplicate"], ["ingested", "parsing", "extracting", "warning"], ["ingested", "parsing", "extracting", "error"]]


def test_scored_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(scoring, "MOST_JOBS", 2)
    people = spark.createDataFrame([(f"c{i}", [{"name": "python", "source": "work_experience"}] * (i % 2), "", float(i), True, [2.0], [{"title": "Dev", "vector": [1.0, 0.0], "weight": 1.0, "source": "p"}]) for i in range(6)], "resume_id string, skills array<struct<name:string,source:string>>, text string, years double, has_history boolean, durations array<double>, titles array<struct<title:string,vector:array<float>,weight:double,source:string>>")
    jobs_in = spark.createDataFrame([(f"j{k}", "Dev", [1.0, 0.0], ["Python"], ["SQL"], k) for k in range(5)], "job_id string, title string, vector array<float>, required array<string>, bonus array<string>, years_min int")
    with pytest.raises(ValueError):
        scoring.score_candidates(people, jobs_in)
    got = scoring.score_in_blocks(people, jobs_in, 2, shared_table).collect()
    assert len(got) == 10 and {r.job_id for r in got} == {f"j{k}" for k in range(5)}


def test_kept_replacement_characters(spark):
    rows = [bytearray("a�b".encode()), bytearray(b"a\xffb"), bytearray("�".encode() + b"\xfe\xef\xbf"), bytearray(b"")]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c binary").orderBy("i")
    assert [r[0] for r in df.select(files.decode(F.col("c"))).collect()] == ["a�b", "ab", "�", ""]
