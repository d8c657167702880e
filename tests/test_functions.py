"""Scalar functions against tables of values written from the survey."""

import datetime

import pytest
from pyspark.sql import functions as F

from talentrank.functions import arrays, dates, rules, vector
from talentrank.functions import text as tx

def NOW():
    return F.lit(datetime.date(2024, 7, 1))



def values(spark, f, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("node", "Node.js"), ("NodeJS", "Node.js"), ("Node.js 14", "Node.js"), ("react.js", "React"), ("angular 12", "Angular"), ("Python 3.11", "Python"), ("k8s", "Kubernetes"),
        ("postgres", "PostgreSQL"), ("c#", "C#"), (".net", ".NET"), ("apache kafka", "Kafka"), ("unknown tool", "Unknown Tool"), ("node.js rest-api", "Node.Js Rest-Api"),
        ("Vue3", "Vue.js"), ("  ", "  "), (None, None), ("golang", "Go"), ("leafletjs", "Leaflet"), ("Excel 2016", "Excel"),
    ],
)
def test_normalize_skill(spark, raw, want):
    assert values(spark, tx.normalize_skill, [raw]) == [want]


def test_skill_lists(spark):
    assert values(spark, tx.normalize_skill_list, [["node", "Node.js", "React", "react.js 17", None, ""]], "array<string>") == [["Node.js", "React"]]
    assert values(spark, tx.hard_skills, [["Python scripting", "security operations", "Burp Suite", "TCP/IP", "experience", "Python"]], "array<string>") == [["Python", "Burp Suite", "TCP/IP"]]


def test_text(spark):
    assert values(spark, tx.normalize_text, ["<p>Hello  there.</p> hello THERE. Bye!"]) == ["Hello there. Bye!"]
    assert values(spark, tx.approx_token_count, ["a b  c\nd", "", None]) == [4, 0, 0]
    assert values(spark, tx.detect_language, ["שלום hi", "مرحبا", "привет", "hi"]) == ["he", "ar", "ru", "en"]
    assert values(spark, tx.norm_text, ["R&D  Team-Lead!", "צה"]) == ["r and d team lead", ""]
    assert values(spark, tx.name_from_path, ["/cv/john_doe-2020.PDF"]) == ["John Doe 2020"]
    assert values(spark, tx.person_name, ["J@ne O'Neil-Smith 3", "דנה"]) == ["Jne O'Neil-Smith", "דנה"]
    assert values(spark, tx.url_key, [" HTTP://x.y/Z// "]) == ["http://x.y/z"]
    assert values(spark, tx.is_broken, ["", None, "ok text", "\n".join("ab c d e f g h i j k l m".split())]) == [True, True, False, True]
    # the tags of bare years go into ranges too, as years there stand between other characters than letters
    want = ["[DATE:[YEAR:2019]-01-01..[YEAR:2020]-03-01]", "[DATE:[YEAR:2018]-01-01..[YEAR:2021]-01-01]", "since [YEAR:2015]", "מאי [DATE:[YEAR:2020]-01-01..PRESENT]", "[DATE:[YEAR:2020]-01-01..PRESENT]"]
    assert values(spark, tx.tag_dates, ["ינואר 2019 - מרץ 2020", "2018-2021", "since 2015", "מאי 2020 - כיום", "2020 – now"]) == want
    assert values(spark, tx.valid_icon, ["🚀", "abc", "🚀🚀🚀🚀🚀🚀🚀🚀🚀🚀"]) == [True, False, False]
    assert values(spark, tx.html_preview, ["a<b", "שלום"]) == ['<pre dir="ltr">a&lt;b</pre>', '<pre dir="rtl">שלום</pre>']


def test_contacts(spark):
    t = "Jane Doe\nmail: Jane.Doe@Example.com or x@y.io\n052-123 4567, 2015-2019, +1 (212) 555 0100\nhttps://www.linkedin.com/in/jane https://github.com/jane"
    assert values(spark, tx.emails, [t]) == [["Jane.Doe@Example.com", "x@y.io"]]
    assert values(spark, tx.phones, ["call 052-1234567 or 2015 - 2019 or +1 212 555 0100."]) == [["+972521234567", "+12125550100"]]
    assert values(spark, tx.phone_display, ["+972521234567", "03-1234567", "0731234567", "12345"]) == ["052-123-4567", "03-1234567", "073-1234567", "12345"]
    assert [[p.type for p in r] for r in values(spark, tx.profiles, [t])] == [["linkedin", "github"]]
    assert values(spark, tx.name_heuristic, [t, "CV\nJohn Smith", "דנה כהן"]) == ["Jane Doe", "John Smith", None]
    assert values(spark, tx.spoken_languages, ["English, hebrew and Polish"]) == [["English", "Hebrew"]]
    assert values(spark, tx.scan_skills, ["C++ and .NET, not pythonic; Python3? python."]) == [["python", "c++", ".net"]]


def test_numbers(spark):
    assert values(spark, tx.format_years, [None, 0.0, 0.5, 3.0, 1.25, 2.75], "double") == ["0 yrs", "0 yrs", "<1 yr", "3 yrs", "1.2 yrs", "2.8 yrs"]
    assert [tuple(r) for r in values(spark, tx.required_years, ["3-5 years", "at least 4+ years", "none"])] == [(3, 5), (4, None), (None, None)]
    assert values(spark, tx.stability_badge, [None, 95.0, 81.0, 55.0, 10.0], "double") == ["Unknown", "Excellent", "Good", "Concern", "High Risk"]


def test_boundaries(spark):
    found = lambda term, texts: values(spark, lambda c: tx.boundary_match(c, term), texts)
    assert found(".net", ["and network", "with .net core"]) == [False, True]
    near = lambda c: tx.ambiguous_term_near_code(c, "go")
    assert values(spark, near, ["go home", "programming in go", "go " + "x" * 80 + " code"]) == [False, True, False]
    assert values(spark, lambda c: tx.text_has_skill(c, "c++"), ["C++11 and C++ 17", "c plus"]) == [True, False]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("2020", "2020-01-01"), ("Jan 2020", "2020-01-01"), ("march 2019", "2019-03-01"), ("2020-1", "2020-01-01"), ("2019-2022", "2019-01-01"), ("03/2021", "2021-03-01"), ("2020-05-17", "2020-05-17"), ("present", "2024-07-01"), ("garbage", None), (None, None), ("", None)],
)
def test_loose_dates(spark, raw, want):
    got = values(spark, lambda c: dates.parse_loose(c, NOW()), [raw])[0]
    assert (got and str(got)) == want


def test_hebrew_dates(spark):
    got = values(spark, lambda c: dates.parse_multilingual(c, NOW()), ["ינואר 2020", "30 מרץ 2021", "היום"])
    assert list(map(str, got)) == ["2020-01-01", "2021-03-28", "2024-07-01"]


def test_durations(spark):
    rows = [("2023", "2024"), ("2023", "2023"), ("Jan 2020", "2021"), ("2020", "present"), ("2020", None), ("2020", ""), ("x", "2021"), ("2022", "2020")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, e string").orderBy("i")
    got = [r[0] for r in df.select(dates.years_stability(F.col("s"), F.col("e"), NOW())).collect()]
    assert got[:2] == [pytest.approx(365 / 365.25), 0.5] and got[2] == pytest.approx(546 / 365.25) and got[3] == got[4] == pytest.approx(1643 / 365.25) and got[5:] == [None, None, 0.0]


def test_arrays(spark):
    d = lambda *p: [{"s": datetime.date.fromisoformat(a), "e": datetime.date.fromisoformat(b)} for a, b in p]
    spans = [d(("2020-01-01", "2020-01-11"), ("2020-01-05", "2020-01-21")), d(("2020-01-01", "2020-01-11"), ("2020-01-11", "2020-01-12")), d(("2020-01-10", "2020-01-01")), d(("2020-01-01", "2020-01-31"), ("2020-01-05", "2020-01-06"), ("2020-03-01", "2020-03-02"))]
    assert values(spark, arrays.interval_union_days, spans, "array<struct<s:date,e:date>>") == [20, 11, None, 31]
    assert values(spark, arrays.ordered_distinct, [["b", "A", "a", "B", "c"]], "array<string>") == [["b", "A", "c"]]
    pair = lambda a, b: spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(arrays.jaccard(F.col("a"), F.col("b"))).first()[0]
    assert (pair([], []), pair([], ["x"]), pair(["x", "y"], ["y", "z"])) == (1.0, 0.0, pytest.approx(1 / 3))


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vector.cosine100(F.col("a"), F.col("b"))).collect()] == [pytest.approx(70.7106781), 0.0, 0.0, 0.0]


@pytest.mark.parametrize(
    ("job", "title", "want"),
    [("Backend Developer", "Backend Engineer", 22.0), ("Software Engineer", "Technical Recruiter", -100.0), ("Engineering Manager", "Data Analyst", -30.0), ("Data Scientist", "ML Scientist", 12.0), ("Chef", "Driver", 0.0)],
)
def test_title_boost(spark, job, title, want):
    got = spark.range(1).select(rules.title_boost(F.lit(job), F.lit(title))).first()[0]
    assert got == want


def test_roles(spark):
    rows = [("Developer", "Acme", None, None), ("Technician", "IDF unit 324", [], []), ("Technician", "IDF", ["Python"], []), ("Cook", "Bistro", [], ["Prepared food"]), ("Clerk", "Soft Systems", [], []), ("Soldier", "Army", [], [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, c string, tech array<string>, b array<string>").orderBy("i")
    assert [r[0] for r in df.select(rules.role_kind(F.col("t"), F.col("c"), F.col("tech"), F.col("b"))).collect()] == ["tech", "military", "tech", "other", "tech", "military"]
    got = spark.createDataFrame([(["Built APIs on the server and database"], ["react", "flask"]), (["Built an LLM tool"], []), (None, [])], "b array<string>, t array<string>").select(rules.infer_title(F.col("b"), F.col("t"))).collect()
    assert [r[0] for r in got] == ["Full Stack Developer", "AI Developer", None]


def test_role_categories(spark):
    assert values(spark, rules.role_category, ["DevOps Lead", "Backend Engineer", "QA Analyst", "UX Designer"]) == ["data_engineer", "software_engineer", None, "data_engineer"]
    assert values(spark, lambda c: rules.role_category(c, strict=True), ["UX Designer", "DevOps Lead"]) == ["ux_designer", "devops"]


def test_keyed_arrays(spark):
    df = spark.createDataFrame([([("b", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), ("a", 2, "w"), (None, 9, "n")],)], "a array<struct<k:string,w:int,v:string>>")
    got = df.select(arrays.max_wins(F.col("a"), lambda x: x["k"], lambda x: x["w"]), arrays.first_by_key(F.col("a"), lambda x: x["k"])).first()
    assert [x.v for x in got[0]] == ["z", "y"] and [x.v for x in got[1]] == ["x", "y"]  # a larger weight replaces at the key's first place


def test_spans_and_labels(spark):
    t = "mail a@b.io, c@d.io! 052-123 4567 or 2015-2019"
    got = values(spark, tx.email_spans, [t, "", None])
    assert [(x.value, t[x.start : x.end], x.confidence) for x in got[0]] == [("a@b.io", "a@b.io", 0.98), ("c@d.io", "c@d.io", 0.98)] and got[1:] == [[], []]
    assert [(x.value, t[x.start : x.end]) for x in values(spark, tx.phone_spans, [t])[0]] == [("+972521234567", "052-123 4567")]
    assert values(spark, tx.skill_counts, ["Python, python; react and REACT, pythonic"]) == [{"Python": 2, "React": 2}]
    assert values(spark, tx.count_bullets, ["• a • b •  ", "a\nb", "", None]) == [2, 1, 0, 0]
    assert values(spark, tx.no_concerns, [None, "", " None ", "No significant concerns at all", "none of it", "-", "אין חששות כלל"]) == [True, True, True, True, False, False, True]
    pay = lambda *r: spark.createDataFrame([r], "a int, b int, c string").select(tx.salary_label(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert (pay(1000, 2000, "USD"), pay(1000, 0, None), pay(None, 5, "EUR"), pay(0, None, "EUR")) == ("1,000-2,000 USD", "1,000+", "Up to 5 EUR", None)
    assert values(spark, tx.name_heuristic, ["דנה כהן\nJane Doe", "a\nb c 2\nJohn - Smith\nX Y", "Address Book\nJane Doe"]) == [None, "John   Smith", "Jane Doe"]


def test_tenths_round_by_the_exact_value(spark):
    import random

    rnd = random.Random(5)
    numbers = [(12 * rnd.randrange(30) + rnd.randrange(12) + rnd.randrange(31) / 30.0) / 12.0 for _ in range(3000)] + [k / 20 for k in range(200)] + [0.44999999999999996]
    assert values(spark, dates.tenth, numbers, "double") == [round(x, 1) for x in numbers]
