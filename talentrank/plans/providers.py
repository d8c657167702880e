"""Providers of what a model does elsewhere, with deterministic offline defaults.

A provider works on pandas batches inside ``mapInPandas``; retries and coercion are here, once.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import ROLE_SYNONYMS

#: Keys under which a judge's answer may hold its list and its scores. Fixed values.
LIST_KEYS = ("evaluations", "candidates", "results", "scores", "rankings", "data")
SCORE_KEYS = ("final_score", "score", "llm_score", "match_score", "total_score", "overall_score", "rating")


class Judge(Protocol):
    def __call__(self, batch: pd.DataFrame) -> list[dict]: ...


class Embedder(Protocol):
    def __call__(self, titles: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class Config:
    """Settings of a run. A chat model's name chooses the local service, none the remote one; offline providers need neither."""

    chat_model: str | None = None
    remote_model: str = "remote"
    temperature: float = 0.0
    seed: int = 7
    context: int = 16384
    predict: int = 2048
    judge_batch: int = 3
    attempts: int = 4

    def service(self) -> str:
        return "local" if self.chat_model else "remote"

    def options(self) -> dict:
        """What a request carries, so that equal requests give equal answers."""
        return {"temperature": self.temperature, "seed": self.seed, "num_ctx": self.context, "num_predict": self.predict}


class Registry:
    """Providers by kind (extractor, clusterer, analyzer, judge) and service; offline ones answer where none is registered."""

    def __init__(self) -> None:
        self._found: dict[tuple[str, str], Callable] = {}

    def register(self, kind: str, service: str, provider: Callable) -> None:
        self._found[kind, service] = provider

    def get(self, kind: str, config: Config) -> Callable:
        offline = {"extractor": rule_extractor, "clusterer": no_clusters, "analyzer": rule_analyzer, "judge": rubric_judge}
        return self._found.get((kind, config.service()), offline[kind])


def load_prompt(name: str, folder: str | Path | None = None) -> str:
    """A prompt's text by its path under ``folder``, else by its file name there."""
    base = Path(folder) if folder else Path(__file__).parent / "prompts"
    tried = [base / name, base / Path(name).name]
    for path in tried:
        if path.is_file():
            return path.read_text(encoding="utf-8")
    raise FileNotFoundError(f"no prompt at {tried[0]} nor {tried[1]}")


def coerce_score(item: dict) -> int:
    for k in SCORE_KEYS:
        if item.get(k) is not None:
            try:
                return int(round(float(item[k])))
            except (TypeError, ValueError):
                return 0
    return 0


def coerce_json(text: str) -> dict:
    """The first balanced object of a model's answer, code fences ignored; a list of one object is that object; else an error."""
    text = text.replace("```json", "").replace("```", "").strip()
    try:
        found = json.loads(text)
        if isinstance(found, list) and len(found) == 1 and isinstance(found[0], dict):
            return found[0]
        if isinstance(found, dict):
            return found
    except ValueError:
        pass
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
            if isinstance(found, dict):
                return found
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return {"error": "no JSON object"}


def evaluations_of(answer: dict | list) -> list[dict]:
    if isinstance(answer, list):
        return answer
    return next((answer[k] for k in LIST_KEYS if isinstance(answer.get(k), list)), [])


def rubric_judge(batch: pd.DataFrame) -> list[dict]:
    """The offline judge: skills 25, title 30, experience 20, content 15, education 10; times 0.85 if title and skills are both under 15."""
    out = []
    for r in batch.itertuples():
        skills, title = 25 * r.skills_score / 100, 30 * r.title_score / 100
        total = skills + title + 20 * r.experience_score + 15 * min(1.0, r.content_overlap) + 10
        if title < 15 and skills < 15:
            total *= 0.85
        out.append({"resume_id": r.resume_id, "final_score": round(total), "strengths": "- " + ("relevant title" if title >= 15 else "stated skills"), "concerns": "" if skills >= 15 else "- few required skills"})
    return out


def judge(rows: DataFrame, judge_fn: Judge = rubric_judge, attempts: int = 4) -> DataFrame:
    """Evaluate candidates in their batches (column ``batch``): resume_id, llm_score, strengths, concerns.

    A batch is asked again while answers are missing, and the last answer is taken; candidates that it
    omits score 0. Batches are dealt out by number, so the number of partitions caps concurrent calls.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for _, batch in frame.groupby("batch", sort=True):
                found: dict[str, dict] = {}
                for _ in range(attempts):
                    found = {str(e.get("resume_id")): e for e in judge_fn(batch)}
                    if len(found) == len(batch):
                        break
                for i in batch["resume_id"]:
                    e = found.get(str(i))
                    out.append((i, coerce_score(e) if e else 0, (e or {}).get("strengths", ""), e.get("concerns", "") if e else "Evaluation missing"))
            yield pd.DataFrame(out, columns=["resume_id", "llm_score", "strengths", "concerns"])

    kind = rows.schema["resume_id"].dataType.simpleString()
    return rows.repartition("batch").mapInPandas(run, f"resume_id {kind}, llm_score int, strengths string, concerns string")


def ask(rows: DataFrame, key: str, columns: list[str], provider: Callable[[dict], dict | str | None], good: Callable[[dict], bool], attempts: int = 4) -> DataFrame:
    """Ask a provider once per row until an answer is good: key, ``answer`` (JSON text, null if none was), ``attempts``, ``failed``.

    Errors of the provider, text without an object and error payloads count as bad answers. Rows are asked where they
    lie, so the number of partitions caps concurrent calls.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                answer, n = None, 0
                while answer is None and n < attempts:
                    n += 1
                    try:
                        found = provider({c: r[c] for c in columns})
                        found = coerce_json(found) if isinstance(found, str) else found
                        if isinstance(found, dict) and not found.get("error") and not found.get("__llm_error__") and good(found):
                            answer = json.dumps(found, ensure_ascii=False)
                    except Exception:  # noqa: BLE001, S112  a remote service may fail in any way
                        continue
                out.append((r[key], answer, n, answer is None))
            yield pd.DataFrame(out, columns=[key, "answer", "attempts", "failed"])

    return rows.select(key, *columns).mapInPandas(run, f"{key} {kind}, answer string, attempts int, failed boolean")


def good_extraction(answer: dict) -> bool:
    """An object with a person, and lists (or nothing) of roles and schools."""
    lists = all(answer.get(k) is None or isinstance(answer.get(k), list) for k in ("experience", "education"))
    person = answer.get("person") or {}
    return lists and isinstance(person, dict) and (person.get("languages") is None or isinstance(person["languages"], list))


def good_clustering(answer: dict) -> bool:
    """Lists of clusters of known categories, totals that are numbers of at least 0; anything may be missing."""
    from ..operators.clusters import CATEGORIES

    clusters, totals, primary = answer.get("experience_clusters"), answer.get("totals_by_category"), answer.get("recommended_primary_years")
    if not (clusters is None or isinstance(clusters, list)) or not (totals is None or isinstance(totals, dict)) or not (primary is None or isinstance(primary, dict)):
        return False
    number = lambda v: isinstance(v, int | float) and v == v and 0 <= v < float("inf")
    return all(k in CATEGORIES and number(v) for k, v in (totals or {}).items()) and all(not c.get("category") or c["category"] in CATEGORIES for c in clusters or [] if isinstance(c, dict))


def good_analysis(answer: dict) -> bool:
    """An analysis that says something: a role, skills, responsibilities or requirements."""
    skills = answer.get("skills") or {}
    return bool(answer.get("role_title") or skills.get("must_have") or skills.get("nice_to_have") or answer.get("responsibilities") or answer.get("requirements"))


_DATE = r"(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* )?(?:19|20)\d\d"
_ROLE_LINE = rf"^(?P<title>[^,@\d][^,@]{{2,60}}?)\s*(?:,| at | @ )\s*(?P<company>[^,()\d][^,()]{{1,60}}?)(?:\s*[,(]\s*|\s+)(?P<start>{_DATE})\s*[-–]\s*(?P<end>{_DATE}|present|now|current)\)?\s*$"


def rule_extractor(row: dict) -> dict:
    """The offline extractor: lines such as 'Title, Company (2019 - 2021)' are roles, with the bullets below them."""
    roles: list[dict] = []
    for line in (row.get("parsed_text") or "").splitlines():
        found = re.match(_ROLE_LINE, line.strip(), re.IGNORECASE)
        if found:
            roles.append({"title": found["title"].strip(), "company": found["company"].strip(), "start_date": found["start"], "end_date": found["end"], "bullets": []})
        elif roles and re.match(r"\s*[-•*]\s+\S", line):
            roles[-1]["bullets"].append(line.strip().lstrip("-•* "))
    return {"person": {}, "experience": roles, "education": []}


def no_clusters(row: dict) -> dict:
    """The offline clusterer finds none, so totals come from the roles' own words."""
    return {"experience_clusters": [], "totals_by_category": {}, "recommended_primary_years": {}}


def rule_analyzer(row: dict) -> dict:
    """The offline job analyzer: the title is the role, bullet lines are requirements; skills are found by the normalization."""
    lines = [x.strip().lstrip("-•* ") for x in (row.get("job_description") or "").splitlines() if re.match(r"\s*[-•*]\s+\S", x)]
    return {"role_title": row.get("title") or "", "requirements": lines, "skills": {"must_have": [], "nice_to_have": []}}


def extract_records(texts: DataFrame, now, provider: Callable[[dict], dict | str | None] = rule_extractor, clusterer: Callable[[dict], dict | str | None] = no_clusters, attempts: int = 4) -> DataFrame:
    """``texts`` (id, parsed_text) to records: id, extraction, llm_enhancement ('ok' or 'failed').

    The provider's answer gives roles and schools, deterministic extraction gives contacts, languages and further skills,
    the clusterer's answer is rebuilt from the roles. Without a good extraction after all attempts the deterministic
    parts remain, without roles; without good clusters totals come from the roles' own words.
    """
    from .. import schema
    from ..operators import clusters, extraction

    answers = ask(texts, "id", ["parsed_text"], provider, good_extraction, attempts).select("id", "answer", "failed")
    facts = extraction.extract(texts).withColumnsRenamed({"name": "_name", "emails": "_emails", "phones": "_phones", "urls": "_urls", "profiles": "_profiles", "languages": "_languages", "skills": "_skills"})
    rows = texts.select("id", "parsed_text").join(answers, "id").join(facts, "id").withColumn("p", clusters.read_payload(F.col("answer")))
    experience = extraction.sanitize_roles(F.coalesce(F.col("p.experience"), F.array().cast(schema.EXTRACTION["experience"].dataType)))
    rows = rows.withColumn("experience", experience).withColumn("roles", F.to_json("experience"))
    grouped = ask(rows, "id", ["parsed_text", "roles"], clusterer, good_clustering, attempts).select("id", F.from_json("answer", schema.EXTRACTION["experience_meta"].dataType)["experience_clusters"].alias("raw_clusters"))
    rows = rows.join(grouped, "id")
    contact = lambda c: F.from_json(F.to_json(F.transform(c, lambda v: F.struct(v.alias("value")))), schema.CONTACT)
    base = F.struct(contact(F.col("_emails")).alias("emails"), contact(F.col("_phones")).alias("phones"), F.col("_urls").alias("links"), F.col("_profiles").alias("profiles"), F.col("_languages").alias("languages"))
    person = F.coalesce(F.col("p.person"), F.from_json(F.lit("{}"), schema.EXTRACTION["person"].dataType))
    skills = clusters.merge_skills(F.col("p.skills"), F.transform("_skills", lambda s: F.struct(s["name"].alias("name"), s["source"].alias("source"), s["weight"].cast("double").alias("weight"), F.lit(None).cast("string").alias("category"))))
    rows = rows.withColumn("meta", F.when(~F.col("failed"), clusters.rebuild(F.col("experience"), F.col("p.education"), F.col("raw_clusters"), now)))
    whole = F.struct(
        clusters.base_signals(person, base).alias("person"), F.col("p.education").alias("education"), F.when(~F.col("failed"), F.col("experience")).alias("experience"), skills.alias("skills"), F.col("meta").alias("experience_meta"),
        clusters.years_by_category(F.col("meta.totals_by_category")).alias("years_by_category"), F.try_element_at(F.col("meta.recommended_primary_years"), F.lit("tech")).alias("primary_years"), F.col("p.summary").alias("summary"),
    )
    return rows.select("id", whole.alias("extraction"), F.when(F.col("failed"), "failed").otherwise("ok").alias("llm_enhancement"))


def analyze_jobs(jobs: DataFrame, provider: Callable[[dict], dict | str | None] = rule_analyzer, attempts: int = 3) -> DataFrame:
    """``jobs`` (id, title, job_description, free_text, ..) with a normalized analysis and ``failed`` (no usable content after all attempts)."""
    from .. import schema
    from ..operators.jobs import normalize_jobs

    answers = ask(jobs, "id", ["title", "job_description", "free_text"], provider, good_analysis, attempts).select("id", F.from_json("answer", schema.ANALYSIS).alias("analysis"), "failed")
    return normalize_jobs(jobs.drop("analysis").join(answers, "id"))


def analyze_search(rows: DataFrame, provider: Callable[[dict], dict | str | None] | None = None, attempts: int = 1) -> DataFrame:
    """``rows`` (id, query) as filters: id, profession, min_experience, max_experience, skills (first letter capital), free_text, exclude_keywords; a query that the provider fails on is free text."""
    answers = ask(rows, "id", ["query"], provider or (lambda r: analyze_query(r["query"] or "")), lambda a: True, attempts)
    form = "profession array<string>, min_experience int, max_experience int, skills array<string>, free_text string, exclude_keywords array<string>"
    a = F.from_json("answer", form)
    none = F.array().cast("array<string>")
    from ..functions.text import expand_query_skill

    return rows.join(answers, "id").select(
        "id", F.coalesce(a["profession"], none).alias("profession"), a["min_experience"].alias("min_experience"), a["max_experience"].alias("max_experience"),
        F.coalesce(F.transform(a["skills"], expand_query_skill), none).alias("skills"), F.when(F.col("failed"), F.col("query")).otherwise(F.nullif(a["free_text"], F.lit(""))).alias("free_text"), F.coalesce(a["exclude_keywords"], none).alias("exclude_keywords"),
    )


def hashed_embedder(titles: list[str], dims: int = 256) -> list[list[float]]:
    """The offline embedder: hashed character trigrams, unit length."""
    out = []
    for t in titles:
        v = np.zeros(dims, np.float32)
        s = f"  {t.lower().strip()} "
        for i in range(len(s) - 2):
            h = zlib.crc32(s[i : i + 3].encode())
            v[h % dims] += 1 if h >> 31 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def embed_titles(rows: DataFrame, title: str, out: str = "vector", embedder: Callable[[list[str]], list[list[float]]] = hashed_embedder) -> DataFrame:
    """Each distinct collapsed title is embedded once and joined back; null titles have no vector."""
    key = F.trim(F.regexp_replace(F.col(title), r"\s+", " "))
    distinct = rows.select(key.alias("_title")).where("_title is not null").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"_title": f["_title"], out: embedder(list(f["_title"]))})

    vectors = distinct.mapInPandas(run, f"_title string, {out} array<float>")
    return rows.withColumn("_title", key).join(vectors, "_title", "left").drop("_title")


def expand_titles(title: str, limit: int = 12) -> list[str]:
    """The title and the synonyms of its role category, case-insensitively distinct."""
    low = title.lower()
    names = next((s.split("|") for s in ROLE_SYNONYMS.values() if any(t in low for t in s.split("|"))), [])
    out: list[str] = []
    for t in [title, *names]:
        if t.lower() not in {x.lower() for x in out}:
            out.append(t)
    return out[:limit]


def analyze_query(text: str) -> dict:
    """A question as filters: 'n+ years' and known skills, the rest as free text."""
    from ..dims import skill_variants

    years = re.search(r"(\d+)\s*\+?\s*(?:years?|yrs?)", text, re.IGNORECASE)
    words = re.findall(r"[\w.#+-]+", text.lower())
    table = skill_variants()
    skills = list(dict.fromkeys(table[w] for w in words if w in table and len(w) > 1))
    return {"profession": [], "min_experience": int(years[1]) if years else None, "max_experience": None, "skills": skills, "free_text": "" if skills else text, "exclude_keywords": []}
