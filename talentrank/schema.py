"""Struct types of the documents and tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D = T.StringType(), T.DoubleType()
_A = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CONTACT = T.ArrayType(_struct(value=_S, type=_S, provenance=_struct(char_start=T.IntegerType(), char_end=T.IntegerType()), confidence=_D))
ROLE = _struct(title=_S, company=_S, location=_S, start_date=_S, end_date=_S, bullets=_A, tech=_A, duration_years=_D)
EDUCATION = _struct(degree=_S, field=_S, institution=_S, start_date=_S, end_date=_S, tech=_A, skills=_A, courses=_A)
SKILL = _struct(name=_S, source=_S, weight=_D, category=_S)
CLUSTER = _struct(category=_S, members=T.ArrayType(_struct(title=_S, company=_S, start_date=_S, end_date=_S)), total_years=_D, confidence=_D, normalized_roles=_A, original_roles=_A, reasoning=_S)
YEARS = T.MapType(_S, _D)
EXTRACTION = _struct(
    person=_struct(name=_S, self_declared_title=_S, location=_S, phones=CONTACT, emails=CONTACT, links=_A, profiles=T.ArrayType(_struct(type=_S, value=_S)), languages=_A),
    education=T.ArrayType(EDUCATION), experience=T.ArrayType(ROLE), skills=T.ArrayType(SKILL),
    experience_meta=_struct(experience_clusters=T.ArrayType(CLUSTER), totals_by_category=YEARS, recommended_primary_years=YEARS),
    years_by_category=YEARS, primary_years=_D, summary=_S, years_of_experience=_D,
)
RESUME = _struct(id=_S, file_path=_S, content_hash=_S, mime_type=_S, file_size=T.LongType(), status=_S, error=_S, parsed_text=_S, extraction=EXTRACTION, created_at=T.TimestampType(), updated_at=T.TimestampType())
ANALYSIS = _struct(
    role_title=_S, icon=_S, is_tech_role=T.BooleanType(), organization=_S, summary=_S, locations=_A, responsibilities=_A, requirements=_A,
    skills=_struct(must_have=_A, nice_to_have=_A), additional_skills=_A, experience=_struct(years_min=T.IntegerType(), years_max=T.IntegerType()), education=_A,
    salary_range=_struct(min=_D, max=_D, currency=_S), security_clearance=_struct(mentioned=T.BooleanType(), note=_S), tech_stack=T.MapType(_S, _A), languages=_A, keywords=_A, evidence=_A,
)
JOB = _struct(id=_S, title=_S, job_description=_S, free_text=_S, icon=_S, status=_S, normalized_text=_S, lang=_S, tokens=T.IntegerType(), analysis=ANALYSIS, created_at=T.TimestampType(), updated_at=T.TimestampType())
EDGE = _struct(id=_S, job_id=_S, resume_id=_S, status=_S, match_score=T.IntegerType(), rag_score=T.IntegerType(), llm_score=T.IntegerType(), analysis=_S, notes=_S, created_at=T.TimestampType(), updated_at=T.TimestampType())
