"""Explicit schemas (no inference): the nested candidate record and friends."""

from __future__ import annotations

from pyspark.sql import types as T

CANDIDATE_DDL = """
candidate_id STRING,
profile STRUCT<anonymized_name: STRING, headline: STRING, summary: STRING, location: STRING,
  country: STRING, years_of_experience: DOUBLE, current_title: STRING, current_company: STRING,
  current_company_size: STRING, current_industry: STRING>,
career_history ARRAY<STRUCT<company: STRING, title: STRING, start_date: STRING, end_date: STRING,
  duration_months: INT, is_current: BOOLEAN, industry: STRING, company_size: STRING,
  description: STRING>>,
education ARRAY<STRUCT<institution: STRING, degree: STRING, field_of_study: STRING,
  start_year: INT, end_year: INT, grade: STRING, tier: STRING>>,
skills ARRAY<STRUCT<name: STRING, proficiency: STRING, endorsements: INT, duration_months: INT>>,
certifications ARRAY<STRUCT<name: STRING, issuer: STRING, year: INT>>,
languages ARRAY<STRUCT<language: STRING, proficiency: STRING>>,
redrob_signals STRUCT<profile_completeness_score: DOUBLE, signup_date: STRING,
  last_active_date: STRING, open_to_work_flag: BOOLEAN, profile_views_received_30d: INT,
  applications_submitted_30d: INT, recruiter_response_rate: DOUBLE,
  avg_response_time_hours: DOUBLE, skill_assessment_scores: MAP<STRING, DOUBLE>,
  connection_count: INT, endorsements_received: INT, notice_period_days: INT,
  expected_salary_range_inr_lpa: STRUCT<min: DOUBLE, max: DOUBLE>, preferred_work_mode: STRING,
  willing_to_relocate: BOOLEAN, github_activity_score: DOUBLE, search_appearance_30d: INT,
  saved_by_recruiters_30d: INT, interview_completion_rate: DOUBLE,
  offer_acceptance_rate: DOUBLE, verified_email: BOOLEAN, verified_phone: BOOLEAN,
  linkedin_connected: BOOLEAN>
"""

CANDIDATE_DDL_FIELDS = ["candidate_id", "profile", "career_history", "education", "skills",
                        "certifications", "languages", "redrob_signals"]


def candidate_schema() -> T.StructType:
    """Parsed lazily: DDL parsing needs a running session."""
    return T._parse_datatype_string(" ".join(CANDIDATE_DDL.split()))  # type: ignore[attr-defined]

JD_PARAGRAPHS = "jd_id STRING, para_no BIGINT, text STRING"
RANKING = "candidate_id STRING, rank STRING, score STRING, reasoning STRING"


# FIXED VALUES: the candidate record as a JSON Schema (draft-07 keywords).
COMPANY_SIZES = ("1-10", "11-50", "51-200", "201-500", "501-1000", "1001-5000", "5001-10000", "10001+")
TIERS = ("tier_1", "tier_2", "tier_3", "tier_4", "unknown")
SKILL_LEVELS = ("beginner", "intermediate", "advanced", "expert")
LANGUAGE_LEVELS = ("basic", "conversational", "professional", "native")
WORK_MODES = ("remote", "hybrid", "onsite", "flexible")


def _text(**more) -> dict:
    return {"type": "string", **more}


def _number(low=None, high=None, kind: str = "number") -> dict:
    return {"type": kind} | ({} if low is None else {"minimum": low}) | ({} if high is None else {"maximum": high})


def _whole(low=None, high=None) -> dict:
    return _number(low, high, "integer")


def _record(required: str, **properties) -> dict:
    return {"type": "object", "required": required.split(), "properties": properties}


def _list(items: dict, **more) -> dict:
    return {"type": "array", "items": items, **more}


_YES_NO, _DAY = {"type": "boolean"}, _text(format="date")

CANDIDATE_JSON_SCHEMA = _record(
    "candidate_id profile career_history education skills redrob_signals",
    candidate_id=_text(pattern="^CAND_[0-9]{7}$"),
    profile=_record(
        "anonymized_name headline summary location country years_of_experience current_title current_company "
        "current_company_size current_industry",
        anonymized_name=_text(), headline=_text(), summary=_text(), location=_text(), country=_text(),
        years_of_experience=_number(0, 50), current_title=_text(), current_company=_text(),
        current_company_size=_text(enum=COMPANY_SIZES), current_industry=_text()),
    career_history=_list(_record(
        "company title start_date end_date duration_months is_current industry company_size description",
        company=_text(), title=_text(), start_date=_DAY, end_date={"type": ["string", "null"], "format": "date"},
        duration_months=_whole(0), is_current=_YES_NO, industry=_text(), company_size=_text(enum=COMPANY_SIZES),
        description=_text()), minItems=1, maxItems=10),
    education=_list(_record(
        "institution degree field_of_study start_year end_year",
        institution=_text(), degree=_text(), field_of_study=_text(), start_year=_whole(1970, 2030),
        end_year=_whole(1970, 2035), grade={"type": ["string", "null"]}, tier=_text(enum=TIERS)), minItems=0, maxItems=5),
    skills=_list(_record(
        "name proficiency endorsements",
        name=_text(), proficiency=_text(enum=SKILL_LEVELS), endorsements=_whole(0), duration_months=_whole(0)), minItems=0),
    certifications=_list(_record("name issuer year", name=_text(), issuer=_text(), year=_whole())),
    languages=_list(_record("language proficiency", language=_text(), proficiency=_text(enum=LANGUAGE_LEVELS))),
    redrob_signals=_record(
        "profile_completeness_score signup_date last_active_date open_to_work_flag profile_views_received_30d "
        "applications_submitted_30d recruiter_response_rate avg_response_time_hours skill_assessment_scores "
        "connection_count endorsements_received notice_period_days expected_salary_range_inr_lpa preferred_work_mode "
        "willing_to_relocate github_activity_score search_appearance_30d saved_by_recruiters_30d "
        "interview_completion_rate offer_acceptance_rate verified_email verified_phone linkedin_connected",
        profile_completeness_score=_number(0, 100), signup_date=_DAY, last_active_date=_DAY, open_to_work_flag=_YES_NO,
        profile_views_received_30d=_whole(0), applications_submitted_30d=_whole(0), recruiter_response_rate=_number(0, 1),
        avg_response_time_hours=_number(0),
        skill_assessment_scores={"type": "object", "additionalProperties": _number(0, 100)},
        connection_count=_whole(0), endorsements_received=_whole(0), notice_period_days=_whole(0, 180),
        expected_salary_range_inr_lpa=_record("min max", min=_number(0), max=_number(0)),
        preferred_work_mode=_text(enum=WORK_MODES), willing_to_relocate=_YES_NO, github_activity_score=_number(-1, 100),
        search_appearance_30d=_whole(0), saved_by_recruiters_30d=_whole(0), interview_completion_rate=_number(0, 1),
        offer_acceptance_rate=_number(-1, 1), verified_email=_YES_NO, verified_phone=_YES_NO, linkedin_connected=_YES_NO))
