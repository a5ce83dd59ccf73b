"""Projections over nested candidate records (row-local, no shuffle).

* ``with_defaults`` (B1): education tier 'unknown', skill duration 0,
  certifications/languages empty when absent.
* ``raw_text`` (B2): headline, summary, current title, every skill name, then
  per job (title, description), then per education (degree, field), joined
  by newlines.  Certifications, languages, company and location are not part
  of it.  NULL parts are skipped.
* ``lower_text`` (B3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_defaults(df: DataFrame) -> DataFrame:
    edu = F.transform(F.coalesce(F.col("education"), F.array()), lambda e: F.struct(
        e["institution"].alias("institution"), e["degree"].alias("degree"),
        e["field_of_study"].alias("field_of_study"), e["start_year"].alias("start_year"),
        e["end_year"].alias("end_year"), e["grade"].alias("grade"),
        F.coalesce(e["tier"], F.lit("unknown")).alias("tier")))
    skills = F.transform(F.col("skills"), lambda s: F.struct(
        s["name"].alias("name"), s["proficiency"].alias("proficiency"),
        s["endorsements"].alias("endorsements"),
        F.coalesce(s["duration_months"], F.lit(0)).alias("duration_months")))
    cert_t = "array<struct<name:string,issuer:string,year:int>>"
    lang_t = "array<struct<language:string,proficiency:string>>"
    return (df.withColumn("education", edu).withColumn("skills", skills)
            .withColumn("certifications",
                        F.coalesce(F.col("certifications"), F.array().cast(cert_t)))
            .withColumn("languages", F.coalesce(F.col("languages"), F.array().cast(lang_t))))


def raw_text(profile: str = "profile", skills: str = "skills", career: str = "career_history",
             education: str = "education") -> Column:
    p = F.col(profile)
    sk = F.transform(F.coalesce(F.col(skills), F.array()), lambda s: s["name"])
    jobs = F.flatten(F.transform(F.coalesce(F.col(career), F.array()),
                                 lambda c: F.array(c["title"], c["description"])))
    edu = F.flatten(F.transform(F.coalesce(F.col(education), F.array()),
                                lambda e: F.array(e["degree"], e["field_of_study"])))
    return F.concat_ws("\n", p["headline"], p["summary"], p["current_title"], sk, jobs, edu)


def lower_text(raw: Column) -> Column:
    return F.lower(raw)


def to_candidates(df: DataFrame) -> DataFrame:
    """Nested candidate records -> the ranking's flat candidate columns.

    doc_id = candidate_id, text = raw_text, years, employers (career companies),
    title, open_to_work and response_rate from the signals.
    """
    cols = set(df.columns)
    sig = F.col("redrob_signals") if "redrob_signals" in cols else F.lit(None).cast(
        "struct<open_to_work_flag:boolean,recruiter_response_rate:double>")
    return df.select(
        F.col("candidate_id").alias("doc_id"), raw_text().alias("text"),
        F.col("profile.years_of_experience").cast("double").alias("years"),
        F.transform(F.coalesce(F.col("career_history"), F.array()), lambda c: c["company"]).alias("employers"),
        F.col("profile.current_title").alias("title"),
        F.coalesce(sig["open_to_work_flag"], F.lit(False)).alias("open_to_work"),
        sig["recruiter_response_rate"].cast("double").alias("response_rate"))
