"""Nested candidate records derived from the driver's ``documents`` table.

The driver has no nested candidate data, so each document is turned into a
record of the candidate shape *per row* (no grouping, so no group can grow
with the data): lines of the text become career entries, words of the first
line become skills, language and source fill profile and education fields.
Some fields are deliberately left NULL so the defaults (B1) and the
conformance rules (C5) have work to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critrank.plans.tables import read


def nested_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    lines = F.split(F.col("text"), "\n")
    first_words = F.filter(F.split(lines[0], " "), lambda w: w != "")
    skills = F.transform(first_words, lambda w, i: F.struct(
        w.alias("name"),
        F.element_at(F.array(*[F.lit(x) for x in
                               ("beginner", "intermediate", "advanced", "expert", "guru")]),
                     (i % 5) + 1).alias("proficiency"),
        F.length(w).alias("endorsements"),
        F.when(i % 2 == 0, i * 6).alias("duration_months")))
    career = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda l, i: F.struct(
        F.col("source").alias("company"),
        F.concat(F.lit("role "), i.cast("string")).alias("title"),
        F.lit("2020-01-01").alias("start_date"),
        F.when(i > 0, F.lit("2021-01-01")).alias("end_date"),
        (F.length(l) % 40).alias("duration_months"),
        (i == 0).alias("is_current"),
        F.col("lang").alias("industry"),
        F.element_at(F.array(*[F.lit(x) for x in ("1-10", "11-50", "51-200", "huge")]),
                     (i % 4) + 1).alias("company_size"),
        l.alias("description")))
    education = F.array(F.struct(
        F.col("source").alias("institution"), F.col("lang").alias("degree"),
        F.col("source").alias("field_of_study"),
        (F.lit(1965) + (F.col("doc_id") % 70)).cast("int").alias("start_year"),
        (F.lit(1970) + (F.col("doc_id") % 70)).cast("int").alias("end_year"),
        F.lit(None).cast("string").alias("grade"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("tier_1")).alias("tier")))
    cid = F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit("CAND_"), F.col("doc_id").cast("string")))\
        .otherwise(F.concat(F.lit("CAND_"), F.when(F.length(F.col("doc_id").cast("string")) < 7, F.lpad(
            F.col("doc_id").cast("string"), 7, "0")).otherwise(F.col("doc_id").cast("string"))))
    profile = F.struct(
        F.col("source").alias("anonymized_name"), lines[0].alias("headline"),
        F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("summary"),
        F.col("lang").alias("location"), F.col("lang").alias("country"),
        (F.col("n_chars") / 500.0).alias("years_of_experience"),
        F.col("source").alias("current_title"), F.col("source").alias("current_company"),
        F.lit("11-50").alias("current_company_size"), F.col("lang").alias("current_industry"))
    return d.select(
        F.col("doc_id"), cid.alias("candidate_id"), profile.alias("profile"),
        career.alias("career_history"), education.alias("education"),
        skills.alias("skills"),
        F.lit(None).cast("array<struct<name:string,issuer:string,year:int>>").alias("certifications"),
        F.lit(None).cast("array<struct<language:string,proficiency:string>>").alias("languages"))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, record): the nested records as JSON texts with signals, some of them broken.

    Nulls are written out, so a missing tier is a null of the wrong type; text surgery
    makes values of a wrong type, a missing salary end, and texts that aren't JSON.
    """
    k = F.col("doc_id")
    d = nested_candidates(spark, sf_dir).join(
        read(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), F.col("n_chars").alias("_n")),
        F.col("doc_id") == F.col("_id"))
    lit = F.lit
    signals = F.struct(
        (k % 105).alias("profile_completeness_score"), lit("2020-01-01").alias("signup_date"),
        F.when(k % 19 == 3, "2020-13-01").otherwise("2020-12-01").alias("last_active_date"),
        lit(True).alias("open_to_work_flag"), F.when(k % 29 == 5, -1).otherwise(k % 10).alias("profile_views_received_30d"),
        lit(1).alias("applications_submitted_30d"), lit(0.5).alias("recruiter_response_rate"),
        lit(2.5).alias("avg_response_time_hours"),
        F.create_map(lit("a"), F.col("_n") % 130, lit("b b"), lit(50).cast("bigint")).alias("skill_assessment_scores"),
        F.when(k % 31 == 4, 1.5).otherwise(3.0).alias("connection_count"), lit(1).alias("endorsements_received"),
        (k % 200).alias("notice_period_days"),
        F.struct(F.when(k % 7 == 0, -1.0).otherwise(5.0).alias("min"),
                 F.when(k % 5 != 2, 9.0).alias("max")).alias("expected_salary_range_inr_lpa"),
        F.when(k % 13 == 6, "moon").otherwise("remote").alias("preferred_work_mode"), lit(True).alias("willing_to_relocate"),
        lit(-1).alias("github_activity_score"), lit(0).alias("search_appearance_30d"), lit(0).alias("saved_by_recruiters_30d"),
        lit(0.5).alias("interview_completion_rate"), lit(-1).alias("offer_acceptance_rate"),
        lit(True).alias("verified_email"), lit(True).alias("verified_phone"), lit(True).alias("linkedin_connected"))
    whole = F.to_json(F.struct("candidate_id", "profile", "career_history", "education", "skills",
                               signals.alias("redrob_signals")), {"ignoreNullFields": "false"})
    text = F.replace(whole, lit(',"max":null'), lit(""))
    text = F.when(k % 17 == 2, F.replace(text, lit('"verified_email":true'), lit('"verified_email":"yes"'))).otherwise(text)
    text = F.when(k % 37 == 1, F.replace(text, lit('"verified_phone":true'), lit('"verified_phone":null'))).otherwise(text)
    text = F.when(k % 23 == 6, F.substring(text, lit(1), F.length(text) - 1)).otherwise(text)
    return d.select("doc_id", text.alias("record"))
