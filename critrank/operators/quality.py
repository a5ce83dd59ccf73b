"""Quality jobs that report one row per violation instead of failing.

Ranking validation (L3-L10) over a table of rankings
    (ranking_id, row_num, candidate_id, rank, score, reasoning[, bad_cells]) all STRING
  -> (ranking_id, row_num, rule, detail);  row_num is NULL for table-level rules.

  count           a ranking does not have exactly ``expected`` non-blank rows
  cells           a row does not have four cells; its other checks are skipped
  id_required / id_pattern / id_duplicate        first failing check only
  rank_integer / rank_range / rank_duplicate     strict integer ('01', '+1', '1.0' fail)
  score_float     not a finite decimal/scientific number
  missing_ranks   ranks 1..expected never seen (one row per ranking, listed)
  not_monotonic   score rises between rank-adjacent rows
  tie_order       equal adjacent scores with descending ids
  The adjacency checks use rows with a parsed rank, a parsed score and a
  non-empty id, ordered by (rank, row_num) as a stable sort would.

  Adjacency and repeated ranks follow from a sort by range with a carry over its
  parts, repeated ids, counts and missing ranks from aggregates.

Record conformance (C5): ``schema_violations`` evaluates the candidate JSON
Schema rules (required, pattern, enum, minimum/maximum, minItems/maxItems,
date format) on typed records, as one projection that builds an array of violations
per record, then explodes it: (record_key, path, rule).  ``conformance`` judges raw
JSON by a schema document, types included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from critrank.functions.text import strip
from critrank.session import materialize
from critrank.sources.schemas import COMPANY_SIZES, LANGUAGE_LEVELS, SKILL_LEVELS, TIERS, WORK_MODES

ID_PATTERN = r"^CAND_[0-9]{7}$"
INT_PATTERN = r"^(0|-?[1-9][0-9]*)$"
FLOAT_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _v(ranking: Column, row: Column, rule: str, detail: Column) -> Column:
    return F.struct(ranking.alias("ranking_id"), row.cast("bigint").alias("row_num"),
                    F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def parse_ranking(df: DataFrame) -> DataFrame:
    """Add cid/rank_i/score_d and the per-row flags used by the rules."""
    d = df if "bad_cells" in df.columns else df.withColumn("bad_cells", F.lit(False))
    d = (d.withColumn("cid", strip(F.coalesce("candidate_id", F.lit(""))))
          .withColumn("rank_s", strip(F.coalesce("rank", F.lit(""))))
          .withColumn("score_s", strip(F.coalesce("score", F.lit("")))))
    rank_ok = F.col("rank_s").rlike(INT_PATTERN)
    d = d.withColumn("rank_i", F.when(rank_ok, F.expr("try_cast(rank_s AS BIGINT)")))
    score_ok = F.col("score_s").rlike(FLOAT_PATTERN)
    d = d.withColumn("score_d", F.when(score_ok, F.expr("try_cast(score_s AS DOUBLE)")))
    return d.withColumn("id_ok", F.col("cid").rlike(ID_PATTERN))


def validate_rankings(df: DataFrame, expected: int = 100) -> DataFrame:
    """All rules; a ranking may have any number of rows, and no task needs a whole one.

    Rows are dealt out by range of (ranking, rank, row number) and sorted, so the row
    before is in the same part, or is what the parts before it end with: one row for
    each part is carried over.  Later rows with the same rank follow the first.
    Repeated ids are the rows after the least row number of an id that occurs twice.
    """
    ok = ~F.col("bad_cells")
    in_range = F.col("rank_i").between(1, expected)
    d = (parse_ranking(df)
         .withColumn("in_range", F.coalesce(ok & in_range, F.lit(False)))
         .withColumn("placed", F.coalesce(ok & F.col("rank_i").isNotNull() & F.col("score_d").isNotNull()
                                          & (F.col("cid") != ""), F.lit(False)))
         .select("ranking_id", "row_num", "bad_cells", "cid", "id_ok", "rank_s", "rank_i", "score_s", "score_d",
                 "in_range", "placed"))
    keys = [F.col(c).asc_nulls_first() for c in ("ranking_id", "rank_i", "row_num")]
    d = materialize(d.repartitionByRange(*keys).sortWithinPartitions(*keys)
                    .withColumn("at", F.monotonically_increasing_id()), "ranking-rows").withColumn(
        "part", F.shiftright("at", 33))
    rid, rn = F.col("ranking_id"), F.col("row_num")
    ranked = F.when(F.col("in_range"), F.struct("ranking_id", "rank_i"))
    placed = F.when(F.col("placed"), F.struct("ranking_id", "score_d", "cid"))
    before = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ends = d.groupBy("part").agg(F.max_by(ranked, F.when(F.col("in_range"), F.col("at"))).alias("r"),
                                 F.max_by(placed, F.when(F.col("placed"), F.col("at"))).alias("p"))
    parts_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    carried = ends.select("part", F.last("r", True).over(parts_before).alias("r"),
                          F.last("p", True).over(parts_before).alias("p"))
    rows = (d.withColumn("prev_r", F.last(ranked, True).over(before)).withColumn("prev_p", F.last(placed, True).over(before))
            .join(F.broadcast(carried), "part")  # as many rows as parts
            .withColumn("prev_r", F.coalesce("prev_r", "r")).withColumn("prev_p", F.coalesce("prev_p", "p")))
    same = F.col("prev_p.ranking_id").eqNullSafe(rid)
    rows = (rows.withColumn("prev_s", F.when(same, F.col("prev_p.score_d")))
            .withColumn("prev_c", F.when(same, F.col("prev_p.cid")))
            .withColumn("rank_again", F.col("in_range") & F.coalesce(
                F.col("prev_r.ranking_id").eqNullSafe(rid) & (F.col("prev_r.rank_i") == F.col("rank_i")), F.lit(False))))
    twice = (d.where(ok & F.col("id_ok")).groupBy(rid.alias("_rid"), F.col("cid").alias("_cid"))
             .agg(F.min("row_num").alias("first_row"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    rows = rows.join(twice, rid.eqNullSafe(F.col("_rid")) & (F.col("cid") == F.col("_cid")), "left").withColumn(
        "id_again", F.coalesce(F.col("row_num") > F.col("first_row"), F.lit(False)))
    row_rules = F.array(
        F.when(~ok, _v(rid, rn, "cells", F.lit(""))),
        F.when(ok, F.when(F.col("cid") == "", _v(rid, rn, "id_required", F.lit("")))
               .when(~F.col("id_ok"), _v(rid, rn, "id_pattern", F.col("cid")))
               .when(F.col("id_again"), _v(rid, rn, "id_duplicate", F.col("cid")))),
        F.when(ok, F.when(F.col("rank_i").isNull(), _v(rid, rn, "rank_integer", F.col("rank_s")))
               .when(~in_range, _v(rid, rn, "rank_range", F.col("rank_s")))
               .when(F.col("rank_again"), _v(rid, rn, "rank_duplicate", F.col("rank_s")))),
        F.when(ok & F.col("score_d").isNull(), _v(rid, rn, "score_float", F.col("score_s"))),
        F.when(F.col("placed") & (F.col("prev_s") < F.col("score_d")), _v(rid, rn, "not_monotonic", F.concat_ws(
            " < ", F.col("prev_s").cast("string"), F.col("score_d").cast("string")))),
        F.when(F.col("placed") & (F.col("prev_s") == F.col("score_d")) & (F.col("prev_c") > F.col("cid")),
               _v(rid, rn, "tie_order", F.concat_ws(" > ", F.col("prev_c"), F.col("cid")))))
    per_row = rows.select(F.explode(F.filter(row_rules, lambda x: x.isNotNull())).alias("v"))

    # at most ``expected`` ranks of a ranking are kept
    whole = d.groupBy("ranking_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set(
        F.when(F.col("in_range"), F.col("rank_i"))).alias("seen"))
    absent = F.array_except(F.sequence(F.lit(1), F.lit(expected)).cast("array<bigint>"), "seen")
    table_rules = F.array(
        F.when(F.col("n") != expected, _v(rid, F.lit(None), "count", F.col("n"))),
        F.when(F.size(absent) > 0, _v(rid, F.lit(None), "missing_ranks", F.array_join(absent, ","))))
    per_table = whole.select(F.explode(F.filter(table_rules, lambda x: x.isNotNull())).alias("v"))
    return per_row.unionByName(per_table).select("v.*")


def missing_ranks(df: DataFrame, expected: int = 100) -> DataFrame:
    """(ranking_id, rank) for every rank 1..expected that no valid row carries."""
    d = parse_ranking(df).filter(~F.col("bad_cells"))
    seen = d.filter(F.col("rank_i").between(1, expected)).select(
        "ranking_id", F.col("rank_i").alias("rank")).distinct()
    allr = d.select("ranking_id").distinct().select(
        "ranking_id", F.explode(F.sequence(F.lit(1), F.lit(expected)).cast("array<bigint>")).alias("rank"))
    return allr.join(seen, ["ranking_id", "rank"], "left_anti")


# ----------------------------------------------------------------------------- C5
# FIXED VALUES: constraints of the candidate JSON Schema.
DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"

PROFILE_REQUIRED = ("anonymized_name", "headline", "summary", "location", "country",
                    "years_of_experience", "current_title", "current_company",
                    "current_company_size", "current_industry")
CAREER_REQUIRED = ("company", "title", "start_date", "duration_months", "is_current",
                   "industry", "company_size", "description")  # end_date may be null
EDUCATION_REQUIRED = ("institution", "degree", "field_of_study", "start_year", "end_year")
SKILL_REQUIRED = ("name", "proficiency", "endorsements")
SIGNAL_RANGES = (
    ("profile_completeness_score", 0, 100), ("profile_views_received_30d", 0, None),
    ("applications_submitted_30d", 0, None), ("recruiter_response_rate", 0, 1),
    ("avg_response_time_hours", 0, None), ("connection_count", 0, None),
    ("endorsements_received", 0, None), ("notice_period_days", 0, 180),
    ("github_activity_score", -1, 100), ("search_appearance_30d", 0, None),
    ("saved_by_recruiters_30d", 0, None), ("interview_completion_rate", 0, 1),
    ("offer_acceptance_rate", -1, 1),
)
SIGNAL_REQUIRED = ("profile_completeness_score", "signup_date", "last_active_date",
                   "open_to_work_flag", "profile_views_received_30d", "applications_submitted_30d",
                   "recruiter_response_rate", "avg_response_time_hours", "skill_assessment_scores",
                   "connection_count", "endorsements_received", "notice_period_days",
                   "expected_salary_range_inr_lpa", "preferred_work_mode", "willing_to_relocate",
                   "github_activity_score", "search_appearance_30d", "saved_by_recruiters_30d",
                   "interview_completion_rate", "offer_acceptance_rate", "verified_email",
                   "verified_phone", "linkedin_connected")


def _viol(path: Column | str, rule: str) -> Column:
    p = F.lit(path) if isinstance(path, str) else path
    return F.struct(p.alias("path"), F.lit(rule).alias("rule"))


def _range(c: Column, path, lo, hi) -> list[Column]:
    out = []
    if lo is not None:
        out.append(F.when(c < lo, _viol(path, "minimum")))
    if hi is not None:
        out.append(F.when(c > hi, _viol(path, "maximum")))
    return out


def _enum(c: Column, path, values) -> Column:
    return F.when(c.isNotNull() & ~c.isin(list(values)), _viol(path, "enum"))


def _required(struct_col: Column, fields, prefix) -> list[Column]:
    return [F.when(struct_col[f].isNull(), _viol(f"{prefix}.{f}", "required")) for f in fields]


def _items(arr: str, name: str, checks) -> Column:
    """Flattened violations of every array element; paths carry the index."""
    def per(x, i):
        path = lambda f: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"].{f}"))
        return F.filter(F.array(*checks(x, path)), lambda v: v.isNotNull())
    return F.flatten(F.transform(F.coalesce(F.col(arr), F.array()), per))


def schema_violations(df: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, path, rule) for every violated JSON Schema rule; missing columns count as NULL."""
    cols = set(df.columns)

    def col(name, typ):
        return F.col(name) if name in cols else F.lit(None).cast(typ)
    cid = col("candidate_id", "string")
    prof = col("profile", "struct<x:int>")
    sig = col("redrob_signals", "struct<x:int>")
    top = [F.when(cid.isNull(), _viol("candidate_id", "required")),
           F.when(cid.isNotNull() & ~cid.rlike(ID_PATTERN), _viol("candidate_id", "pattern"))]
    for f in ("profile", "career_history", "education", "skills", "redrob_signals"):
        top.append(F.when(col(f, "string").isNull(), _viol(f, "required")))
    if "profile" in cols:
        top += [F.when(prof.isNotNull(), v) for v in _required(prof, PROFILE_REQUIRED, "profile")]
        top += _range(prof["years_of_experience"], "profile.years_of_experience", 0, 50)
        top.append(_enum(prof["current_company_size"], "profile.current_company_size", COMPANY_SIZES))
    if "career_history" in cols:
        n = F.size(F.col("career_history"))
        top.append(F.when(F.col("career_history").isNotNull() & (n < 1), _viol("career_history", "minItems")))
        top.append(F.when(n > 10, _viol("career_history", "maxItems")))
    if "education" in cols:
        top.append(F.when(F.size(F.col("education")) > 5, _viol("education", "maxItems")))
    if "redrob_signals" in cols:
        top += [F.when(sig.isNotNull(), v) for v in _required(sig, SIGNAL_REQUIRED, "redrob_signals")]
        for f, lo, hi in SIGNAL_RANGES:
            top += _range(sig[f], f"redrob_signals.{f}", lo, hi)
        top.append(_enum(sig["preferred_work_mode"], "redrob_signals.preferred_work_mode", WORK_MODES))
        for f in ("signup_date", "last_active_date"):
            top.append(F.when(sig[f].isNotNull() & ~sig[f].rlike(DATE_PATTERN),
                              _viol(f"redrob_signals.{f}", "format")))
    parts = [F.filter(F.array(*top), lambda v: v.isNotNull())]
    if "career_history" in cols:
        parts.append(_items("career_history", "career_history", lambda x, p: (
            [F.when(x[f].isNull(), _viol(p(f), "required")) for f in CAREER_REQUIRED]
            + [F.when(x["duration_months"] < 0, _viol(p("duration_months"), "minimum")),
               _enum(x["company_size"], p("company_size"), COMPANY_SIZES),
               F.when(x["start_date"].isNotNull() & ~x["start_date"].rlike(DATE_PATTERN),
                      _viol(p("start_date"), "format")),
               F.when(x["end_date"].isNotNull() & ~x["end_date"].rlike(DATE_PATTERN),
                      _viol(p("end_date"), "format"))])))
    if "education" in cols:
        parts.append(_items("education", "education", lambda x, p: (
            [F.when(x[f].isNull(), _viol(p(f), "required")) for f in EDUCATION_REQUIRED]
            + _range(x["start_year"], p("start_year"), 1970, 2030)
            + _range(x["end_year"], p("end_year"), 1970, 2035)
            + [_enum(x["tier"], p("tier"), TIERS)])))
    if "skills" in cols:
        parts.append(_items("skills", "skills", lambda x, p: (
            [F.when(x[f].isNull(), _viol(p(f), "required")) for f in SKILL_REQUIRED]
            + [_enum(x["proficiency"], p("proficiency"), SKILL_LEVELS),
               F.when(x["endorsements"] < 0, _viol(p("endorsements"), "minimum")),
               F.when(x["duration_months"] < 0, _viol(p("duration_months"), "minimum"))])))
    if "languages" in cols:
        parts.append(_items("languages", "languages", lambda x, p: (
            [F.when(x[f].isNull(), _viol(p(f), "required")) for f in ("language", "proficiency")]
            + [_enum(x["proficiency"], p("proficiency"), LANGUAGE_LEVELS)])))
    if "certifications" in cols:
        parts.append(_items("certifications", "certifications", lambda x, p: (
            [F.when(x[f].isNull(), _viol(p(f), "required")) for f in ("name", "issuer", "year")])))
    allv = F.concat(*parts)
    return df.select(F.col(key).alias("record_key"), F.explode(allv).alias("v")).select(
        "record_key", "v.path", "v.rule")
