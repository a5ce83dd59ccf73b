"""Schema documents compiled to expressions, judged on raw JSON."""

import json
import tempfile

from critrank.operators.conformance import conformance, read_raw_records
from critrank.operators import quality
from critrank.sources.schemas import CANDIDATE_JSON_SCHEMA

from test_quality import _good, _ranking


def judge(spark, records, schema):
    df = spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)],
                               "k long, record string")
    out = {}
    for r in conformance(df, "k", "record", schema).collect():
        out.setdefault(r["record_key"], set()).add((r["path"], r["rule"]))
    return out


SCHEMA = {"type": "object", "required": ["a"], "properties": {
    "a": {"type": ["integer", "null"], "minimum": 0, "maximum": 9},
    "b": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "required": ["c"], "properties": {
        "c": {"type": "string", "pattern": "^x", "enum": ["x1", "y"]}}}},
    "d": {"type": "string", "format": "date"},
    "m": {"type": "object", "properties": {"k": {"type": "boolean"}}, "additionalProperties": {"type": "number", "maximum": 5}}}}


def test_keywords(spark):
    got = judge(spark, [
        {"a": 1}, {}, {"a": None}, {"a": 1.0}, {"a": 1.5}, {"a": "1"}, {"a": -1}, {"a": 10}, [], "nope", None, "", {"a": True},
        {"a": 1, "b": []}, {"a": 1, "b": [{"c": "x1"}, {"c": "z"}, {}]}, {"a": 1, "b": "text"}, {"a": 1, "b": [3, {"c": None}]},
        {"a": 1, "d": "2020-02-30"}, {"a": 1, "d": "2020-2-1"}, {"a": 1, "d": 5}, {"a": 1, "d": "2024-02-29"},
        {"a": 1, "m": {"k": 1, "z": 6, "y": "s", "w": 2.5}}, {"a": 99999999999999999999}, {"a": 1e300}], SCHEMA)
    assert got == {
        1: {("a", "required")}, 4: {("a", "type")}, 5: {("a", "type")}, 6: {("a", "minimum")}, 7: {("a", "maximum")},
        8: {("", "type")}, 9: {("", "json")}, 11: {("", "json")}, 12: {("a", "type")}, 13: {("b", "minItems")},
        14: {("b", "maxItems"), ("b[1].c", "pattern"), ("b[1].c", "enum"), ("b[2].c", "required")}, 15: {("b", "type")},
        16: {("b[0]", "type"), ("b[1].c", "type"), ("b[1].c", "enum")}, 17: {("d", "format")}, 18: {("d", "format")},
        19: {("d", "type")}, 21: {("m.k", "type"), ("m.z", "maximum"), ("m.y", "type")}, 22: {("a", "maximum")},
        23: {("a", "maximum")}}


def test_the_candidate_schema(spark):
    signals = {"profile_completeness_score": 80, "signup_date": "2020-01-01", "last_active_date": "2020-01-01",
               "open_to_work_flag": True, "profile_views_received_30d": 1, "applications_submitted_30d": 1,
               "recruiter_response_rate": 0.5, "avg_response_time_hours": 2, "skill_assessment_scores": {"a": 90.5},
               "connection_count": 1, "endorsements_received": 1, "notice_period_days": 30,
               "expected_salary_range_inr_lpa": {"min": 5, "max": 9}, "preferred_work_mode": "remote",
               "willing_to_relocate": True, "github_activity_score": -1, "search_appearance_30d": 1,
               "saved_by_recruiters_30d": 1, "interview_completion_rate": 1, "offer_acceptance_rate": -1,
               "verified_email": True, "verified_phone": False, "linkedin_connected": True}
    good = {"candidate_id": "CAND_0000001", "profile": {
        "anonymized_name": "a", "headline": "b", "summary": "c", "location": "d", "country": "e", "years_of_experience": 5,
        "current_title": "f", "current_company": "g", "current_company_size": "1-10", "current_industry": "h"},
        "career_history": [{"company": "a", "title": "b", "start_date": "2020-01-01", "end_date": None, "duration_months": 3,
                            "is_current": True, "industry": "c", "company_size": "11-50", "description": "d"}],
        "education": [], "skills": [{"name": "a", "proficiency": "expert", "endorsements": 0}], "redrob_signals": signals}

    def broken(**more):
        return good | {"redrob_signals": signals | more}
    got = judge(spark, [good, broken(skill_assessment_scores={"a": 101, "b": "x", "c": -1}),
                        broken(expected_salary_range_inr_lpa={"min": -1}), broken(expected_salary_range_inr_lpa={"min": "1", "max": 2}),
                        good | {"career_history": [], "languages": [{"language": "a", "proficiency": "fluent"}]}], CANDIDATE_JSON_SCHEMA)
    s = "redrob_signals.skill_assessment_scores"
    e = "redrob_signals.expected_salary_range_inr_lpa"
    assert got == {1: {(s + ".a", "maximum"), (s + ".b", "type"), (s + ".c", "minimum")},
                   2: {(e + ".min", "minimum"), (e + ".max", "required")}, 3: {(e + ".min", "type")},
                   4: {("career_history", "minItems"), ("languages[0].proficiency", "enum")}}


def test_raw_readers(spark):
    d = tempfile.mkdtemp(prefix="cr-raw-")
    for name, text in (("a.jsonl", '{"a": 1}\n\n  \n{"a": "x"}\nbroken\n'), ("b.json", '[{"a": 1},\n {"a": "x"}]'), ("c.json", '{"a":\n 1}')):
        with open(f"{d}/{name}", "w") as f:
            f.write(text)
    found = {n: read_raw_records(spark, f"{d}/{n}") for n in ("a.jsonl", "b.json", "c.json")}
    assert {n: df.count() for n, df in found.items()} == {"a.jsonl": 3, "b.json": 2, "c.json": 1}
    rules = [sorted((r["path"], r["rule"]) for r in conformance(df, "source", "record", SCHEMA).collect()) for df in found.values()]
    assert rules == [[("", "json"), ("a", "type")], [("a", "type")], []]


def test_rankings_over_many_parts(spark):
    """The same violations however the rows are dealt out; ties and rises across parts are seen."""
    rows = [(f"CAND_{i:07d}", str(i), f"{2000 - i}") for i in range(1, 1501)]
    rows[700] = ("CAND_0000001", "701", rows[700][2])           # an id again
    rows[900] = (rows[900][0], "900", rows[900][2])             # a rank again, 901 is missing
    rows[1100] = (rows[1100][0], rows[1100][1], rows[1098][2])  # rises above the row before
    rows[1300] = ("CAND_0000005", "1301", rows[1299][2])        # ties, and a repeated, smaller id
    df = _ranking(spark, rows)
    want = {(702, "id_duplicate"), (902, "rank_duplicate"), (1102, "not_monotonic"), (1302, "id_duplicate"), (1302, "tie_order"),
            (None, "missing_ranks")}
    for parts in (1, 4, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            got = quality.validate_rankings(df.repartition(3), expected=1500).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert {(r["row_num"], r["rule"]) for r in got} == want and len(got) == len(want)
    both = df.unionByName(_ranking(spark, _good()).selectExpr("cast(null as string) ranking_id", "row_num", "candidate_id", "rank", "score", "reasoning"))
    got = quality.validate_rankings(both, expected=1500).collect()
    assert {(r["ranking_id"], r["rule"]) for r in got if r["ranking_id"] is None} == {(None, "count"), (None, "missing_ranks")}
