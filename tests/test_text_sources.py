"""Text expressions, JD parsing, candidate readers and CSV sink/scan."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from critrank.functions import text as tx
from critrank.operators import records
from critrank.sources import io


def candidate(cid, title="AI Engineer", years=6.0, text="ranking", companies=("Acme",),
              open_=True, rate=0.5, tier=None, with_optional=True):
    rec = {
        "candidate_id": cid,
        "profile": {"anonymized_name": "n", "headline": f"{title} headline", "summary": text,
                    "location": "Pune", "country": "IN", "years_of_experience": years,
                    "current_title": title, "current_company": companies[0] if companies else "x",
                    "current_company_size": "11-50", "current_industry": "tech"},
        "career_history": [{"company": c, "title": "Engineer", "start_date": "2020-01-01",
                            "end_date": None, "duration_months": 12, "is_current": True,
                            "industry": "tech", "company_size": "51-200",
                            "description": f"built {text} at {c}"} for c in companies],
        "education": [{"institution": "U", "degree": "BTech", "field_of_study": "CS",
                       "start_year": 2010, "end_year": 2014, "grade": None,
                       **({"tier": tier} if tier else {})}],
        "skills": [{"name": "python", "proficiency": "expert", "endorsements": 3}],
        "redrob_signals": {"open_to_work_flag": open_, "recruiter_response_rate": rate,
                           "signup_date": "2024-01-01", "last_active_date": "2024-02-01"},
    }
    if with_optional:
        rec["certifications"] = []
    return rec


def test_tokens_and_strip(spark):
    df = spark.createDataFrame([("A/B Testing\nC++ ", "  x y\t\n")], "a STRING, b STRING")
    r = df.select(tx.tokens("a").alias("t"), tx.strip(F.col("b")).alias("s"),
                  tx.normalize_ws("b").alias("n")).collect()[0]
    assert r["t"] == ["a", "b", "testing", "c"]
    assert r["s"] == "x y"
    assert r["n"] == " x y "


def test_jd_header(spark):
    rows = [("j1", 0, "Job Description: Senior ML Engineer"), ("j1", 1, "Company:"),
            ("j1", 2, "Acme"), ("j1", 3, "Experience Required: 5–9 years"),
            ("j2", 0, "Backend role"), ("j2", 1, "location: Pune"), ("j2", 2, "Experience Required: 5-9"),
            ("j3", 0, "Nothing here")]
    paras = spark.createDataFrame(rows, "jd_id STRING, para_no INT, text STRING")
    got = {r["jd_id"]: r for r in io.jd_header(paras).collect()}
    assert got["j1"]["title"] == "Senior ML Engineer" and got["j1"]["company"] == "Acme"
    assert (got["j1"]["min_years"], got["j1"]["max_years"]) == (5.0, 9.0)
    assert got["j2"]["title"] == "Backend role" and got["j2"]["location"] == "Pune"
    assert (got["j2"]["min_years"], got["j2"]["max_years"]) == (5.0, 9.0)
    assert got["j3"]["company"] == "" and got["j3"]["min_years"] is None


def test_read_candidates_jsonl_and_json(spark):
    d = tempfile.mkdtemp(prefix="cr-src-")
    a, b = candidate("CAND_0000001"), candidate("CAND_0000002", with_optional=False)
    with open(os.path.join(d, "c.jsonl"), "w") as f:
        f.write(json.dumps(a) + "\n\n" + json.dumps(b) + "\n")
    with open(os.path.join(d, "one.json"), "w") as f:
        json.dump(a, f)
    with open(os.path.join(d, "arr.json"), "w") as f:
        json.dump([a, b], f)
    jl = io.read_candidates(spark, os.path.join(d, "c.jsonl"))
    assert sorted(r["candidate_id"] for r in jl.collect()) == ["CAND_0000001", "CAND_0000002"]
    assert io.read_candidates(spark, os.path.join(d, "one.json")).count() == 1
    assert io.read_candidates(spark, os.path.join(d, "arr.json")).count() == 2
    assert [r["candidate_id"] for r in io.read_candidates(spark, os.path.join(d, "c.jsonl"), limit=1).collect()] \
        == ["CAND_0000001"]


def test_defaults_and_raw_text(spark):
    df = io.from_records(spark, [candidate("CAND_0000001", with_optional=False)])
    d = records.with_defaults(df).collect()[0]
    assert d["education"][0]["tier"] == "unknown"
    assert d["skills"][0]["duration_months"] == 0
    assert d["certifications"] == [] and d["languages"] == []
    raw = df.select(records.raw_text().alias("r")).collect()[0]["r"]
    assert raw == ("AI Engineer headline\nranking\nAI Engineer\npython\nEngineer\n"
                   "built ranking at Acme\nBTech\nCS")
    assert io.from_records(spark, [candidate(f"CAND_{i:07d}") for i in range(150)]).count() == 150
    assert io.from_records(spark, [candidate(f"CAND_{i:07d}") for i in range(5)], limit=2).count() == 2


def test_csv_sink_and_scan_roundtrip(spark):
    ranked = spark.createDataFrame(
        [(1, "CAND_0000002", 1, 0.5000004, "Lead, Search"), (1, "CAND_0000001", 2, 0.5000001, "x")],
        "jd_id INT, doc_id STRING, rank INT, score DOUBLE, reasoning STRING")
    out = tempfile.mkdtemp(prefix="cr-csv-") + "/out"
    io.write_ranking_csv(ranked, out)
    back = io.read_ranking_csv(spark, out + "/jd_id=1")
    rows = sorted(back.collect(), key=lambda r: r["row_num"])
    assert [r["reasoning"] for r in rows] == ["Lead, Search", "x"]
    assert [r["score"] for r in rows] == ["0.500000", "0.500000"]
    assert not any(r["bad_cells"] for r in rows)


def test_read_jd_text(spark):
    d = tempfile.mkdtemp(prefix="cr-jd-")
    with open(os.path.join(d, "jd1.txt"), "w") as f:
        f.write("Job Description: ML Engineer\n\n   \nCompany: Acme\n  must know python  \n")
    p = io.read_jd_text(spark, d)
    rows = sorted((r["para_no"], r["text"]) for r in p.collect())
    assert rows == [(0, "Job Description: ML Engineer"), (3, "Company: Acme"), (4, "must know python")]
    h = io.jd_header(p).collect()[0]
    assert h["title"] == "ML Engineer" and h["company"] == "Acme"


def test_feature_cache(spark):
    d = tempfile.mkdtemp(prefix="cr-idx-")
    docs = spark.createDataFrame([("A", "faiss bm25 ranking"), ("B", "python ranking python")],
                                 "id STRING, text STRING")
    built = []
    t = io.load_or_build(spark, d + "/cache", lambda: built.append(1) or docs)
    t2 = io.load_or_build(spark, d + "/cache", lambda: built.append(1) or docs)
    assert t.count() == t2.count() == 2 and built == [1]


def test_stamped():
    from datetime import datetime
    assert io.stamped("out/ranking.csv", datetime(2025, 1, 31, 9, 45)) == "out/ranking_20250131_094500.csv"
    assert io.stamped("ranking", datetime(2025, 1, 31, 9, 45)) == "ranking_20250131_094500"


def test_header_values_after_blank_paragraphs(spark):
    rows = [(1, n, t) for n, t in enumerate(["", "Engineer", "Company:", "", " ", "", "Acme", "", "Location: Pune"])] + [(2, 0, " ")]
    got = {r["jd_id"]: r for r in io.jd_header(spark.createDataFrame(rows, "jd_id int, para_no long, text string")).collect()}
    assert (got[1]["title"], got[1]["company"], got[1]["location"]) == ("Engineer", "Acme", "Pune")
    assert (got[2]["title"], got[2]["company"], got[2]["min_years"]) == ("", "", None)


def test_encoding_of_ranking_files(spark):
    d = tempfile.mkdtemp(prefix="cr-enc-")
    head = b"candidate_id,rank,score,reasoning\n"
    with open(os.path.join(d, "good.csv"), "wb") as f:
        f.write(b"\xef\xbb\xbf" + head + "CAND_0000001,1,0.5,\u00e9t\u00e9\n".encode())
    with open(os.path.join(d, "bad.csv"), "wb") as f:
        f.write(head + b"CAND_0000001,1,0.5,x\n" * 48 + b"CAND_0000001,1,0.5,\xff\n")
    with open(os.path.join(d, "long.csv"), "wb") as f:
        f.write("\u00e9".encode() * 5000 + b"\n")
    v = {(os.path.basename(r["path"]), r["rule"], r["detail"][:3]) for r in io.check_ranking_files(spark, d).collect()}
    assert v == {("bad.csv", "encoding", "50"), ("long.csv", "header", "\u00e9\u00e9\u00e9")}


def test_ranking_file_checks(spark):
    d = tempfile.mkdtemp(prefix="cr-files-")
    with open(os.path.join(d, "team.csv"), "w") as f:
        f.write("candidate_id,rank,score,reasoning\nCAND_0000001,1,0.5,x\n")
    with open(os.path.join(d, "bad.txt"), "w") as f:
        f.write("id,rank,score\n")
    open(os.path.join(d, "empty.csv"), "w").close()
    v = {(os.path.basename(r["path"]), r["rule"]) for r in io.check_ranking_files(spark, d).collect()}
    assert v == {("bad.txt", "suffix"), ("bad.txt", "header"), ("empty.csv", "empty")}


def test_result_json(spark, catalog):
    from critrank.operators import explain
    n = len(catalog.dimensions)
    df = spark.createDataFrame([("c1", [0.1] * n, [0.2] * n, [0.3] * n, [0.4] * n, [None] * n, [0.5] * n)],
                               "id STRING, e ARRAY<DOUBLE>, b ARRAY<DOUBLE>, s ARRAY<DOUBLE>, f ARRAY<DOUBLE>, "
                               "c ARRAY<DOUBLE>, x ARRAY<DOUBLE>")
    from pyspark.sql import functions as F
    rec = df.select("id", explain.result_record(catalog, F.col("e"), F.col("b"), F.col("s"), F.col("f"),
                                                F.col("c"), None, F.col("x")).alias("dimension_scores"))
    out = tempfile.mkdtemp(prefix="cr-json-") + "/r"
    io.write_results_json(rec, out)
    back = spark.read.json(out).collect()[0]
    t = back["dimension_scores"]["TECHNICAL_SKILLS"]
    assert (t["bm25_score"], t["cross_encoder_score"], t["final_score"]) == (0.2, 0.0, 0.5)


def test_write_embeddings_half_precision(spark):
    d = tempfile.mkdtemp(prefix="cr-emb-") + "/e"
    df = spark.createDataFrame([(1, [0.1, 0.2, 0.70710678]), (2, None)], "doc_id INT, vec ARRAY<DOUBLE>")
    io.write_embeddings(df, d)
    got = {r["doc_id"]: r["embedding"] for r in spark.read.parquet(d).collect()}
    assert got[2] is None
    import numpy as np
    exp = np.asarray([0.1, 0.2, 0.70710678], dtype=np.float16).astype(np.float32)
    assert [float(x) for x in got[1]] == [float(x) for x in exp]


def test_weights_report_order(spark, catalog):
    from critrank.operators import criteria
    paras = spark.createDataFrame([("jd", 0, "Must know Python and machine learning"),
                                   ("jd", 1, "We own search ranking")], "jd_id STRING, para_no INT, text STRING")
    dims = [r["dim"] for r in criteria.weights_report(paras, catalog).collect()]
    assert dims[:3] == ["TECHNICAL_SKILLS", "RANKING_RETRIEVAL", "LEADERSHIP"]
    assert dims[3:] == [d for d in catalog.names if d not in dims[:3]]


def test_ranking_csv_survives_quotes_and_lines(spark, tmp_path):
    import csv
    import glob
    reasons = ['Sr "ML" Eng, x', "plain", "two\nlines, and a comma", 'back\\slash "quoted"']
    df = spark.createDataFrame([("jd", i, i + 1, 1.0 / (i + 1), r) for i, r in enumerate(reasons)],
                               "jd_id string, doc_id long, rank int, score double, reasoning string")
    io.write_ranking_csv(df, str(tmp_path / "out"))
    files = glob.glob(str(tmp_path / "out" / "*" / "*.csv"))
    rows = [r for f in files for r in list(csv.reader(open(f, newline="")))[1:]]
    assert [r[3] for r in rows] == reasons and all(len(r) == 4 for r in rows)
    back = io.read_ranking_csv(spark, str(tmp_path / "out" / "*")).collect()
    assert [r.reasoning for r in sorted(back, key=lambda r: int(r["rank"]))] == reasons
    assert not any(r.bad_cells for r in back)
    assert io.check_ranking_files(spark, str(tmp_path / "out")).where("rule = 'header'").count() == 0


def test_file_check_reports_headers_and_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"candidate_id,rank,score\n")
    (tmp_path / "b.csv").write_bytes(b"\xff\xfe\x00candidate_id\n")
    (tmp_path / "c.csv").write_bytes(b"candidate_id,rank,score,reasoning\r\nCAND_0000001,1,0.5,r\r\n")
    (tmp_path / "d.csv").write_bytes(b"")
    (tmp_path / "e.txt").write_bytes(b'"candidate_id","rank","score","reasoning"\n')
    got = {(r.path.rsplit("/", 1)[1], r.rule) for r in io.check_ranking_files(spark, str(tmp_path)).collect()}
    assert got == {("a.csv", "header"), ("b.csv", "header"), ("d.csv", "empty"), ("e.txt", "suffix")}


def test_experience_with_no_break_spaces(spark):
    from critrank.functions import text as tx
    from pyspark.sql import functions as F
    lo, hi = tx.jd_experience(F.col("t"))
    df = spark.createDataFrame([("Experience Required: 5 – 9 years",), ("experience required: 2-3",), ("no",)], "t string")
    assert [tuple(r) for r in df.select(lo, hi).collect()] == [(5.0, 9.0), (2.0, 3.0), (None, None)]


def test_stored_table_is_never_overwritten(spark, tmp_path):
    import pytest
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part.parquet").write_bytes(b"")
    (tmp_path / "t" / "x").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        io.load_or_build(spark, str(tmp_path / "t"), lambda: spark.range(3)).count()
    assert (tmp_path / "t" / "x").exists()
    new = str(tmp_path / "new")
    assert io.load_or_build(spark, new, lambda: spark.range(3)).count() == 3
    assert io.load_or_build(spark, new, lambda: spark.range(9)).count() == 3


def test_get_spark_leaves_a_session_alone(spark):
    from critrank.session import get_spark
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        again = get_spark("local[2]", shuffle_partitions=77)
        assert again.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
        assert again.conf.get("spark.sql.shuffle.partitions") != "77"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_temporary_tables_go_at_the_end(spark):
    import os
    from critrank.session import materialize, temporary_tables
    with temporary_tables(spark):
        with temporary_tables(spark):
            inner = materialize(spark.range(3), "inner").inputFiles()[0].removeprefix("file://")
            kept = materialize(spark.range(3), "kept", outlives=True)
            assert os.path.exists(inner)
        assert not os.path.exists(inner) and kept.count() == 3
        path = kept.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(path)


def test_a_jd_of_blank_text_has_zero_weights(spark, probe, tmp_path):
    from critrank.operators import criteria
    (tmp_path / "blank.txt").write_text(" \n\n")
    (tmp_path / "full.txt").write_text("You must know things\n")
    rows = criteria.weight_vectors(io.read_jd_text(spark, str(tmp_path), keep_blank=True), probe).collect()
    assert len(rows) == 2 and any(r.jd_id.endswith("blank.txt") and not any(r["weights"]) for r in rows)


def test_header_values_over_several_paragraphs(spark):
    rows = [(1, 0, "Job Description: A"), (1, 1, "Company:"), (1, 2, "Acme"), (1, 3, "Experience Required:"),
            (1, 4, "5"), (1, 5, "- 9 years"), (1, 6, "Company: other"), (2, 0, "B"), (2, 7, "location: Here"),
            (2, 9, "Experience Required: several"), (2, 11, "Experience Required: 2-4"), (3, 0, "Company:")]
    got = {r.jd_id: r for r in io.jd_header(spark.createDataFrame(rows, "jd_id long, para_no long, text string")).collect()}
    assert (got[1].title, got[1].company, got[1].min_years, got[1].max_years) == ("A", "Acme", 5.0, 9.0)
    assert (got[2].title, got[2].location, got[2].min_years) == ("B", "Here", 2.0)
    assert (got[3].title, got[3].company, got[3].location) == ("Company:", "", "")


def test_nested_results_are_written_compressed(spark, monkeypatch):
    """Records repeat all field names: as plain text they took nine times the input."""
    import glob
    import os

    from critrank.plans import registry
    from critrank.session import ensure_checkpoint_dir
    fields = ("source_score", "embedding_score", "bm25_score", "structured_score", "cross_encoder_score",
              "confidence_score", "final_score")
    scores = ", ".join(f"'dim{d}', struct({', '.join(f'id * {d} / 7.0D as {f}' for f in fields)})" for d in range(9))
    rows = spark.range(2000).selectExpr("id % 20 as jd_id", "id as candidate_id", "1 as rank", "0.5 as final_score",
                                        "'r' as reasoning", f"map({scores}) as dimension_scores")
    monkeypatch.setattr(registry, "_results", lambda *a: rows)
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{top}/critrank-results-*"))
    out = registry.q_result_nested(spark, "").collect()
    (path,) = set(glob.glob(f"{top}/critrank-results-*")) - before
    size = sum(os.path.getsize(f) for f in glob.glob(f"{path}/part-*"))
    assert size < sum(len(r.dimension_scores) for r in out) / 4
    assert sorted(r.doc_id for r in out) == list(range(2000))
    assert all(r.dimension_scores.startswith('{"dim0":{"source_score":"0.000000"') for r in out)
