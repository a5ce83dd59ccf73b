"""Weights (paragraph mapping, emphasis, normalisation) against hand-worked goldens."""

import pytest

from critrank.operators import criteria


def _weights(spark, catalog, paragraphs):
    rows = [("jd", i, p) for i, p in enumerate(paragraphs)]
    paras = spark.createDataFrame(rows, "jd_id STRING, para_no INT, text STRING")
    out = criteria.weights(paras, catalog).collect()
    return {r["dim"]: r for r in out}


def test_three_paragraphs(spark, catalog):
    w = _weights(spark, catalog, ["Must know Python and machine learning",
                                  "We own search ranking", "Mumbai"])
    t = w["TECHNICAL_SKILLS"]
    assert (t["n_paragraphs"], t["anchor_hits"], t["emphasis"], t["score"]) == (1, 2, 3, 6)
    assert t["weight"] == pytest.approx(0.545455, abs=1e-6)
    assert w["RANKING_RETRIEVAL"]["weight"] == pytest.approx(0.272727, abs=1e-6)
    assert w["LEADERSHIP"]["weight"] == pytest.approx(0.181818, abs=1e-6)
    assert w["LOCATION"]["n_paragraphs"] == 1 and w["LOCATION"]["weight"] == 0.0
    assert sum(r["weight"] for r in w.values()) == pytest.approx(1.0)


def test_repeated_paragraph_counts_twice(spark, catalog):
    w = _weights(spark, catalog, ["You absolutely need python", "You absolutely need python"])
    t = w["TECHNICAL_SKILLS"]
    assert (t["n_paragraphs"], t["anchor_hits"], t["emphasis"], t["score"]) == (2, 2, 12, 16)
    assert t["weight"] == 1.0


def test_zero_total(spark, catalog):
    w = _weights(spark, catalog, ["Pune or Noida"])
    assert all(r["weight"] == 0.0 for r in w.values())


def test_whitespace_collapse(spark, catalog):
    w = _weights(spark, catalog, ["vector   database", "must  own"])
    assert w["LEADERSHIP"]["score"] == 5
    assert w["LEADERSHIP"]["weight"] == pytest.approx(0.714286, abs=1e-6)
    assert w["RANKING_RETRIEVAL"]["weight"] == pytest.approx(0.285714, abs=1e-6)


def test_dimension_text_keeps_trailing_newline(spark, catalog):
    paras = spark.createDataFrame([("jd", 0, "We own search ranking")],
                                  "jd_id STRING, para_no INT, text STRING")
    rows = {r["dim"]: r for r in criteria.dimension_text(paras, catalog).collect()}
    assert rows["LOCATION"]["text"] == "\n".join(catalog.dimensions[7].anchors) + "\n"
    assert rows["LEADERSHIP"]["text"].endswith("\nWe own search ranking")
    assert rows["LEADERSHIP"]["n_paragraphs"] == 1


def test_bm25_query_keeps_duplicates(catalog):
    q = criteria.bm25_query(catalog)
    assert q["RANKING_RETRIEVAL"].count("retrieval") == 3
    assert "LOCATION" not in q
