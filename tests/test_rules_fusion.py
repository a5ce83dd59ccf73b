"""Rule scores, confidence, min-max, blend and reasons against hand-worked goldens."""

import pytest
from pyspark.sql import functions as F

from critrank.operators import explain, fusion, rerank, rules

ALL_TERMS = ("ranking retrieval search recommendation system embeddings vector database faiss "
             "pinecone qdrant milvus weaviate elasticsearch opensearch bm25 production deployed "
             "real users scale pipeline ndcg mrr map a/b testing ab testing offline benchmark "
             "evaluation framework")

RULE_CASES = [
    ("R1", "Roadmap research upscale", 5.0, ["TCS"], (0.1, 0.35, 0.25, 0.2)),
    ("R2", "recommendation system", 4.9, ["Google"], (0.2, 0.0, 0.0, 0.5)),
    ("R3", "", 5.0, [], (0.0, 0.2, 0.0, 0.7)),
    ("R4", "", 0.0, ["TCS Ltd"], (0.0, 0.0, 0.0, 0.5)),
    ("R5", ALL_TERMS, 6.0, ["A", "Wipro"], (1.0, 0.95, 1.0, 0.2)),
    ("R6", "OpenSearch A/B Testing pipeline deployed", 10.0, ["Acme", "Beta"], (0.2, 0.5, 0.25, 0.7)),
]


def test_rule_goldens(spark, catalog):
    df = spark.createDataFrame([(a, b, c, d) for a, b, c, d, _ in RULE_CASES],
                               "doc_id STRING, text STRING, years DOUBLE, employers ARRAY<STRING>")
    out = {r["doc_id"]: r for r in rules.with_rule_scores(df, catalog, evidence=True).collect()}
    dims = ["RANKING_RETRIEVAL", "PRODUCTION_EXPERIENCE", "EVALUATION_FRAMEWORKS", "PRODUCT_MINDSET"]
    for cid, *_, exp in RULE_CASES:
        got = tuple(round(out[cid][f"rule__{d}"], 6) for d in dims)
        assert got == pytest.approx(exp), cid
    assert out["R1"]["evidence__RANKING_RETRIEVAL"] == ["search"]
    assert out["R3"]["evidence__PRODUCT_MINDSET"] == ["product company experience", "senior engineer"]
    assert out["R6"]["evidence__PRODUCTION_EXPERIENCE"] == ["5+ years experience", "deployed", "pipeline"]


def test_none_of_null_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("b", []), ("c", ["Infosys"])], "id STRING, e ARRAY<STRING>")
    got = {r["id"]: r["ok"] for r in df.select("id", rules.none_of(F.col("e"), ("infosys",)).alias("ok")).collect()}
    assert got == {"a": True, "b": True, "c": False}


@pytest.mark.parametrize("src,exp", [
    ((0.0, 0.0, 0.0), (0.0, 0.0, 0.0)),
    ((0.5, 0.0, 0.0), (1.0, 0.333333, 0.577350)),
    ((0.3, 0.9, -1.0), (0.548812, 0.666667, 0.448103)),
    ((0.2, 0.4, 0.6), (0.721373, 1.0, 0.721373)),
])
def test_confidence(spark, src, exp):
    df = spark.createDataFrame([src], "e DOUBLE, b DOUBLE, s DOUBLE")
    r = df.select(fusion.confidence(F.col("e"), F.col("b"), F.col("s")).alias("c")).collect()[0]["c"]
    assert (r["agreement"], r["coverage"], r["value"]) == pytest.approx(exp, abs=1e-6)


def test_minmax(spark):
    df = spark.createDataFrame([("g", 1, 2.0), ("g", 2, 4.0), ("g", 3, 3.0), ("h", 1, 7.0), ("h", 2, 7.0)],
                               "g STRING, i INT, v DOUBLE")
    got = {(r["g"], r["i"]): r["n"] for r in rerank.minmax(df, ["g"], "v", "n").collect()}
    assert got == {("g", 1): 0.0, ("g", 2): 1.0, ("g", 3): 0.5, ("h", 1): 0.0, ("h", 2): 0.0}


def test_minmax_invariant_to_positive_scaling(spark):
    rows = [("g", i, float(v)) for i, v in enumerate([3, 9, 1, 4, 4])]
    df = spark.createDataFrame(rows, "g STRING, i INT, v DOUBLE")
    a = {r["i"]: r["n"] for r in rerank.minmax(df, ["g"], "v", "n").collect()}
    b = {r["i"]: r["n"] for r in rerank.minmax(df.withColumn("v", F.col("v") * 7.5 + 2), ["g"], "v", "n").collect()}
    assert a == pytest.approx(b)


def test_blend_and_final(spark, catalog):
    n = len(catalog.dimensions)
    s1 = [0.1 * (i + 1) for i in range(n)]
    ce = [None if catalog.pair_query(d.name) is None else 1.0 for d in catalog.dimensions]
    df = spark.createDataFrame([(s1, ce)], "s ARRAY<DOUBLE>, c ARRAY<DOUBLE>")
    b = df.select(fusion.blend(F.col("s"), F.col("c"), catalog).alias("b")).collect()[0]["b"]
    for i, d in enumerate(catalog.dimensions):
        if catalog.pair_query(d.name) is None:
            assert b[i] == pytest.approx(s1[i])
        else:
            wc = catalog.blend_weight(d.name)
            assert b[i] == pytest.approx(wc * 1.0 + (1 - wc) * s1[i])
    w = [1.0 / n] * n
    df2 = spark.createDataFrame([(w, b)], "w ARRAY<DOUBLE>, v ARRAY<DOUBLE>")
    r = df2.select(fusion.weighted_sum(F.col("w"), F.col("v"), n).alias("a"),
                   fusion.weighted_sum(F.col("w"), F.col("v")).alias("b")).collect()[0]
    seq = 0.0
    for x, y in zip(w, b):
        seq += x * y
    assert r["a"] == seq and r["b"] == seq


def test_reason_golden(spark, catalog):
    n = len(catalog.dimensions)
    scores = [0.0] * n
    scores[catalog.ordinal("RANKING_RETRIEVAL")] = 0.9
    scores[catalog.ordinal("PRODUCT_MINDSET")] = 0.8
    scores[catalog.ordinal("LOCATION")] = 5.0  # unlabelled: never named
    df = spark.createDataFrame([("AI Engineer", 16.9, scores, True, 0.72)],
                               "t STRING, y DOUBLE, s ARRAY<DOUBLE>, o BOOLEAN, r DOUBLE")
    labels = explain.top_dims(F.col("s"), catalog)
    got = df.select(explain.reason(F.col("t"), F.col("y"), labels, F.col("o"), F.col("r")).alias("x")).collect()[0]["x"]
    assert got == ("AI Engineer with 16.9 years experience. Strong ranking/retrieval and product mindset. "
                   "Open to work. Recruiter response rate 0.72.")
    df2 = spark.createDataFrame([("X", 3.0, [0.0] * n, False, -1.0)],
                                "t STRING, y DOUBLE, s ARRAY<DOUBLE>, o BOOLEAN, r DOUBLE")
    labels2 = explain.top_dims(F.col("s"), catalog)
    got2 = df2.select(explain.reason(F.col("t"), F.col("y"), labels2, F.col("o"), F.col("r")).alias("x"),
                      labels2.alias("l")).collect()[0]
    # all tied: template order decides; no rate when it is the -1 sentinel
    assert got2["l"] == ["technical skills", "ranking/retrieval"]
    assert got2["x"] == "X with 3.0 years experience. Strong technical skills and ranking/retrieval."
