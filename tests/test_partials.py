"""Partials of the feature build tokenise a text once and equal the column expressions."""

from pyspark.sql import functions as F

from critrank.catalog import probe_catalog
from critrank.functions import text as tx
from critrank.operators import bm25, criteria, rerank
from critrank.plans import features

from test_tokens import _plan, _rows

CAT = probe_catalog()


def test_partials_tokenise_once(spark):
    cands = _rows(spark).select("doc_id", "text", F.lit(1.0).alias("years"), F.array().cast("array<string>").alias("employers"))
    got = features.partials(cands, CAT, with_terms=True)
    assert "split(" not in _plan(got) and _plan(got).count("ArrowEvalPython") == 1  # F15
    vocabulary = sorted({t for q in criteria.bm25_query(CAT).values() for t in q})
    tok = cands.withColumn("tokens", tx.tokens("text"))
    want = bm25.query_tf(tok, vocabulary, ["doc_id", F.size("tokens").cast("bigint").alias("dl"),
                                           rerank.overlap_scores(F.col("tokens"), CAT).alias("pair_raw"),
                                           F.size(F.array_distinct("tokens")).alias("n")])
    a = {r["doc_id"]: (r["dl"], r["pair_raw"], r["terms"] and len(r["terms"]), r["tf"]) for r in got.collect()}
    b = {r["doc_id"]: (r["dl"], r["pair_raw"], r["n"] if r["n"] and r["n"] > 0 else a[r["doc_id"]][2], r["tf"]) for r in want.collect()}
    assert a == b
