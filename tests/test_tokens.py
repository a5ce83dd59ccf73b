"""Tokens found on bytes equal the column expression; texts are tokenised without lists handed over."""

import pyarrow as pa
from pyspark.sql import functions as F

from critrank.functions import text as tx
from critrank.functions.tokens import token_digest, token_runs
from critrank.operators import bm25
from critrank.operators.postings import block_rows

TEXTS = ["Data data, x9-Y9", None, "", "ends", "starts", "Käse İSTANBUL Kelvin ١٢", " a\n\tb ", "---", "é", "日本abc語1", "a" * 5000,
         "the pipeline-search team", "THE the"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark, copies=1):
    return spark.createDataFrame([(i + 100 * c, t) for c in range(copies) for i, t in enumerate(TEXTS)],
                                 "doc_id long, text string").coalesce(1)


def test_runs_of_a_slice():
    texts = pa.array(["zz", "ab", "cd e", None, "", "f", "gh"]).slice(1, 5)
    tokens, n = token_runs(texts)
    assert tokens.to_pylist() == ["ab", "cd", "e", "f"] and n.tolist() == [1, 2, 0, 0, 1]
    for empty in (texts.slice(0, 0), pa.array([None, ""], pa.string())):
        tokens, n = token_runs(empty)
        assert len(tokens) == 0 and not n.any() and len(n) == len(empty)


def test_digest_equals_the_column_expression(spark):
    words = ["the", "y9", "a", "data"]
    rows = _rows(spark, 200)  # more than a slice, and one batch
    t = tx.tokens("text")
    d = token_digest(F.lower("text"), words, True)
    got = rows.select("doc_id", d.alias("d")).select("doc_id", "d.dl", "d.found", F.array_sort("d.terms").alias("terms"))
    want = rows.select("doc_id", F.size(t).cast("bigint").alias("dl"), F.filter(t, lambda x: x.isin(words)).alias("found"),
                       F.array_sort(F.array_distinct(t)).alias("terms"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    short = rows.select(token_digest(F.lower("text"), [], False).alias("d")).where("d.terms is not null or size(d.found) > 0")
    assert short.count() == 0


def test_blocks_hand_over_texts_not_tokens(spark):
    rows = block_rows(_rows(spark), "doc_id", "text", 4)
    assert "split(" not in _plan(rows)  # F14
    df = {r["term"]: r["df"] for r in rows.where("term is not null").groupBy("term").agg(F.sum("n").alias("df")).collect()}
    want = bm25.term_stats(bm25.doc_tokens(_rows(spark), "doc_id", "text")).collect()
    assert df == {r["term"]: r["df"] for r in want}
    length = rows.where("term is null").agg(F.sum("length"), F.sum("n")).first()
    assert tuple(length) == (sum(len(tx.py_tokens(t.replace("İ", "i ").replace("K", "k"))) for t in TEXTS if t), len(TEXTS))
