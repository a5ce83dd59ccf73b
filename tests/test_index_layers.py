"""Stored index with block skipping, threshold top-k, lexicons, refresh and encoding in the feature build."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from critrank.catalog import probe_catalog
from critrank.operators import bm25, criteria, lexicon
from critrank.operators.postings import PostingsIndex
from critrank.plans import features, ranking, tables

from conftest import SF001

CAT = probe_catalog()


def path_of(name):
    return tempfile.mkdtemp(prefix="cr-") + "/" + name


@pytest.fixture(scope="module")
def corpus(spark):
    """Rare words in few documents, one word everywhere, copies that tie, empty and null texts."""
    r = random.Random(3)
    rows = []
    for i in range(1200):
        words = ["common"] + [r.choice("abcdefghij") * 2 for _ in range(r.randint(0, 30))]
        if i % 97 == 0:
            words += ["rare"] * (1 + i // 400)
        rows.append((i, " ".join(words)))
    rows += [(2000 + i, "rare common rare") for i in range(30)] + [(3000, None), (3001, ""), (3002, "only other")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


QUERIES = {"rare": ["rare", "aa"], "twice": ["rare", "rare", "bb"], "common": ["common", "cc"], "none": ["zzz"]}


def expected(corpus, k):
    raw = bm25.bm25_raw(bm25.doc_tokens(corpus, "doc_id", "text").withColumn("dl", F.greatest("dl", F.lit(0))), QUERIES,
                        keep=["doc_id", "dl", "tokens"]).collect()
    out = {}
    for q, terms in QUERIES.items():
        hit = [(-r[f"bm25_raw__{q}"], r["doc_id"]) for r in raw if r["tokens"] and set(terms) & set(r["tokens"])]
        out[q] = [(i, round(-s, 9)) for s, i in sorted(hit)[:k]]
    return out


@pytest.fixture(scope="module")
def whole(corpus):
    return PostingsIndex.build(corpus, "doc_id", "text", path_of("whole"), block_docs=40)


@pytest.mark.parametrize("k", [1, 5000])
def test_index_topk_equals_full_scoring(corpus, whole, k):
    best, report = whole.topk(QUERIES, k)
    got = {q: [] for q in QUERIES}
    for r in best.orderBy("query", "rank").collect():
        got[r["query"]].append((r["doc_id"], round(r["score"], 9)))
    assert got == expected(corpus.withColumn("text", F.coalesce("text", F.lit(""))), k)
    read = {r["query"]: (r["blocks"], r["blocks_read"]) for r in report.collect()}
    if k == 1:
        assert read["rare"][1] < read["rare"][0]  # blocks were skipped
    if k == 5000:
        assert all(a == b for a, b in read.values())


def test_appends_equal_a_rebuild(corpus, whole, spark):
    path = path_of("parts")
    PostingsIndex.build(corpus.where("doc_id < 500"), "doc_id", "text", path, block_docs=64)
    PostingsIndex.open(spark, path).append(corpus.where("doc_id between 500 and 999"), "doc_id", "text")
    grown = PostingsIndex.open(spark, path).append(corpus.where("doc_id > 999"), "doc_id", "text")
    assert sorted(map(tuple, grown.terms().collect())) == sorted(map(tuple, whole.terms().collect()))
    assert grown.corpus().first()["n_docs"] == whole.corpus().first()["n_docs"] == 1233
    for c in ("avgdl", "mean_idf"):
        assert grown.corpus().first()[c] == pytest.approx(whole.corpus().first()[c], abs=1e-12)
    rows = [sorted((r["query"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in i.topk(QUERIES, 20)[0].collect())
            for i in (grown, whole)]
    assert rows[0] == rows[1]


def test_a_query_reads_its_terms_only(spark):
    """Row groups without a query term aren't read: the scan gives fewer rows than the table has."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[
        F.concat(F.lit("w"), ((F.col("id") * 7 + j * 131) % 20000).cast("string")) for j in range(20)]).alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        index = PostingsIndex.build(docs, "doc_id", "text", path_of("big"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    from critrank.operators.postings import any_of
    wanted = spark.read.parquet(f"{index.path}/terms").where(any_of("term", ["w17", "w4242"]))
    assert wanted.count() == 2
    plan = wanted._jdf.queryExecution()
    wanted.collect()
    leaf = plan.executedPlan().collectLeaves().head()
    total = spark.read.parquet(f"{index.path}/terms").count()
    assert "PushedFilters: [Or(EqualTo(term,w17),EqualTo(term,w4242))]" in str(plan.toString())
    assert leaf.metrics().apply("numOutputRows").value() < total


@pytest.fixture(scope="module")
def feats(spark):
    n = len(CAT.dimensions)
    dv = tables.dimension_vectors(spark, SF001, n)
    return features.build_features(tables.candidates(spark, SF001), CAT, embeddings=tables.embeddings(spark, SF001),
                                   dim_vectors=dv), dv


def test_layers_equal_the_full_scan(spark, feats):
    f, dv = feats
    more = f
    for i in range(1, 8):  # ties, and enough rows that layers differ
        more = more.unionByName(f.withColumn("doc_id", F.col("doc_id") + i * 10_000))
    w = criteria.weight_vectors(tables.jd_paragraphs(spark, SF001, keep_blank=True), CAT)
    n = len(CAT.dimensions)
    odd = spark.createDataFrame([(-1, [-1.0] + [0.5] * (n - 1)), (-2, [0.0] * n), (-3, [None] * n), (-4, [1.0])],
                                "jd_id long, weights array<double>")
    jds = w.unionByName(odd)
    layers = ranking.Layers.write(more, CAT, path_of("layers"), dv)
    for k in (1,):
        best, report = layers.top(jds, CAT, k)
        full = ranking.top_candidates(more, jds, dv, CAT, k)
        cols = ["jd_id", "doc_id", "stage1", "stage1_rank"]
        assert sorted(map(tuple, best.select(cols).collect())) == sorted(map(tuple, full.select(cols).collect()))
        read = {r["jd_id"]: r["rows_read"] for r in report.collect()}
        assert len(read) == jds.count() and read[-1] == read[-2] == more.count()
        if k == 1:
            assert min(read.values()) < more.count() / 2
    ranked = [sorted((r["jd_id"], r["rank"], r["doc_id"]) for r in ranking.rank(more, w, CAT, dv, k=5, layers=x).collect())
              for x in (layers, None)]
    assert ranked[0] == ranked[1]


def test_tasks_pass_on_k_rows_of_a_jd(spark, feats):
    """However many Arrow chunks a task has."""
    f, dv = feats
    w = criteria.weight_vectors(tables.jd_paragraphs(spark, SF001), CAT)
    narrow = ranking._with_sources(f, dv, CAT).select("doc_id", "fused").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = ranking.best_of_tasks(narrow, {"fused": len(CAT.dimensions)}, w, CAT, 3)
        assert rows.count() == 2 * 3 * w.count()
        assert sorted(map(tuple, ranking.topk.topk_per_group(rows, 3, "jd_id", "stage1", salts=32).collect())) == sorted(
            (r["jd_id"], r["doc_id"], r["stage1"], r["stage1_rank"]) for r in ranking.top_candidates(f, w, dv, CAT, 3).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_features_from_a_stored_index(spark, feats):
    cands = tables.candidates(spark, SF001)
    index = PostingsIndex.build(cands, "doc_id", "text", path_of("idx"))
    got = features.build_features(cands, CAT, index=index).select("doc_id", "bm25", "structured", "pair_raw")
    want = feats[0].select("doc_id", "bm25", "structured", "pair_raw")

    def rows(df):
        return {r["doc_id"]: ([round(x, 9) for x in r["bm25"]], r["structured"], r["pair_raw"]) for r in df.collect()}
    assert rows(got) == rows(want)


def test_encoder_fills_what_is_missing(spark):
    cands = spark.createDataFrame([(i, "x" * i, 1.0, ["a"]) for i in range(6)] + [(6, None, 1.0, ["a"])],
                                  "doc_id long, text string, years double, employers array<string>")
    stored = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(6, [0.0, 1.0])], "vec_id long, embedding array<double>")
    odd = stored.where("vec_id < 3").unionByName(spark.createDataFrame([(4, None)], "vec_id long, embedding array<double>"))

    def lengths():
        """A model whose vector is the length of the text; made in the worker."""
        class Lengths:
            def encode(self, texts):
                import numpy as np
                return np.array([[float(len(t)), 1.0] for t in texts])
        return Lengths()

    def rows(df):
        return sorted((r["doc_id"], r["embedding"]) for r in df.collect())
    full = rows(features.build_features(cands, CAT, embeddings=stored))
    assert rows(features.build_features(cands, CAT, embeddings=odd, encoder=lengths)) == full
    assert rows(features.build_features(cands, CAT, encoder=lengths)) == full


def test_a_lexicon_of_ten_thousand_terms(spark):
    r = random.Random(9)
    letters = "abcdeé"
    terms = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(14_000)})[:10_000]
    texts = [(i, "".join(r.choice(letters + " ") for _ in range(300))) for i in range(40)] + [(90, None), (91, ""), (92, "zzz")]
    lex = [(i % 50, t) for i, t in enumerate(terms)] + [(7, terms[0]), (7, terms[7]), (8, None), (9, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(lex, "group int, term string")
    by = {}
    for g, t in lex:
        if t:
            by.setdefault(g, set()).add(t)
    want = sorted((i, g, len(h), sorted(h)) for i, t in texts if t for g, ts in by.items() for h in [[x for x in ts if x in t]] if h)
    for block in (lexicon.BLOCK_BYTES, 300_000):
        got = lexicon.lexicon_hits(df, ["doc_id"], "text", table, block)
        assert sorted((r["doc_id"], r["group"], r["hits"], sorted(r["terms"])) for r in got.collect()) == want
    assert lexicon.lexicon_hits(df, ["doc_id"], "text", table.limit(0)).count() == 0
