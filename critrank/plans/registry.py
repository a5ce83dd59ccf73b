"""Named queries over the driver tables: one per operator of the inventory.

Every query reads whole tables (no id subsets, no row caps except where the
limit *is* the operator: top-k and the first-n reader) and returns scalar
columns whose names match ``plans.oracle``.  Doubles are rounded to six
decimals so that engines summing in different orders still agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critrank.catalog import probe_catalog
from critrank.functions import text as tx
from critrank.functions import vectors as vx
from critrank.operators import bm25, criteria, fusion, lexicon, records, rerank, rules, topk
from critrank.operators.postings import PostingsIndex
from critrank.operators import vectors as vops
from critrank.plans import features, ranking, tables
from critrank.plans.nested import nested_candidates, raw_records
from critrank.session import materialize, scratch_path
from critrank.sources import io
from critrank.sources.bucketed import write_bucketed
from critrank.sources.schemas import CANDIDATE_JSON_SCHEMA

CAT = probe_catalog()
N = len(CAT.dimensions)
K = 100


def _r(c, d: int = 6):
    return F.round(c, d)


def _dims_long(df: DataFrame, keys: list[str], arrays: dict[str, str]) -> DataFrame:
    """Explode parallel ARRAY columns into (keys..., ordinal, dim, <name>...)."""
    names = F.array(*[F.lit(n) for n in CAT.names])
    z = F.arrays_zip(names.alias("dim"), *[F.col(c).alias(n) for n, c in arrays.items()])
    return (df.select(*keys, F.posexplode(z))
            .select(*keys, F.col("pos").alias("ordinal"), "col.*"))


# ---------------------------------------------------------------- shared bits
def _feats(spark, sf) -> DataFrame:
    c = tables.candidates(spark, sf)
    return features.build_features(c, CAT, embeddings=tables.embeddings(spark, sf),
                                   dim_vectors=tables.dimension_vectors(spark, sf, N))


def _ranked(spark, sf) -> DataFrame:
    paras = tables.jd_paragraphs(spark, sf, keep_blank=True)
    w = criteria.weight_vectors(paras, CAT)
    dv = tables.dimension_vectors(spark, sf, N)
    return ranking.rank(_feats(spark, sf), w, CAT, dv, k=K)


def _survivors(spark, sf, k: int = K) -> DataFrame:
    paras = tables.jd_paragraphs(spark, sf, keep_blank=True)
    w = criteria.weight_vectors(paras, CAT)
    dv = tables.dimension_vectors(spark, sf, N)
    return ranking.survivors(_feats(spark, sf), w, CAT, dv, k)


def _tok(spark, sf) -> DataFrame:
    return bm25.doc_tokens(tables.read(spark, sf, "documents"), "doc_id", "text")


# ---------------------------------------------------------------- queries
def q_rank(spark, sf):
    r = _ranked(spark, sf)
    return r.select("jd_id", "doc_id", F.col("rank").cast("bigint").alias("rank"),
                    F.col("score_6").alias("score"), "reasoning")


def q_rank_jd_vectors(spark, sf):
    """Ranking with each JD's own dimension vectors: texts are hash-encoded, not looked up."""
    paras = tables.jd_paragraphs(spark, sf, keep_blank=True)
    dv = vops.hash_encode_grouped(criteria.dimension_tokens(paras, CAT), ["jd_id", "ordinal"], "tokens", "vec", 64)
    own = vops.hash_encode_grouped(_tok(spark, sf), ["doc_id"], "tokens", "embedding", 64)
    feats = features.build_features(tables.candidates(spark, sf), CAT, embeddings=own, emb_id="doc_id")
    r = ranking.rank(feats, criteria.weight_vectors(paras, CAT), CAT, dv, k=K)
    return r.select("jd_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.col("score_6").alias("score"))


def q_pair_generate(spark, sf):
    """Survivors with their text and each pair query."""
    s = materialize(_survivors(spark, sf).select("jd_id", "doc_id"), "survivors")
    texts = tables.read(spark, sf, "documents").select("doc_id", "text")
    p = rerank.pair_table(s.join(texts, "doc_id"), CAT, ["jd_id", "doc_id"])
    return p.select("jd_id", "doc_id", "dim", "query", F.length("text").cast("bigint").alias("n_chars"))


def q_submission(spark, sf):
    s = ranking.to_submission(_ranked(spark, sf))
    return s.withColumn("rank", F.col("rank").cast("bigint"))


def q_weights(spark, sf):
    w = criteria.weights(tables.jd_paragraphs(spark, sf, keep_blank=True), CAT)
    return w.select("jd_id", "dim", "n_paragraphs", "anchor_hits", "emphasis", "score",
                    _r("weight").alias("weight"))


def q_anchor_map(spark, sf):
    am = criteria.anchor_map(tables.jd_paragraphs(spark, sf), CAT)
    return am.select("jd_id", "para_no", "dim", F.col("hits").cast("bigint").alias("hits"))


def q_emphasis(spark, sf):
    p = tables.jd_paragraphs(spark, sf)
    return p.select("jd_id", "para_no",
                    criteria.emphasis_count(F.col("text"), CAT).cast("bigint").alias("emphasis"))


def q_jd_paragraphs(spark, sf):
    return tables.jd_paragraphs(spark, sf).select("jd_id", "para_no", "text")


def q_dimension_text(spark, sf):
    d = criteria.dimension_text(tables.jd_paragraphs(spark, sf, keep_blank=True), CAT)
    return d.select("jd_id", "dim", "n_paragraphs", "text")


def q_jd_header(spark, sf):
    from critrank.sources.io import jd_header
    return jd_header(header_paragraphs(spark, sf))


def header_paragraphs(spark, sf) -> DataFrame:
    """A JD per customer: header lines built from customer, nation and region."""
    c = tables.read(spark, sf, "customer")
    n = tables.read(spark, sf, "nation")
    r = tables.read(spark, sf, "region")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    k = F.col("c_custkey")
    dash = F.when(k % 3 == 0, F.lit("-")).otherwise(F.lit("–"))
    lines = F.array(
        F.when(k % 4 == 0, F.col("c_name"))
        .otherwise(F.concat(F.lit("Job Description: "), F.col("c_name"))),
        F.when(k % 5 == 0, F.lit("Company:")).otherwise(
            F.concat(F.lit("company: "), F.col("n_name"))),
        F.when(k % 5 == 0, F.col("n_name")).otherwise(F.lit("About the role")),
        F.concat(F.lit("Location:  "), F.col("r_name"), F.lit(" ")),
        F.concat(F.lit("Employment Type: "), F.col("c_mktsegment")),
        F.when(k % 7 == 0, F.lit("Experience Required: several years")).otherwise(
            F.concat(F.lit("Experience Required: "), (k % 6).cast("string"), dash,
                     (k % 6 + 4).cast("string"), F.lit(" years"))))
    return (j.select(F.col("c_custkey").alias("jd_id"), F.posexplode(lines))
            .select("jd_id", F.col("pos").cast("bigint").alias("para_no"), F.col("col").alias("text")))


def q_tokenize(spark, sf):
    t = _tok(spark, sf)
    return t.select("doc_id", F.col("dl").alias("n_tokens"),
                    F.md5(F.concat_ws(" ", "tokens")).alias("tokens_md5"))


def q_normalize_ws(spark, sf):
    d = tables.read(spark, sf, "documents")
    n = tx.normalize_ws("text")
    return d.select("doc_id", F.length(n).cast("bigint").alias("n_chars"), F.md5(n).alias("norm_md5"))


def q_term_stats(spark, sf):
    return bm25.term_stats(_tok(spark, sf)).select("term", "df")


def q_bm25_idf(spark, sf):
    tok = _tok(spark, sf)
    terms = bm25.term_stats(tok)
    st = bm25.corpus_stats(tok, terms)
    return bm25.idf_table(terms, st).select("term", _r("idf_raw").alias("idf_raw"),
                                            _r("idf").alias("idf"))


def _bm25_raw(spark, sf) -> DataFrame:
    tok = _tok(spark, sf)
    return bm25.bm25_raw(tok, criteria.bm25_query(CAT))


def q_bm25_scores(spark, sf):
    raw = _bm25_raw(spark, sf)
    dims = list(criteria.bm25_query(CAT))
    return _long_cols(raw, dims, "bm25_raw__", "bm25")


def q_bm25_norm(spark, sf):
    raw = materialize(_bm25_raw(spark, sf))
    dims = list(criteria.bm25_query(CAT))
    norm = bm25.normalize_max(raw, dims)
    return _long_cols(norm, dims, "bm25__", "bm25_norm")


def _long_cols(df, dims, prefix, name):
    arr = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"{prefix}{d}").alias("v")) for d in dims])
    return df.select("doc_id", F.explode(arr).alias("x")).select(
        "doc_id", "x.dim", _r(F.col("x.v")).alias(name))


def _cands(spark, sf):
    return tables.candidates(spark, sf)


def q_rule_scores(spark, sf):
    c = rules.with_rule_scores(_cands(spark, sf), CAT)
    arr = F.array(*[F.struct(F.lit(r.dim).alias("dim"), F.col(f"rule__{r.dim}").alias("v"))
                    for r in CAT.rules])
    return c.select("doc_id", F.explode(arr).alias("x")).select(
        "doc_id", "x.dim", _r(F.col("x.v")).alias("score"))


def q_rule_hits(spark, sf):
    c = _cands(spark, sf)
    low = F.lower(F.col("text"))
    arr = F.array(*[F.struct(F.lit(r.dim).alias("dim"),
                             rules.rule_hits(low, r).cast("bigint").alias("v"))
                    for r in CAT.rules if r.terms])
    return c.select("doc_id", F.explode(arr).alias("x")).select("doc_id", "x.dim",
                                                                 F.col("x.v").alias("hits"))


def q_rule_evidence(spark, sf):
    c = rules.with_rule_scores(_cands(spark, sf), CAT, evidence=True)
    arr = F.array(*[F.struct(F.lit(r.dim).alias("dim"),
                             F.array_join(F.col(f"evidence__{r.dim}"), "|").alias("v"))
                    for r in CAT.rules])
    return c.select("doc_id", F.explode(arr).alias("x")).select("doc_id", "x.dim",
                                                                 F.col("x.v").alias("evidence"))


def q_none_of_list(spark, sf):
    """Customers none of whose orders carries an excluded priority; no orders at all is true."""
    c = tables.read(spark, sf, "customer").select("c_custkey")
    o = tables.read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("employers"))
    met = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return met.select("c_custkey", rules.none_of(F.col("employers"), ("1-URGENT", "2-HIGH")).alias("none_of"))


def q_embedding_lookup(spark, sf):
    d = tables.read(spark, sf, "documents").select("doc_id")
    e = vops.embedding_lookup(d, tables.embeddings(spark, sf))
    return e.select("doc_id", "has_embedding", _r(vx.l2norm("embedding")).alias("norm"))


def q_embedding_scores(spark, sf):
    d = vops.embedding_lookup(tables.read(spark, sf, "documents").select("doc_id"),
                              tables.embeddings(spark, sf))
    s = vops.dimension_scores(d, tables.dimension_vectors(spark, sf, N), N)
    long = _dims_long(s, ["doc_id"], {"score": "emb_scores"})
    return long.select("doc_id", "dim", _r("score").alias("score"))


def q_hash_encode(spark, sf):
    d = criteria.dimension_tokens(tables.jd_paragraphs(spark, sf, keep_blank=True), CAT)
    v = vops.hash_encode_grouped(d, ["jd_id", "dim"], "tokens", "vec", 64)
    return v.select("jd_id", "dim", F.posexplode("vec")).select(
        "jd_id", "dim", F.col("pos").cast("bigint").alias("i"), _r("col").alias("v"))


def q_pair_overlap(spark, sf):
    t = _tok(spark, sf)
    s = t.select("doc_id", rerank.overlap_scores(F.col("tokens"), CAT).alias("p"))
    long = _dims_long(s, ["doc_id"], {"score": "p"}).filter(F.col("score").isNotNull())
    return long.select("doc_id", "dim", _r("score").alias("score"))


def _source_table(spark, sf) -> DataFrame:
    f = _feats(spark, sf)
    return vops.dimension_scores(f, tables.dimension_vectors(spark, sf, N), N, "embedding")


def _fused_long(s):
    s = s.withColumn("fused", fusion.fused(F.col("emb_scores"), F.col("bm25"),
                                           F.col("structured"), CAT))
    long = _dims_long(s, ["doc_id"], {"e": "emb_scores", "b": "bm25", "s": "structured",
                                      "fused": "fused"})
    return long.select("doc_id", "dim", _r("e").alias("embedding"), _r("b").alias("bm25"),
                       _r("s").alias("structured"), _r("fused").alias("fused"))


def q_source_fusion(spark, sf):
    return _fused_long(_source_table(spark, sf))


def q_features_bucketed(spark, sf):
    """The fused scores of features built from, and into, tables bucketed by id."""
    name = "critrank_" + uuid.uuid4().hex
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    emb = write_bucketed(tables.embeddings(spark, sf).where("vec_id IS NOT NULL"), name + "_emb", "vec_id", buckets,
                         scratch_path(spark, "embeddings"))
    feats = features.build_bucketed(tables.candidates(spark, sf), CAT, name, buckets, embeddings=emb,
                                    dim_vectors=tables.dimension_vectors(spark, sf, N),
                                    path=scratch_path(spark, "features-bucketed"))
    return _fused_long(feats.withColumnRenamed("emb", "emb_scores"))


def q_confidence(spark, sf):
    s = _source_table(spark, sf)
    long = _dims_long(s, ["doc_id"], {"e": "emb_scores", "b": "bm25", "s": "structured"})
    c = long.withColumn("c", fusion.confidence(F.col("e"), F.col("b"), F.col("s")))
    return c.select("doc_id", "dim", _r("c.agreement").alias("agreement"),
                    _r("c.coverage").alias("coverage"), _r("c.value").alias("value"))


def q_source_outer(spark, sf):
    """Sparse per-source tables (only positive scores) aligned by one union + groupBy."""
    s = _source_table(spark, sf)
    long = _dims_long(s, ["doc_id"], {"e": "emb_scores", "b": "bm25", "s": "structured"})
    src = {
        "embedding": long.filter(F.col("e") > 0).select("doc_id", "dim", F.col("e").alias("score")),
        "bm25": long.filter(F.col("b") > 0).select("doc_id", "dim", F.col("b").alias("score")),
        "structured": long.filter(F.col("s") > 0).select("doc_id", "dim", F.col("s").alias("score")),
    }
    out = fusion.outer_sources(src)
    return out.select("doc_id", "dim", _r("embedding").alias("embedding"),
                      _r("bm25").alias("bm25"), _r("structured").alias("structured"))


def q_stage1(spark, sf):
    """Stage-1 of each JD's survivors (no candidate x JD rows)."""
    s = _survivors(spark, sf)
    return s.select("jd_id", "doc_id", _r("stage1").alias("stage1"))


def q_topk_per_group(spark, sf):
    s = _survivors(spark, sf)
    return s.select("jd_id", "doc_id", F.col("stage1_rank").cast("bigint").alias("stage1_rank"),
                    _r("stage1").alias("stage1"))


def q_topk(spark, sf):
    raw = _bm25_raw(spark, sf).select("doc_id", F.col("bm25_raw__TECHNICAL_SKILLS").alias("score"))
    t = topk.topk(raw, K, "score", "doc_id")
    return topk.rank_rows(t, None, "score", "doc_id", "rank").select(
        "doc_id", F.col("rank").cast("bigint").alias("rank"), _r("score").alias("score"))


def q_limit_by_id(spark, sf):
    d = tables.read(spark, sf, "documents")
    return io.first_rows(d, "doc_id", K).select("doc_id", "lang", "n_chars")


def q_topk_lookup(spark, sf):
    s = materialize(_survivors(spark, sf).select("jd_id", "doc_id"), "survivors")
    prof = _cands(spark, sf).select("doc_id", "title", "years")
    ids = s.select("doc_id").distinct()
    found = prof.join(ids, "doc_id", "left_semi")
    return s.join(found, "doc_id", "left").select("jd_id", "doc_id", "title", "years")


def q_minmax(spark, sf):
    s = rerank.minmax_arrays(_survivors(spark, sf), ["jd_id"], "pair_raw", N, "ce")
    long = _dims_long(s, ["jd_id", "doc_id"], {"ce": "ce"}).filter(F.col("ce").isNotNull())
    return long.select("jd_id", "doc_id", "dim", _r("ce").alias("ce"))


def q_blend(spark, sf):
    r = _ranked(spark, sf)
    long = _dims_long(r, ["jd_id", "doc_id"], {"blended": "blended"})
    return long.select("jd_id", "doc_id", "dim", _r("blended").alias("blended"))


def q_confidence_blend(spark, sf):
    r = _ranked(spark, sf)
    long = _dims_long(r, ["jd_id", "doc_id"], {"e": "emb", "b": "bm25", "s": "structured",
                                               "f": "fused", "ce": "ce"})
    conf = fusion.confidence(F.col("e"), F.col("b"), F.col("s"))["value"]
    vals = [fusion.confidence_blend(F.col("f"), conf, F.coalesce(F.col("ce"), F.lit(0.0)), d, CAT)
            for d in CAT.names]
    out = long.withColumn("v", F.element_at(F.array(*vals), F.col("ordinal") + 1))
    return out.select("jd_id", "doc_id", "dim", _r("v").alias("value"))


def q_top_dims(spark, sf):
    r = _ranked(spark, sf)
    return r.select("jd_id", "doc_id", F.col("top_dims")[0].alias("top1"),
                    F.col("top_dims")[1].alias("top2"))


def _results(spark, sf) -> DataFrame:
    return ranking.results(_ranked(spark, sf), CAT)


def q_result_json(spark, sf):
    """The nested records of a ranking, taken apart."""
    long = _results(spark, sf).select("jd_id", F.col("candidate_id").alias("doc_id"), F.explode("dimension_scores"))
    return long.select("jd_id", "doc_id", F.col("key").alias("dim"), *[_r(f"value.{c}").alias(c) for c in (
        "source_score", "embedding_score", "bm25_score", "structured_score", "cross_encoder_score", "final_score")])


def q_result_nested(spark, sf):
    """The nested records as written: JSON lines read back as text, scores printed with six decimals."""
    fields = ("source_score", "embedding_score", "bm25_score", "structured_score", "cross_encoder_score",
              "confidence_score", "final_score")
    path = scratch_path(spark, "results")
    printed = F.transform_values("dimension_scores", lambda k, v: F.struct(
        *[F.format_string("%.6f", _r(v[f]) + F.lit(0.0)).alias(f) for f in fields]))
    io.write_results_json(_results(spark, sf).withColumn("dimension_scores", printed).drop("reasoning"), path, "gzip")
    lines = spark.read.text(path).select("value", F.from_json("value", "jd_id bigint, candidate_id bigint").alias("k"))
    return lines.select("k.jd_id", F.col("k.candidate_id").alias("doc_id"), F.regexp_extract(
        "value", r'"dimension_scores":(.*)\}$', 1).alias("dimension_scores"))


def q_bm25_index_topk(spark, sf):
    """Top documents of each BM25 query from a stored postings index, blocks skipped by bound."""
    path = scratch_path(spark, "bm25-index")
    index = PostingsIndex.build(tables.read(spark, sf, "documents"), "doc_id", "text", path)
    best, _ = index.topk(criteria.bm25_query(CAT), K)
    return best.select(F.col("query").alias("dim"), "doc_id", F.col("rank").cast("bigint").alias("rank"),
                       _r("score").alias("score"))


def q_bm25_refresh(spark, sf):
    """idf after documents arrived in three parts: statistics merged over the index's segments."""
    docs = tables.read(spark, sf, "documents")
    path = scratch_path(spark, "bm25-refresh")
    parts = [docs.where(F.pmod("doc_id", F.lit(3)) == i) for i in range(3)]
    index = PostingsIndex.build(parts[0], "doc_id", "text", path)
    for p in parts[1:]:
        index.append(p, "doc_id", "text")
    return bm25.idf_table(index.terms(), index.corpus()).select(
        "term", "df", _r("idf_raw").alias("idf_raw"), _r("idf").alias("idf"))


def q_features_refresh(spark, sf):
    """BM25 features after two appends: old partial rows, an index grown by segments, no old text read again."""
    cands = tables.candidates(spark, sf)
    path = scratch_path(spark, "refresh-index")
    parts = [cands.where(F.pmod("doc_id", F.lit(3)) == i) for i in range(3)]
    index = PostingsIndex.build(parts[0], "doc_id", "text", path)
    rows = materialize(features.partials(parts[0], CAT), "partials")
    for p in parts[1:]:
        index.append(p, "doc_id", "text")
        rows = rows.unionByName(materialize(features.partials(p, CAT), "partials"))
    feats = features.finish_features(rows, CAT, index)
    long = _dims_long(feats, ["doc_id"], {"v": "bm25"}).where(F.col("dim").isin(list(criteria.bm25_query(CAT))))
    return long.select("doc_id", "dim", _r("v").alias("bm25_norm"))


def q_topk_threshold(spark, sf):
    """Top candidates of each JD by the threshold algorithm over layers of the features."""
    dv = tables.dimension_vectors(spark, sf, N)
    layers = ranking.Layers.write(_feats(spark, sf), CAT, scratch_path(spark, "layers"), dv)
    jds = materialize(criteria.weight_vectors(tables.jd_paragraphs(spark, sf, keep_blank=True), CAT), "jds")
    return layers.top(jds, CAT, K)[0].select(
        "jd_id", "doc_id", F.col("stage1_rank").cast("bigint").alias("stage1_rank"), _r("stage1").alias("stage1"))


def q_lexicon_hits(spark, sf):
    """How many different words of each benchmark item a document contains, as substrings."""
    words = tables.read(spark, sf, "benchmark").select(F.col("item_id").alias("group"), F.explode(tx.tokens("text")).alias("term"))
    texts = tables.read(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    hits = lexicon.lexicon_hits(texts, ["doc_id"], "text", words)
    return hits.select("doc_id", F.col("group").alias("item_id"), "hits",
                       F.md5(F.array_join("terms", " ")).alias("terms_md5"))


def q_anchor_map_lexicon(spark, sf):
    """The paragraph-to-dimension mapping with the anchors as a table."""
    anchors = spark.createDataFrame([(d.name, a) for d in CAT.dimensions for a in d.anchors], "dim string, anchor string")
    return lexicon.anchor_map(tables.jd_paragraphs(spark, sf), anchors)


def q_project_defaults(spark, sf):
    n = records.with_defaults(nested_candidates(spark, sf))
    return n.select("doc_id",
                    F.array_join(F.transform("education", lambda e: e["tier"]), "|").alias("tiers"),
                    F.aggregate(F.transform("skills", lambda s: s["duration_months"]), F.lit(0),
                                lambda a, x: a + x).cast("bigint").alias("skill_months"),
                    F.size("certifications").cast("bigint").alias("n_certs"),
                    F.size("languages").cast("bigint").alias("n_langs"))


def q_raw_text(spark, sf):
    n = nested_candidates(spark, sf)
    raw = records.raw_text()
    return n.select("doc_id", F.length(raw).cast("bigint").alias("n_chars"),
                    F.md5(raw).alias("raw_md5"), F.md5(records.lower_text(raw)).alias("lower_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rank": q_rank,
    "submission": q_submission,
    "weights": q_weights,
    "anchor_map": q_anchor_map,
    "emphasis": q_emphasis,
    "jd_paragraphs": q_jd_paragraphs,
    "dimension_text": q_dimension_text,
    "jd_header": q_jd_header,
    "tokenize": q_tokenize,
    "normalize_ws": q_normalize_ws,
    "term_stats": q_term_stats,
    "bm25_idf": q_bm25_idf,
    "bm25_scores": q_bm25_scores,
    "bm25_norm": q_bm25_norm,
    "rule_scores": q_rule_scores,
    "rule_hits": q_rule_hits,
    "rule_evidence": q_rule_evidence,
    "none_of_list": q_none_of_list,
    "embedding_lookup": q_embedding_lookup,
    "embedding_scores": q_embedding_scores,
    "hash_encode": q_hash_encode,
    "pair_overlap": q_pair_overlap,
    "source_fusion": q_source_fusion,
    "features_bucketed": q_features_bucketed,
    "confidence": q_confidence,
    "source_outer": q_source_outer,
    "rank_jd_vectors": q_rank_jd_vectors,
    "pair_generate": q_pair_generate,
    "stage1": q_stage1,
    "topk_per_group": q_topk_per_group,
    "topk": q_topk,
    "limit_by_id": q_limit_by_id,
    "topk_lookup": q_topk_lookup,
    "minmax": q_minmax,
    "blend": q_blend,
    "confidence_blend": q_confidence_blend,
    "top_dims": q_top_dims,
    "result_json": q_result_json,
    "result_nested": q_result_nested,
    "bm25_index_topk": q_bm25_index_topk,
    "bm25_refresh": q_bm25_refresh,
    "features_refresh": q_features_refresh,
    "topk_threshold": q_topk_threshold,
    "lexicon_hits": q_lexicon_hits,
    "anchor_map_lexicon": q_anchor_map_lexicon,
    "project_defaults": q_project_defaults,
    "raw_text": q_raw_text,
}


# ---------------------------------------------------------------- quality
def _digits(key):
    """A key with seven digits at least; longer ones stay whole."""
    text = key.cast("string")
    return F.when(F.length(text) < 7, F.lpad(text, 7, "0")).otherwise(text)


def ranking_table(spark, sf, whole: bool = False) -> DataFrame:
    """Rankings derived from orders, with deterministic defects injected by key
    arithmetic: blocks of 197 keys form a ranking of 100 rows and one of 97, or
    (``whole``) all orders are one ranking."""
    o = tables.read(spark, sf, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    short = k % 197 >= 100
    pos = F.when(short, k % 197 - 100).otherwise(k % 197)
    rid = F.floor(k / 197) * 2 + F.when(short, 1).otherwise(0)
    if whole:
        pos, rid = k, F.lit(0)
    cid = (F.when(k % 97 == 5, F.concat(F.lit("CAND_"), k.cast("string")))
           .when(k % 89 == 7, F.lit(""))
           .when(k % 83 == 3, F.concat(F.lit("CAND_"), _digits(k - 1)))
           .when(k % 41 == 12, F.concat(F.lit("CAND_"), _digits(k - 2)))
           .otherwise(F.concat(F.lit("CAND_"), _digits(k))))
    rank = (F.when(k % 101 == 4, F.concat(F.lit("0"), (pos + 1).cast("string")))
            .when(k % 103 == 9, pos.cast("string"))
            .when(k % 107 == 2, F.lit("101"))
            .otherwise((pos + 1).cast("string")))
    base = F.lit(1000.0) - pos.cast("double") * 1.5
    sd = F.when(k % 109 == 1, base + 50.0).when((k % 113 == 0) | (k % 41 == 12), base + 1.5).otherwise(base)
    score = F.when(k % 127 == 6, F.lit("abc")).otherwise(F.format_string("%.2f", sd))
    return o.select(rid.cast("bigint").alias("ranking_id"),
                    (pos + 2).cast("bigint").alias("row_num"), cid.alias("candidate_id"),
                    rank.alias("rank"), score.alias("score"), F.lit("r").alias("reasoning"),
                    (k % 131 == 10).alias("bad_cells"))


def _violations(spark, sf):
    from critrank.operators.quality import validate_rankings
    return validate_rankings(ranking_table(spark, sf))


def q_validate(spark, sf):
    return _violations(spark, sf).select("ranking_id", "row_num", "rule")


#: Rows that the one ranking of all orders should have.
WHOLE = 20_000


def q_validate_whole(spark, sf):
    """All orders as one ranking: no task holds a ranking."""
    from critrank.operators.quality import validate_rankings
    v = validate_rankings(ranking_table(spark, sf, whole=True), WHOLE)
    return v.select("ranking_id", "row_num", "rule", F.when(F.col("rule") != "not_monotonic", F.col("detail")).alias("detail"))


def _rules(spark, sf, rules_, detail=True):
    v = _violations(spark, sf).filter(F.col("rule").isin(rules_))
    cols = ["ranking_id", "row_num", "rule"] + (["detail"] if detail else [])
    return v.select(*cols)


def q_validate_count(spark, sf):
    return _rules(spark, sf, ["count"])


def q_validate_ids(spark, sf):
    return _rules(spark, sf, ["id_required", "id_pattern"])


def q_validate_dups(spark, sf):
    return _rules(spark, sf, ["id_duplicate", "rank_duplicate"])


def q_validate_ranks(spark, sf):
    return _rules(spark, sf, ["rank_integer", "rank_range", "score_float", "cells"])


def q_validate_monotonic(spark, sf):
    return _rules(spark, sf, ["not_monotonic"], detail=False)


def q_validate_ties(spark, sf):
    return _rules(spark, sf, ["tie_order"])


def q_missing_ranks(spark, sf):
    from critrank.operators.quality import missing_ranks
    return missing_ranks(ranking_table(spark, sf)).select("ranking_id", "rank")


def q_schema_violations(spark, sf):
    from critrank.operators.quality import schema_violations
    return schema_violations(nested_candidates(spark, sf), key="doc_id")


def q_conformance(spark, sf):
    """Raw JSON records judged by the compiled schema document."""
    from critrank.operators.conformance import conformance
    return conformance(raw_records(spark, sf), "doc_id", "record", CANDIDATE_JSON_SCHEMA)


QUERIES.update({
    "validate": q_validate,
    "validate_whole": q_validate_whole,
    "conformance": q_conformance,
    "validate_count": q_validate_count,
    "validate_ids": q_validate_ids,
    "validate_dups": q_validate_dups,
    "validate_ranks": q_validate_ranks,
    "validate_monotonic": q_validate_monotonic,
    "validate_ties": q_validate_ties,
    "missing_ranks": q_missing_ranks,
    "schema_violations": q_schema_violations,
})
