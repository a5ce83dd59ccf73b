"""Build the JD-independent candidate feature table once.

Everything that does not depend on a job description is computed here, per
candidate row, and stored as arrays in template order:

    doc_id, bm25 (normalised), structured (rule scores), pair_raw (built-in
    pair scores, NULL outside paired dimensions), embedding, profile columns

Jobs and shuffles
  1. ``partials``: one scan of the candidates, row-local, written: length, the query
     terms' frequencies, rule and pair scores, and (without a stored index) the
     distinct tokens, which only step 2 reads
  2. term statistics: explode(terms) -> groupBy(term), one shuffle; or, with a stored
     ``PostingsIndex``, the row groups of the query terms and its corpus row
  3. idf of the query terms, N, average length, BM25 maxima: one row each
  4. BM25 from the stored frequencies, normalised: row-local, no text is read
  5. embeddings: stored vectors by a LEFT JOIN on id (one shuffle join); a model
     encodes only the candidates that have none
  6. the finished table is materialised once (it is read by stage-1 and again
     for the survivors); ``write_features`` persists it as Parquet

Refresh.  ``partials`` don't depend on the corpus.  For new candidates only they and
a new index segment are computed; ``finish_features`` over old and new partials then
equals a rebuild, without reading the old texts (tests hold it to that).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critrank.catalog import Catalog
from critrank.functions import text as tx
from critrank.functions import vectors as vx
from critrank.functions.tokens import token_digest
from critrank.operators import bm25, criteria, rerank, rules
from critrank.operators import vectors as vops
from critrank.operators.postings import PostingsIndex
from critrank.session import materialize, scratch_path
from critrank.sources.bucketed import write_bucketed

PROFILE = ("title", "years", "open_to_work", "response_rate")


def _vocabulary(catalog: Catalog) -> list[str]:
    return sorted({t for q in criteria.bm25_query(catalog).values() for t in q})


def partials(cands: DataFrame, catalog: Catalog, text_col: str = "text", years_col: str = "years",
             employers_col: str = "employers", profile: tuple[str, ...] = PROFILE, keep_text: bool = False,
             with_terms: bool = False) -> DataFrame:
    """What a candidate's features need of its own row: (doc_id, dl, tf, structured, pair_raw, profile ...).

    ``tf`` holds the query terms' frequencies; ``with_terms`` adds the distinct tokens.
    """
    extra = [c for c in profile if c in cands.columns]
    # each text is lowered and tokenised once; what scores need of its tokens are the few that queries name
    queries = [q for q in map(catalog.pair_query, catalog.names) if q is not None]
    vocabulary = _vocabulary(catalog)
    asked = {*vocabulary, *(t for q in queries for t in tx.py_tokens(q))}
    low = cands.select("doc_id", F.col(text_col).alias("_text"), F.col(years_col).alias("_years"),
                       F.col(employers_col).alias("_employers"), *extra).withColumn("_low", F.lower("_text"))
    tok = low.withColumn("_digest", token_digest("_low", sorted(asked), with_terms)).withColumn("tokens", F.col("_digest.found"))
    cols = [F.col("doc_id"), F.col("_digest.dl").alias("dl"),
            rules.structured_scores(F.col("_low"), F.col("_years"), F.col("_employers"), catalog).alias("structured"),
            rerank.overlap_scores(F.col("tokens"), catalog).alias("pair_raw"), *[F.col(c) for c in extra]]
    if keep_text:
        cols.append(F.col("_text").alias("text"))
    if with_terms:
        cols.append(F.col("_digest.terms").alias("terms"))
    return bm25.query_tf(tok, vocabulary, cols)


def _statistics(rows: DataFrame, catalog: Catalog, index: PostingsIndex | None) -> tuple[dict[str, float], float]:
    """(idf of each query term that occurs, average length); the catalog bounds both."""
    vocabulary = _vocabulary(catalog)
    if index is not None:
        idf, stats = index.idf(vocabulary), index.corpus()
    else:
        terms = materialize(rows.select(F.explode("terms").alias("term")).groupBy("term")
                            .agg(F.count(F.lit(1)).alias("df")), "term-stats")
        stats = materialize(bm25.corpus_stats(rows, terms), "corpus-stats")  # one row
        idf = bm25.idf_table(terms, stats, vocabulary=vocabulary)
    return {r["term"]: r["idf"] for r in idf.collect()}, stats.first()["avgdl"] or 1.0


def finish_features(rows: DataFrame, catalog: Catalog, index: PostingsIndex | None = None,
                    embeddings: DataFrame | None = None, emb_id: str = "vec_id", emb_col: str = "embedding",
                    dim_vectors: DataFrame | None = None) -> DataFrame:
    """The feature table of written ``partials``, under the corpus statistics of ``index`` (or of ``rows``)."""
    queries = criteria.bm25_query(catalog)
    idf, avgdl = _statistics(rows, catalog, index)
    known = F.lit(None).cast("map<string,double>") if not idf else F.create_map(
        *[F.lit(x) for item in sorted(idf.items()) for x in item])
    raw = F.array(*[bm25.bm25_expr(F.col("tf"), F.col("dl"), queries[d.name], known, F.lit(avgdl))
                    if d.name in queries else F.lit(0.0) for d in catalog.dimensions])
    feats = rows.drop("terms").withColumn("bm25_raw", raw).drop("tf")
    most = feats.agg(*[F.max(F.col("bm25_raw")[i]) for i in range(len(catalog.dimensions))]).first()
    feats = feats.withColumn("bm25", F.array(*[
        F.col("bm25_raw")[i] / F.lit(m) if m is not None and m > 0 else F.col("bm25_raw")[i]
        for i, m in enumerate(most)])).drop("bm25_raw")
    if embeddings is not None:
        e = embeddings.select(F.col(emb_id).alias("_eid"), vx.as_double_array(emb_col).alias("embedding"))
        feats = feats.join(e, feats["doc_id"] == e["_eid"], "left").drop("_eid")
    else:
        feats = feats.withColumn("embedding", F.lit(None).cast("array<double>"))
    if dim_vectors is not None:
        feats = vops.dimension_scores(feats, dim_vectors, len(catalog.dimensions), "embedding")
        feats = feats.withColumnRenamed("emb_scores", "emb")
    return feats


def encode_missing(cands: DataFrame, embeddings: DataFrame | None, encoder: Callable[[], object], text_col: str = "text",
                   emb_id: str = "vec_id", emb_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding): the stored vectors, and the model's for candidates without one.

    ``encoder()`` gives an object with ``encode(list[str]) -> ndarray[n, d]``, once a
    Python worker.  What a row without a text gets is the model's answer to ''.
    """
    texts = cands.select(F.col("doc_id").alias("vec_id"), F.col(text_col).alias("_text"))
    if embeddings is None:
        missing, stored = texts, None
    else:
        stored = (embeddings.where(F.col(emb_col).isNotNull())
                  .select(F.col(emb_id).alias("vec_id"), vx.as_double_array(emb_col).alias("embedding")))
        missing = texts.join(stored.select("vec_id"), "vec_id", "left_anti")
    own = materialize(vops.encode(missing, "_text", encoder, "embedding").drop("_text"), "encoded")
    return own if stored is None else stored.unionByName(own)


def build_features(cands: DataFrame, catalog: Catalog, embeddings: DataFrame | None = None,
                   emb_id: str = "vec_id", emb_col: str = "embedding",
                   text_col: str = "text", years_col: str = "years",
                   employers_col: str = "employers", profile: tuple[str, ...] = PROFILE,
                   keep_text: bool = False, dim_vectors: DataFrame | None = None,
                   index: PostingsIndex | None = None, encoder: Callable[[], object] | None = None) -> DataFrame:
    """Feature table; with JD-independent ``dim_vectors`` (ordinal, vec) the
    dimension similarities ``emb`` are stored too, so ranking never recomputes them.

    ``index``: a stored index of these candidates, in place of counting terms anew.
    ``encoder``: a model factory; candidates without a stored vector are encoded.
    """
    rows = materialize(partials(cands, catalog, text_col, years_col, employers_col, profile, keep_text,
                                with_terms=index is None), "partials")
    if encoder is not None:
        embeddings = encode_missing(cands, embeddings, encoder, text_col, emb_id, emb_col)
        emb_id, emb_col = "vec_id", "embedding"
    # Ranking reads the features twice (stage-1 over all candidates, then the
    # survivors' attach); one compact per-candidate table is cheaper than
    # redoing the embeddings join and similarities for each read.
    return materialize(finish_features(rows, catalog, index, embeddings, emb_id, emb_col, dim_vectors), "features")


def build_bucketed(cands: DataFrame, catalog: Catalog, table: str, buckets: int, embeddings: DataFrame | None = None,
                   emb_id: str = "vec_id", emb_col: str = "embedding", dim_vectors: DataFrame | None = None,
                   index: PostingsIndex | None = None, path: str | None = None, **columns) -> DataFrame:
    """``build_features`` into a table bucketed by doc_id, for joins that leave it in place.

    Candidates are dealt out once, as narrow partials.  Where ``embeddings`` is a table
    with as many buckets (``sources.bucketed``), neither its join nor the write shuffles;
    any other is shuffled alone.  Later joins (``ranking.attach``) move survivors only.
    ``columns`` go to ``partials``.  ``path`` makes an external table there.
    """
    rows = partials(cands, catalog, with_terms=index is None, **columns)
    staged = f"{table}_partials_{uuid.uuid4().hex}"
    rows = write_bucketed(rows, staged, "doc_id", buckets, scratch_path(cands.sparkSession, "partials"))
    feats = finish_features(rows, catalog, index, embeddings, emb_id, emb_col, dim_vectors)
    found = write_bucketed(feats, table, "doc_id", buckets, path)
    cands.sparkSession.sql(f"DROP TABLE {staged}")  # its files go with the other temporary tables
    return found


def write_features(feats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist sorted by id within files, so id lookups prune row groups."""
    feats.sortWithinPartitions("doc_id").write.mode(mode).parquet(path)
