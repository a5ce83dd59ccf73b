"""Okapi BM25 as DataFrame jobs.

Index build (once per corpus)
  * ``doc_tokens``   (id, tokens, dl)                  row-local, no shuffle
  * ``term_stats``   (term, df)    explode(array_distinct(tokens)) -> groupBy(term)
                      The only shuffle.  Partial aggregation collapses hot
                      terms ("the" in most documents) on the map side.
  * ``corpus_stats`` one row: n_docs, avgdl, mean_idf (mean over the *whole*
                      vocabulary, taken before negative idfs are floored).

Scoring (per catalog)
  Query tokens come from the catalog (bounded), so their idf values are
  gathered into ONE map row and attached to every document as a scalar
  subquery: no join, no shuffle.  Per document the term frequencies of the
  query vocabulary are counted in the row (``INSET`` filter, then counts),
  and the score is summed over query tokens in query order, repeats adding
  again, exactly as a sequential loop does.

  idf(t)   = ln(N - df + 0.5) - ln(df + 0.5); negative -> eps * mean_idf
  score    = sum_q idf(q) * tf*(k1+1) / (tf + k1*(1 - b + b*dl/avgdl))
  norm     = score / max_docs(score) when that max is > 0, else score

k1 = 1.5, b = 0.75, eps = 0.25 are the documented defaults of the public
Okapi BM25 implementation the ranking used; they are parameters here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critrank.functions import text as tx

K1, B, EPS = 1.5, 0.75, 0.25


def doc_tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    toks = tx.tokens(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), toks.alias("tokens")).withColumn(
        "dl", F.size("tokens").cast("bigint"))


def term_stats(tok: DataFrame) -> DataFrame:
    """(term, df): number of documents containing each term."""
    return (tok.select(F.explode(F.array_distinct("tokens")).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def idf_expr(df: Column, n_docs: Column) -> Column:
    return F.ln(n_docs - df + 0.5) - F.ln(df + 0.5)


def corpus_stats(tok: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl, mean_idf.  ``tok`` needs ``dl`` only, and is read once."""
    base = tok.agg(F.count(F.lit(1)).alias("n_docs"),
                   F.avg(F.col("dl").cast("double")).alias("avgdl"))
    # the number of documents joins the few rows of df counts: one row for each df that occurs
    counts = terms.groupBy("df").agg(F.count(F.lit(1)).alias("m"))
    n = base.select(F.col("n_docs").cast("double")).scalar()
    raw = idf_expr(F.col("df").cast("double"), n)
    mean_idf = counts.agg(F.try_divide(F.sum(raw * F.col("m")), F.sum("m"))).scalar()
    return base.select("n_docs", "avgdl", mean_idf.alias("mean_idf"))


def idf_table(terms: DataFrame, stats: DataFrame, eps: float = EPS,
              vocabulary: list[str] | None = None) -> DataFrame:
    """(term, df, idf_raw, idf) with negatives floored to eps * mean_idf."""
    if vocabulary is not None:
        terms = terms.filter(F.col("term").isin(list(vocabulary)))
    n = stats.select(F.col("n_docs").cast("double")).scalar()
    mean_idf = stats.select("mean_idf").scalar()
    raw = idf_expr(F.col("df").cast("double"), n)
    return terms.select("term", "df", raw.alias("idf_raw"),
                        F.when(raw < 0, F.lit(eps) * mean_idf).otherwise(raw).alias("idf"))


def query_idf_map(terms: DataFrame, stats: DataFrame, vocabulary: list[str],
                  eps: float = EPS) -> Column:
    """Scalar MAP<term, idf> for the query vocabulary (size bounded by the catalog)."""
    t = idf_table(terms, stats, eps, vocabulary)
    return t.agg(F.map_from_entries(F.collect_list(F.struct("term", "idf")))).scalar()


def query_term_occurrences(tokens_col: Column, vocabulary: list[str]) -> Column:
    """The document's tokens that belong to the query vocabulary (``INSET`` filter)."""
    if not vocabulary:
        return F.array().cast("array<string>")
    return F.filter(tokens_col, lambda x: x.isin(list(vocabulary)))


def term_frequencies(tq: Column) -> Column:
    """MAP<term, INT> counting each distinct term of ``tq``.

    ``tq`` must be a column (not an expression): it is read once per distinct
    term, which is cheap only when it is already computed.
    """
    return F.map_from_entries(F.transform(
        F.array_distinct(tq),
        lambda t: F.struct(t.alias("k"), F.size(F.filter(tq, lambda y: y == t)).alias("v"))))


def bm25_expr(tf_map: Column, dl: Column, query: list[str], idf_map: Column,
              avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """Raw BM25 of one document for one query (list of tokens, repeats kept)."""
    if not query:
        return F.lit(0.0)
    qarr = F.array(*[F.lit(q) for q in query])
    length_norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl.cast("double") / avgdl)

    def add(acc, q):
        tf = F.coalesce(F.try_element_at(tf_map, q), F.lit(0)).cast("double")
        idf = F.coalesce(F.try_element_at(idf_map, q), F.lit(0.0))
        return acc + idf * (tf * (k1 + 1.0) / (tf + length_norm))
    return F.aggregate(qarr, F.lit(0.0), add)


def query_tf(tok: DataFrame, vocabulary: list[str], keep: list[Column | str], name: str = "tf") -> DataFrame:
    """``keep`` and MAP<term, INT> ``name``: how often each query term occurs in ``tokens``.

    Staged projections: the query-term occurrences are computed once and referenced
    twice, so Catalyst keeps them as a column.
    """
    out = tok.select(*keep, query_term_occurrences(F.col("tokens"), vocabulary).alias("_tq"))
    return out.withColumn(name, term_frequencies(F.col("_tq"))).drop("_tq")


def bm25_raw(tok: DataFrame, queries: dict[str, list[str]], terms: DataFrame | None = None,
             stats: DataFrame | None = None, k1: float = K1, b: float = B,
             eps: float = EPS, keep: list[str] | None = None) -> DataFrame:
    """Add one raw-score column ``bm25_raw__<dim>`` per query to the token table.

    ``terms``/``stats`` are the corpus statistics (built from ``tok`` when
    omitted).  Statistics are read through scalar subqueries: one row each.
    """
    if terms is None:
        terms = term_stats(tok)
    if stats is None:
        stats = corpus_stats(tok, terms)
    vocab = sorted({t for q in queries.values() for t in q})
    idf_map = query_idf_map(terms, stats, vocab, eps)
    avgdl = stats.select("avgdl").scalar()
    cols = [F.col(c) for c in (keep or ["doc_id", "dl"])]
    # scalar subqueries may not appear inside lambdas, so they are projected as columns too
    out = query_tf(tok, vocab, [*cols, idf_map.alias("_idf"), avgdl.alias("_avgdl")], "_tf")
    for dim, q in queries.items():
        out = out.withColumn(f"bm25_raw__{dim}",
                             bm25_expr(F.col("_tf"), F.col("dl"), q, F.col("_idf"),
                                       F.col("_avgdl"), k1, b))
    return out.drop("_tf", "_idf", "_avgdl")


def normalize_max(df: DataFrame, cols: list[str], out_prefix: str = "bm25__",
                  in_prefix: str = "bm25_raw__") -> DataFrame:
    """Divide each score column by its corpus max when that max is positive.

    The maxima are one aggregate row read as scalar subqueries, never an
    unpartitioned window.  Callers materialise ``df`` first so that the
    scores are not computed twice.
    """
    maxes = df.agg(F.struct(*[F.max(f"{in_prefix}{c}").alias(c) for c in cols])).scalar()
    out = df
    for c in cols:
        m = maxes[c]
        raw = F.col(f"{in_prefix}{c}")
        out = out.withColumn(f"{out_prefix}{c}", F.when(m > 0, raw / m).otherwise(raw))
    return out
