"""Second-stage pair scoring over the top-k survivors.

* ``overlap``          built-in pair scorer, a column expression:
                       |distinct query tokens found in the text| / |distinct query tokens|.
                       It is JD-independent, so feature builds precompute it.
* ``pair_table``       survivors x the catalog's pair queries (D9), generated
                       from a literal array per row: no join.
* ``score_pairs``      a caller's model (``factory() -> obj.predict(pairs)``)
                       per Arrow batch in ``mapInPandas``; input is repartitioned
                       first because a top-k result sits in few partitions.
* ``minmax``           per (group, dimension) min-max over the survivors; all
                       equal -> 0.0 (E13).  Groups hold k rows, so the window is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critrank.catalog import Catalog
from critrank.functions.text import py_tokens


def overlap(query: str, tokens_col: Column) -> Column:
    q = sorted(set(py_tokens(query)))
    if not q:
        return F.lit(0.0)
    hits = F.size(F.array_intersect(F.array(*[F.lit(t) for t in q]), tokens_col))
    return hits.cast("double") / F.lit(float(len(q)))


def overlap_scores(tokens_col: Column, catalog: Catalog) -> Column:
    """ARRAY<DOUBLE> over all dimensions; NULL where a dimension has no pair query."""
    out = []
    for d in catalog.dimensions:
        q = catalog.pair_query(d.name)
        out.append(overlap(q, tokens_col) if q is not None else F.lit(None).cast("double"))
    return F.array(*out)


def pair_table(survivors: DataFrame, catalog: Catalog, keys: list[str],
               text_col: str = "text") -> DataFrame:
    qs = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(d.name).alias("dim"),
                            F.lit(catalog.pair_query(d.name)).alias("query"))
                   for i, d in enumerate(catalog.dimensions)
                   if catalog.pair_query(d.name) is not None])
    return (survivors.select(*keys, F.col(text_col).alias("text"), F.explode(qs).alias("q"))
            .select(*keys, "q.ordinal", "q.dim", "q.query", "text"))


class OverlapScorer:
    """Python twin of ``overlap`` for the model path (tests, local runs)."""

    def predict(self, pairs):
        out = []
        for q, t in pairs:
            qs = set(py_tokens(q))
            out.append(len(qs & set(py_tokens(t or ""))) / len(qs) if qs else 0.0)
        return np.asarray(out, dtype=np.float64)


def score_pairs(texts: DataFrame, factory: Callable[[], object] | None, catalog: Catalog, keys: list[str],
                batch_size: int = 128) -> DataFrame:
    """(keys, ordinal, dim, pair_raw): a model's score of each row's pairs.

    ``texts`` has ``keys`` and ``text``; a text travels once, its pairs are made in
    the task that scores them.  ``factory`` builds the model, once per worker.
    """
    factory = factory or OverlapScorer
    kinds = T.StructType([*texts.select(*keys).schema.fields, T.StructField("ordinal", T.IntegerType()),
                          T.StructField("dim", T.StringType()), T.StructField("pair_raw", T.DoubleType())])
    queries = [(i, d.name, catalog.pair_query(d.name)) for i, d in enumerate(catalog.dimensions)
               if catalog.pair_query(d.name) is not None]
    holder: dict = {}

    def run(batches):
        model = holder.get("m")
        if model is None:
            model = holder["m"] = factory()
        for pdf in batches:
            out = []
            for i, dim, query in queries:
                pairs_ = [(query, t) for t in pdf["text"].fillna("").tolist()]
                scores = []
                for a in range(0, len(pairs_), batch_size):
                    scores.extend(np.ravel(np.asarray(model.predict(pairs_[a:a + batch_size]),
                                                      dtype=np.float64)).tolist())
                out.append(pdf[keys].assign(ordinal=np.int32(i), dim=dim, pair_raw=scores))
            if out:
                yield pd.concat(out)

    return texts.select(*keys, "text").mapInPandas(run, kinds)


def minmax(df: DataFrame, group: list[str], col: str = "pair_raw",
           out: str = "pair_norm") -> DataFrame:
    w = Window.partitionBy(*group)
    mn, mx = F.min(col).over(w), F.max(col).over(w)
    return df.withColumn(out, F.when(mx > mn, (F.col(col) - mn) / (mx - mn)).otherwise(F.lit(0.0)))


def minmax_arrays(df: DataFrame, group: list[str], col: str, n_dims: int,
                  out: str) -> DataFrame:
    """Element-wise min-max of an ARRAY<DOUBLE> column within each group.

    NULL elements (dimensions without pair scoring) stay NULL.
    """
    w = Window.partitionBy(*group)
    tmp = df
    for i in range(n_dims):
        tmp = tmp.withColumn(f"_mn{i}", F.min(F.col(col)[i]).over(w)) \
                 .withColumn(f"_mx{i}", F.max(F.col(col)[i]).over(w))
    elems = []
    for i in range(n_dims):
        v, mn, mx = F.col(col)[i], F.col(f"_mn{i}"), F.col(f"_mx{i}")
        elems.append(F.when(v.isNull(), F.lit(None).cast("double"))
                     .when(mx > mn, (v - mn) / (mx - mn)).otherwise(F.lit(0.0)))
    tmp = tmp.withColumn(out, F.array(*elems))
    return tmp.drop(*[f"_mn{i}" for i in range(n_dims)], *[f"_mx{i}" for i in range(n_dims)])
