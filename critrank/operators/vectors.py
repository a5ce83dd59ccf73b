"""Vector operators: embedding lookup, dimension similarity, corpus encoding.

* ``embedding_lookup``   candidates LEFT JOIN embeddings on id, with a
                         ``has_embedding`` flag (a missing id is reported, not fatal).
* ``dimension_scores``   dot(candidate vector, each dimension vector).  The
                         dimension vectors (one per dimension, or one per
                         (JD, dimension)) are a bounded table gathered into one
                         scalar row, so the similarity is a per-row expression.
* ``encode``             text -> unit vectors with a caller-supplied encoder,
                         run per Arrow batch in ``mapInPandas`` (the model is
                         built once per Python worker).  ``HashEncoder`` is the
                         built-in deterministic stand-in; it equals the
                         relational ``hash_encode_grouped`` (one groupBy).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critrank.functions import vectors as vx
from critrank.functions.text import col_, py_tokens

def embedding_lookup(cands: DataFrame, emb: DataFrame, cand_id: str = "doc_id",
                     emb_id: str = "vec_id", emb_col: str = "embedding") -> DataFrame:
    e = emb.select(F.col(emb_id).alias("_eid"), vx.as_double_array(emb_col).alias("embedding"))
    out = cands.join(e, cands[cand_id] == e["_eid"], "left").drop("_eid")
    return out.withColumn("has_embedding", F.col("embedding").isNotNull())


def dimension_matrix(dim_vecs: DataFrame, n_dims: int, ordinal: str = "ordinal",
                     vec: str = "vec") -> Column:
    """Scalar ARRAY<ARRAY<DOUBLE>> indexed by dimension ordinal (NULL where absent)."""
    entries = dim_vecs.select(F.col(ordinal).cast("int").alias("k"),
                              vx.as_double_array(vec).alias("v"))
    m = entries.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    arr = F.array(*[F.try_element_at(F.col("m"), F.lit(i)) for i in range(n_dims)])
    return m.select(arr).scalar()


def similarity(matrix: Column, vec: Column) -> Column:
    """ARRAY<DOUBLE>: dot(vec, row) per matrix row; 0.0 when either side is missing."""
    return F.transform(matrix, lambda row: F.coalesce(vx.dot(row, vec), F.lit(0.0)))


def dimension_scores(cands: DataFrame, dim_vecs: DataFrame, n_dims: int,
                     vec_col: str = "embedding") -> DataFrame:
    """Add ``emb_scores`` ARRAY<DOUBLE>(n_dims) for JD-independent dimension vectors."""
    out = cands.withColumn("_dm", dimension_matrix(dim_vecs, n_dims))
    return out.withColumn("emb_scores", similarity(F.col("_dm"), F.col(vec_col))).drop("_dm")


def token_sums(tokens_col, dim: int) -> Column:
    """ARRAY<INT>(dim): how often each slot's tokens occur in an ARRAY<STRING>, with their signs; a null has none.

    Slots and signs are those of ``vx.token_bucket`` and ``vx.token_sign``; a batch's
    distinct tokens are hashed once.
    """
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def sums(lists: pa.Array) -> pa.Array:
        n = len(lists)
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        coded = lists.flatten().dictionary_encode()
        code = pc.fill_null(coded.indices, -1).to_numpy()
        row, code = row[code >= 0], code[code >= 0]
        raw = b"".join(hashlib.md5(t.encode("utf-8")).digest() for t in coded.dictionary.to_pylist())
        md5 = np.frombuffer(raw, np.uint8).reshape(-1, 16).astype(np.int64)
        slot = (md5[:, :4] @ np.array([1 << 24, 1 << 16, 1 << 8, 1])) % dim
        total = np.bincount(row * dim + slot[code], np.where(md5[:, 4] < 128, 1.0, -1.0)[code], n * dim)
        return pa.ListArray.from_arrays(np.arange(0, n * dim + 1, dim, np.int32), total.astype(np.int32))

    return sums(col_(tokens_col))


def hash_encode_grouped(df: DataFrame, keys: list[str], tokens_col: str, out: str = "vec",
                        dim: int = 64) -> DataFrame:
    """Feature-hash encode one token array per key (relational form of ``hash_vector``).

    A row's tokens are summed at once (``token_sums``) -> ONE groupBy(keys) with ``dim``
    sums over rows: whole-stage-codegen aggregation with map-side partial sums, no row
    per token.  Rows without tokens get the zero vector.  Sums of +-1 are exact, so the
    order of addition is irrelevant.
    """
    t = df.select(*keys, token_sums(tokens_col, dim).alias("_s"))
    g = t.groupBy(*keys).agg(*[F.sum(F.col("_s")[i]).cast("double").alias(f"_v{i}") for i in range(dim)])
    g = g.select(*keys, F.array(*[F.col(f"_v{i}") for i in range(dim)]).alias("_hv"))
    g = g.withColumn("_hn", vx.l2norm("_hv"))
    return g.withColumn(out, F.when(F.col("_hn") > 0, F.transform("_hv", lambda v: v / F.col("_hn")))
                        .otherwise(F.col("_hv"))).drop("_hv", "_hn")


# --- encoders ---------------------------------------------------------------
class HashEncoder:
    """Signed feature hashing of tokens into ``dim`` buckets, unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._cache: dict[str, tuple[int, float]] = {}

    def _slot(self, t: str) -> tuple[int, float]:
        s = self._cache.get(t)
        if s is None:
            h = hashlib.md5(t.encode("utf-8")).hexdigest()
            s = (int(h[:8], 16) % self.dim, 1.0 if int(h[8], 16) < 8 else -1.0)
            if len(self._cache) < 1_000_000:
                self._cache[t] = s
        return s

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        for i, text in enumerate(texts):
            for t in py_tokens(text or ""):
                b, s = self._slot(t)
                out[i, b] += s
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def encode(df: DataFrame, text_col: str, factory: Callable[[], object] | None = None,
           out_col: str = "vec", dim: int = 64, batch_size: int = 256,
           half_precision: bool = False) -> DataFrame:
    """Encode a text column to unit vectors per Arrow batch.

    ``factory()`` returns an object with ``encode(list[str]) -> ndarray[n, d]``;
    it is called once per Python worker process.  ``half_precision`` rounds
    through float16 as a compact store would.
    """
    factory = factory or (lambda: HashEncoder(dim))
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    holder: dict = {}

    def run(batches):
        model = holder.get("m")
        if model is None:
            model = holder["m"] = factory()
        for pdf in batches:
            vecs = []
            texts = pdf[text_col].fillna("").tolist()
            for i in range(0, len(texts), batch_size):
                v = np.asarray(model.encode(texts[i:i + batch_size]), dtype=np.float64)
                if half_precision:
                    v = v.astype(np.float16).astype(np.float64)
                vecs.extend(list(v))
            yield pdf.assign(**{out_col: pd.Series(vecs, index=pdf.index, dtype=object)})

    return df.mapInPandas(run, schema)
