"""Vector column expressions: dot products and a feature-hash encoder.

Spark 4.1 has no vector dot function for ARRAY columns, so the dot product is
``aggregate(zip_with(a, b, *), 0D, +)`` in DOUBLE (FLOAT arrays are cast first).
It sums left to right, the same order as a sequential loop.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from critrank.functions.text import col_


def as_double_array(c) -> Column:
    return col_(c).cast("array<double>")


def dot(a, b) -> Column:
    """Dot product of two numeric arrays (NULL if either is NULL)."""
    prod = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y)
    return F.aggregate(prod, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def l2norm(a) -> Column:
    return F.sqrt(F.aggregate(as_double_array(a), F.lit(0.0), lambda acc, v: acc + v * v))


def unit(a) -> Column:
    """Scale to unit length; the zero vector stays zero."""
    n = l2norm(a)
    return F.when(n > 0, F.transform(as_double_array(a), lambda v: v / n)).otherwise(
        as_double_array(a))


# --- feature-hash encoder (a deterministic stand-in for a text encoder) -------
# token -> md5 hex; bucket = first 8 hex digits (as an integer) mod dim;
# sign = +1 when the 9th hex digit is 0-7, else -1.  vector = unit(sum of signs).
def token_bucket(t: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dim))


def token_sign(t: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(t), 9, 1), 16, 10).cast("int") < 8,
                  F.lit(1.0)).otherwise(F.lit(-1.0))


def hash_vector(tokens_col, dim: int = 64) -> Column:
    """Un-normalised feature-hash vector of an ARRAY<STRING> of tokens.

    One pass over the tokens: each token is hashed once (the input array of
    ``aggregate`` is evaluated once), then added into a ``dim``-slot
    accumulator.  Meant for short texts (dimension texts, queries);
    corpus-scale encoding uses ``operators.vectors.encode`` (Arrow batches).
    """
    hashed = F.transform(col_(tokens_col),
                         lambda t: F.struct(token_bucket(t, dim).cast("int").alias("b"),
                                            token_sign(t).alias("s")))
    return F.aggregate(hashed, F.array_repeat(F.lit(0.0), dim),
                       lambda acc, h: F.transform(acc, lambda x, i: x + F.when(i == h["b"], h["s"])
                                                  .otherwise(F.lit(0.0))))
