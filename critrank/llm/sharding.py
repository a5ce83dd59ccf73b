"""Sharding: a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of key columns; a keyed Feistel network
permutes the numbers, walking along its cycle until the value falls below n
again.  The permuted number v gives shard ``v % shards`` and slot
``v // shards``: counts are at most one apart and slots are gapless.  Where
row r went, and which row sits in a shard's slot, can be computed from
(n, seed) alone.

Defined results: a null key sorts first; repeated rows get numbers of their
own; an empty table gives an empty result; extra columns stay, but an input
column named like an output column is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import mix, number_rows

ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _round_keys(seed: int) -> list[np.uint64]:
    return [mix(np.array([seed * 2654435761 + r + 1], np.uint64))[0] for r in range(ROUNDS)]


def _feistel(x: np.ndarray, bits: int, keys: list[np.uint64]) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for key in keys:
        left, right = right, left ^ (mix(right ^ key) & mask)
    return (right << shift) | left


def _walk(x: np.ndarray, n: int, seed: int, inverse: bool) -> np.ndarray:
    # halves are exchanged after the last round, so the inverse is the same
    # network with its keys in reverse order
    bits, keys = _half_bits(n), _round_keys(seed)
    keys = keys[::-1] if inverse else keys
    out = _feistel(x.astype(np.uint64), bits, keys)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _feistel(out[outside], bits, keys)
    return out.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places (0..n-1) of row numbers (0..n-1)."""
    return _walk(np.asarray(rows), n, seed, False)


def unpermute(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Row numbers of places; the inverse of ``permute``."""
    return _walk(np.asarray(places), n, seed, True)


def shard_rows(df: DataFrame, order: list[str], shards: int, seed: int = 20) -> DataFrame:
    """``df`` with ``row_number``, ``shard`` and ``slot`` (all computed from the row's number)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    clash = [c for c in df.columns if c.lower() in ("row_number", "shard", "slot")]
    numbered, n = number_rows(df.drop(*clash), order, "row_number", "shard")

    @F.pandas_udf(LongType())
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return (numbered.withColumn("_place", place("row_number"))
            .withColumn("shard", (F.col("_place") % shards).cast("int"))
            .withColumn("slot", F.expr(f"_place div {shards}")).drop("_place"))


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: size, CRC-32 of the text, law, shard and slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard_rows(rows, ["doc_id", "size", "text_crc32"], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
