"""Rounds of exact integer k-means, shared by centroid clustering and vector codes.

Vectors are integers (``floor(scale * x)``), cut into equal consecutive parts, and
each part has a codebook (a centroid table).  A round is one scan: every task looks
its vectors up through the caller's search structure and passes on one row of sums
for each entry that it met; the sums meet by entry, and the new codebook comes to
the driver.  Codebooks are bounded by parameters (parts x entries x width numbers)
and travel with the tasks; vectors stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save

#: Components beyond this count as this, so that squared distances fit 64 bits.
LIMIT = 1 << 24
#: Vectors that a task searches at a time.
STEP = 16384
#: Buckets of a counting pass of ``smallest``, and how many times k rows may be left to sort.
BUCKETS, SPARE = 1024, 8


def integer_vectors(df: DataFrame, keep: list[str], vector: str, scale: int, dim: int, name: str) -> DataFrame:
    """(*keep, v ARRAY<INT>): floor(scale * x) of each usable vector, written once.

    Usable: ``dim`` components, none null, NaN or infinite; other rows are left out.
    """
    out = T.StructType([*[df.schema[c] for c in keep], T.StructField("v", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_vector")
            fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
            batch = batch.filter(fits)
            if not batch.num_rows:
                continue
            flat = batch.column("_vector").flatten().cast(pa.float64(), safe=False)
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
            sound = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                v = np.clip(np.floor(x[sound] * scale), -LIMIT, LIMIT).astype(np.int32)
            batch = batch.filter(pa.array(sound))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dim), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], names=[*keep, "v"])

    return save(df.select(*keep, F.col(vector).alias("_vector")).mapInArrow(run, out), name)


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as int64 rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def smallest(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows by ``order``, which begins with the integer column ``key`` (nulls last).

    Counting passes over ranges of the key narrow the rows down first, so that not
    every task has k rows to send: each pass keeps every row up to the range in which
    the k-th lies, until few are left or that range is one value.
    """
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if n < k:
        return df.orderBy(*order).limit(k)
    below = 0  # rows under ``low``; the k-th lies from ``low`` to ``high``
    while n > SPARE * k and low < high:
        width = (high - low) // BUCKETS + 1
        place = F.expr(f"cast((cast(`{key}` as decimal(20, 0)) - {low}) div {width} as int)")
        counts = dict(df.where(F.col(key).between(low, high)).groupBy(place.alias("b")).count().collect())
        for b in sorted(counts):  # BUCKETS rows
            n = below + counts[b]
            if n >= k:
                break
            below = n
        low, high = low + b * width, min(high, low + (b + 1) * width - 1)
    return df.where(F.col(key) <= high).orderBy(*order).limit(k)


def _searches(books: list[np.ndarray], search: Callable) -> list:
    return [search(book) for book in books]


def _lookup(x: np.ndarray, searches: list) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each vector and part."""
    width = x.shape[1] // len(searches)
    found = [s.nearest(x[:, p * width:(p + 1) * width]) for p, s in enumerate(searches)]
    return np.stack([w for w, _ in found], 1), np.stack([d for _, d in found], 1)


def moved(table: DataFrame, books: list[np.ndarray], search: Callable) -> list[np.ndarray]:
    """The codebooks after one round: floor(sum / count) of each entry's parts; unused entries stay."""
    parts, (entries, width) = len(books), books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(books, search)
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = as_matrix(batch.column("v"), parts * width)
            for a in range(0, len(x), STEP):
                block = x[a:a + STEP]
                which, _ = _lookup(block, searches)
                for p in range(parts):
                    at = which[:, p] + p * entries
                    np.add.at(sums, at, block[:, p * width:(p + 1) * width])
                    counts += np.bincount(at, minlength=parts * entries)
        used = np.flatnonzero(counts)
        if len(used):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * width),
                                             pa.array(sums[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), lists],
                                             names=["at", "n", "s"])

    rows = (table.select("v").mapInArrow(run, "at int, n long, s array<long>").groupBy("at")
            .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s")).collect())
    out = [b.copy() for b in books]
    for r in rows:  # parts x entries rows at most
        out[r["at"] // entries][r["at"] % entries] = [s // r["n"] for s in r["s"]]
    return out


def assigned(table: DataFrame, keep: list[str], books: list[np.ndarray], search: Callable, name: str) -> DataFrame:
    """(*keep, entries ARRAY<INT>, error LONG): each vector's entries and summed squared distance, written once."""
    dim = len(books) * books[0].shape[1]
    out = T.StructType([*[table.schema[c] for c in keep], T.StructField("entries", T.ArrayType(T.IntegerType())),
                        T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(books, search)
        for batch in batches:
            x = as_matrix(batch.column("v"), dim)
            for a in range(0, len(x), STEP):
                which, d = _lookup(x[a:a + STEP], searches)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1, dtype=np.int32) * which.shape[1]),
                                                 pa.array(which.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, len(which)) for c in keep], lists, pa.array(d.sum(axis=1))],
                    names=[*keep, "entries", "error"])

    return save(table.select(*keep, "v").mapInArrow(run, out), name)


def decimal_text(books: list[np.ndarray]) -> str:
    """All entries' components as decimal integers, joined by commas: part, entry, position."""
    return ",".join(str(int(x)) for book in books for x in book.ravel())
