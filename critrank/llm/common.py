"""Helpers shared by the training-data operators.

* ``save``: an intermediate table under ``spark.checkpoint.dir``.
* ``flat_words`` and ``hash_strings``: word splitting on Arrow columns, used
  inside ``mapInArrow`` tasks.
* ``number_rows``: global, reproducible row numbers without a global window.
* ``components``: connected components of a link table by star contraction.
* ``blocks`` / ``pack`` / ``unpack``: bounded blocks of rows inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from critrank.session import materialize


def save(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and reread it.

    ``critrank.temporary_tables`` deletes such tables when their results are written.
    """
    return materialize(df, f"llm-{name}", codec=codec)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores until no column of ``taken`` has it (in any case)."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns under names of their own, so that no helper column clashes; {column: name}."""
    names = {c: f"own_{n}" for n, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(names[c]) for c in df.columns]), names


def bare(df: DataFrame, names: dict[str, str], *more: str) -> DataFrame:
    """The way back from ``shielded``, with the columns ``more`` behind."""
    return df.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()], *more)


# -------------------------------------------------------------------- words
def lower_ascii(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(texts)


def flat_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a string column.

    Returns (offsets, words): the words of row i are
    ``words[offsets[i]:offsets[i + 1]]``.  A null text has no words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy()
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # a blank at either end of a text leaves an empty piece
        kept = np.concatenate(([0], np.cumsum(full)))
        words, offsets = words.filter(pa.array(full)), kept[offsets]
    return offsets.astype(np.int64), words


def hash_strings(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each string, as uint64."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(s, seed) for s in strings.cast(pa.large_binary()).to_pylist()),
                       np.uint64, len(strings))


def join_words(offsets: np.ndarray, words: pa.Array, by: str = " ") -> pa.Array:
    """The words of each row, joined: the way back from ``flat_words``."""
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words.cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(by, pa.large_string()))


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each word; every distinct word of the column is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    return hash_strings(coded.dictionary, seed)[coded.indices.to_numpy()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes of a flat column.

    Runs that cross from one text to the next are included; callers mask them.
    """
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mix(out + words[k:k + m] + np.uint64(k + 1))
    return out


# ------------------------------------------------------------ bounded blocks
def blocks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.Table]:
    """Regroup a task's batches into tables of about ``max_bytes`` of ``column``.

    Blocks hold whole rows; a single text above the bound is a block of its own.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False).astype(np.int64) + 64
        start = 0
        ends = np.cumsum(lengths)
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + max_bytes - size, side="right"))
            stop = min(max(stop, start if size else start + 1), batch.num_rows)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - base)
            if stop < batch.num_rows or size >= max_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            start = stop
    if held:
        yield pa.Table.from_batches(held)


def pack(*arrays: np.ndarray, level: int | None = None) -> bytes:
    """Arrays of numbers as one compressed value (``level``: the codec's own unless given)."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    raw = len(head).to_bytes(4, "little") + head + b"".join(
        np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", level).compress(raw, asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    raw = pa.decompress(value[8:], int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for part in raw[4:at].decode().split(";"):
        kind, n = part.split(",")
        kind = np.dtype(kind)
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += int(n) * kind.itemsize
    return out


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Groups of consecutive rows with the same ``key`` (rows sorted by it)."""
    now, held = None, []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and keys[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


# -------------------------------------------------------------- row numbers
def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def number_rows(df: DataFrame, order: list[str], number: str, name: str) -> tuple[DataFrame, int]:
    """Add global row numbers 0, 1, 2, ... in ascending ``order`` (nulls first).

    The rows are dealt out by range, sorted in each partition and written
    once; a row's number is its place in its partition plus the rows of the
    partitions before it.  Only one count for each partition meets in a
    window.  A spreading key ends the order, so that many repeated rows don't
    meet in one partition.  Returns (numbered rows, their count).
    """
    spark = df.sparkSession
    mine = df.withColumn("_rn_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in order] + [F.col("_rn_tie").asc()]
    placed = save(mine.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
                  .drop("_rn_tie").withColumn("_rn_at", F.monotonically_increasing_id()), name, "zstd")  # whole rows
    part = F.shiftright("_rn_at", 33)
    counts = placed.groupBy(part.alias("_rn_part")).agg(F.count(F.lit(1)).alias("_rn_rows"))
    before = Window.orderBy("_rn_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_rn_part", F.coalesce(F.sum("_rn_rows").over(before), F.lit(0)).alias("_rn_start"))
    total = counts.agg(F.sum("_rn_rows")).first()[0] or 0
    # one row for each range partition: as many as spark.sql.shuffle.partitions at most
    numbered = (placed.withColumn("_rn_part", part).join(F.broadcast(starts), "_rn_part")
                .withColumn(number, F.col("_rn_start") + F.col("_rn_at").bitwiseAND(F.lit((1 << 33) - 1)))
                .select(*df.columns, number))
    return numbered, total


# --------------------------------------------------------------- components
def _is_stars(links: DataFrame) -> bool:
    """Whether every node has one link down, to a node without any."""
    ends = (links.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("centre"))
            .union(links.select(F.col("b"), F.lit(0), F.lit(1))))
    return not (ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("centre").alias("centre"))
                .where("down > 1 or down > 0 and centre > 0").limit(1).count())


def components(links: DataFrame, name: str) -> DataFrame:
    """Connected components: (node, root), root = the smallest node reachable.

    ``links`` has columns ``a``, ``b`` (any integers, either order, repeats
    allowed).  The result has every node that isn't the root of its component.
    Rounds of large-star and small-star steps, each one written table, until every
    component is a star around its smallest node.  No star is gathered in one place:
    each step is a ``min`` per node and a join back.
    """
    now = save(links.where("a <> b")
               .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _is_stars(now):
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        # small star: every smaller neighbour, and the node, go to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = save(small, name)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
