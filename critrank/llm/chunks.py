"""Chunks of documents that ask a distributed table, and get answers.

A chunk is a block of whole documents, compressed into one row.  Each chunk
asks for its distinct keys only, split into buckets by key: a question is one
row (bucket, chunk, blob).  A bucket sees all questions for its keys, and
answers each chunk in the order it asked.  So a key travels once for each chunk
that has it, however often it occurs there, and neither keys nor documents are
gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, join_words, pack, partitions, runs, save, unpack

CHUNK_BYTES = 6 << 20
TALK = "chunk long, bucket int, blob binary"
_TALK = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])


class Chunk:
    """The documents of a chunk: ids (as objects, null allowed), flags and texts."""

    def __init__(self, blob: bytes):
        ids, known, self.flag, lengths, text = unpack(blob)
        self.ids = pa.array(ids, mask=known == 0)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        self.texts = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offsets), pa.py_buffer(text))

    @staticmethod
    def of(table: pa.Table, level: int | None = None) -> bytes:
        texts = pc.fill_null(table.column("text").combine_chunks().cast(pa.large_string()), "")
        ids = table.column("doc_id").combine_chunks()
        lengths = pc.binary_length(texts).to_numpy().astype(np.int64)
        joined = join_words(np.array([0, len(texts)]), texts, "")[0].as_py()
        return pack(pc.fill_null(ids, 0).to_numpy().astype(np.int64), ids.is_valid().to_numpy(False).astype(np.uint8),
                    table.column("flag").to_numpy().astype(np.uint8), lengths,
                    np.frombuffer(joined.encode(), np.uint8), level=level)


def chunk_table(docs: DataFrame, flag=None, size: int | None = None, name: str = "chunks",
                level: int | None = None) -> DataFrame:
    """(chunk, blob): ``docs`` (doc_id, text) and a flag of each row, in blocks of ``size`` bytes (``CHUNK_BYTES``).

    ``level``: of compression.
    """

    size = size or CHUNK_BYTES
    flag = F.lit(False) if flag is None else flag

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, table in enumerate(blocks(batches, "text", size)):
            yield pa.record_batch([pa.array([part << 32 | k]), pa.array([Chunk.of(table, level)], pa.binary())],
                                  names=["chunk", "blob"])

    return save(docs.select(F.col("doc_id").cast("long"), "text", flag.alias("flag"))
                .mapInArrow(run, "chunk long, blob binary"), name)


def deal(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts keys in their buckets, and where each bucket starts in it."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))


def deal_ascending(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``deal``, with the keys of a bucket in ascending order."""
    order = np.argsort(keys, kind="stable")
    inner, starts = deal(keys[order], buckets)
    return order[inner], starts


def squeeze(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending keys of one bucket, as few bits as their largest step needs.

    A bucket knows a key by its quotient, and a quotient by its step from the one before.
    """
    steps = np.diff(keys // np.uint64(buckets), prepend=np.uint64(0))
    width = max(1, int(steps.max(initial=0)).bit_length())
    bits = np.unpackbits(steps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=width)
    return np.concatenate(([np.uint8(width)], np.packbits(bits.ravel(), bitorder="little")))


def expand(packed: np.ndarray, n: int) -> np.ndarray:
    """The quotients of ``n`` squeezed keys: equal for equal keys of a bucket."""
    width = int(packed[0])
    bits = np.unpackbits(packed[1:], bitorder="little", count=n * width).reshape(n, width)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :(width + 7) // 8] = np.packbits(bits, axis=1, bitorder="little")
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def n_buckets(chunks: DataFrame) -> int:
    """A bucket for each chunk: its share of keys grows no more than a chunk's."""
    return max(partitions(chunks.sparkSession), chunks.count())


def ask(chunks: DataFrame, question: Callable[[int, Chunk], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Questions of all chunks: ``question(chunk id, chunk)`` yields (bucket, blob)."""

    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
                found = list(question(chunk, Chunk(blob.as_py())))
                yield pa.record_batch([pa.array([chunk] * len(found), pa.int64()),
                                       pa.array([b for b, _ in found], pa.int32()),
                                       pa.array([x for _, x in found], pa.binary())], schema=_TALK)

    return chunks.mapInArrow(run, TALK)


def answer(asked: DataFrame, buckets: int, reply: Callable[[list[int], list[bytes]], list[tuple[int, bytes]]]) -> DataFrame:
    """Answers of all buckets: ``reply(chunk ids, blobs)`` gives (chunk id, blob)."""

    def run(batches):
        for bucket, table in runs(batches, "bucket"):
            found = reply(table.column("chunk").to_pylist(), [b.as_py() for b in table.column("blob")])
            yield pa.record_batch([pa.array([c for c, _ in found], pa.int64()),
                                   pa.array([int(bucket)] * len(found), pa.int32()),
                                   pa.array([x for _, x in found], pa.binary())], schema=_TALK)

    return asked.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "chunk").mapInArrow(run, TALK)


def meet(chunks: DataFrame, answers: DataFrame, act: Callable[[int, Chunk, dict[int, bytes]], Iterator[pa.RecordBatch]],
         schema: str, parts: int | None = None) -> DataFrame:
    """``act(chunk id, chunk, blob of each bucket)`` on every chunk with its answers.

    ``parts``: the number of parts that chunks are dealt to (the session's unless given).
    """
    kinds = chunks.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        own = {b: x.as_py() for b, x in zip(right.column("bucket").to_pylist(), right.column("blob"))}
        for chunk, blob in zip(left.column("chunk").to_pylist(), left.column("blob")):
            out.extend(act(chunk, Chunk(blob.as_py()), own))
        return pa.Table.from_batches(out, schema=arrow) if out else arrow.empty_table()

    if parts:
        chunks, answers = chunks.repartition(parts, "chunk"), answers.repartition(parts, "chunk")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, kinds)
