"""Stored BM25 index: postings in blocks of documents, and a top-k that skips blocks.

Layout below the index path, one ``segment=<n>`` folder for each build or append

    postings   (term, block, n, max_tf, min_dl, docs[], tfs[], dls[]), sorted by
               (term, block); a block has ``BLOCK_DOCS`` documents at most, so a term
               that is in every document is many bounded rows, not one list
    terms      (term, df) of the segment, sorted by term
    corpus     one row: n_docs and total_length of the segment, and mean_idf over
               everything up to and including it

An append writes a new segment from the new documents alone.  Document frequencies,
counts and lengths are additive, so the statistics of the whole are sums over
segments; only the mean idf is taken anew, over the vocabulary.

Top-k.  A term's share of a score grows with tf and falls with the document's
length, so (max_tf, min_dl) of a row bound the share of every document in it, and
the sum over a query's terms bounds every score of a block, whatever N and avgdl are
by then.  The blocks with the best bounds that surely hold k documents are scored
first; their k-th score is a threshold, and only blocks whose bound reaches it are
read after that.  Filters on ``term`` are equalities, so Parquet reads the row
groups of the query's terms only, and the bounds read no lists.

Results: documents with at least one query term, by (score DESC, id ASC).  A null
text has no tokens and counts as a document of length 0.  Ids must be unique: the
scores of rows with one id would be added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critrank.functions.tokens import token_runs
from critrank.operators import bm25
from critrank.operators.topk import SALTS, topk_per_group
from critrank.session import materialize

#: Documents of a block at most.
BLOCK_DOCS = 4096
#: Bounds are raised by this share, above the rounding of any sum.
SLACK = 1e-9
#: Small row groups and pages, so that a term's rows are read without many others.
SMALL_PIECES = {"parquet.block.size": str(16 << 20), "parquet.page.row.count.limit": "1024"}


def block_rows(docs: DataFrame, id_col: str, text_col: str, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Posting rows of ``docs``, and for each block a row without term: its documents and their length."""
    kind = docs.schema[id_col].dataType
    out = T.StructType([
        T.StructField("term", T.StringType()), T.StructField("block", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("max_tf", T.IntegerType()), T.StructField("min_dl", T.IntegerType()),
        T.StructField("length", T.LongType()), T.StructField("docs", T.ArrayType(kind)),
        T.StructField("tfs", T.ArrayType(T.IntegerType())), T.StructField("dls", T.ArrayType(T.IntegerType()))])

    def rows_of(batch: pa.RecordBatch, block: int) -> list[pa.RecordBatch]:
        ids = batch.column("id")
        tokens, dl = token_runs(batch.column("text"))
        coded = tokens.dictionary_encode()
        row = np.repeat(np.arange(len(dl)), dl)
        key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(dl) + row, return_counts=True)
        code, row = key // len(dl), key % len(dl)
        cuts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(key) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(key)) if len(key) else cuts
        tf, length = tf.astype(np.int32), dl[row]
        offsets = pa.array(np.append(cuts, len(key)).astype(np.int32))
        m = len(cuts)

        def lists(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(offsets, values)
        names = ["term", "block", "n", "max_tf", "min_dl", "length", "docs", "tfs", "dls"]
        whole = pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.string()), pa.array([block]), pa.array([len(dl)]), pa.nulls(1, pa.int32()),
             pa.nulls(1, pa.int32()), pa.array([int(dl.astype(np.int64).sum())]), pa.nulls(1, pa.list_(ids.type)),
             pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32()))], names=names)
        if not m:
            return [whole]
        terms = coded.dictionary.take(pa.array(code[cuts]))
        return [whole, pa.RecordBatch.from_arrays(
            [terms.cast(pa.string()), pa.array(np.full(m, block)), pa.array((ends - cuts).astype(np.int64)),
             pa.array(np.maximum.reduceat(tf, cuts)), pa.array(np.minimum.reduceat(length, cuts)),
             pa.nulls(m, pa.int64()), lists(ids.take(pa.array(row))), lists(pa.array(tf)), lists(pa.array(length))],
            names=names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, block_docs):
                yield from rows_of(batch.slice(a, block_docs), block)
                block += 1

    # tokens are found in the task: as lists of strings they would cost more to hand over than to find
    return docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text")).mapInArrow(run, out)


def any_of(column: str, values: list[str]) -> Column:
    """column = v1 or column = v2 ...: unlike a long IN list, pushed to Parquet value by value."""
    return reduce(lambda a, b: a | b, [F.col(column) == v for v in values], F.lit(False))


class PostingsIndex:
    """A stored index; ``build``, ``append`` to it, ``open`` it, ask for ``topk`` or ``idf``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # ------------------------------------------------------------------ writing
    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str, path: str,
              block_docs: int = BLOCK_DOCS) -> PostingsIndex:
        """Write a new index; there must be none at ``path``."""
        index = cls(docs.sparkSession, path)
        index._segment(docs, id_col, text_col, 0, block_docs)
        return index

    def append(self, docs: DataFrame, id_col: str, text_col: str, block_docs: int = BLOCK_DOCS) -> PostingsIndex:
        """Add documents (with ids that the index doesn't have) as a new segment."""
        last = self._read("corpus").agg(F.max("segment")).first()[0]
        self._segment(docs, id_col, text_col, last + 1, block_docs)
        return self

    def _segment(self, docs: DataFrame, id_col: str, text_col: str, n: int, block_docs: int) -> None:
        # written once before it is dealt out by range, or sampling would read the texts twice
        rows = materialize(block_rows(docs, id_col, text_col, block_docs), "postings")
        posted = rows.where("term is not null").drop("length")
        (posted.repartitionByRange("term", "block").sortWithinPartitions("term", "block")
         .write.options(**SMALL_PIECES).mode("error").parquet(f"{self.path}/postings/segment={n}"))
        (posted.groupBy("term").agg(F.sum("n").alias("df")).repartitionByRange("term").sortWithinPartitions("term")
         .write.options(**SMALL_PIECES).mode("error").parquet(f"{self.path}/terms/segment={n}"))
        own = rows.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"),
                                             F.coalesce(F.sum("length"), F.lit(0)).alias("total_length"))
        before = self._read("corpus").agg(F.sum("n_docs")).first()[0] if n else 0
        n_docs = before + own.first()[0]
        mean = self.terms().agg(F.avg(bm25.idf_expr(F.col("df").cast("double"), F.lit(float(n_docs)))).alias("mean_idf"))
        # the corpus row is written last: a segment without it isn't part of the index
        own.crossJoin(mean).coalesce(1).write.mode("error").parquet(f"{self.path}/corpus/segment={n}")  # one row each

    # ------------------------------------------------------------------ reading
    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PostingsIndex:
        return cls(spark, path)

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def terms(self, wanted: list[str] | None = None) -> DataFrame:
        """(term, df) over all segments; with ``wanted``, of those terms only."""
        rows = self._read("terms")
        if wanted is not None:
            rows = rows.where(any_of("term", wanted))
        return rows.groupBy("term").agg(F.sum("df").alias("df"))

    def corpus(self) -> DataFrame:
        """One row: n_docs, avgdl, mean_idf."""
        return self._read("corpus").agg(
            F.sum("n_docs").alias("n_docs"),
            F.try_divide(F.sum("total_length").cast("double"), F.sum("n_docs").cast("double")).alias("avgdl"),
            F.max_by("mean_idf", "segment").alias("mean_idf"))

    def idf(self, wanted: list[str], eps: float = bm25.EPS) -> DataFrame:
        """(term, df, idf_raw, idf) of the wanted terms that occur."""
        return bm25.idf_table(self.terms(wanted), self.corpus(), eps)

    def topk(self, queries: dict[str, list[str]], k: int, k1: float = bm25.K1, b: float = bm25.B,
             eps: float = bm25.EPS) -> tuple[DataFrame, DataFrame]:
        """((query, doc_id, score, rank), (query, blocks, blocks_read)): the k best documents of each query.

        ``queries``: tokens of each query, repeats count again.
        """
        spark = self.spark
        terms = sorted({t for q in queries.values() for t in q})
        asked = spark.createDataFrame(
            [(name, t, [i for i, x in enumerate(q) if x == t]) for name, q in queries.items() for t in sorted(set(q))],
            "query string, term string, at array<int>")
        # as many rows as the queries have different terms
        weights = F.broadcast(materialize(asked.join(self.idf(terms, eps).select("term", "idf"), "term"), "query-terms"))
        avgdl = self.corpus().first()["avgdl"] or 1.0
        rows = self._read("postings").where(any_of("term", terms))

        def share(tf: Column, dl: Column) -> Column:
            norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl.cast("double") / F.lit(avgdl))
            return (tf.cast("double") * (k1 + 1.0)) / (tf.cast("double") + norm)

        most = F.size("at") * F.greatest(F.col("idf"), F.lit(0.0)) * share(F.col("max_tf"), F.col("min_dl"))
        bounds = materialize(
            rows.select("segment", "block", "term", "n", "max_tf", "min_dl").join(weights, "term")
            .groupBy("query", "segment", "block").agg((F.sum(most) * (1 + SLACK)).alias("bound"), F.max("n").alias("n"))
            .withColumn("id", F.struct("segment", "block")), "bounds")

        def scored(blocks: DataFrame) -> DataFrame:
            hit = (rows.join(weights, "term").join(blocks.select("query", "segment", "block"), ["query", "segment", "block"])
                   .select("query", "idf", "at", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p")))
            one = F.col("idf") * share(F.col("p.tfs"), F.col("p.dls"))
            per = (hit.select("query", F.col("p.docs").alias("doc_id"), F.transform(
                "at", lambda i: F.struct(i.alias("i"), one.alias("x"))).alias("xs"))
                .groupBy("query", "doc_id").agg(F.collect_list("xs").alias("xs")))  # a document's query terms
            total = F.aggregate(F.array_sort(F.flatten("xs")), F.lit(0.0), lambda s, x: s + x["x"])
            best = per.select("query", "doc_id", total.alias("score"))
            return materialize(topk_per_group(best, k, "query", "score", "doc_id", "rank", salts=SALTS), "scored")

        # the first blocks: as many of the best bounds as surely hold k documents
        best = topk_per_group(bounds, k, "query", "bound", "id", "at", salts=SALTS)
        before = F.sum("n").over(_window("query", "at", -1))
        first = materialize(best.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k)
                            .select("query", "segment", "block"), "first-blocks")  # k rows of a query at most
        found = scored(first)
        least = found.where(F.col("rank") == k).select("query", F.col("score").alias("least"))  # a row for each query
        rest = materialize(
            bounds.join(first, ["query", "segment", "block"], "left_anti").join(F.broadcast(least), "query", "left")
            .where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select("query", "segment", "block"), "more-blocks")
        both = found.unionByName(scored(rest)).drop("rank")
        report = (bounds.groupBy("query").agg(F.count(F.lit(1)).alias("blocks"))
                  .join(first.unionByName(rest).groupBy("query").agg(F.count(F.lit(1)).alias("blocks_read")), "query"))
        return topk_per_group(both, k, "query", "score", "doc_id", "rank"), report


def _window(group: str, order: str, end: int):
    from pyspark.sql import Window
    return Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
