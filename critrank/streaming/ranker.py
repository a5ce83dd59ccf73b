"""M1: rank each arriving batch of candidates on its own (Structured Streaming).

Candidate files (JSONL, the candidate schema) land in a folder; every
micro-batch is ranked by itself, with its own BM25 statistics and its own
top-k, as an uploaded candidate set is.  ``foreachBatch`` runs the batch
ranker and writes ``<out>/batch_id=<n>`` with mode overwrite, so a replayed
batch (after a failure, from the checkpoint) rewrites the same folder:
the sink is idempotent.  The flow is stateless, so it needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from critrank.catalog import Catalog
from critrank.operators.records import to_candidates
from critrank.plans import features, ranking
from critrank.sources.schemas import candidate_schema
from critrank.session import temporary_tables


def rank_batch(batch: DataFrame, jd_weights: DataFrame, catalog: Catalog, k: int = 100,
               dim_vectors: DataFrame | None = None,
               embeddings: DataFrame | None = None) -> DataFrame:
    cands = to_candidates(batch)
    own = dim_vectors is not None and "jd_id" in dim_vectors.columns
    feats = features.build_features(cands, catalog, embeddings=embeddings,
                                    dim_vectors=None if own else dim_vectors)
    return ranking.rank(feats, jd_weights, catalog, dim_vectors if own else None, k=k)


def start(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str,
          jd_weights: DataFrame, catalog: Catalog, k: int = 100,
          dim_vectors: DataFrame | None = None, embeddings: DataFrame | None = None,
          available_now: bool = True, files_per_trigger: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(candidate_schema())
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.json(source_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        with temporary_tables(batch.sparkSession):
            ranked = rank_batch(batch, jd_weights, catalog, k, dim_vectors, embeddings)
            (ranked.select("jd_id", "doc_id", "rank", "score", "reasoning")
             .withColumn("batch_id", F.lit(batch_id))
             .write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}"))

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
