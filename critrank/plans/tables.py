"""Adapters from the driver's tables to the ranking's data model.

| ranking notion          | table(s)                                             |
|-------------------------|------------------------------------------------------|
| candidate (id, text)    | documents(doc_id, text)                              |
| candidate profile       | title = source, years = (n_chars div 100) / 10,      |
|                         | employers = [source], open_to_work = labels.quality=1|
|                         | response rate = 0.5*quality + 0.25*(1-toxic), or -1  |
|                         | when the document has no label (no history)          |
| JD paragraphs (many JDs)| conversations: one JD per conv_id; paragraphs are the|
|                         | stripped non-empty lines of each turn, ordered by    |
|                         | (turn, line): para_no = turn * 2^31 + line           |
| candidate embeddings    | embeddings(vec_id = doc_id, embedding)               |
| dimension vectors       | lowest vec_id of each label; label = dim ordinal     |
| nested candidate record | documents: lines are jobs, words of line 1 are skills|

Years are derived with one decimal so that ``%.1f`` prints them exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critrank.functions import text as tx

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
#: A text has fewer lines than an array has places, so turns never overlap.
PARA_STRIDE = 1 << 31


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    labels = read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("_lid"), "quality", "toxic")
    j = docs.join(labels, docs["doc_id"] == labels["_lid"], "left")
    rate = F.when(F.col("_lid").isNull(), F.lit(-1.0)).otherwise(
        F.col("quality").cast("double") * 0.5 + (1 - F.col("toxic")).cast("double") * 0.25)
    return j.select(
        "doc_id", "text",
        F.col("source").alias("title"),
        (F.floor(F.col("n_chars") / 100).cast("double") / 10.0).alias("years"),
        F.array(F.col("source")).alias("employers"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("open_to_work"),
        rate.alias("response_rate"))


def jd_paragraphs(spark: SparkSession, sf_dir: str, keep_blank: bool = False) -> DataFrame:
    """``keep_blank``: blank lines stay, so that a JD of blank text alone is known (weights 0)."""
    conv = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    lines = conv.select("conv_id", "turn", F.posexplode(F.split(F.col("text"), "\n")))
    return (lines.select(F.col("conv_id").alias("jd_id"),
                         (F.col("turn").cast("bigint") * PARA_STRIDE + F.col("pos")).alias("para_no"),
                         tx.strip(F.col("col")).alias("text"))
            .filter(F.lit(keep_blank) | (F.col("text") != "")))


def dimension_vectors(spark: SparkSession, sf_dir: str, n_dims: int) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    return (emb.filter(F.col("label") < n_dims).groupBy("label")
            .agg(F.min_by("embedding", "vec_id").alias("vec"))
            .select(F.col("label").alias("ordinal"), F.col("vec").cast("array<double>")))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
