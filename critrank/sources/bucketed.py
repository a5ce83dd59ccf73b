"""Tables bucketed by id: joins on the id without a shuffle.

Bucketing pays the shuffle once, when a table is written.  Afterwards a join of two
tables with the same id type and bucket count reads bucket against bucket, and a join
with any other rows shuffles those rows only.

    emb = write_bucketed(embeddings, "emb", "vec_id", 512)
    feats = features.build_bucketed(cands, catalog, "feats", 512, embeddings=emb)
    ranking.rank(feats, weights, catalog)   # moves survivors, never features

A bucket is one task's work in such a join: take as many buckets as the table has
times the size that a task may hold (about 128 MB).  Rows without an id are all in one
bucket: they never join, so keep them out where they are many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bucketed(df: DataFrame, table: str, id_col: str, buckets: int, path: str | None = None,
                   mode: str = "error") -> DataFrame:
    """Write ``df`` as ``table`` in ``buckets`` files by ``id_col``, sorted by it, and read it back.

    Rows are shuffled once, unless they come from a join of tables bucketed alike: Spark
    finds them dealt out already and drops the shuffle.
    ``path`` makes an external table there.  ``mode='append'`` adds files to the
    buckets of a table that has the same id and count (any other is an error).
    """
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    spark = df.sparkSession
    if mode == "append" and spark.catalog.tableExists(table) and bucketing(spark, table) != (id_col, buckets):
        raise ValueError(f"{table} isn't bucketed by {id_col} into {buckets}")
    out = df.repartition(buckets, F.col(id_col)).write.format("parquet").mode(mode).bucketBy(buckets, id_col).sortBy(id_col)
    (out.option("path", path) if path else out).saveAsTable(table)
    return spark.table(table)


def bucketing(spark: SparkSession, table: str) -> tuple[str, int] | None:
    """(id column, buckets) of a table bucketed by one column, else None."""
    found = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    columns = found.get("Bucket Columns", "").strip("[]").replace("`", "")
    if not columns or "," in columns:
        return None
    return columns, int(found["Num Buckets"])
