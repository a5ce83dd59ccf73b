"""Top-k and ranking.

Order is always (score DESC, id ASC): ties resolve by ascending id, which
makes results independent of partitioning.

* ``topk``            one ranking: ORDER BY ... LIMIT k (TakeOrderedAndProject:
                      each task keeps k rows, the driver merges k x tasks).
* ``topk_per_group``  many rankings: ``row_number() <= k`` over a window
                      partitioned by the group; Spark inserts a partial
                      WindowGroupLimit before the shuffle, so at most
                      k rows per group per task cross the network; ``salts``
                      splits the merge of a group as well.
* ``rank_rows``       consecutive rank 1..n per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Parts in which a group is merged first.
SALTS = 32


def _order(score: str, id_col: str):
    return [F.col(score).desc(), F.col(id_col).asc()]


def topk(df: DataFrame, k: int, score: str = "score", id_col: str = "doc_id") -> DataFrame:
    return df.orderBy(*_order(score, id_col)).limit(k)


def topk_per_group(df: DataFrame, k: int, group: str | list[str], score: str = "score",
                   id_col: str = "doc_id", rank_col: str = "rank", salts: int = 1) -> DataFrame:
    """The first ``k`` rows of each group; with ``salts``, merged in two stages.

    The first stage merges each group in ``salts`` parts, dealt by task: a task's rows
    of a group stay together, so it passes on k of them at most, and one group's rows
    from very many tasks don't meet in one.  The second stage sees k x salts rows of a
    group at most.  The order is total, so the parts make no difference to the result.
    """
    groups = [group] if isinstance(group, str) else list(group)
    if salts > 1:
        part = Window.partitionBy(*groups, "_salt").orderBy(*_order(score, id_col))
        df = (df.withColumn("_salt", F.spark_partition_id() % F.lit(salts))
              .withColumn("_at", F.row_number().over(part)).filter(F.col("_at") <= k).drop("_salt", "_at"))
    w = Window.partitionBy(*groups).orderBy(*_order(score, id_col))
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def rank_rows(df: DataFrame, group: str | list[str] | None, score: str = "score",
              id_col: str = "doc_id", rank_col: str = "rank") -> DataFrame:
    """Consecutive ranks.  ``group=None`` ranks one table (use on bounded inputs)."""
    groups = [] if group is None else ([group] if isinstance(group, str) else list(group))
    w = Window.partitionBy(*groups).orderBy(*_order(score, id_col)) if groups else \
        Window.orderBy(*_order(score, id_col))
    return df.withColumn(rank_col, F.row_number().over(w))
