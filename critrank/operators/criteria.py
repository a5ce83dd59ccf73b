"""Job-description criteria: paragraph-to-dimension mapping and weights.

Input is a paragraph table ``(jd_id, para_no, text)`` holding many JDs at once.
The catalog is compiled into per-row expressions (one containment count per
dimension), so mapping paragraphs to dimensions needs no join; the weights
are one ``groupBy(jd_id)`` with decomposable sums (map-side partial
aggregation, so a JD holding a third of all paragraphs does not overload a
task).

Rules reproduced
----------------
* a paragraph maps to a dimension when at least one anchor (lower-cased) is a
  substring of the paragraph lower-cased with whitespace runs collapsed;
  hits = number of such anchors (each at most once per paragraph);
* a repeated paragraph counts again (identity is ``para_no``, not text);
* emphasis = points x number of emphasis phrases found in the mapped paragraph
  (lower-cased, whitespace *not* collapsed), summed over mapped paragraphs;
* score = paragraphs + hits + emphasis, 0 for unweighted dimensions;
  weight = score / total over the JD; a zero total leaves every weight 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critrank.catalog import Catalog
from critrank.functions import text as tx


def paragraph_hits(paras: DataFrame, catalog: Catalog, text_col: str = "text") -> DataFrame:
    """Add ``hits`` ARRAY<INT> (one per dimension, template order) and ``emph`` INT."""
    norm = tx.normalize_ws(text_col)
    low = F.lower(F.col(text_col))
    hits = F.array(*[tx.count_contained(norm, [a.lower() for a in d.anchors])
                     for d in catalog.dimensions])
    emph = tx.count_contained(low, catalog.emphasis)
    return paras.withColumn("hits", hits).withColumn("emph", emph)


def anchor_map(paras: DataFrame, catalog: Catalog) -> DataFrame:
    """Long form of the mapping: one row per (jd_id, para_no, dim) with hits > 0."""
    ph = paragraph_hits(paras, catalog)
    names = F.array(*[F.lit(n) for n in catalog.names])
    return (ph.select("jd_id", "para_no", "text", "emph",
                      F.posexplode(F.arrays_zip(names.alias("dim"), F.col("hits").alias("h"))))
            .select("jd_id", "para_no", "text", "emph", F.col("pos").alias("ordinal"),
                    F.col("col.dim").alias("dim"), F.col("col.h").alias("hits"))
            .filter(F.col("hits") > 0))


def jd_dimension_stats(paras: DataFrame, catalog: Catalog) -> DataFrame:
    """Wide per-JD statistics: arrays n_paragraphs, anchor_hits, emphasis, score, weight."""
    ph = paragraph_hits(paras, catalog)
    n = len(catalog.dimensions)
    aggs = []
    for i in range(n):
        h = F.col("hits")[i]
        aggs += [F.sum(F.when(h > 0, 1).otherwise(0)).alias(f"p{i}"),
                 F.sum(h).alias(f"h{i}"),
                 F.sum(F.when(h > 0, F.col("emph")).otherwise(0)).alias(f"e{i}")]
    g = ph.groupBy("jd_id").agg(*aggs)
    pts = catalog.emphasis_points
    scores = []
    for i, d in enumerate(catalog.dimensions):
        s = (F.col(f"p{i}") + F.col(f"h{i}") + F.col(f"e{i}") * pts).cast("bigint")
        scores.append(F.lit(0).cast("bigint") if d.name in catalog.unweighted else s)
    g = g.select(
        "jd_id",
        F.array(*[F.col(f"p{i}").cast("bigint") for i in range(n)]).alias("n_paragraphs"),
        F.array(*[F.col(f"h{i}").cast("bigint") for i in range(n)]).alias("anchor_hits"),
        F.array(*[(F.col(f"e{i}") * pts).cast("bigint") for i in range(n)]).alias("emphasis"),
        F.array(*scores).alias("score"))
    total = F.aggregate(F.col("score"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    weights = F.transform(F.col("score"), lambda s: F.when(total == 0, F.lit(0.0))
                          .otherwise(s.cast("double") / total.cast("double")))
    return g.withColumn("weight", weights)


def weights(paras: DataFrame, catalog: Catalog) -> DataFrame:
    """Long weights report: (jd_id, ordinal, dim, n_paragraphs, anchor_hits, emphasis, score, weight).

    JDs whose paragraphs map to no dimension still get one row per dimension
    with weight 0 (their paragraphs are in the input, so the JD is known).
    """
    wide = jd_dimension_stats(paras, catalog)
    names = F.array(*[F.lit(n) for n in catalog.names])
    z = F.arrays_zip(names.alias("dim"), F.col("n_paragraphs").alias("n_paragraphs"),
                     F.col("anchor_hits").alias("anchor_hits"),
                     F.col("emphasis").alias("emphasis"), F.col("score").alias("score"),
                     F.col("weight").alias("weight"))
    return (wide.select("jd_id", F.posexplode(z))
            .select("jd_id", F.col("pos").alias("ordinal"), "col.*"))


def weight_vectors(paras: DataFrame, catalog: Catalog) -> DataFrame:
    """(jd_id, weights ARRAY<DOUBLE>) in template order: the input of stage 1."""
    return jd_dimension_stats(paras, catalog).select("jd_id", F.col("weight").alias("weights"))


def dimension_text(paras: DataFrame, catalog: Catalog) -> DataFrame:
    """(jd_id, ordinal, dim, n_paragraphs, text): anchors, newline, mapped paragraphs.

    Matches the text a dimension encoder reads: anchors joined by newlines,
    a newline, then the mapped paragraphs in order joined by newlines (with no
    mapped paragraph the trailing newline stays).  Only paragraph *text* of
    one JD is gathered per row, which is what the encoder must see.
    """
    am = anchor_map(paras, catalog)
    grouped = (am.groupBy("jd_id", "ordinal")
               .agg(F.array_sort(F.collect_list(F.struct("para_no", "text"))).alias("ps")))
    # Every JD gets every dimension: generate the catalog rows per JD (no join).
    cat = F.array(*[F.struct(F.lit(d.name).alias("dim"),
                             F.lit("\n".join(d.anchors)).alias("anchor_text"))
                    for d in catalog.dimensions])
    full = (paras.select("jd_id").distinct()
            .select("jd_id", F.posexplode(cat))
            .select("jd_id", F.col("pos").alias("ordinal"), "col.dim", "col.anchor_text"))
    out = full.join(grouped, ["jd_id", "ordinal"], "left")
    para_text = F.concat_ws("\n", F.transform(F.coalesce(F.col("ps"), F.array()), lambda p: p["text"]))
    return out.select("jd_id", "ordinal", "dim",
                      F.coalesce(F.size("ps"), F.lit(0)).cast("bigint").alias("n_paragraphs"),
                      F.concat(F.col("anchor_text"), F.lit("\n"), para_text).alias("text"))


def dimension_tokens(paras: DataFrame, catalog: Catalog) -> DataFrame:
    """(jd_id, ordinal, dim, tokens): the tokens of ``dimension_text``, a row per paragraph.

    Encoders that only count tokens need no gathered text: one row has the anchors'
    tokens, and each mapped paragraph has a row of its own.
    """
    mapped = anchor_map(paras, catalog).select("jd_id", "ordinal", "dim", tx.tokens("text").alias("tokens"))
    cat = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(d.name).alias("dim"), tx.tokens(
        F.lit("\n".join(d.anchors))).alias("tokens")) for i, d in enumerate(catalog.dimensions)])
    anchors = paras.select("jd_id").distinct().select("jd_id", F.explode(cat).alias("c")).select("jd_id", "c.*")
    return anchors.unionByName(mapped)


def bm25_query(catalog: Catalog) -> dict[str, list[str]]:
    """Query tokens per BM25 dimension: tokens of all anchors, duplicates kept."""
    return {d.name: tx.py_tokens("\n".join(d.anchors))
            for d in catalog.dimensions if d.name in catalog.bm25_dims}


def emphasis_count(text: Column, catalog: Catalog) -> Column:
    return tx.count_contained(F.lower(text), catalog.emphasis)


def weights_report(paras: DataFrame, catalog: Catalog) -> DataFrame:
    """Weights per JD sorted by weight (descending), ties in template order."""
    return weights(paras, catalog).orderBy(F.col("jd_id"), F.col("weight").desc(), F.col("ordinal"))
