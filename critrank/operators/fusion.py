"""Score fusion as wide per-row array arithmetic (no shuffle).

Scores travel as ARRAY<DOUBLE> in template order, one element per dimension:
``emb`` (embedding similarity), ``bm25`` (normalised BM25, 0 outside BM25
dimensions), ``structured`` (rule scores, 0 outside rule dimensions).

* ``fused``         per dimension we*emb + wb*bm25 + ws*structured (E11)
* ``weighted_sum``  sum_d weight[d] * value[d], added left to right from 0.0,
                    the order of a sequential loop over the template (E12/E15)
* ``blend``         wc*ce + (1-wc)*stage1 on paired dimensions, stage1 elsewhere (E14)
* ``confidence``    coverage/agreement/value over the positive sources (E16)
* ``confidence_blend`` (1-w)*fused*confidence + w*ce (E17)

The long-form alignment helpers (``align_sources``/``outer_sources``) exist
for callers that hold per-source (id, dim, score) tables: a union followed by
one ``groupBy`` replaces a chain of joins, so all sources meet in one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critrank.catalog import Catalog


def _at(arr: Column, i: int) -> Column:
    return F.coalesce(arr[i], F.lit(0.0))


def fused(emb: Column, bm: Column, st: Column, catalog: Catalog) -> Column:
    out = []
    for i, d in enumerate(catalog.dimensions):
        we, wb, ws = catalog.fusion_weights(d.name)
        out.append(F.lit(we) * _at(emb, i) + F.lit(wb) * _at(bm, i) + F.lit(ws) * _at(st, i))
    return F.array(*out)


def weighted_sum(weights: Column, values: Column, n: int | None = None) -> Column:
    """sum_d weights[d] * values[d], added left to right from 0.0.

    With ``n`` (the catalog size) the sum is unrolled into plain arithmetic on
    array elements, which whole-stage codegen compiles; without it a
    higher-order function is used (interpreted, for unknown lengths).
    """
    if n is not None:
        acc = F.lit(0.0)
        for i in range(n):
            acc = acc + F.coalesce(weights[i], F.lit(0.0)) * F.coalesce(values[i], F.lit(0.0))
        return acc
    prod = F.zip_with(weights, values, lambda w, v: F.coalesce(w, F.lit(0.0)) * F.coalesce(v, F.lit(0.0)))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def blend(stage1: Column, ce: Column, catalog: Catalog) -> Column:
    out = []
    for i, d in enumerate(catalog.dimensions):
        if catalog.pair_query(d.name) is not None:
            wc = catalog.blend_weight(d.name)
            out.append(F.lit(wc) * _at(ce, i) + F.lit(1.0 - wc) * _at(stage1, i))
        else:
            out.append(_at(stage1, i))
    return F.array(*out)


def confidence(e: Column, b: Column, s: Column) -> Column:
    """STRUCT(agreement, coverage, value) over the sources that are > 0."""
    pos = F.filter(F.array(e, b, s), lambda x: x > 0)
    n = F.size(pos).cast("double")
    mean = F.aggregate(pos, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(pos, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    agreement = F.exp(F.lit(-2.0) * F.sqrt(var))
    coverage = n / F.lit(3.0)
    value = agreement * F.sqrt(coverage)
    zero = F.lit(0.0)
    return F.when(n == 0, F.struct(zero.alias("agreement"), zero.alias("coverage"),
                                   zero.alias("value"))) \
        .otherwise(F.struct(agreement.alias("agreement"), coverage.alias("coverage"),
                            value.alias("value")))


def confidence_blend(fused_value: Column, conf_value: Column, ce: Column, dim: str,
                     catalog: Catalog) -> Column:
    w = catalog.confidence_weight(dim)
    return F.lit(1.0 - w) * (fused_value * conf_value) + F.lit(w) * ce


# --- long-form alignment --------------------------------------------------------
def outer_sources(sources: dict[str, DataFrame], id_col: str = "doc_id",
                  dim_col: str = "dim", score_col: str = "score") -> DataFrame:
    """Union of keys over the sources, absent scores read 0.0.

    Each source is ``(id, dim, score)``; the result has one column per source.
    One union + one groupBy: a single shuffle keyed by (id, dim) whatever the
    number of sources, with map-side partial aggregation.
    """
    parts = []
    names = list(sources)
    for name, df in sources.items():
        cols = [F.col(id_col), F.col(dim_col)] + [
            (F.col(score_col).cast("double") if n == name else F.lit(None).cast("double")).alias(n)
            for n in names]
        parts.append(df.select(*cols))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(id_col, dim_col).agg(
        *[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names])
