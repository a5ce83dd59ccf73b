"""Rule-based structured scores (row-local column expressions, no joins).

Every rule of the catalog becomes one capped sum over containment flags:

    least(cap, senior_bonus * [years >= senior_years]
               + per_hit * hits
               + none_of_bonus * [no employer (lower-cased) is in the excluded list])

Containment has no word boundaries ("search" hits "research").  The
none-of predicate is vacuously true for an empty employer list.  Hits are
multiplied rather than added one by one, so sums of 0.1 do not drift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critrank.catalog import Catalog, RuleSpec
from critrank.functions import text as tx


def none_of(employers: Column, excluded: tuple[str, ...]) -> Column:
    """True when no employer, lower-cased, equals an excluded name (exact match)."""
    if not excluded:
        return F.lit(True)
    excl = [e.lower() for e in excluded]
    return F.coalesce(F.forall(employers, lambda x: ~F.coalesce(F.lower(x).isin(excl), F.lit(False))),
                      F.lit(True))


def senior(years: Column, threshold: float) -> Column:
    return F.coalesce(years.cast("double") >= F.lit(float(threshold)), F.lit(False))


def rule_hits(lower_text: Column, rule: RuleSpec) -> Column:
    return tx.count_contained(lower_text, rule.terms)


def rule_score(lower_text: Column, years: Column, employers: Column, rule: RuleSpec,
               catalog: Catalog) -> Column:
    total = F.lit(0.0)
    if rule.senior_bonus:
        total = total + F.when(senior(years, catalog.senior_years), F.lit(rule.senior_bonus)
                               ).otherwise(F.lit(0.0))
    if rule.terms and rule.per_hit:
        total = total + rule_hits(lower_text, rule).cast("double") * F.lit(rule.per_hit)
    if rule.none_of_bonus:
        total = total + F.when(none_of(employers, catalog.excluded_employers),
                               F.lit(rule.none_of_bonus)).otherwise(F.lit(0.0))
    return F.least(total, F.lit(rule.cap))


def rule_evidence(lower_text: Column, years: Column, employers: Column, rule: RuleSpec,
                  catalog: Catalog) -> Column:
    """Sorted ARRAY<STRING> of matched terms and rule labels."""
    parts = [tx.contained_terms(lower_text, rule.terms)]
    if rule.senior_bonus and rule.senior_label:
        parts.append(F.when(senior(years, catalog.senior_years), F.array(F.lit(rule.senior_label)))
                     .otherwise(F.array().cast("array<string>")))
    if rule.none_of_bonus and rule.none_of_label:
        parts.append(F.when(none_of(employers, catalog.excluded_employers),
                            F.array(F.lit(rule.none_of_label)))
                     .otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.concat(*parts))


def structured_scores(lower_text: Column, years: Column, employers: Column,
                      catalog: Catalog) -> Column:
    """ARRAY<DOUBLE> over all dimensions (template order); 0.0 where no rule exists."""
    out = []
    for d in catalog.dimensions:
        r = catalog.rule(d.name)
        out.append(rule_score(lower_text, years, employers, r, catalog) if r else F.lit(0.0))
    return F.array(*out)


def with_rule_scores(df: DataFrame, catalog: Catalog, text: str = "text", years: str = "years",
                     employers: str = "employers", evidence: bool = False) -> DataFrame:
    """Add one ``rule__<dim>`` column per rule (and ``evidence__<dim>`` on request)."""
    low = F.lower(F.col(text))
    out = df
    for r in catalog.rules:
        out = out.withColumn(f"rule__{r.dim}",
                             rule_score(low, F.col(years), F.col(employers), r, catalog))
        if evidence:
            out = out.withColumn(f"evidence__{r.dim}",
                                 rule_evidence(low, F.col(years), F.col(employers), r, catalog))
    return out
