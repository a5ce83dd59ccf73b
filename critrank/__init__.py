"""critrank: multi-criteria text ranking as Spark DataFrame jobs.

Layout
------
- ``catalog``      dimension catalog, rule lexicons and weight tables (fixed values)
- ``functions``    column expressions: tokenising, normalising, vectors, formatting
- ``operators``    DataFrame operators: criteria weights, BM25, rules, vectors,
                   fusion, top-k, rerank, explanations, quality checks
- ``sources``      readers and writers (JSON/JSONL candidates, JD text, CSV, Parquet)
- ``plans``        composed jobs: feature build (P3), ranking (P1/P2), reports
- ``streaming``    Structured Streaming ranking of arriving candidate batches
"""

import sys

from pyspark import cloudpickle

from critrank.catalog import Catalog, default_catalog, probe_catalog  # noqa: F401
from critrank.session import get_spark, materialize, temporary_tables  # noqa: F401

# task functions travel by value: executors need the public libraries only
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Catalog", "default_catalog", "probe_catalog", "get_spark", "materialize", "temporary_tables"]
