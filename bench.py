"""Benchmark of the headline jobs; prints ONE JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3).  Each job runs once to warm up, then BENCH_REPEAT
times; the median is reported.  Jobs execute fully through the ``noop`` sink
(no collect to the driver).

Jobs
  p3_features   build the candidate feature table (BM25 index + rules + pair
                scores + embeddings) and write it as Parquet
  p1_rank_1jd   rank all candidates for one job description from the features
  p1_rank_all   rank all candidates for every job description (conversations)
  p4_weights    per-JD dimension weights over all conversations
  p5_validate   validate all derived rankings (one row per violation)
  bm25_index    term statistics + idf over the whole corpus
  conformance   JSON-Schema conformance of the nested candidate records
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    from pyspark.sql import functions as F

    from critrank.catalog import probe_catalog
    from critrank.operators import bm25, criteria
    from critrank.plans import features, ranking, registry, tables
    from critrank.session import get_spark

    scratch = tempfile.mkdtemp(prefix="critrank-bench-", dir="/tmp")
    events = os.path.join(scratch, "events")
    os.makedirs(events)
    base_conf = {"spark.driver.memory": "16g"}
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), extra=base_conf)
    cat = probe_catalog()
    n = len(cat.dimensions)
    feat_path = os.path.join(scratch, "features")

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    def p3():
        c = tables.candidates(spark, sf)
        f = features.build_features(c, cat, embeddings=tables.embeddings(spark, sf),
                                    dim_vectors=tables.dimension_vectors(spark, sf, n))
        features.write_features(f, feat_path)

    def rank_job(all_jds: bool):
        def job():
            feats = spark.read.parquet(feat_path)
            paras = tables.jd_paragraphs(spark, sf)
            w = criteria.weight_vectors(paras, cat)
            if not all_jds:
                first = paras.agg(F.min("jd_id")).scalar()
                w = w.filter(F.col("jd_id") == first)
            dv = tables.dimension_vectors(spark, sf, n)
            run(ranking.rank(feats, w, cat, dv, k=100))
        return job

    def weights():
        run(criteria.weights(tables.jd_paragraphs(spark, sf), cat))

    def validate():
        run(registry.q_validate(spark, sf))

    def bm25_index():
        tok = bm25.doc_tokens(tables.read(spark, sf, "documents"), "doc_id", "text")
        terms = bm25.term_stats(tok)
        run(bm25.idf_table(terms, bm25.corpus_stats(tok, terms)))

    def conformance():
        run(registry.q_schema_violations(spark, sf))

    jobs = [("p3_features", p3), ("p1_rank_1jd", rank_job(False)), ("p1_rank_all", rank_job(True)),
            ("p4_weights", weights), ("p5_validate", validate), ("bm25_index", bm25_index),
            ("conformance", conformance)]
    results = {}
    for name, job in jobs:
        job()  # warm-up
        times = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            job()
            times.append(time.perf_counter() - t0)
        results[name] = round(statistics.median(times), 3)
    total = round(sum(results.values()), 3)

    # Shuffle volume: one untimed run per job in a fresh session that writes
    # Spark's event log to the scratch folder (kept out of the timed runs).
    spark.stop()
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), extra={
        **base_conf, "spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + events,
        "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false"})
    for name, job in jobs:
        spark.sparkContext.setJobGroup(name, name)
        job()
    spark.stop()  # completes the event log
    shuffle = shuffle_bytes(events, [name for name, _ in jobs])
    print(json.dumps({"metric": "sum of median job seconds", "value": total, "unit": "sec",
                      "queries": results, "sf": os.path.basename(sf.rstrip("/")),
                      "cpus": cpus, "repeat": repeat,
                      "shuffle_write_bytes": shuffle}))


def shuffle_bytes(events_dir: str, groups: list[str]) -> dict:
    """Shuffle bytes written per job group, from the event log."""
    stage_group: dict[int, str] = {}
    written: dict[str, int] = {g: 0 for g in groups}
    paths = [os.path.join(d, f) for d, _, fs in os.walk(events_dir) for f in fs]
    for path in sorted(paths):
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = g
                elif kind == "SparkListenerTaskEnd":
                    g = stage_group.get(ev.get("Stage ID"))
                    if g in groups:
                        m = (ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                        written[g] += int(m.get("Shuffle Bytes Written", 0))
    return written


if __name__ == "__main__":
    main()
