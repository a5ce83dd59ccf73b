"""Tables bucketed by id: joins and writes without a shuffle of the large side."""

import uuid

import pytest
from pyspark.sql import functions as F

from critrank.operators import criteria
from critrank.plans import features, ranking, tables
from critrank.sources.bucketed import bucketing, write_bucketed

from conftest import SF001

BUCKETS = 6


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rounded(df):
    """Rows as text, doubles to nine places: sums of idf differ in the last one."""
    def plain(v):
        if isinstance(v, float):
            return round(v, 9) + 0.0
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v
    return sorted(str(plain(tuple(r))) for r in df.collect())


@pytest.fixture()
def sort_merge(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture()
def named(spark, tmp_path):
    """``named(rows, id)``: a bucketed external table, dropped after the test."""
    made = []

    def write(df, id_col, **more):
        made.append("t" + uuid.uuid4().hex)
        return write_bucketed(df, made[-1], id_col, BUCKETS, str(tmp_path / made[-1]), **more), made[-1]
    yield write
    for t in made:
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_join_and_rewrite_of_bucketed_tables_have_no_exchange(spark, sort_merge, named):
    a, name = named(spark.range(1000).withColumnRenamed("id", "doc_id"), "doc_id")
    b, _ = named(spark.range(0, 2000, 2).select(F.col("id").alias("vec_id"), F.col("id").cast("double").alias("x")), "vec_id")
    assert bucketing(spark, name) == ("doc_id", BUCKETS)
    j = a.join(b, a.doc_id == b.vec_id, "left")
    assert "Exchange" not in _plan(j) and "Bucketed: true" in _plan(j)
    assert "Exchange" not in _plan(j.repartition(BUCKETS, "doc_id"))
    assert j.where("x IS NOT NULL").count() == 500 and j.count() == 1000
    other = spark.range(50)
    assert _plan(a.join(other, a.doc_id == other.id)).count("Exchange hashpartitioning") == 1


def test_append_keeps_the_buckets(spark, sort_merge, named, tmp_path):
    rows = spark.range(100).withColumnRenamed("id", "doc_id")
    a, name = named(rows, "doc_id")
    both = write_bucketed(rows.select((F.col("doc_id") + 50).alias("doc_id")), name, "doc_id", BUCKETS, mode="append")
    assert both.count() == 200 and both.distinct().count() == 150
    assert "Exchange" not in _plan(both.groupBy("doc_id").count())
    for id_col, n in (("doc_id", BUCKETS + 1), ("x", BUCKETS)):
        with pytest.raises(ValueError):
            write_bucketed(rows.withColumn("x", F.lit(1)), name, id_col, n, mode="append")
    with pytest.raises(ValueError):
        write_bucketed(rows, name + "b", "doc_id", 0)


def test_nulls_repeats_and_empty_tables(spark, named):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, None)], "doc_id long, x string")
    a, _ = named(rows, "doc_id")
    assert sorted(map(str, a.collect())) == sorted(map(str, rows.collect()))
    e, name = named(rows.limit(0), "doc_id")
    assert e.count() == 0 and bucketing(spark, name) == ("doc_id", BUCKETS)


def test_bucketed_features_equal_the_plain_ones_and_stay_in_place(spark, probe, sort_merge, named, tmp_path):
    cands, emb = tables.candidates(spark, SF001), tables.embeddings(spark, SF001)
    dims = tables.dimension_vectors(spark, SF001, len(probe.dimensions))
    plain = features.build_features(cands, probe, embeddings=emb, dim_vectors=dims)
    stored, _ = named(emb, "vec_id")
    table = "f" + uuid.uuid4().hex
    got = features.build_bucketed(cands, probe, table, BUCKETS, embeddings=stored, dim_vectors=dims,
                                  path=str(tmp_path / table))
    try:
        assert bucketing(spark, table) == ("doc_id", BUCKETS)
        assert not [t.name for t in spark.catalog.listTables() if "partials" in t.name]
        assert _rounded(got.select(*plain.columns)) == _rounded(plain)
        weights = criteria.weight_vectors(tables.jd_paragraphs(spark, SF001, keep_blank=True), probe)
        best = spark.createDataFrame([(1, 1, 0.5, 1)], "jd_id long, doc_id long, stage1 double, stage1_rank int")
        joined = got.join(best, "doc_id")
        scan = _plan(joined)
        assert scan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in scan
        same = [_rounded(ranking.rank(f, weights, probe, dims, k=5)) for f in (got, plain)]
        assert same[0] == same[1] and same[0]
    finally:
        spark.sql(f"DROP TABLE {table}")
