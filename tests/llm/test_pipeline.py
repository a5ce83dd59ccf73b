from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from critrank.llm import mixing

from .test_decontamination import brute as contaminated
from .test_simhash import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark, small, rows_of):
    """SQL can't express the stages: each decision is made again, plainly, over all rows."""
    out = corpus_pipeline.run(spark, SF).collect()
    rows = [(i, t) for i, t in rows_of(small) if t and any(c.isalpha() for c in t)]
    first = {g[2] for g in brute_groups(rows)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated([r for r in rows if r[0] in first], items)}
    clean = small.where(small.doc_id.isin(list(first - bad)))
    kept = {r.doc_id for r in mixing.mix_sources(clean).collect() if r.in_mix}
    assert {r.doc_id for r in out} == kept and len(out) == len(kept)
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(40)) <= 1
    texts = dict(rows_of(small))
    assert all(r.text == texts[r.doc_id] for r in out) and bad


def test_the_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_and_empty_tables(spark, odd, none, stage):
    out = stage(spark, odd, SF)
    extra = {"row_number", "shard", "slot"} if stage is corpus_pipeline.shard else set()
    assert [c for c in out.columns if c not in extra] == [c for c in odd.columns if c not in extra]
    assert 0 < out.count() <= odd.count()
    assert stage(spark, none, SF).count() == 0


def test_near_copies_keeps_one_of_each_group(spark, odd, rows_of):
    """The first row of a group by doc_id (nulls last) stays, whatever ids are missing or repeated."""
    clash = odd.selectExpr("*", "1 as row", "2 as hash", "3 as no_id")
    out = corpus_pipeline.drop_near_copies(spark, clash, SF)
    assert out.columns == clash.columns
    rows = sorted(rows_of(odd), key=lambda r: (r[0] is None, r[0] or 0))
    groups = {g[2] for g in brute_groups([(n, t) for n, (_, t) in enumerate(rows)])}
    assert Counter(r.doc_id for r in out.collect()) == Counter(rows[n][0] for n in groups)


def test_different_texts_with_one_id_both_stay(spark):
    df = spark.createDataFrame([(1, "a first text about one thing only"), (1, "some other words that differ in all ways"),
                                (2, "a first text about one thing only"), (None, "a first text about one thing only"),
                                (None, "nothing like the rest of them at all")], "doc_id long, text string")
    for parts in (1, 3):
        kept = corpus_pipeline.drop_near_copies(spark, df.repartition(parts), SF).collect()
        assert sorted((str(r.doc_id), r.text[:7]) for r in kept) == [("1", "a first"), ("1", "some ot"), ("None", "nothing")]


def test_shard_needs_no_other_column(spark):
    df = spark.createDataFrame([(n, f"text {n}", "mine", n) for n in range(90)], "doc_id long, text string, _text_hash string, text_hash long")
    out = corpus_pipeline.shard(spark, df, SF)
    assert out.columns == [*df.columns, "row_number", "shard", "slot"]
    assert sorted((r.doc_id, r._text_hash, r.text_hash) for r in out.collect()) == [(n, "mine", n) for n in range(90)]


def test_mixing_keeps_all_rows_each_part_in_the_order_of_the_mix(spark, small):
    out = corpus_pipeline.mix(spark, small, SF)
    place = {r.doc_id: r.position for r in mixing.mix_sources(small).collect()}
    rows = [(r.part, place[r.doc_id]) for r in out.withColumn("part", F.spark_partition_id()).collect()]
    assert len(rows) == small.count()
    assert all(a[1] < b[1] for a, b in zip(rows, rows[1:]) if a[0] == b[0])


def test_row_numbers_follow_the_mix(spark, tmp_path):
    """Ids come source by source; the numbers that shard and slot are made of don't."""
    df = spark.createDataFrame([(n, f"text {n}", "a" if n < 400 else "b") for n in range(800)], "doc_id long, text string, source string")
    corpus_pipeline.mix(spark, df, SF).write.parquet(path := str(tmp_path / "mixed"))
    mixed = spark.read.parquet(path)
    stored = [r.doc_id for r in mixed.select("doc_id", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()]
    out = sorted(corpus_pipeline.shard(spark, mixed, SF).collect(), key=lambda r: r.row_number)
    assert [r.doc_id for r in out] == stored and [r.row_number for r in out] == list(range(800))
    assert 150 < sum(r.source == "a" for r in out[:400]) < 250


def test_row_numbers_are_the_places_of_the_whole_mix(spark, tmp_path):
    """Not the places within each of the files that the mix is stored in."""
    sizes = {"a": 900, "b": 450, "c": 150, None: 60}
    df = spark.createDataFrame([(n, f"text {n}", s) for n, s in enumerate(s for s, k in sizes.items() for _ in range(k))],
                               "doc_id long, text string, source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        place = {r.doc_id: r.position for r in mixing.mix_sources(df).collect()}
        corpus_pipeline.mix(spark, df, SF).write.parquet(path := str(tmp_path / "mixed"))
        out = sorted(corpus_pipeline.shard(spark, spark.read.parquet(path), SF).collect(), key=lambda r: r.row_number)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() > 1
    assert [r.row_number for r in out] == list(range(1560))
    assert [place[r.doc_id] for r in out] == sorted(place.values())
