import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from critrank.llm import mixing, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 40, 1000, 65537])
def test_the_network_permutes_and_inverts(n):
    places = sharding.permute(np.arange(n), n, 20)
    assert sorted(places.tolist()) == list(range(n))
    assert (sharding.unpermute(places, n, 20) == np.arange(n)).all()
    if n > 30:
        assert (sharding.permute(np.arange(n), n, 21) != places).any()


def test_shards(odd, rows_of):
    got = sharding.digest(odd).collect()
    texts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows_of(odd))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == texts
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(40)) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    order = sorted(texts.elements(), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    place = sharding.permute(np.arange(len(order)), len(order), 20)
    assert Counter((*r, int(p) % 40, int(p) // 40) for r, p in zip(order, place)) == Counter(
        (r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got)
    again = sharding.digest(odd.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_shards_keep_columns_and_take_empty_tables(odd, none):
    out = sharding.shard_rows(odd, ["doc_id"], 7)
    assert [c for c in out.columns if c not in ("row_number", "shard", "slot")] == [c for c in odd.columns if c != "slot"]
    assert sharding.digest(none).count() == 0


def test_one_period_keeps_every_window():
    for slots in ({"a": 1, "b": 2, "c": 4}, {"a": 333, "b": 333, "c": 334}, {None: 9, "x": 1}, {"z": 5},
                  {k: k + 1 for k in range(20)}):
        period, found = sum(slots.values()), mixing.one_period(slots)
        assert sorted(t for x in found.values() for t in x) == list(range(period))
        for s, k in slots.items():
            for j, t in enumerate(found[s]):
                assert j * period // k <= t < -(-(j + 1) * period // k)


def test_weights():
    assert mixing.whole_slots({"a": 1, "b": 1, "c": 1}, 10) in ({"a": 4, "b": 3, "c": 3},)
    slots = mixing.capped_weights({"hot": 900, "b": 60, "c": 40, "d": 30, "e": 20}, 0.25, 10_000)
    assert sum(slots.values()) == 10_000 and slots["hot"] == 2500
    assert mixing.capped_weights({"a": 10, None: 90}, 0.25, 100) == {"a": 50, None: 50}
    assert mixing.capped_weights({}, 0.25, 100) == {}
    with pytest.raises(ValueError):
        mixing.capped_weights({k: 1 for k in range(11)}, 0.25, 10)
    tiny = mixing.capped_weights({"a": 10**9, "b": 10**9, "c": 1}, 0.9, 100)
    assert tiny["c"] == 1 and sum(tiny.values()) == 100


def test_the_mix_holds_its_targets(spark):
    sizes = {"a": 400, "b": 100, None: 60, "c": 45}
    df = spark.createDataFrame([(n, s) for n, s in enumerate(s for s, k in sizes.items() for _ in range(k))],
                               "doc_id long, source string").repartition(4)
    rows = mixing.mix_sources(df, max_share=0.25, period=1000).collect()
    assert len(rows) == 605 and len({r.position for r in rows}) == 605
    slots = mixing.capped_weights(sizes, 0.25, 1000)
    mixed = sorted((r for r in rows if r.in_mix), key=lambda r: r.position)
    assert mixed and len(mixed) < 605
    blocks = Counter()
    for t in sorted({r.slot for r in mixed}):
        blocks[next(r.source for r in mixed if r.slot == t)] += 1
        assert all(abs(Fraction(slots[s] * (t + 1), 1000) - blocks[s]) < 1 for s in sizes)
    assert max(r.slot for r in mixed) + 1 == sum(blocks.values())  # no slot is left out


def test_without_targets_every_row_is_mixed(spark):
    """Each source at its own share, also with few sources, and with more of them than a period has slots."""
    sizes = {"a": 6000, "b": 3000, "c": 997, None: 3}
    df = spark.createDataFrame([(n, s) for n, s in enumerate(s for s, k in sizes.items() for _ in range(k))],
                               "doc_id long, source string").repartition(4)
    rows = sorted(mixing.mix_sources(df).collect(), key=lambda r: r.position)
    assert len(rows) == 10_000 and all(r.in_mix for r in rows) and len({r.position for r in rows}) == 10_000
    seen = Counter()
    for n, r in enumerate(rows, 1):
        seen[r.source] += 1
        if n % 500 == 0:
            assert all(abs(seen[s] - k * n / 10_000) < 3 * mixing.BLOCK_ROWS for s, k in sizes.items())
    many = spark.range(700).selectExpr("id as doc_id", "cast(id div 2 as string) as source")
    assert mixing.mix_sources(many, period=100).where("in_mix").count() == 700


def test_clashing_helper_columns_of_the_mix(spark, odd):
    clash = odd.selectExpr("doc_id", "source", "1 as _s", "2 as _n", "3 as _h", "4 as _t", "5 as _whole", "6 as own_1")
    out = mixing.mix_sources(clash)
    assert out.columns == [*clash.columns, *mixing.OUTPUT]
    assert {tuple(r)[2:8] for r in out.collect()} == {(1, 2, 3, 4, 5, 6)} and out.count() == odd.count()


def test_a_given_weight_and_a_source_without_one(spark):
    df = spark.createDataFrame([(n, "ab"[n % 2]) for n in range(40)], "doc_id long, source string")
    rows = mixing.mix_sources(df, weights={"a": 1, "missing": 5}, period=10).collect()
    assert {r.source for r in rows if r.in_mix} == {"a"} and sum(r.in_mix for r in rows) == 20


def test_odd_and_empty_tables(odd, none):
    out = mixing.mix_sources(odd)
    assert set(odd.columns) <= set(out.columns) and out.count() == odd.count()
    assert out.select("position").distinct().count() == odd.count()
    assert mixing.digest(none).count() == 0


def mixed_by_hand(sizes, cap=Fraction(1, 4)):
    """Rows of each source in the mix, by an independent count: capped ones a share of all, the others whole."""
    capped = set()
    while True:
        free = sum(n for s, n in sizes.items() if s not in capped)
        total = free / (1 - cap * len(capped))
        more = {s for s, n in sizes.items() if s not in capped and n > cap * total}
        if not more:
            return {s: cap * total if s in capped else Fraction(n) for s, n in sizes.items()}
        capped |= more


@pytest.mark.parametrize("sizes", [{**{f"s{k}": 2500 for k in range(8)}, "tiny": 3},
                                   {f"z{k}": 6000 // (k + 1) for k in range(60)},
                                   {"hot": 9000, "b": 1100, "c": 700, "d": 600, None: 41, "e": 1}], ids=["tiny", "zipf", "hot"])
def test_no_source_is_cut_by_rounding(spark, sizes):
    """With 300 slots a period, rounded weights ended the mix early."""
    df = spark.createDataFrame([(n, s) for n, s in enumerate(s for s, k in sizes.items() for _ in range(k))],
                               "doc_id long, source string").repartition(4)
    rows = mixing.mix_sources(df, max_share=0.25, period=300).collect()
    total = sum(sizes.values())
    assert len(rows) == total and len({r.position for r in rows}) == total
    kept, wanted = Counter(r.source for r in rows if r.in_mix), mixed_by_hand(sizes)
    for s, n in sizes.items():
        if wanted[s] == n:
            assert kept[s] == n
        else:
            assert abs(kept[s] - wanted[s]) <= 12  # three blocks
    share = {s: x / sum(wanted.values()) for s, x in wanted.items()}
    for r in rows:
        assert r.release == r.block / share[r.source] // 1 and r.deadline == -(-(r.block + 1) / share[r.source] // 1)
        if r.in_mix:
            assert abs(share[r.source] * r.slot - r.block) < 3


def test_segments_join_without_breaking_a_window():
    for weights in ([1, 2, 4], [333, 333, 334], [5], [1, 1, 50, 48, 7, 3], list(range(3, 23))):
        shares = [Fraction(w, sum(weights)) for w in weights]
        length, done = 2 * sum(weights) // min(weights) + 1, Counter()
        for start in range(0, 4 * length, length):
            found = mixing.segment(shares, start, start + length)
            assert [t for _, _, t in found] == list(range(start, start + length))
            for n, i, t in found:
                assert i == done[n] and i / shares[n] // 1 <= t < -(-(i + 1) / shares[n] // 1)
                done[n] += 1
