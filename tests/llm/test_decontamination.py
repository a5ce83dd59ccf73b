import re
from collections import Counter

import numpy as np

from critrank.llm import decontamination as dc

from .conftest import prose


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))


def brute(docs, items):
    out = Counter()
    for i, t in docs:
        w = words(t)
        for k, x in set(items):
            v = words(x)
            n = min(5, len(v))
            if not n:
                continue
            wanted = {" ".join(v[a:a + n]) for a in range(len(v) - n + 1)}
            found = len(wanted & {" ".join(w[a:a + n]) for a in range(len(w) - n + 1)})
            if found >= 0.8 * len(wanted):
                out[i, k, len(wanted), found, found / len(wanted)] += 1
    return out


def test_matches_of_driver_tables(spark, small, rows_of):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = Counter(map(tuple, dc.matches(small, items).collect()))
    assert got == brute(rows_of(small), [(r.item_id, r.text) for r in items.collect()]) and got


def test_items_of_all_sizes_in_long_documents(spark, odd, rows_of):
    items = [(k, prose(100 + k, 5 + k * k)) for k in range(14)]
    items += [(20, "One TWO three four"), (21, "one"), (22, ""), (23, None), (24, items[3][1]), (None, "été ça va")]
    planted = []
    for k, (i, t) in enumerate(x for x in items if x[1]):
        w = t.split()
        gone = w[:len(w) // 2] + ["other"] + w[len(w) // 2 + 1:]  # a word replaced
        planted.append((1000 + k, prose(k, 9000) + " " + t + " " + prose(k + 50, 4000)))
        planted.append((2000 + k, " ".join(gone) + "\n" + prose(k, 300)))
    docs = odd.unionByName(spark.createDataFrame(planted, "doc_id long, text string"), allowMissingColumns=True)
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(rows_of(docs), items)
    for block in (1 << 20, 300):  # one block of items, and several
        assert Counter(map(tuple, dc.matches(docs, table, block=block).collect())) == expected
        bad = {r[0] for r in expected}
        kept = dc.clean(docs, table, block=block)
        assert kept.columns == docs.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows_of(docs) if i not in bad)


def test_short_items_are_never_missed(spark):
    """Items of one to six shingles, alone in long documents."""
    words = [f"w{i}" for i in range(900)]
    r = np.random.default_rng(4)
    items = [(k, " ".join(r.choice(words, 3 + k % 8))) for k in range(1600)]
    docs = [(d, " ".join(f"{' '.join(r.choice(words, 60))} {t}" for _, t in items[d * 40:d * 40 + 40])) for d in range(40)]
    got = dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(k // 40, k) for k in range(1600)} <= {(x.doc_id, x.item_id) for x in got.collect()}


def test_empty_tables(spark, odd, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert dc.matches(odd, items).collect() == [] and dc.clean(odd, items).count() == odd.count()
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.matches(none, some).collect() == [] and dc.clean(none, some).count() == 0


def test_signature_is_the_minimum_of_each_bin():
    h = np.random.default_rng(1).integers(0, 2**64, 500, np.uint64)
    low = dc.signature(h)
    for b in range(64):
        own = [x for x in h.tolist() if x >> 58 == b]
        assert low[b] == (min(own) if own else 2**64 - 1)
