import random
import re

import numpy as np
import pyarrow as pa

from critrank.llm import common


def test_words_match_the_definition():
    texts = ["a b", " lead and trail ", "", None, "x y z", "tab\tnl\nvt\x0bff\x0ccr\rend", " em \x1csep"]
    offsets, words = common.flat_words(pa.array(texts))
    got = [words.to_pylist()[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert common.join_words(offsets, words).to_pylist() == [" ".join(g) for g in got]
    sliced = pa.array(["drop me", *texts]).slice(1)
    assert common.flat_words(sliced)[1].to_pylist() == words.to_pylist()


def test_pack_round_trip():
    arrays = [np.arange(5, dtype=np.uint8), np.zeros(0, np.int64), np.array([2**64 - 1], np.uint64)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, common.unpack(common.pack(*arrays))))


def test_blocks_hold_every_row_once():
    batches = [pa.record_batch({"k": list(range(a, a + 7)), "text": [None if i % 5 == 0 else "x" * (i * 40) for i in range(7)]})
               for a in (0, 7, 14)]
    out = list(common.blocks(iter(batches), "text", 400))
    assert [k for t in out for k in t.column("k").to_pylist()] == list(range(21))
    assert len(out) > 3


def test_numbers_follow_the_order(spark):
    keys = [None, 5, 5, 5, 3, 9, 1, 7, None]
    df = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k long, n long").repartition(4)
    numbered, total = common.number_rows(df, ["k"], "place", "t")
    got = sorted(numbered.collect(), key=lambda r: r.place)
    assert total == len(keys) and [r.place for r in got] == list(range(len(keys)))
    assert [r.k for r in got] == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_components_match_union_find(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 440)] + [(500, 500)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in common.components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert all(got.get(x, x) == top(x) for x in list(parent))
