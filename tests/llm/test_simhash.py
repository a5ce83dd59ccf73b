import random
import re

import numpy as np
import xxhash

from critrank.llm import simhash


def brute_print(text):
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                parent[top(i)] = top(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[top(k)] = min(low.get(top(k), i), i)
    return [(i, f"{p:016x}", low.get(top(k))) for k, ((i, _), p) in enumerate(zip(rows, prints))]


def key(r):
    return tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in r)


def test_groups(odd, small, rows_of):
    for df in (odd, small):
        assert sorted(map(tuple, simhash.digest(df).collect()), key=key) == sorted(brute_groups(rows_of(df)), key=key)


def test_hash_is_sparks(small):
    from pyspark.sql import functions as F
    row = small.select(F.xxhash64(F.lit("a b é")).alias("h")).first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest("a b é".encode(), 42)


def test_empty_table(none):
    assert simhash.digest(none).collect() == []


def test_trie_join_finds_every_link():
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(300)]
    base += [b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) for b in base for _ in range(2)]
    fp = np.unique(np.array(base, np.uint64))
    for budget in (0, 1, 2, 3):
        i, j = simhash.trie_links(fp, None, 0, 0, budget)
        near = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp))
                if bin(int(fp[a] ^ fp[b])).count("1") <= budget}
        assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == near and len(i) == len(near)
    cut = int(np.searchsorted(fp, np.uint64(1 << 63)))
    i, j = simhash.trie_links(fp[:cut], fp[cut:], 1, 1, 2)
    assert {(a, b + cut) for a, b in zip(i.tolist(), j.tolist())} == {
        (a, b) for a in range(cut) for b in range(cut, len(fp)) if bin(int(fp[a] ^ fp[b])).count("1") <= 2}


def test_links_through_spark_subtrees(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SUBTREE", 8)  # more subtree pairs
    r = random.Random(6)
    fp = [r.getrandbits(64) for _ in range(200)]
    fp += [b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in fp[:120]]
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(set(fp))]
    got = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2).collect()}
    near = {(a, b) for a in signed for b in signed if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert {frozenset(p) for p in got} <= {frozenset(p) for p in near}
    assert {x for p in got for x in p} == {x for p in near for x in p}


def test_subtrees_deepen_by_their_own_count(spark, monkeypatch):
    """Nearly all fingerprints share a prefix of 12 bits: no pair stays large, no component is lost."""
    r = random.Random(7)
    fp = {0xF3A << 52 | r.getrandbits(6) << 46 | r.getrandbits(3) for _ in range(220)}
    fp |= {x ^ (1 << r.randrange(64)) for x in sorted(fp)[:30]} | {r.getrandbits(64) for _ in range(20)} | {0, 2**64 - 1}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fp)]
    sizes, whole = [], simhash._subtree_links

    def watched(rows, depth, budget):
        sizes.append((depth, rows.groupBy("low", "high").count().agg({"count": "max"}).first()[0] or 0))
        return whole(rows, depth, budget)
    monkeypatch.setattr(simhash, "_subtree_links", watched)
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {(x.a, x.b) for x in simhash.links(table, 2, subtree=16).collect()}
    assert max(n for _, n in sizes) <= 64 and max(d for d, _ in sizes) > 12
    near = {(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert {frozenset(p) for p in got} <= {frozenset(p) for p in near}
    assert groups_of(got) == groups_of(near)


def groups_of(pairs):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x
    for a, b in pairs:
        top[find(a)] = find(b)
    found = {}
    for x in list(top):
        found.setdefault(find(x), set()).add(x)
    return sorted(sorted(g) for g in found.values())


def test_deepest_subtrees_still_link(spark):
    """With subtrees of one fingerprint the walk goes down to the last level but one."""
    signed = [0, 1, 2, 3, 4, 8, 256, 2**40 + 112]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {(x.a, x.b) for x in simhash.links(table, 2, subtree=1).collect()}
    assert groups_of(got) == [[0, 1, 2, 3, 4, 8, 256]]
