"""SimHash near-dedup: 64-bit fingerprints, linked by a binary-trie self-join.

A bit of a fingerprint is 1 if it is set in over half of the text's shingle
hashes.  Copies collapse to one fingerprint.  The distinct fingerprints form a
binary trie; two of its nodes are walked together, the differing bits of their
paths add up, and a pair is left as soon as they exceed the error budget.  The
first levels are walked by Spark: a subtree meets every subtree whose prefix
differs in few enough bits, one task for each such pair; a pair with a crowded side
is walked deeper by Spark first.  Below, the walk runs level by level over arrays of
node pairs.  A task passes on a spanning forest
of the links it found, which loses no component.

Defined results: a null or empty text has fingerprint zero and links like any
other; fewer words than a shingle make one shingle; repeated rows and equal
texts are one group; an empty table gives an empty result; extra columns make
no difference.  A null doc_id is never the representative of a group that has
another; a group of nulls alone has component null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, components, save

BITS = 64
#: Distinct fingerprints that a subtree has on average.
SUBTREE = 4096
#: Places in which the rows of one crowded pair are found.
SALTS = 16
_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def popcount(x: np.ndarray) -> np.ndarray:
    v = np.ascontiguousarray(x).view(np.uint16).reshape(-1, 4)
    return _POPCOUNT[v].sum(axis=1)


def fingerprint(text: bytes, n: int, seed: int = 42) -> int:
    """SimHash of the words' n-shingles (A-Z in lower case), repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= n:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-n]))
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter((h(line[a:b], seed) for a, b in zip(starts.tolist(), (ends[n - 1:] - 1).tolist())),
                             np.uint64, len(starts))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        octets = hashes[at:at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row, as a signed long."""

    def run(batches):
        for block in blocks(batches, "text", 4 << 20):
            texts = pc.fill_null(block.column("text").cast(pa.large_binary()), b"").to_pylist()
            found = np.array([fingerprint(t, n) for t in texts], np.uint64).view(np.int64)
            yield from pa.table({"doc_id": block.column("doc_id"), "fp": pa.array(found)}).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def trie_links(a: np.ndarray, b: np.ndarray | None, used: int, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into a, into b) of fingerprints that differ in ``budget`` bits at most.

    ``a`` and ``b``: sorted distinct uint64 below two trie nodes at ``depth``
    whose prefixes differ in ``used`` bits; ``b`` None: the node with itself.
    """
    alone = b is None
    both = a if alone else np.concatenate([a, b])
    lo_a, hi_a = np.array([0]), np.array([len(a)])
    lo_b, hi_b = (lo_a, hi_a) if alone else (np.array([len(a)]), np.array([len(both)]))
    dist, out = np.array([used]), []
    for level in range(depth, BITS):
        one = np.concatenate(([0], np.cumsum((both >> np.uint64(BITS - 1 - level)) & np.uint64(1)))).astype(np.int64)
        mid_a, mid_b = hi_a - (one[hi_a] - one[lo_a]), hi_b - (one[hi_b] - one[lo_b])
        same = (lo_a == lo_b) & (hi_a == hi_b) if alone else np.zeros(len(lo_a), bool)
        other = ~same
        parts = [(lo_a, mid_a, lo_b, mid_b, dist), (mid_a, hi_a, mid_b, hi_b, dist),
                 (lo_a, mid_a, mid_b, hi_b, dist + 1),
                 (mid_a[other], hi_a[other], lo_b[other], mid_b[other], dist[other] + 1)]
        lo_a, hi_a, lo_b, hi_b, dist = (np.concatenate(x) for x in zip(*parts))
        live = (lo_a < hi_a) & (lo_b < hi_b) & (dist <= budget)
        if alone:  # a single fingerprint with itself is no link
            live &= ~((lo_a == lo_b) & (hi_a - lo_a == 1) & (hi_b - lo_b == 1))
        lo_a, hi_a, lo_b, hi_b, dist = lo_a[live], hi_a[live], lo_b[live], hi_b[live], dist[live]
        # two single fingerprints: the rest of both paths at once
        leaf = (hi_a - lo_a == 1) & (hi_b - lo_b == 1)
        if leaf.any():
            i, j = lo_a[leaf], lo_b[leaf]
            near = popcount(both[i] ^ both[j]) <= budget
            out.append((i[near], j[near]))
            rest = ~leaf
            lo_a, hi_a, lo_b, hi_b, dist = lo_a[rest], hi_a[rest], lo_b[rest], hi_b[rest], dist[rest]
        if not len(lo_a):
            break
    i = np.concatenate([x[0] for x in out]) if out else np.zeros(0, np.int64)
    j = np.concatenate([x[1] for x in out]) if out else np.zeros(0, np.int64)
    return i, (j if alone else j - len(a))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Indices of links that connect what all links connect."""
    parent, kept = list(range(n)), []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        x, y = top(x), top(y)
        if x != y:
            parent[x] = y
            kept.append(k)
    return np.array(kept, np.int64)


def _children(fp: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, deeper: int, budget: int):
    """(rows, low, high): the pairs at depth ``deeper`` that each row of the pairs (low, high) at ``depth`` is in.

    A subtree meets every subtree of the other side whose path differs in ``budget`` bits at most.
    """
    step = deeper - depth
    own = fp >> np.uint64(BITS - deeper)
    used = popcount(low ^ high)
    across = (low ^ high) << np.uint64(step) if depth else np.zeros(len(fp), np.uint64)
    for r in range(budget + 1):
        rows = np.flatnonzero(used + r <= budget)
        for bits in combinations(range(step), r):
            other = own[rows] ^ across[rows] ^ np.uint64(sum(1 << k for k in bits))
            yield rows, np.minimum(own[rows], other), np.maximum(own[rows], other)


def _spread(held: DataFrame, depth: int, deeper: int, budget: int) -> DataFrame:
    """Rows (low, high, fp) of pairs at ``depth``, dealt out to the pairs at ``deeper``."""

    def run(batches):
        for batch in batches:
            low, high, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("low", "high", "fp"))
            for rows, a, b in _children(fp, low, high, depth, deeper, budget):
                yield pa.record_batch({"low": pa.array(a.view(np.int64)), "high": pa.array(b.view(np.int64)),
                                       "fp": pa.array(fp[rows].view(np.int64))})

    return held.mapInArrow(run, "low long, high long, fp long")


def _crowded(held: DataFrame, depth: int, deeper: int, budget: int, most: int) -> tuple[DataFrame, int]:
    """((low, high): the pairs at ``deeper`` with a subtree of over ``most`` rows, the rows of the largest one or 0)."""
    sides = save(held.withColumn("own", F.shiftrightunsigned("fp", BITS - deeper))
                 .groupBy("low", "high", "own").count().where(F.col("count") > most)
                 .select("low", "high", F.shiftleft("own", BITS - deeper).alias("fp"), "count"), "simhash-crowded")
    pairs = _spread(sides.drop("count"), depth, deeper, budget).select("low", "high").distinct()
    return pairs, sides.agg(F.max("count")).first()[0] or 0


def links(prints: DataFrame, budget: int, subtree: int | None = None) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints ``fp`` within ``budget`` bits.

    Subtrees hold ``subtree`` (``SUBTREE``) fingerprints on average.  A pair of which one
    side holds over twice as many goes deeper, by the levels that the largest side would
    need if it were spread evenly, until all sides are small.  So a pair is 4 x
    ``subtree`` fingerprints at most, however many share a prefix.
    """
    subtree = subtree or SUBTREE
    root = F.lit(0).cast("long")
    depth, held, found = 0, prints.select(root.alias("low"), root.alias("high"), "fp"), None
    largest = prints.count()
    while True:
        # a side at the last level but one is two fingerprints at most, never crowded
        deeper = min(BITS - 1, depth + max(1, (largest // subtree).bit_length()))
        rows = _spread(held, depth, deeper, budget)
        crowded, largest = _crowded(held, depth, deeper, budget, 2 * subtree)
        if largest:
            # a pair's rows may be a third of all: they meet its one row in SALTS places
            salted = rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
            marks = crowded.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
            keys = ["low", "high", "salt"]
            rows = salted.join(marks, keys, "left_anti").drop("salt")
            held = save(salted.join(marks, keys, "left_semi").drop("salt"), "simhash-deeper")
        some = _subtree_links(rows, deeper, budget)
        found = some if found is None else found.unionByName(some)
        if not largest:
            return found
        depth = deeper


def _subtree_links(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    """(a, b): a spanning forest of the links of each pair (low, high) of subtrees at ``depth``."""

    def join(key, table):
        fp = np.sort(table.column("fp").to_numpy().view(np.uint64))
        low, high = (k.as_py() & (1 << BITS) - 1 for k in key)
        if low == high:
            i, j = trie_links(fp, None, 0, depth, budget)
        else:
            cut = int(np.searchsorted(fp >> np.uint64(BITS - depth), np.uint64(high)))
            i, j = trie_links(fp[:cut], fp[cut:], bin(low ^ high).count("1"), depth, budget)
            j = j + cut
        k = forest(i, j, len(fp))
        return pa.table({"a": pa.array(fp[i[k]].view(np.int64)), "b": pa.array(fp[j[k]].view(np.int64))})

    return rows.groupBy("low", "high").applyInArrow(join, "a long, b long")


def near_groups(docs: DataFrame, n: int, budget: int) -> DataFrame:
    """(doc_id, fp, component_id): every row with the smallest doc_id reachable by links."""
    rows = save(fingerprints(docs, n), "simhash")
    prints = save(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-prints")
    roots = components(save(links(prints, budget), "simhash-links"), "simhash-components")
    placed = (prints.join(roots, prints.fp == roots.node, "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(placed.join(lowest, "root").select("fp", "component_id"), "fp")


def digest(docs: DataFrame, n: int = 3, budget: int = 2) -> DataFrame:
    """One row per document: fingerprint (16 hexadecimal digits) and component."""
    return near_groups(docs, n, budget).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
