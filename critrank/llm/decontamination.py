"""Benchmark decontamination: size-partitioned MinHash containment search.

Items fall into classes by their number of 5-word shingles (powers of two).
For a class whose items have fewer than u shingles, a document is read as
overlapping windows of 2u shingles, one every u: a passage of the item lies
whole in one of them, and the two sets that MinHash compares are of like size
however long the document is.  A signature is the minimum in each of 64 bins
of the hash range (one permutation); item and window that agree in one bin are
candidates.  With containment 0.8 and the most unlike sizes of a class, the
Jaccard similarity is 0.19, and a pair agrees in none of 40 filled bins once in
5,000 times, with whole items far less often.  Every candidate is then
verified: the share of the item's shingles, as text, that the whole document has.

Items of few shingles (``DIRECT``) need no signature: each of their hashes leads to
them, since a window's neighbours could hide the only one.

A window is only given a signature where one of its hashes occurs in an item;
no other window could agree.  Items are handled in blocks of bounded size, one at a time:
a block is on the driver, is searched against all documents, and its result is written
before the next one comes.

Defined results: A-Z count as lower case; words are ``[^\\x20\\x09-\\x0D]+``; an
item of fewer than 5 words is one shingle of all its words; null and empty
items or texts match nothing; repeated rows are rows of their own; extra columns
stay in ``clean`` and are left out of ``matches``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, flat_words, lower_ascii, save, shingle_hashes, word_hashes

WORDS = 5
THRESHOLD = 0.8
BINS = 64
#: Items of so many shingles at most are indexed by every hash.
DIRECT = 4
#: Bytes of items that one pass over the documents carries.
ITEM_BLOCK = 16 << 20
_SHIFT = np.uint64(64 - 6)
_NONE = np.uint64((1 << 64) - 1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minima of the 64 bins; a bin without a hash has the largest value."""
    low = np.full(BINS, _NONE, np.uint64)
    np.minimum.at(low, (hashes >> _SHIFT).astype(np.int64), hashes)
    return low


class Items:
    """A block of items, partitioned by shingle length and size class."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float):
        self.threshold = threshold
        self.shingles: list[set[str]] = []
        self.ids = [r[0] for r in rows]
        self.classes: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.direct: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        marked = defaultdict(list)
        offsets, words = flat_words(lower_ascii(pa.array([r[1] for r in rows], pa.large_string())))
        hashes, text = word_hashes(words), words.to_pylist()
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            n = int(min(WORDS, b - a))
            self.shingles.append({" ".join(text[i:i + n]) for i in range(a, b - n + 1)} if n else set())
            if n:
                own = np.unique(shingle_hashes(hashes[a:b], n))
                size = len(own).bit_length()  # fewer than 2**size shingles
                marked[n].append(own)
                if len(own) <= DIRECT:
                    for value in own.tolist():
                        self.direct[n][value].append(k)
                    continue
                for value in signature(own):
                    if value != _NONE:
                        self.classes[n, size][int(value)].append(k)
        self.direct = {n: dict(x) for n, x in self.direct.items()}
        self.classes = {c: dict(x) for c, x in sorted(self.classes.items())}
        self.marked = {n: np.unique(np.concatenate(x)) for n, x in marked.items()}

    def search(self, texts: pa.Array) -> list[list[tuple[int, int]]]:
        """For each text: (item, number of its shingles found) of every item that it contains."""
        offsets, words = flat_words(lower_ascii(texts))
        hashes = word_hashes(words)
        candidates: dict[int, set[int]] = defaultdict(set)
        for n, marked in self.marked.items():
            runs = shingle_hashes(hashes, n)
            low = (runs >> np.uint64(44)).astype(np.int64)  # a bitmap of leading bits spares most look-ups
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(marked >> np.uint64(44)).astype(np.int64)] = True
            hit = np.flatnonzero(bitmap[low])
            hit = hit[np.isin(runs[hit], marked)]
            row = np.searchsorted(offsets, hit, side="right") - 1
            inside = hit + n <= offsets[row + 1]
            hit, row = hit[inside], row[inside]
            direct = self.direct.get(n, {})
            if direct:
                for r, value in zip(row.tolist(), runs[hit].tolist()):
                    if value in direct:
                        candidates[r].update(direct[value])
            for (m, size), index in self.classes.items():
                if m != n:
                    continue
                u = 1 << size
                place = (hit - offsets[row]) // u
                windows = np.unique(np.concatenate([np.stack([row, place], 1),
                                                    np.stack([row, np.maximum(place - 1, 0)], 1)]), axis=0)
                for r, j in windows.tolist():
                    a = offsets[r] + j * u
                    b = min(a + 2 * u, offsets[r + 1] - n + 1)
                    for value in signature(runs[a:b]).tolist():
                        if value in index:
                            candidates[r].update(index[value])
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(offsets) - 1)]
        for r, items in candidates.items():
            text = words.slice(offsets[r], offsets[r + 1] - offsets[r]).to_pylist()
            own = {n: {" ".join(text[i:i + n]) for i in range(len(text) - n + 1)} for n in self.marked}
            for k in sorted(items):
                wanted = self.shingles[k]
                n = min(WORDS, next(iter(wanted)).count(" ") + 1)
                found = len(wanted & own[n])
                if found >= self.threshold * len(wanted):
                    out[r].append((k, found))
        return out


def item_blocks(items: DataFrame, threshold: float, block: int) -> Iterator[tuple[Items, bool]]:
    """(items of about ``block`` bytes, whether they are all); a block comes to the driver when it is asked for."""
    rows = items.where("text is not null").select("item_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // block) + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield Items([(r.item_id, r.text) for r in sorted(
            rows.where(part == k).distinct().collect(), key=lambda r: (r.item_id is not None, r.item_id, r.text))],
            threshold), n == 1


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every item that a document contains."""
    schema = "doc_id long, item_id long, n_shingles long, n_found long, containment double"

    def finder(index: Items):
        def run(batches):
            for part in blocks(batches, "text", 4 << 20):
                ids = part.column("doc_id").to_pylist()
                found = [(i, index.ids[k], len(index.shingles[k]), n)
                         for i, own in zip(ids, index.search(part.column("text"))) for k, n in own]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([f[c] for f in found], pa.int64()) for c in range(4)),
                     pa.array([f[3] / f[2] for f in found], pa.float64())],
                    names=["doc_id", "item_id", "n_shingles", "n_found", "containment"])
        return run

    out = None
    for index, alone in item_blocks(items, threshold, block):
        part = docs.select("doc_id", "text").mapInArrow(finder(index), schema)
        part = part if alone else save(part, "matches")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = ITEM_BLOCK) -> DataFrame:
    """Rows of ``docs`` that contain no item; no shuffle, all columns stay."""

    def keeper(index: Items):
        def run(batches):
            for part in blocks(batches, "text", 4 << 20):
                clear = pa.array([not own for own in index.search(part.column("text"))], pa.bool_())
                yield from part.filter(clear).to_batches()
        return run

    for index, alone in item_blocks(items, threshold, block):
        docs = docs.mapInArrow(keeper(index), docs.schema)
        docs = docs if alone else save(docs, "clear")
    return docs


ORACLE_SQL = """
WITH letters AS (
  SELECT item_id AS id, 1 AS side, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
  UNION ALL
  SELECT doc_id, 2, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM documents
), split AS (
  SELECT id, side, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM letters WHERE t IS NOT NULL
), item AS (
  SELECT id, least(5, len(w)) AS n, w FROM split WHERE side = 1 AND len(w) > 0
), item_shingle AS (
  SELECT DISTINCT id, n, unnest(list_transform(range(1, (len(w) - n + 2)::BIGINT),
    lambda i: array_to_string(w[i:(i + n - 1)::BIGINT], ' '))) AS s FROM item
), doc_shingle AS (
  SELECT DISTINCT id, n, unnest(list_transform(range(1, greatest(1, len(w) - n + 2)::BIGINT),
    lambda i: array_to_string(w[i:(i + n - 1)::BIGINT], ' '))) AS s
  FROM (SELECT id, w FROM split WHERE side = 2), (SELECT DISTINCT n FROM item)
), sized AS (
  SELECT id, count(*) AS n_shingles FROM item_shingle GROUP BY id
), found AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_found
  FROM doc_shingle d JOIN item_shingle i ON d.n = i.n AND d.s = i.s GROUP BY d.id, i.id
)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles::DOUBLE AS containment
FROM found JOIN sized ON sized.id = item_id WHERE n_found >= 0.8 * n_shingles
"""
