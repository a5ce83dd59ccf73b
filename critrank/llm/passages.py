"""Substring dedup: suffix subtrees of prefix-partitioned groups.

A repeat is a run of 20 words that also starts earlier.  Suffixes are sampled by
content, then partitioned by prefix, and every group gets a subtree of its own:

1. Of each 20-word window the 8-word prefix with the smallest hash is its
   anchor.  Equal windows have equal anchors at equal offsets, so it is enough
   to compare suffixes that start at anchors, one in seven.
2. Chunks ask for their anchors (``chunks``).  An anchor that occurs once in the
   corpus ends there; the others go on to the group of their prefix, with the
   words of all windows that they stand for.
3. A group sorts its suffixes by the words from the anchor on, and by the words
   before it, backwards.  Common prefixes of neighbours give the internal nodes
   of both subtrees at each depth; a pair of nodes whose depths add up to 20
   words is a repeated window, and all its starts but the first are removed.
4. A prefix with more than ``GROUP`` entries (different words around it, in one
   chunk or several) would be too much for a group; it is extended to all 20 words
   of the window, where the node is the repeat itself and its first start is a
   minimum that Spark aggregates.

Within a chunk, a passage that was met before is removed at once and asked for
only once.

Defined results: a null text has no words; rows with one doc_id follow each
other in the order of their chunks; a null doc_id comes first; fewer than 20
words are never removed; extra columns make no difference.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunk, answer, ask, chunk_table, deal, meet, n_buckets
from .common import flat_words, join_words, mix, pack, save, shingle_hashes, unpack, word_hashes

WINDOW = 20
PREFIX = 8
#: Entries that a prefix may have, each chunk's different ones counted, before it is extended.
GROUP = 20_000


class Suffixes:
    """The sampled suffixes of a chunk.

    One entry for each run of windows with the same anchor: ``first`` (flat word
    index of the run's first window), ``windows`` (their number), ``anchor`` (flat
    index), ``row`` (document), ``key`` (hash of the 8-word prefix).
    """

    def __init__(self, chunk: Chunk):
        self.offsets, self.words = flat_words(chunk.texts)
        self.hashes = hashes = word_hashes(self.words)
        n = len(hashes)
        if n < WINDOW:
            self.first = self.windows = self.anchor = self.row = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        prefix = shingle_hashes(hashes, PREFIX)
        span = WINDOW - PREFIX + 1
        low, at = prefix[:n - WINDOW + 1].copy(), np.zeros(n - WINDOW + 1, np.int64)
        for k in range(1, span):  # the leftmost minimum of each window
            other = prefix[k:k + len(low)]
            less = other < low
            low[less], at[less] = other[less], k
        row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))[:len(low)]
        start = np.flatnonzero(np.arange(len(low)) + WINDOW <= self.offsets[row + 1])
        anchor, row = start + at[start], row[start]
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))[:len(start)]
        self.first, self.anchor, self.row = start[new], anchor[new], row[new]
        self.windows = np.diff(np.concatenate((new, [len(start)])))
        self.key = prefix[self.anchor]

    def contexts(self, k: np.ndarray) -> np.ndarray:
        """A row of numbers for each entry of ``k``, equal for equal words around equal anchors."""
        ends = np.zeros((2, len(k)), np.uint64)
        for row, at in zip(ends, (self.first[k], self.first[k] + self.windows[k] - 1)):  # its first and last window
            for d in range(WINDOW):
                row[:] = mix(row + self.hashes[at + d] + np.uint64(d + 1))
        return np.column_stack((self.key[k], *ends, self.anchor[k] - self.first[k], self.windows[k])).astype(np.uint64)

    def text(self, k: np.ndarray) -> list[str]:
        """The words of all windows of entries ``k``, joined by blanks."""
        lengths = self.windows[k] + WINDOW - 1
        ends = np.cumsum(lengths)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[k] - ends + lengths, lengths)
        return join_words(np.concatenate(([0], ends)), self.words.take(pa.array(index))).to_pylist()


def _ids(chunk: Chunk) -> np.ndarray:
    return pc.fill_null(chunk.ids, -(1 << 63)).to_numpy(False)


def ask_anchors(buckets: int):
    def question(_, chunk):
        suffixes = Suffixes(chunk)
        key, inverse, counts = np.unique(suffixes.key, return_inverse=True, return_counts=True)
        different = np.ones(len(key), np.int64)
        often = np.flatnonzero(counts[inverse] > 1) if len(key) else np.zeros(0, np.int64)
        if len(often):
            rows = suffixes.contexts(often)
            order = np.lexsort(rows.T[::-1])
            new = np.concatenate(([True], (rows[order][1:] != rows[order][:-1]).any(axis=1)))
            times = np.bincount(inverse[often[order[new]]], minlength=len(key))
            different = np.maximum(different, times)
        # entries that go on to a group if the prefix is repeated, and whether some are there again
        counts = (different << 1 | (counts > different)).astype(np.uint32)
        order, starts = deal(key, buckets)
        for b in np.flatnonzero(np.diff(starts)):
            own = order[starts[b]:starts[b + 1]]
            yield int(b), pack(key[own], counts[own])
    return question


def count_anchors(group: int):
    """0: occurs once; 1: repeated; 2: has more than ``group`` entries."""
    def reply(chunks, blobs):
        parts = [unpack(b) for b in blobs]
        keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.concatenate([p[1] for p in parts])
        entries = np.bincount(inverse, counts >> 1, len(keys))
        again = np.bincount(inverse, counts & 1, len(keys))
        code = np.where(entries > group, 2, np.where(entries + again > 1, 1, 0)).astype(np.uint8)[inverse]
        ends = np.cumsum([len(p[0]) for p in parts])
        return [(c, pack(x)) for c, x in zip(chunks, np.split(code, ends[:-1]))]
    return reply


def _codes(suffixes: Suffixes, buckets: int, answers: dict[int, bytes]) -> np.ndarray:
    """The answered code of each entry."""
    key, inverse = np.unique(suffixes.key, return_inverse=True)
    order, starts = deal(key, buckets)
    code = np.zeros(len(key), np.uint8)
    for b, blob in answers.items():
        code[order[starts[b]:starts[b + 1]]] = unpack(blob)[0]
    return code[inverse] if len(key) else code


def _distinct(chunk: Chunk, suffixes: Suffixes, entries: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of entries with the same words: the first in order of documents, and whether it is.

    Returns (first entries, their words, entries that repeat one of them).
    """
    text = suffixes.text(entries)
    ids, at = _ids(chunk)[suffixes.row[entries]], suffixes.anchor[entries]
    where = suffixes.anchor[entries] - suffixes.first[entries]
    first: dict[tuple[str, int], int] = {}
    order = np.lexsort((at, ids))
    again = []
    for k in order.tolist():
        if first.setdefault((text[k], int(where[k])), k) != k:
            again.append(k)
    kept = np.array(sorted(first.values()), np.int64)
    return entries[kept], [text[k] for k in kept], entries[np.array(sorted(again), np.int64)]


def ask_groups(buckets: int):
    """Entries with a repeated prefix go to the group of the prefix."""
    def act(name, chunk, answers):
        suffixes = Suffixes(chunk)
        entries = np.flatnonzero(_codes(suffixes, buckets, answers) == 1)
        entries, text, _ = _distinct(chunk, suffixes, entries)
        ids = _ids(chunk)
        order, starts = deal(suffixes.key[entries], buckets)
        found = []
        for b in np.flatnonzero(np.diff(starts)):
            own = order[starts[b]:starts[b + 1]]
            e = entries[own]
            row = suffixes.row[e]
            found.append((int(b), pack(
                ids[row], row.astype(np.int32), (suffixes.anchor[e] - suffixes.offsets[row]).astype(np.int64),
                (suffixes.anchor[e] - suffixes.first[e]).astype(np.uint8), suffixes.windows[e].astype(np.uint8),
                np.frombuffer("\n".join(text[k] for k in own).encode(), np.uint8))))
        yield pa.record_batch([pa.array([name] * len(found), pa.int64()), pa.array([b for b, _ in found], pa.int32()),
                               pa.array([x for _, x in found], pa.binary())], names=["chunk", "bucket", "blob"])
    return act


def _node_ids(rows: np.ndarray) -> np.ndarray:
    """For each depth d = 0..width, the subtree node of each row at depth d.

    Rows (of word numbers) are sorted; neighbours with a common prefix of d words
    are below one node of depth d.
    """
    n, width = rows.shape
    order = np.lexsort(rows.T[::-1]) if width else np.arange(n)
    ranked = rows[order]
    common = np.cumprod(ranked[1:] == ranked[:-1], axis=1).sum(axis=1)
    out = np.zeros((width + 1, n), np.int64)
    for d in range(width + 1):
        out[d, order] = np.concatenate(([0], np.cumsum(common < d)))
    return out


def repeated_windows(chunks: list[int], blobs: list[bytes]) -> list[tuple[int, bytes]]:
    """The subtree of a group: a mask of the windows that also start earlier, for each entry."""
    parts = [unpack(b) for b in blobs]
    ids, row, anchor, before, windows = (np.concatenate([p[k] for p in parts]) for k in range(5))
    sizes = [len(p[0]) for p in parts]
    chunk = np.repeat(np.array(chunks, np.int64), sizes)
    text = "\n".join(p[5].tobytes().decode() for p in parts)
    offsets, words = flat_words(pa.array(text.split("\n"), pa.large_string()))
    number = words.dictionary_encode().indices.to_numpy().astype(np.int32)
    before, windows = before.astype(np.int64), windows.astype(np.int64)
    n, reach = len(ids), WINDOW - PREFIX
    ahead = np.full((n, WINDOW), -1, np.int32)
    behind = np.full((n, reach), -1, np.int32)
    at = offsets[:-1] + before
    for k in range(WINDOW):
        has = at + k < offsets[1:]
        ahead[has, k] = number[at[has] + k]
    for k in range(reach):
        has = before > k
        behind[has, k] = number[at[has] - 1 - k]
    right, left = _node_ids(ahead), _node_ids(behind)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((anchor, row, chunk, ids))] = np.arange(n)
    mask = np.zeros(n, np.uint16)
    for off in range(reach + 1):  # windows that begin ``off`` words before their anchor
        window = before - off  # its place in the entry
        has = np.flatnonzero((window >= 0) & (window < windows))
        if not len(has):
            continue
        node = right[WINDOW - off, has] * n + left[off, has]
        order = np.lexsort((rank[has], node))
        later = np.concatenate(([False], node[order][1:] == node[order][:-1]))
        again = has[order[later]]
        mask[again] |= (1 << window[again]).astype(np.uint16)
    return [(c, pack(m)) for c, m in zip(chunks, np.split(mask, np.cumsum(sizes)[:-1]))]


def _extended(buckets: int):
    """Windows of prefixes with too many entries, by the hash of all their words.

    ``again``: whether the window starts earlier in its chunk.
    """
    def act(name, chunk, answers):
        suffixes = Suffixes(chunk)
        entries = np.flatnonzero(_codes(suffixes, buckets, answers) == 2)
        if not len(entries):
            return
        first = np.concatenate([np.arange(a, a + w) for a, w in zip(suffixes.first[entries], suffixes.windows[entries])])
        words = suffixes.words.to_pylist()
        row = np.searchsorted(suffixes.offsets, first, side="right") - 1
        window = [xxhash.xxh3_128_digest(" ".join(words[a:a + WINDOW])) for a in first]
        met: set[bytes] = set()
        again = np.zeros(len(first), bool)
        for k in np.lexsort((first, row, _ids(chunk)[row])).tolist():
            again[k] = window[k] in met
            met.add(window[k])
        yield pa.record_batch([
            pa.array([name] * len(first), pa.int64()), pa.array(_ids(chunk)[row]), pa.array(row.astype(np.int32)),
            pa.array(first), pa.array(window, pa.binary()), pa.array(again)],
            names=["chunk", "id", "row", "start", "window", "again"])
    return act


def extended_answers(chunks: DataFrame, counted: DataFrame, buckets: int) -> DataFrame:
    """For each chunk, the windows of over-full prefixes that also start earlier (bucket -1)."""
    rows = save(meet(chunks, counted, _extended(buckets),
                     "chunk long, id long, row int, start long, window binary, again boolean"),
                "passages-extended")
    once = rows.where("not again")  # a window has one such row for each chunk at most
    first = once.groupBy("window").agg(F.min(F.struct("id", "chunk", "row", "start")).alias("first"))
    later = once.join(first, "window").where(F.struct("id", "chunk", "row", "start") != F.col("first"))
    later = later.select("chunk", "start").union(rows.where("again").select("chunk", "start"))

    def gather(key, batches):
        starts = np.sort(np.concatenate([b.column("start").to_numpy() for b in batches.to_batches()]))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "bucket": pa.array([-1], pa.int32()),
                         "blob": pa.array([pack(starts)], pa.binary())})

    return later.select("chunk", "start").groupBy("chunk").applyInArrow(gather, "chunk long, bucket int, blob binary")


def _finish(buckets: int, with_text: bool):
    def act(name, chunk, answers):
        suffixes = Suffixes(chunk)
        extended = unpack(answers.pop(-1))[0] if -1 in answers else np.zeros(0, np.int64)
        # the codes of the first answers give the questions of ask_groups again, in their order
        codes = _codes(suffixes, buckets, {b - buckets: x for b, x in answers.items() if b >= buckets})
        entries, _, again = _distinct(chunk, suffixes, np.flatnonzero(codes == 1))
        order, starts = deal(suffixes.key[entries], buckets)
        mask = np.zeros(len(entries), np.uint16)
        for b in np.flatnonzero(np.diff(starts)):
            mask[order[starts[b]:starts[b + 1]]] = unpack(answers[int(b)])[0]
        n = len(suffixes.words)
        change = np.zeros(n + 1, np.int64)
        for k in range(WINDOW - PREFIX + 1):
            at = suffixes.first[entries[(mask >> k & 1) > 0]] + k
            np.add.at(change, at, 1)
            np.add.at(change, at + WINDOW, -1)
        np.add.at(change, suffixes.first[again], 1)
        np.add.at(change, suffixes.first[again] + suffixes.windows[again] + WINDOW - 1, -1)
        np.add.at(change, extended, 1)
        np.add.at(change, extended + WINDOW, -1)
        removed = np.cumsum(change[:-1]) > 0
        kept = np.concatenate(([0], np.cumsum(~removed)))[suffixes.offsets]
        texts = join_words(kept, suffixes.words.filter(pa.array(~removed))).to_pylist()
        n_words = np.diff(suffixes.offsets)
        edge = np.diff(np.concatenate(([0], removed.astype(np.int8), [0])))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        spans: list[list[dict]] = [[] for _ in texts]
        for a, b in zip(begin.tolist(), end.tolist()):
            while a < b:  # removed words on both sides of a document's end are two spans
                r = int(np.searchsorted(suffixes.offsets, a, side="right")) - 1
                stop = min(b, int(suffixes.offsets[r + 1]))
                spans[r].append({"start": a - int(suffixes.offsets[r]), "end": stop - int(suffixes.offsets[r])})
                a = stop
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [chunk.ids, pa.array(n_words), pa.array(n_words - np.diff(kept)),
                   pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()), pa.array(spans, kind)]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
        if with_text:
            columns, names = [*columns, pa.array(texts, pa.string())], [*names, "kept_text"]
        yield pa.RecordBatch.from_arrays(columns, names=names)
    return act


def remove_repeats(docs: DataFrame, with_text: bool = True, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans[, kept_text]) of every row.

    ``spans``: the removed runs of words, [start, end).
    """
    chunks = chunk_table(docs, name="passages")
    buckets = n_buckets(chunks)
    counted = save(answer(ask(chunks, ask_anchors(buckets)), buckets, count_anchors(group)), "passages-counts")
    asked = meet(chunks, counted, ask_groups(buckets), "chunk long, bucket int, blob binary")
    found = answer(asked, buckets, repeated_windows)
    answers = found.union(counted.select("chunk", (F.col("bucket") + buckets).alias("bucket"), "blob"))
    if _has_extended(counted):
        answers = answers.union(extended_answers(chunks, counted, buckets))
    schema = ("doc_id long, n_words long, n_removed long, kept_sha256 string, "
              "spans array<struct<start: bigint, end: bigint>>" + (", kept_text string" if with_text else ""))
    return meet(chunks, answers, _finish(buckets, with_text), schema)


def _has_extended(counted: DataFrame) -> bool:
    def run(batches):
        for batch in batches:
            hit = any((unpack(b.as_py())[0] == 2).any() for b in batch.column("blob"))
            yield pa.record_batch([pa.array([1] if hit else [], pa.int32())], names=["hit"])

    return counted.mapInArrow(run, "hit int").limit(1).count() > 0


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: words, removed words and what is kept."""
    return remove_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
