"""LM scoring: a weighted backoff automaton over trigrams.

The text of a document is its words (A-Z in lower case) and one end.  Trigrams
are smoothed with a Dirichlet prior towards bigrams, and those towards words:

    P(w | u v) = (c(uvw) + PRIORS[1] * P(w | v)) / (c(uv) + PRIORS[1])
    P(w | v)   = (c(vw) + PRIORS[0] * P(w)) / (c(v) + PRIORS[0])

with P(w) = (1 - m) c(w) / N for a word seen in training and m for all others,
m being the share of words seen once.  In the automaton, every word and every
bigram seen is a state.  A state's arc for a word that was seen after it has the
log10 probability as its weight.  Without such an arc the walk takes the failure
arc, from a bigram to its last word and from there to the root, which weighs
log10(PRIOR / (c(state) + PRIOR)), and goes on from there; the root has an arc,
log10 P(w), for any word.  An arc leads to the state of the longest seen suffix.
A walk goes through a text from left to right, starts in the state of the end,
carries the state from word to word, and adds up the weights.

Counts are those of the whole corpus.  Chunks of documents ask for the counts
of their own words, bigrams and trigrams (``chunks``), and walk the part of the
automaton that they were answered.  No vocabulary is gathered or broadcast, pruned
or cut.

Defined results: a null text is empty (its end is scored); a very long text is a
chunk of its own; without any training row no word is known, and every token has
probability one as the unknown word; a null doc_id counts as the empty text;
extra columns and repeated rows stay rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunk, answer, ask, chunk_table, deal_ascending, expand, meet, n_buckets, squeeze
from .common import flat_words, lower_ascii, mix, pack, partitions, save, unpack, word_hashes
from .linear import remainder

#: Weight of the shorter context's probability, in observations of a context of one and of two words.
PRIORS = (1000.0, 10.0)
CHUNK_BYTES = 12 << 20
#: Chunks are written and shuffled once; a higher level than the other blobs' saves shuffle.
ZSTD = 6
#: Chunks that a task of the walk has, about.
CHUNKS_A_PART = 4
#: No word has a line feed in it.
_END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
_RESULT = pa.schema([("doc_id", pa.int64()), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


class Tokens:
    """Tokens of a chunk, numbered, with its distinct words, bigrams and trigrams.

    ``symbol``: token numbers, the end's last of each text; ``bounds``: where texts
    start; ``pair``, ``triple``: the bigram and trigram that each token completes, a
    text's first token a bigram with the end before it and no trigram (-1).
    ``keys``: hashes of words, bigrams and trigrams.
    """

    def __init__(self, chunk: Chunk):
        offsets, words = flat_words(lower_ascii(chunk.texts))
        coded = words.dictionary_encode()
        n, rows = len(words), len(offsets) - 1
        del words
        end = len(coded.dictionary)
        hashes = np.concatenate([word_hashes(coded.dictionary), [_END]]).astype(np.uint64)
        self.bounds = offsets + np.arange(rows + 1)
        self.row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(self.bounds))
        self.symbol = np.full(n + rows, end, np.int32)
        inner = np.ones(n + rows, bool)
        inner[self.bounds[1:] - 1] = False
        self.symbol[inner] = coded.indices.to_numpy()
        del coded
        inner = np.flatnonzero(np.concatenate(([False], self.symbol[:-1] != end)))  # all but the first token of a text
        codes = np.concatenate(([end], self.symbol[:-1])) * np.int64(end + 1) + self.symbol
        self.left, self.right, self.pair = _numbered(codes, end + 1)
        codes = self.pair[inner - 1] * np.int64(end + 1) + self.symbol[inner]
        self.context, last, triple = _numbered(codes, end + 1)
        del codes
        self.triple = np.full(n + rows, -1, np.int32)
        self.triple[inner] = triple
        self.shorter = np.zeros(len(last), np.int32)  # the bigram that a trigram ends in
        self.shorter[triple] = self.pair[inner]
        pair_hashes = mix(hashes[self.left] * np.uint64(3) + mix(hashes)[self.right])
        self.keys = (hashes, pair_hashes, mix(pair_hashes[self.context] * np.uint64(5) + mix(hashes)[last]))


def _numbered(codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both parts of each distinct code, left * base + right, and each code's number among them."""
    order = np.argsort(codes)
    ranked = codes[order]
    new = np.concatenate((np.ones(min(1, len(codes)), bool), ranked[1:] != ranked[:-1]))
    number = np.empty(len(codes), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    ranked = ranked[new]
    return (ranked // base).astype(np.int32), (ranked % base).astype(np.int32), number


def _narrow(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def ask_counts(buckets: int):
    """A chunk's words, bigrams and trigrams, each with its count in the chunk's training rows."""
    def question(_, chunk):
        t = Tokens(chunk)
        trained = chunk.flag[t.row] > 0
        grams = []
        for keys, at in zip(t.keys, (t.symbol, t.pair, t.triple)):
            counts = _narrow(np.bincount(at[trained & (at >= 0)], minlength=len(keys)))
            grams.append((keys, counts, *deal_ascending(keys, buckets)))
        del t, trained, at
        for b in np.flatnonzero(sum(np.diff(starts) for *_, starts in grams)):
            found = []
            for keys, counts, order, starts in grams:
                own = order[starts[b]:starts[b + 1]]
                found += [squeeze(keys[own], buckets), _narrow(counts[own])]
            yield int(b), pack(*found)
    return question


def count(chunks: list[int], blobs: list[bytes]) -> list[tuple[int, bytes]]:
    """Corpus counts of a bucket's keys; for chunk -1, its tokens, words and words seen once."""
    parts, out, totals = [unpack(b) for b in blobs], [], None
    for k in (0, 2, 4):
        keys, inverse = np.unique(np.concatenate([expand(p[k], len(p[k + 1])) for p in parts]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([p[k + 1] for p in parts]), len(keys)).astype(np.int64)
        if k == 0:
            totals = np.array([total.sum(), (total > 0).sum(), (total == 1).sum()])
        out.append(np.split(total[inverse], np.cumsum([len(p[k + 1]) for p in parts])[:-1]))
    return [(c, pack(*[_narrow(x) for x in found])) for c, *found in zip(chunks, *out)] + [(-1, pack(totals))]


class Automaton:
    """States, arcs and failure arcs between the n-grams of a chunk.

    States are the root (0), words and bigrams, numbered in this order; those with
    training count 0 are never entered.  ``failure``: weight of a state's failure arc,
    ``back``: where it leads.  ``arcs``: weights of the arcs that complete a trigram, a
    bigram and a word, nan for one that was never seen; ``seen``: states with a count.
    """

    def __init__(self, counts: list[np.ndarray], left: np.ndarray, right: np.ndarray, context: np.ndarray,
                 shorter: np.ndarray, total: int, once: int, priors: tuple[float, float] = PRIORS):
        words, pairs, triples = counts
        unseen = (once + 0.5) / (total + 1) if total else 1.0
        root = np.where(words > 0, (1 - unseen) * words / max(1, total), unseen)
        pair = (pairs + priors[0] * root[right]) / (words[left] + priors[0])
        triple = (triples + priors[1] * pair[shorter]) / (pairs[context] + priors[1])
        for own, counted in ((pair, pairs), (triple, triples)):
            own[counted == 0] = np.nan
            np.log10(own, out=own)
        self.arcs = (triple, pair, np.log10(root))
        self.words, self.pairs = 1, 1 + len(words)  # the first state of each kind
        self.failure = np.log10(np.concatenate(([1.0], priors[0] / (words + priors[0]), priors[1] / (pairs + priors[1]))))
        self.back = np.concatenate((np.zeros(self.pairs, np.int32), self.words + right))
        self.seen = np.concatenate(([True], words > 0, pairs > 0))

    def states(self, symbol: np.ndarray, pair: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The state after each step: that of its longest seen suffix; after an ``end``, the end's own."""
        state = np.where(ends, self.words + symbol, self.pairs + pair)
        for _ in self.arcs:
            state = np.where(self.seen[state], state, self.back[state])
        return state

    def walk(self, symbol: np.ndarray, pair: np.ndarray, triple: np.ndarray, end: int) -> np.ndarray:
        """The weight of each step of a walk that starts in the state of ``end``.

        A state is the longest seen suffix, so the states that the walk carries are known
        for all steps; failure arcs are then followed from each, until an arc fits.
        """
        after = self.states(symbol, pair, symbol == end)
        first = self.words + end
        at = np.concatenate(([first if self.seen[first] else 0], after[:-1]))
        weight = np.zeros(len(symbol))
        for kind, (arc, gram) in enumerate(zip(self.arcs, (triple, pair, symbol))):
            lowest = (self.pairs, self.words, 0)[kind]  # states from here on have arcs of this kind
            here = np.flatnonzero((at >= lowest) & (gram >= 0))
            own = arc[gram[here]]
            fits = ~np.isnan(own)
            weight[here[fits]] += own[fits]
            at[here[fits]] = -1  # the step is done
            rest = here[~fits]
            weight[rest] += self.failure[at[rest]]
            at[rest] = self.back[at[rest]]
        return weight


def _score(buckets: int, total: int, words: int, once: int, priors: tuple[float, float]):
    def act(name, chunk, answers):
        t = Tokens(chunk)
        dealt = [deal_ascending(keys, buckets) for keys in t.keys]
        counts = [np.zeros(len(keys), np.int64) for keys in t.keys]
        t.keys = ()
        for b, blob in answers.items():
            for own, (order, starts), found in zip(counts, dealt, unpack(blob)):
                own[order[starts[b]:starts[b + 1]]] = found
        del dealt
        model = Automaton(counts, t.left, t.right, t.context, t.shorter, total, once, priors)
        steps = model.walk(t.symbol, t.pair, t.triple, len(counts[0]) - 1)  # each text starts where the one before ended
        rows = len(t.bounds) - 1
        del model
        c = counts[0][t.symbol]
        base = np.log10((c + 1) / (total + words + 1))
        yield pa.RecordBatch.from_arrays([
            chunk.ids, pa.array(chunk.flag > 0), pa.array(np.diff(t.bounds)),
            pa.array(np.bincount(t.row[c > 0], minlength=rows).astype(np.int64)), pa.array(np.full(rows, total, np.int64)),
            pa.array(np.bincount(t.row, base, rows)), pa.array(np.bincount(t.row, steps, rows))], schema=_RESULT)
    return act


def score(docs: DataFrame, trained, priors: tuple[float, float] = PRIORS) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``trained``: a column, true for the rows whose counts make the model.
    """
    chunks = chunk_table(docs, F.coalesce(trained, F.lit(False)), CHUNK_BYTES, "scoring", level=ZSTD)
    buckets = n_buckets(chunks)
    answers = save(answer(ask(chunks, ask_counts(buckets)), buckets, count), "scoring-counts")

    def totals(batches):
        for batch in batches:
            found = [unpack(b.as_py())[0] for b in batch.column("blob")]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in found], pa.int64()) for k in range(3)],
                                             names=["n", "v", "once"])

    whole = (answers.where("chunk = -1").mapInArrow(totals, "n long, v long, once long")
             .agg(F.sum("n"), F.sum("v"), F.sum("once")).first())
    n, v, once = (int(x or 0) for x in whole)
    return meet(chunks, answers.where("chunk >= 0"), _score(buckets, n, v, once, priors),
                "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double", max(partitions(docs.sparkSession), buckets // CHUNKS_A_PART))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document; the model learns from the rows that aren't held out."""
    return score(docs, remainder(7) != 2).select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
