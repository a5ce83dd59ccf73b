import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from critrank.llm import scoring
from critrank.llm.chunks import Chunk, deal_ascending, expand, squeeze
from pyspark.sql import functions as F


def tokens(t):
    low = (t or "").translate({k: k + 32 for k in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows, held, priors):
    """A walk from word to word, by counts in dictionaries."""
    seen = [Counter(), Counter(), Counter()]  # words, bigrams, trigrams
    for (i, t), h in zip(rows, held):
        if not h:
            w = [None, *tokens(t)]
            for n in range(3):
                seen[n].update(tuple(w[k - n:k + 1]) for k in range(max(1, n), len(w)))
    n, v, once = sum(seen[0].values()), len(seen[0]), sum(c == 1 for c in seen[0].values())
    m = (once + 0.5) / (n + 1) if n else 1.0

    def p(state, x):
        if not state:
            return (1 - m) * seen[0][x,] / n if seen[0][x,] else m
        mass = priors[len(state) - 1]
        return (seen[len(state)][*state, x] + mass * p(state[1:], x)) / (seen[len(state) - 1][state] + mass)

    out = []
    for (i, t), h in zip(rows, held):
        w, state, score = tokens(t), (None,) if n else (), 0.0
        for x in w:
            weight, at = 0.0, state
            while at and not seen[len(at)][*at, x]:  # failure arcs
                mass = priors[len(at) - 1]
                weight += math.log10(mass / (seen[len(at) - 1][at] + mass))
                at = at[1:]
            score += weight + math.log10(p(at, x))
            state = (*at, x)[-2:]
            while state and not seen[len(state) - 1][state]:
                state = state[1:]
        out.append((i, h, len(w), sum(seen[0][x,] > 0 for x in w), n,
                    sum(math.log10((seen[0][x,] + 1) / (n + v + 1)) for x in w), score))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[2], round(r[5], 3))


@pytest.mark.parametrize("table", ["odd", "small"])
def test_scores(table, request, rows_of):
    df = request.getfixturevalue(table)
    rows = rows_of(df)
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    got = sorted(map(tuple, scoring.digest(df.repartition(5)).collect()), key=key)
    expected = sorted(brute(rows, held, scoring.PRIORS), key=key)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert np.allclose([g[5:] for g in got], [e[5:] for e in expected], rtol=1e-9, atol=1e-7)


def test_one_chunk_or_many_and_short_priors(small, rows_of, monkeypatch):
    monkeypatch.setattr(scoring, "CHUNK_BYTES", 4000)
    rows = rows_of(small)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    got = sorted(map(tuple, scoring.score(small, scoring.remainder(7) != 2, (2.0, 0.5)).collect()), key=lambda r: r[0])
    expected = sorted(brute(rows, held, (2.0, 0.5)), key=lambda r: r[0])
    assert [g[2:5] for g in got] == [e[2:5] for e in expected]
    assert np.allclose([g[5:] for g in got], [e[5:] for e in expected], rtol=1e-9, atol=1e-7)


def test_probabilities_sum_to_one():
    """After any state, the words of a chunk and the unknown word share all of the probability."""
    text = "a b a b c a b a c c a b"
    chunk = Chunk(Chunk.of(pa.table({"doc_id": [1], "text": [text + " zz"], "flag": [True]})))
    t = scoring.Tokens(chunk)
    names = [*dict.fromkeys(text.split()), "zz", None]  # zz stands for all unknown words; None is the end
    seen = [*text.split(), None]
    train = [Counter(), Counter(), Counter()]
    for n in range(3):
        train[n].update(tuple([None, *seen][k - n:k + 1]) for k in range(max(1, n), len(seen) + 1))
    states = [(x,) for x in names if train[0][x,]] + [x for x in train[1] if x[1] is not None]
    pairs = [(x, y) for x in names for y in names]
    triples = [(*x, y) for x in pairs if x[1] is not None for y in names]
    number = {x: k for x, k in zip(names, range(5))}
    model = scoring.Automaton(
        [np.array([train[0][x,] for x in names]), np.array([train[1][x] for x in pairs]),
         np.array([train[2][x] for x in triples])],
        np.array([number[x[0]] for x in pairs]), np.array([number[x[1]] for x in pairs]),
        np.array([pairs.index(x[:2]) for x in triples]), np.array([pairs.index(x[1:]) for x in triples]), len(seen), 1,
        (7.0, 3.0))
    assert t.symbol[-1] == len(t.keys[0]) - 1
    for state in states:
        total = 0.0
        for x in names:
            path = [*state, x]
            gram = [pairs.index((a, b)) for a, b in zip([None, *path], path)]
            triple = [-1] + [triples.index((a, b, c)) if b is not None else -1
                             for a, b, c in zip([None, *path], path, path[1:])]
            total += 10 ** model.walk(np.array([number[c] for c in path]), np.array(gram), np.array(triple), number[None])[-1]
        assert total == pytest.approx(1), state


def test_squeezed_keys():
    r = np.random.default_rng(3)
    for n, buckets in [(0, 7), (1, 1), (1, 160), (5000, 3), (2000, 25600)]:
        keys = np.unique(np.concatenate([r.integers(0, 1 << 64, n, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)[:n]]))
        order, starts = deal_ascending(keys, buckets)
        back = []
        for b in np.flatnonzero(np.diff(starts)):
            own = keys[order[starts[b]:starts[b + 1]]]
            back.append(expand(squeeze(own, buckets), len(own)) * np.uint64(buckets) + np.uint64(b))
            assert (back[-1] == own).all()
        assert sum(map(len, back)) == len(keys)
    assert len(expand(squeeze(np.zeros(0, np.uint64), 5), 0)) == 0


def test_nothing_to_learn_from_and_empty(odd, none):
    rows = scoring.score(odd, F.lit(False)).collect()
    assert len(rows) == odd.count() and all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0 and r.base_score == 0
                                            for r in rows)
    assert scoring.digest(none).collect() == []


def test_context_helps_on_text_that_was_not_seen(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = scoring.digest(df).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row.s > row.b
