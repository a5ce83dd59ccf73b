"""Vector code compression (product quantisation), entries found through a GNAT.

Vectors are cut into equal consecutive parts; each part position has a codebook,
and a vector's code is the index of its nearest entry at each position.  Entries
are searched through a geometric near-neighbour access tree: a node's split points
are spread-out entries, every other entry belongs to its nearest split point, and
for each split point i and child j the node stores the least and largest distance
from i to the entries of j.  A query that is d away from i drops j as soon as
[d - r, d + r] misses that range, with r its best distance so far; the ranges and
distances are rounded outwards and must miss strictly, so that no possible tie is
dropped.  Distances that decide are integers; equal ones go to the lower index.

Start: position by position, the parts of the ``entries`` vectors with the smallest
ids, ascending.  See ``lloyd`` for the rounds.

Defined results: rows whose vector is null, has another number of components than
``dim``, or holds null, NaN or infinite ones are left out; scaled components beyond
+-2^24 count as +-2^24; repeated rows and ids count as often as they occur (the
codebook starts with them in order of their components); null ids come last; fewer
vectors than entries give as many entries; an empty table gives an empty result; a
sum of errors beyond 64 bits is null; extra columns make no difference.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lloyd

PARTS, ENTRIES, ROUNDS, SCALE, DIM = 4, 256, 4, 1024, 64
#: Split points of a node, and entries up to which a child is a plain list.
DEGREE, LEAF = 16, 16
#: Doubles are rounded outwards by this share, far above their own error.
SLACK = 1e-12


#: Below this, squared distances by way of products are exact in doubles.
EXACT = 1 << 22


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    off = x - y
    return (off * off).sum(axis=-1)


def _all_squares(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, points).  Doubles below ``EXACT``, integers above."""
    if x.dtype == np.float64:
        p = points.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ p.T) + (p * p).sum(axis=1)[None]).astype(np.int64)
    return np.stack([_squares(x, p) for p in points], 1)


class Gnat:
    """A tree over the rows of ``points`` (integers); ``numbers`` are their indexes, ascending."""

    def __init__(self, points: np.ndarray, numbers: np.ndarray | None = None):
        numbers = np.arange(len(points)) if numbers is None else numbers
        self.measured = 0  # distances computed, for tests and tuning
        self.exact = bool(np.abs(points).max(initial=0) < EXACT)
        self.children: list[Gnat | None] = []
        if len(points) <= LEAF or (points == points[0]).all():
            self.splits, self.numbers, self.low = points, numbers, None
            return
        chosen, least = [0], _squares(points, points[0])
        while len(chosen) < DEGREE and least.max() > 0:  # the entry farthest from the chosen ones
            chosen.append(int(least.argmax()))
            least = np.minimum(least, _squares(points, points[chosen[-1]]))
        chosen.sort()
        self.splits, self.numbers = points[chosen], numbers[chosen]
        to = _all_squares(points, self.splits)
        home = to.argmin(axis=1)
        home[chosen] = np.arange(len(chosen))
        rest = np.ones(len(points), bool)
        rest[chosen] = False
        m = len(chosen)
        self.low, self.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        for j in range(m):
            mine = rest & (home == j)
            self.children.append(Gnat(points[mine], numbers[mine]) if mine.any() else None)
            if mine.any():
                far = np.sqrt(to[mine].astype(np.float64))
                self.low[:, j], self.high[:, j] = far.min(axis=0) * (1 - SLACK), far.max(axis=0) * (1 + SLACK)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest entry."""
        best, which = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.iinfo(np.int64).max)
        if self.exact and np.abs(x).max(initial=0) < EXACT:
            x = x.astype(np.float64)
        self._visit(x, np.arange(len(x)), best, which)
        return which, best

    def _visit(self, x: np.ndarray, rows: np.ndarray, best: np.ndarray, which: np.ndarray) -> None:
        squares = _all_squares(x[rows], self.splits)
        self.measured += squares.size
        first = squares.argmin(axis=1)  # numbers ascend, so of equal distances the lower number
        d, number = squares[np.arange(len(rows)), first], self.numbers[first]
        better = (d < best[rows]) | (d == best[rows]) & (number < which[rows])
        best[rows[better]], which[rows[better]] = d[better], number[better]
        if self.low is None:
            return
        away = np.sqrt(squares.astype(np.float64))
        m = len(self.splits)
        bound = np.full((len(rows), m), -np.inf)  # no entry of child j is closer than this; inf where it has none
        for i in range(m):
            near, far = away[:, i, None] * (1 - SLACK), away[:, i, None] * (1 + SLACK)
            np.maximum(bound, np.maximum(self.low[i] - far, near - self.high[i]), out=bound)
        order = np.argsort(away, axis=1, kind="stable")
        for r in range(m):  # each query's children, nearest split point first
            child = order[:, r]
            live = np.flatnonzero(bound[np.arange(len(rows)), child] <= self._radius(best[rows]))
            live = live[np.argsort(child[live], kind="stable")]
            cuts = np.searchsorted(child[live], np.arange(m + 1))
            for j in np.flatnonzero(cuts[1:] > cuts[:-1]):
                self.children[j]._visit(x, rows[live[cuts[j]:cuts[j + 1]]], best, which)

    @staticmethod
    def _radius(best: np.ndarray) -> np.ndarray:
        return np.sqrt(best.astype(np.float64)) * (1 + SLACK)

    def total_measured(self) -> int:
        return self.measured + sum(c.total_measured() for c in self.children if c is not None)


def start(table: DataFrame, id_col: str, entries: int, parts: int, dim: int) -> list[np.ndarray]:
    first = lloyd.smallest(table.select(id_col, "v"), id_col, [F.col(id_col).asc_nulls_last(), F.col("v").asc()],
                           entries).collect()  # ``entries`` rows
    whole = np.array([r["v"] for r in first], np.int64).reshape(-1, dim)
    return np.split(whole, parts, axis=1)


def compress(df: DataFrame, keep: list[str], id_col: str = "vec_id", vector: str = "embedding", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             dim: int = DIM) -> tuple[DataFrame, list[np.ndarray]]:
    """((*keep, entries ARRAY<INT>, error) of every usable vector, the final codebooks).

    ``keep`` has ``id_col``; ``dim`` is a multiple of ``parts``.
    """
    table = lloyd.integer_vectors(df, keep, vector, scale, dim, "code-vectors")
    books = start(table, id_col, entries, parts, dim)
    if not len(books[0]):
        return table.select(*keep, F.array().cast("array<int>").alias("entries"),
                            F.lit(0).cast("bigint").alias("error")), books
    for _ in range(rounds):
        books = lloyd.moved(table, books, Gnat)
    return lloyd.assigned(table, keep, books, Gnat, "codes"), books


def digest(df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256.

    Errors are summed by label before the join; Spark broadcasts the sums if their
    size allows, and else splits a label with very many rows as a skewed join.
    """
    rows, books = compress(df.select("vec_id", "embedding", "label"), ["vec_id", "label"])
    sums = rows.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    code = F.array_join(F.transform("entries", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    sha = hashlib.sha256(lloyd.decimal_text(books).encode()).hexdigest()
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
