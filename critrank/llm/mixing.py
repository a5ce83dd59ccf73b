"""Mixing sources to target weights: Pfair blocks, earliest deadline first.

A source's target weight is an exact share x.  Its block i is released at slot
floor(i/x) and due by slot ceil((i+1)/x); in each slot the released block with
the earliest deadline goes.  One unit of work per slot and shares that sum to one
make every block meet its window, so after any number of slots a source deviates
from its target by less than one block.  The schedule is cut into segments that
tasks place on their own: ``boundary`` says, from the shares alone, which blocks
go before a cut, such that both sides can keep all windows.

A source with less than two blocks in a segment would reach over several; such
sources are one group, whose blocks go to the last slot of the group's windows,
and are placed among themselves in the same way.  Where there is such a group,
deviations add up, to less than one block for each level.

Without target weights a source's target is its own share of the rows: all sources
run out together and every row is in the mix.  A caller may cap shares (``max_share``)
or name weights.  The mix then ends where the first source runs out.  All rows of
sources that run out there are in it (with a cap, all rows of all sources below it);
the others' rows past that end are surplus, placed after the schedule.

The shares, one number for each source, are on the driver; rows never are.

Defined results: null is a source of its own; rows of a source are taken in
the order of a seeded hash of ``key``, then ``key`` (nulls first); repeated
rows are rows of their own; an empty table gives an empty result; extra
columns stay, but an input column named like an output column is replaced.
"""

from __future__ import annotations

import heapq
from decimal import Decimal
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare, number_rows, partitions, shielded

#: Slots of a segment, which a task places at once.
PERIOD = 20_000
BLOCK_ROWS = 4
OUTPUT = ("source_row", "block", "release", "deadline", "slot", "position", "in_mix")


def capped_shares(counts: dict, max_share: float = 1.0) -> dict:
    """Exact share of each source: its share of rows, none above ``max_share``.

    What the capped sources give up goes to the others in proportion.  With
    too few sources for the cap, they share equally.
    """
    total = sum(counts.values())
    if not total:
        return {}
    cap = max(Fraction(max_share), Fraction(1, len(counts)))
    free, share = dict(counts), {}
    while free:
        left = 1 - cap * len(share)
        over = [s for s, n in free.items() if left * n > cap * sum(free.values())]
        if not over:
            share |= {s: left * n / sum(free.values()) for s, n in free.items()}
            break
        for s in over:
            share[s] = cap
            del free[s]
    return share


def capped_weights(counts: dict, max_share: float = 1.0, period: int = PERIOD) -> dict:
    """``capped_shares`` as whole slots of a period, which has one for each source at least."""
    if len(counts) > period:
        raise ValueError(f"{len(counts)} sources; a period has {period} slots")
    share = capped_shares(counts, max_share)
    return whole_slots(share, period) if share else {}


def whole_slots(share: dict, period: int = PERIOD) -> dict:
    """Shares as whole slots of a period: largest remainders, one slot at least."""
    share = {s: Fraction(x) / sum(map(Fraction, share.values())) for s, x in share.items()}
    slots = {s: max(1, int(x * period)) for s, x in share.items()}
    rest = sorted(share, key=lambda s: (int(share[s] * period) - share[s] * period, str(s), s is None))
    gap = period - sum(slots.values())
    for k in range(max(0, gap)):
        slots[rest[k % len(rest)]] += 1
    for _ in range(max(0, -gap)):  # paid by the largest
        slots[max(slots, key=lambda s: (slots[s], str(s)))] -= 1
    return slots


def boundary(shares: list[Fraction], cut: int) -> list[int]:
    """Blocks of each source before slot ``cut``: the share of it, rounded down or up.

    Of the blocks whose windows reach over the cut, those go before it that the
    slots behind it have no room for by their deadlines, earliest release first,
    and then the earliest released until the slots before it are full.
    """
    done = [cut * x.numerator // x.denominator for x in shares]
    left = cut - sum(done)
    due = [(-(-(k + 1) * x.denominator // x.numerator), n, k) for n, (k, x) in enumerate(zip(done, shares))]
    over = sum(cut * x.numerator % x.denominator > 0 for x in shares)
    heapq.heapify(due)
    seen, early = 0, []
    while left and over:
        deadline = due[0][0]
        while due[0][0] == deadline:
            _, n, k = due[0]
            x = shares[n]
            heapq.heapreplace(due, (-(-(k + 2) * x.denominator // x.numerator), n, k + 1))
            seen += 1
            release = k * x.denominator // x.numerator
            if k * x.denominator < cut * x.numerator:  # the window begins before the cut
                heapq.heappush(early, (release, n))
                over -= 1
        need = seen - (deadline - cut)
        while need > 0 and left:
            done[heapq.heappop(early)[1]] += 1
            left, seen, need = left - 1, seen - 1, need - 1
    for _ in range(left):
        done[heapq.heappop(early)[1]] += 1
    return done


def segment(shares: list[Fraction], start: int, stop: int) -> list[tuple[int, int, int]]:
    """(source, block, slot) of slots ``start`` to ``stop``, by EDF."""
    done, goal, out = boundary(shares, start), boundary(shares, stop), []
    waiting = [(max(start, done[n] * x.denominator // x.numerator), n) for n, x in enumerate(shares)
               if done[n] < goal[n]]  # (release, source)
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    for t in range(start, stop):
        while waiting and waiting[0][0] <= t:
            _, n = heapq.heappop(waiting)
            x = shares[n]
            heapq.heappush(ready, (min(stop, -(-(done[n] + 1) * x.denominator // x.numerator)), n))
        _, n = heapq.heappop(ready)
        out.append((n, done[n], t))
        done[n] += 1
        if done[n] < goal[n]:
            heapq.heappush(waiting, (done[n] * shares[n].denominator // shares[n].numerator, n))
    return out


def one_period(slots: dict) -> dict:
    """The slot of each block j < k_s of each source in one period, by EDF."""
    period = sum(slots.values())
    order = sorted(slots, key=lambda s: (s is not None, str(s)))
    out = {s: [] for s in order}
    for n, _, t in segment([Fraction(slots[s], period) for s in order], 0, period):
        out[order[n]].append(t)
    return out


class Schedule:
    """Slots of the blocks of sources 0, 1, ... with exact shares that sum to one.

    A level has sources with two blocks a segment at least; all smaller ones are
    the next level's.  ``blocks``: how many blocks of each source there are;
    ``stop``: the slot up to which all levels are placed, and beyond it until the
    blocks of the sources ``whole`` are.
    """

    def __init__(self, shares: list[Fraction], blocks: list[int], stop: int, whole: set[int], period: int = PERIOD):
        self.blocks, self.length = blocks, max(period, 4 * len(shares))
        self.levels, self.place, self.first = [], {}, [0]
        self.placed = [0] * len(shares)  # blocks of each source that get a slot
        rest, outer = list(range(len(shares))), Fraction(1)
        while rest:
            total = sum(shares[n] for n in rest)
            main = [n for n in rest if shares[n] * self.length >= 2 * total]
            rest = [n for n in rest if shares[n] * self.length < 2 * total]
            part = sum(shares[n] for n in main)
            own = [shares[n] / part for n in main]
            last = max([stop * part, *(blocks[n] / x for n, x in zip(main, own) if n in whole)])
            count = -(-last // self.length) + 1
            for n, k in zip(main, boundary(own, count * self.length)):
                self.placed[n] = min(k, blocks[n])
                self.place[n] = len(self.levels)
            self.levels.append((main, own, part / total))
            self.first.append(self.first[-1] + count)
        self.end = 1 + max(self.slot(level, (self.first[level + 1] - self.first[level]) * self.length)
                           for level in range(len(self.levels)))

    def slot(self, level: int, at: int) -> int:
        """The slot of the whole mix of a level's own slot."""
        main = self.levels[level][2]
        at = at * main.denominator // main.numerator  # the group's slots left out
        for above in reversed(self.levels[:level]):
            group = 1 - above[2]
            at = -(-(at + 1) * group.denominator // group.numerator) - 1
        return at

    def part(self, k: int) -> list[tuple[int, int, int]]:
        """(source, block, slot) of the k-th segment of all levels."""
        level = next(n for n in range(len(self.levels)) if k < self.first[n + 1])
        main, own, _ = self.levels[level]
        start = (k - self.first[level]) * self.length
        return [(main[n], i, self.slot(level, t)) for n, i, t in segment(own, start, start + self.length)
                if i < self.blocks[main[n]]]

    def last(self, sources: set[int]) -> dict[int, int]:
        """The slot of the last block of each of ``sources``."""
        found: dict[int, int] = {}
        segments: dict[int, set[int]] = {}
        for n in sources:
            level = self.place[n]
            x = self.levels[level][1][self.levels[level][0].index(n)]
            i = self.blocks[n] - 1
            for t in (i / x // 1, max(i / x // 1, -(-(i + 1) // x) - 1)):  # its window's ends
                segments.setdefault(self.first[level] + int(t) // self.length, set()).add(n)
        for k, wanted in segments.items():
            found |= {n: t for n, i, t in self.part(k) if n in wanted and i == self.blocks[n] - 1}
        return found


def mix_sources(df: DataFrame, source: str = "source", key: str = "doc_id", weights: dict | None = None,
                max_share: float = 1.0, period: int = PERIOD, block_rows: int = BLOCK_ROWS,
                seed: int = 9) -> DataFrame:
    """``df`` with the block, its window, its slot, ``position`` and ``in_mix`` of each row.

    ``weights``: target weight of each source (any positive numbers); without it, its
    share of the rows, none above ``max_share``.  ``position`` orders the mix; ``in_mix`` is false
    for surplus rows, and for rows of sources without a weight.
    """
    spark = df.sparkSession
    df, names = shielded(df.drop(*[c for c in df.columns if c.lower() in OUTPUT]))
    source, key = names[source], names[key]
    sizes = df.groupBy(F.col(source).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r.s: r.n for r in sizes.collect()}  # one row for each source
    if weights is None:
        share = capped_shares(counts, max_share)
    else:
        share = {s: Fraction(str(w)) for s, w in weights.items() if w > 0 and counts.get(s)}
        share = {s: x / sum(share.values()) for s, x in share.items()}
    if any(max(x.numerator, x.denominator) >= 10 ** 19 for x in share.values()):
        raise ValueError("weights must be ratios of numbers below 10^19")
    order = list(share)
    blocks = [-(-counts[s] // block_rows) for s in order]
    rows_at_end = min((counts[s] / share[s] for s in order), default=Fraction(0))
    whole = {n for n, s in enumerate(order) if counts[s] / share[s] == rows_at_end}
    plan, horizon, end = None, 0, 0
    if order:
        stop = -(-rows_at_end // block_rows)
        plan = Schedule([share[s] for s in order], blocks, stop, whole, period)
        horizon, end = max(stop, min(plan.last(whole).values()) + 1), plan.end
    starts, at = [], 0
    for s in sorted(counts, key=lambda s: (s is not None, s)):  # the order of number_rows
        n = order.index(s) if s in share else None
        if n is None:
            starts.append((s, at, None, None, None, None, None, False))
        else:
            x = share[s]
            starts.append((s, at, n, Decimal(x.numerator), Decimal(x.denominator), plan.placed[n], end, n in whole))
            end += blocks[n] - plan.placed[n]
        at += counts[s]
    kind = dict(df.dtypes)[source]
    base = spark.createDataFrame(starts, f"_s {kind}, _start long, _source long, _num decimal(19,0), "
                                 "_den decimal(19,0), _placed long, _after long, _whole boolean")
    segments = plan.first[-1] if plan else 0

    def place(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                found = plan.part(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in found], pa.int64()) for c in range(3)], names=["_ps", "_b", "_t"])

    slots = spark.range(0, segments, 1, max(1, min(segments, partitions(spark)))).mapInArrow(
        place, "_ps long, _b long, _t long")
    ranked = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    numbered, _ = number_rows(ranked, [source, "_h", key], "_n", "mix")
    whole_number = "cast(block as decimal(19,0))"
    if len(starts) <= PERIOD:
        base = F.broadcast(base)
    rows = (numbered.join(base, F.col(source).eqNullSafe(F.col("_s")))
            .withColumn("source_row", F.col("_n") - F.col("_start"))
            .withColumn("block", F.expr(f"source_row div {block_rows}"))
            # Spark takes the schedule for a small table, but it has a row for each block
            .join(slots.hint("shuffle_hash"), (F.col("_source") == F.col("_ps")) & (F.col("block") == F.col("_b")), "left")
            .withColumn("release", F.expr(f"({whole_number} * _den) div _num"))
            .withColumn("deadline", F.expr(f"-((-({whole_number} + 1) * _den) div _num)"))
            .withColumn("deadline", F.expr(f"deadline + cast(deadline * _num < ({whole_number} + 1) * _den as int)"))
            .withColumn("slot", F.expr("coalesce(_t, _after + block - _placed)"))
            .withColumn("position", F.expr(f"slot * {block_rows} + source_row % {block_rows}"))
            .withColumn("in_mix", F.coalesce(F.col("_whole") | (F.col("slot") < F.lit(int(horizon))), F.lit(False))))
    return bare(rows, names, *OUTPUT)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: where the mix puts it, and whether it is in the mix."""
    return mix_sources(docs.select("doc_id", "source")).select(
        "doc_id", "source", *OUTPUT)
