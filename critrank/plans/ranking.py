"""Rank candidates for many job descriptions in one job.

Inputs
  feats        candidate features (``plans.features.build_features``)
  jd_weights   (jd_id, weights ARRAY<DOUBLE>) from ``criteria.weight_vectors``
  dim_vectors  (ordinal, vec) shared by all JDs, or (jd_id, ordinal, vec)

Plan
  1. per candidate: similarity to the dimension vectors, fused source scores
  2. stage-1 = sum_d weight[d] * fused[d].  The best candidates of a few JDs give every
     JD a limit that its k best reach surely.  Then, for all JDs in one scan of narrow
     feature rows, chunks of candidates meet the JD weights (blocks of bounded bytes) as
     arrays: leaves of similar candidates that can't reach a limit aren't looked into,
     and a task passes on the rows that do, k of a JD at most.  No candidate x JD row exists
  3. the tasks' best rows are merged in two stages, salted by task, so that even a
     single JD is merged by many tasks; the k x J survivors are written once
  4. survivors join their features and their JD's weights (Spark picks the joins
     by size); built-in pair scores come precomputed with the features, a model
     scorer reads the survivors' text
  5. per (JD, dimension) min-max of pair scores, blend, final, rank, reason

Ties: stage-1 by (score DESC, id ASC); the final rank by (score rounded to six
decimals DESC, id ASC) so that a six-decimal output is never out of id order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critrank.catalog import Catalog
from critrank.operators import explain, fusion, rerank, topk
from critrank.operators import vectors as vops
from critrank.session import materialize

#: Bytes of JD weights (and vectors), and of the k best rows of each, in one scan of the features.
JD_BLOCK_BYTES = 64 << 20
#: Cells (candidates x JDs) that a task scores at a time, and (candidates, JDs) of a product by own vectors.
CELLS = 1 << 21
TILE = (1 << 10, 1 << 9)
#: Candidates that a task puts in order at a time, and those of a leaf of them.
CHUNK, LEAF = 1 << 17, 64
#: Rows that a task holds before it leaves the k best of each JD.
HELD = 1 << 21
#: JDs whose best candidates give all JDs a limit.
PROBES = 32


def _per_jd(dim_vectors: DataFrame | None) -> bool:
    return dim_vectors is not None and "jd_id" in dim_vectors.columns


def _with_sources(feats: DataFrame, dim_vectors: DataFrame | None, catalog: Catalog) -> DataFrame:
    """Add ``emb`` (dimension similarities) and ``fused`` for JD-independent vectors.

    A feature table built with the dimension vectors already carries ``emb``
    (computed once per candidate in P3) and is used as is.
    """
    n = len(catalog.dimensions)
    if "emb" in feats.columns:
        f = feats
    elif dim_vectors is None:
        f = feats.withColumn("emb", F.array_repeat(F.lit(0.0), n))
    else:
        f = vops.dimension_scores(feats, dim_vectors, n, "embedding").withColumnRenamed(
            "emb_scores", "emb")
    return f.withColumn("fused", fusion.fused(F.col("emb"), F.col("bm25"), F.col("structured"),
                                              catalog))


def jd_table(jd_weights: DataFrame, dim_vectors: DataFrame | None, catalog: Catalog) -> DataFrame:
    """(jd_id, weights[, mat]): one row per JD, with its own dimension vectors if it has any."""
    w = jd_weights.select("jd_id", F.col("weights").cast("array<double>").alias("weights"))
    if not _per_jd(dim_vectors):
        return w
    n = len(catalog.dimensions)
    vecs = dim_vectors.groupBy("jd_id").agg(F.map_from_entries(F.collect_list(F.struct(  # n entries a JD
        F.col("ordinal").cast("int"), F.col("vec").cast("array<double>")))).alias("m"))
    mats = vecs.select("jd_id", F.array(*[F.try_element_at("m", F.lit(i)) for i in range(n)]).alias("mat"))
    return w.join(mats, "jd_id", "left")


class _JDs:
    """A block of JDs as arrays: weights (J, n), vectors (J, n, dim) if JDs have their own, and limits.

    A JD's limit (``least``, ``least_id``) is the k-th best of some rows: a row counts only
    with a greater score, or with this score and an id up to ``least_id`` (null: none).
    """

    def __init__(self, rows: pa.Table | pa.RecordBatch, n: int, fusion_weights: list[tuple[float, float, float]]):
        self.ids = rows.column("jd_id")
        if isinstance(self.ids, pa.ChunkedArray):
            self.ids = self.ids.combine_chunks()
        self.fusion = np.array(fusion_weights, dtype=np.float64).reshape(n, 3)
        self.weights = _matrix(rows.column("weights"), n)
        self.mats = self.lines = None
        if "mat" in rows.schema.names:
            entries = [pc.list_element(rows.column("mat"), d) for d in range(n)] if rows.num_rows else []
            dim = max((pc.max(pc.list_value_length(e)).as_py() or 0 for e in entries), default=0)
            self.mats = np.zeros((rows.num_rows, n, dim))
            for d, e in enumerate(entries):
                self.mats[:, d] = _matrix(e, dim)
            w = self.weights * self.fusion[:, 0]
            rest = [self.weights * self.fusion[:, 1], self.weights * self.fusion[:, 2]]
            self.lines = np.concatenate([np.einsum("jd,jdi->ji", w, self.mats), *rest], axis=1).astype(np.float32)
            # the parts of a line may cancel each other
            parts = sum(np.abs(w[:, d, None] * self.mats[:, d]) for d in range(n))
            self.norm = np.linalg.norm(np.concatenate([parts, *rest], axis=1), axis=1)
        self.least, self.least_id = np.full(rows.num_rows, -np.inf), None
        if "least" in rows.schema.names:
            least = rows.column("least").to_numpy(zero_copy_only=False) if isinstance(
                rows, pa.RecordBatch) else rows.column("least").to_numpy()
            self.least = np.where(np.isnan(least.astype(np.float64)), -np.inf, least.astype(np.float64))
            self.least_id = rows.column("least_id").to_pylist()

    def __len__(self) -> int:
        return len(self.weights)

    def matrices(self, part: pa.RecordBatch, widths: dict[str, int]) -> dict[str, np.ndarray]:
        return {c: _matrix(part.column(c), w if w >= 0 else self.mats.shape[2]) for c, w in widths.items()}

    def similarities(self, cols: dict[str, np.ndarray], jd: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Products of pairs' vectors, one for each dimension; sums run left to right."""
        out = np.zeros((len(jd), self.weights.shape[1]))
        for p in range(0, len(jd) if self.mats.shape[2] else 0, 256):
            j, r = jd[p:p + 256], row[p:p + 256]
            out[p:p + 256] += np.add.accumulate(cols["embedding"][r][:, None] * self.mats[j], axis=2)[:, :, -1]
        return out

    def scores(self, cols: dict[str, np.ndarray], jd: np.ndarray, row: np.ndarray,
               emb: np.ndarray | None = None) -> np.ndarray:
        """Stage-1 of pairs (jd, row), with their ``similarities`` where JDs have vectors; sums run left to right."""
        out = np.zeros(len(jd))
        for d in range(self.weights.shape[1]):
            if self.mats is None:
                fused = cols["fused"][row, d]
            else:
                we, wb, ws = self.fusion[d]
                fused = we * emb[:, d] + wb * cols["bm25"][row, d] + ws * cols["structured"][row, d]
            out += self.weights[jd, d] * fused
        return out

    def factors(self, cols: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(JD factors, row factors, slack): a product of both is a score but for rounding, ``slack`` at most."""
        if self.mats is None:
            a, b, unit = self.weights, cols["fused"], 2.0 ** -52
        else:
            a, unit = self.lines, 2.0 ** -22
            b = np.concatenate([cols["embedding"], cols["bm25"], cols["structured"]], axis=1).astype(np.float32)
        # sums of n products, in any order, and in three steps with the weights: n + 16 roundings are more than all
        norm = np.linalg.norm(a.astype(np.float64), axis=1) if self.mats is None else self.norm
        most = np.linalg.norm(b.astype(np.float64), axis=1).max(initial=0.0)
        return a, b, (a.shape[1] + 16) * unit * norm * most + 1e-300

    def set_limits(self, cols: dict[str, np.ndarray], ids: np.ndarray, k: int) -> None:
        """Limits of JDs that have none, from the k-th best of some rows."""
        at = np.flatnonzero(np.isneginf(self.least))
        if len(ids) < k or not len(at):
            return
        order = np.argsort(ids, kind="stable")
        cols, ids = {c: x[order] for c, x in cols.items()}, ids[order]
        if self.least_id is None:
            self.least_id = [None] * len(self)
        a, b, slack = self.factors(cols)
        for p in range(0, len(at), step := max(1, CELLS // len(ids))):
            jd = at[p:p + step]
            if self.mats is not None:
                found = (a[jd] @ b.T).astype(np.float64)
                kth = np.partition(found, len(ids) - k, axis=1)[:, len(ids) - k]
                self.least[jd] = np.nextafter(kth - 2 * slack[jd], -np.inf)
                continue
            found = np.zeros((len(jd), len(ids)))
            for d in range(b.shape[1]):
                found += self.weights[jd, d][:, None] * b[:, d][None, :]
            kth = np.partition(found, len(ids) - k, axis=1)[:, len(ids) - k]
            above = (found > kth[:, None]).sum(axis=1)
            tied = np.cumsum(found == kth[:, None], axis=1)
            last = np.argmax(tied >= (k - above)[:, None], axis=1)
            self.least[jd] = kth
            for j, i in zip(jd.tolist(), last.tolist()):
                self.least_id[j] = ids[i]


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as (rows, width); what is null or absent is 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) and not column.null_count and pc.all(pc.equal(pc.list_value_length(column), width)).as_py():
        return np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width))
    out = np.zeros((len(column), width))
    lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


class _Kept:
    """The k best (score DESC, id ASC) of each JD among the rows that a task has seen."""

    def __init__(self, jds: _JDs, k: int):
        self.jds, self.k = jds, k
        self.found: list[tuple[np.ndarray, ...]] = []  # (JD, score, id), similarities behind where JDs have vectors
        self.size = self.left = 0

    def add(self, jd: np.ndarray, scores: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> None:
        self.found.append((jd, scores, ids, *more))
        self.size += len(jd)
        if self.size > max(HELD // 4 if more else HELD, 2 * self.left):
            self.cut()

    def cut(self) -> None:
        """Leave k rows of a JD; their last is its new limit."""
        if not self.found:
            return
        jd, s, ids, *more = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((ids, -s, jd))
        jd, s, ids = jd[order], s[order], ids[order]
        first = np.searchsorted(jd, jd)
        place = np.arange(len(jd)) - first
        last = np.flatnonzero(place == self.k - 1)
        if len(last):
            if self.jds.least_id is None:
                self.jds.least_id = [None] * len(self.jds)
            self.jds.least[jd[last]] = s[last]
            for j, i in zip(jd[last].tolist(), ids[last].tolist()):
                self.jds.least_id[j] = i
        some = place < self.k
        self.found = [(jd[some], s[some], ids[some], *[x[order[some]] for x in more])]
        self.size = self.left = int(some.sum())

    def take(self) -> tuple[np.ndarray, ...] | None:
        self.cut()
        out, self.found, self.size, self.left = (self.found[0] if self.found else None), [], 0, 0
        return out


def _leaves(x: np.ndarray) -> np.ndarray:
    """An order of rows in which each ``LEAF`` rows are alike: cut in halves along the widest column."""
    left, out = [np.arange(len(x))], []
    while left:
        rows = left.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        part = x[rows]
        column = part[:, np.argmax(part.max(axis=0) - part.min(axis=0))]
        half = -(-len(rows) // (2 * LEAF)) * LEAF
        order = np.argpartition(column, half)
        left += [rows[order[half:]], rows[order[:half]]]
    return np.concatenate(out)


def _probe(jds: _JDs, cols: dict[str, np.ndarray], k: int) -> np.ndarray:
    """Rows that are among the best of a few JDs."""
    a, b, _ = jds.factors(cols)
    some = a[np.linspace(0, len(a) - 1, min(len(a), 16)).astype(np.int64)]
    if jds.mats is None:
        some = np.concatenate([some, np.eye(a.shape[1])])
    if len(b) <= k:
        return np.arange(len(b))
    return np.unique(np.argpartition(some @ b.T, len(b) - k, axis=1)[:, len(b) - k:])


def _reaching(found: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the cells that are at least their row's ``reach``, which few are: eight are looked at at a time."""
    hit = found >= reach[:, None]
    if hit.shape[1] % 8:
        return np.nonzero(hit)
    words = np.flatnonzero(hit.reshape(-1).view(np.uint64))
    word, byte = np.nonzero(hit.reshape(-1, 8)[words])
    return np.divmod(words[word] * 8 + byte, hit.shape[1])


def _score_chunk(jds: _JDs, kept: _Kept, cols: dict[str, np.ndarray], ids: np.ndarray) -> None:
    """Give ``kept`` all rows of a chunk that reach a JD's limit.

    Rows are put into leaves of similar rows.  A JD looks at a leaf only if the leaf's
    best values (its worst, where a weight is negative) reach the limit, and at rows that
    do so but for rounding; only these get an exact score.
    """
    if np.isneginf(jds.least).any():
        some = _probe(jds, cols, kept.k)
        jds.set_limits({c: x[some] for c, x in cols.items()}, ids[some], kept.k)
    if jds.mats is None:
        order = _leaves(cols["fused"])
        cols, ids = {c: x[order] for c, x in cols.items()}, ids[order]
    a, b, slack = jds.factors(cols)
    known, rank = np.unique(ids, return_inverse=True)

    def ties(jd: np.ndarray) -> np.ndarray:
        """How many of the chunk's ids, in order, still count at a JD's limit."""
        got = [jds.least_id[j] if jds.least_id is not None else None for j in jd.tolist()]
        out, has = np.zeros(len(jd), np.int64), np.array([g is not None for g in got], dtype=bool)
        if has.any():
            out[has] = np.searchsorted(known, np.array([g for g in got if g is not None], dtype=known.dtype), "right")
        return out

    def exact(jd: np.ndarray, row: np.ndarray) -> None:
        for p in range(0, len(jd), 1 << 13):
            j, r = jd[p:p + (1 << 13)], row[p:p + (1 << 13)]
            emb = [jds.similarities(cols, j, r)] if jds.mats is not None else []
            s = jds.scores(cols, j, r, *emb)
            ok = (s > jds.least[j]) | ((s == jds.least[j]) & (rank[r] < limit[j]))
            if ok.any():
                kept.add(j[ok], s[ok], ids[r[ok]], *[x[ok] for x in emb])

    limit = ties(np.arange(len(jds)))
    if jds.mats is not None:
        rows, step = TILE
        idle = np.flatnonzero(jds.norm == 0)  # every row scores 0 and ties: the k smallest ids are enough
        some = np.argsort(rank, kind="stable")[:kept.k] if len(idle) else idle
        for j in idle.tolist():
            exact(np.full(len(some), j), some)
        busy = np.flatnonzero(jds.norm != 0)
        a = a[busy]
        for p in range(0, len(ids), rows):
            part = np.ascontiguousarray(b[p:p + rows]).T
            for q in range(0, len(a), step):
                own = busy[q:q + step]
                reach = (jds.least[own] - slack[own]).astype(np.float32)
                jd, row = _reaching(a[q:q + step] @ part, np.nextafter(reach, np.float32(-np.inf)))
                exact(own[jd], row + p)
        return
    starts = np.arange(0, len(ids), LEAF)
    most, least = np.maximum.reduceat(b, starts), np.minimum.reduceat(b, starts)
    first = np.minimum.reduceat(rank, starts)
    for q in range(0, len(a), step := max(1, 4 * CELLS // len(starts))):
        up, down, mine = np.maximum(a[q:q + step], 0.0), np.minimum(a[q:q + step], 0.0), jds.least[q:q + step]
        reach = mine - slack[q:q + step]
        bound = most @ up.T + least @ down.T
        hit = bound >= reach[None, :]
        leaf, jd = np.nonzero(hit & (bound <= (mine + slack[q:q + step])[None, :]))
        best = np.zeros(len(leaf))
        for d in range(a.shape[1]):  # rounded as a score is, so that no row of the leaf is above it
            best += up[jd, d] * most[leaf, d] + down[jd, d] * least[leaf, d]
        none = (best < mine[jd]) | ((best == mine[jd]) & (first[leaf] >= limit[q + jd]))
        hit[leaf[none], jd[none]] = False
        jds_, rows_, size = [], [], 0
        for n in np.flatnonzero(hit.any(axis=1)):
            some = np.flatnonzero(hit[n])
            jd, row = np.nonzero(a[q + some] @ b[n * LEAF:(n + 1) * LEAF].T >= reach[some][:, None])
            jds_.append(q + some[jd])
            rows_.append(row + n * LEAF)
            size += len(jd)
            if size > CELLS:
                exact(np.concatenate(jds_), np.concatenate(rows_))
                jds_, rows_, size = [], [], 0
                reach = jds.least[q:q + step] - slack[q:q + step]
        if size:
            exact(np.concatenate(jds_), np.concatenate(rows_))


def _scan(rows: DataFrame, jds: _JDs, k: int, widths: dict[str, int], schema: T.StructType) -> DataFrame:
    """The k best rows that each task saw for each JD of the block: k x JDs rows leave a task at most."""
    score, keep = _score_chunk, _Kept
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        kept, waiting, size = keep(jds, k), [], 0

        def chunk():
            whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            score(jds, kept, jds.matrices(whole, widths), whole.column("doc_id").to_numpy(zero_copy_only=False))

        for batch in batches:
            for r in range(0, batch.num_rows, CHUNK):
                waiting.append(batch.slice(r, CHUNK))
                size += waiting[-1].num_rows
                if size >= CHUNK:
                    chunk()
                    waiting, size = [], 0
        if size:
            chunk()
        best = kept.take()
        for p in range(0, len(best[0]) if best else 0, 1 << 17):
            jd, s, ids, *emb = (x[p:p + (1 << 17)] for x in best)
            emb = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], np.int32), x.reshape(-1)) for x in emb]
            yield pa.RecordBatch.from_arrays([jds.ids.take(pa.array(jd)), pa.array(ids), pa.array(s), *emb],
                                             names=arrow.names).cast(arrow)

    return rows.mapInArrow(run, schema)


def _fusion(catalog: Catalog) -> list[tuple[float, float, float]]:
    return [tuple(catalog.fusion_weights(d.name)) for d in catalog.dimensions]


def with_limits(rows: DataFrame, widths: dict[str, int], jds: DataFrame, catalog: Catalog, k: int) -> DataFrame:
    """``jds`` with a limit of each: the k-th best of rows that are the best of a few JDs (``PROBES``).

    A row below it is in no result, so tasks look at few rows and pass on few more
    than k of a JD in all.  Which rows the limit is from makes no difference to the result.
    """
    n, spark = len(catalog.dimensions), rows.sparkSession
    rows = rows.where("doc_id is not null")
    few = jds.orderBy(F.xxhash64("jd_id"), "jd_id").limit(PROBES).select(
        F.monotonically_increasing_id().alias("jd_id"), *[c for c in jds.columns if c != "jd_id"])
    if "mat" not in jds.columns:
        few = few.unionByName(spark.range(n + 1).select(  # one dimension alone, and none
            (-1 - F.col("id")).alias("jd_id"),
            F.array(*[(F.col("id") == i).cast("double") for i in range(n)]).alias("weights")))
    few = materialize(few, "probes")
    best = topk.topk_per_group(best_of_tasks(rows, widths, few, catalog, k), k, "jd_id", "stage1", "doc_id", "at",
                               salts=topk.SALTS)
    found = F.broadcast(materialize(best.select("doc_id").distinct(), "probed"))  # k of each probe
    some = rows.join(found, "doc_id", "left_semi").dropDuplicates(["doc_id"]).toArrow()
    weights, scores = _fusion(catalog), _JDs
    out = T.StructType([*jds.schema.fields, T.StructField("least", T.DoubleType()),
                        T.StructField("least_id", rows.schema["doc_id"].dataType)])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out)

    def limit(batches):
        for batch in batches:
            for p in range(0, batch.num_rows, 1024):
                part = batch.slice(p, 1024)
                block = scores(part, n, weights)
                whole = some.combine_chunks()
                if whole.num_rows and not (block.mats is not None and not block.mats.shape[2]):
                    one = whole.to_batches()[0]
                    block.set_limits(block.matrices(one, widths), one.column("doc_id").to_numpy(zero_copy_only=False), k)
                least = pa.array(block.least, mask=np.isneginf(block.least))
                ids = pa.array(block.least_id or [None] * len(block), arrow.field("least_id").type)
                yield pa.RecordBatch.from_arrays([*part.columns, least, ids], names=arrow.names).cast(arrow)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return materialize(jds.repartition(parts, F.xxhash64("jd_id")).mapInArrow(limit, out), "jd-limits")


def best_of_tasks(rows: DataFrame, widths: dict[str, int], jds: DataFrame, catalog: Catalog, k: int,
                  jd_block_bytes: int = JD_BLOCK_BYTES) -> DataFrame:
    """(jd_id, doc_id, stage1): the k best rows of each JD that each task saw, not merged yet.

    Where JDs have vectors, ``emb`` has the similarities of a row to them.

    ``rows``: doc_id and the columns of ``widths`` (entries a row; -1: of the JDs' vectors).
    Rows without an id can't be ranked and are left out, and so are rows below a JD's
    limit, if ``jds`` has them (``with_limits``).
    """
    n = len(catalog.dimensions)
    rows = rows.where("doc_id is not null")
    size = F.lit(64 + 8 * n + 24 * k)  # weights, and the k best rows that a task holds
    if "mat" in jds.columns:
        size = size + F.coalesce(F.aggregate("mat", F.lit(0), lambda s, v: s + F.coalesce(F.size(v), F.lit(0)) * 8),
                                 F.lit(0))
    total = jds.agg(F.sum(size)).first()[0] or 0
    blocks = total // jd_block_bytes + 1
    schema = T.StructType([jds.schema["jd_id"], rows.schema["doc_id"], T.StructField("stage1", T.DoubleType())])
    if "mat" in jds.columns:
        schema = schema.add("emb", T.ArrayType(T.DoubleType()))
    part, found = F.pmod(F.xxhash64("jd_id"), F.lit(blocks)), None
    for p in range(blocks):  # one block is on the driver and in the tasks at a time
        block = _JDs(jds.where(part == p).toArrow(), n, _fusion(catalog))
        best = _scan(rows, block, k, widths, schema)
        if blocks > 1:
            best = materialize(best, "block-survivors")
        found = best if found is None else found.union(best)
    return found


def top_candidates(feats: DataFrame, jds: DataFrame, dim_vectors: DataFrame | None, catalog: Catalog,
                   k: int, jd_block_bytes: int = JD_BLOCK_BYTES) -> DataFrame:
    """(jd_id, doc_id, stage1[, emb], stage1_rank): the k best candidates of each JD of ``jd_table``."""
    n = len(catalog.dimensions)
    if "mat" in jds.columns:
        rows = feats.select("doc_id", "bm25", "structured", "embedding")
        widths = {"bm25": n, "structured": n, "embedding": -1}
    else:
        rows, widths = _with_sources(feats, dim_vectors, catalog).select("doc_id", "fused"), {"fused": n}
    jds = with_limits(rows, widths, jds, catalog, k)
    found = best_of_tasks(rows, widths, jds, catalog, k, jd_block_bytes)
    return topk.topk_per_group(found, k, "jd_id", "stage1", "doc_id", "stage1_rank", salts=topk.SALTS)


class Layers:
    """Features in layers of falling value, for a threshold algorithm over many JDs.

    Each dimension has a descending list of cuts (quantiles of its fused scores, from
    ``SHARES``); a candidate is in the first layer in which any dimension exceeds its
    cut.  What no layer up to l holds is at most cut[l] in every dimension, so with
    weights of 0 or more its stage-1 is at most sum_d weight[d] * cut[l][d].  A JD is
    finished after layer l if its k-th best so far is greater than that; equal isn't
    enough, as a smaller id could still tie.  Quantiles may be approximate: cuts decide
    how much is read, never what comes out.  Layers are Parquet folders, so a layer
    that no JD needs isn't opened.
    """

    #: About the share of candidates that exceed a cut, in each dimension.
    SHARES = tuple(4.0 ** -j for j in (6, 5, 4, 3, 2, 1))

    def __init__(self, rows: DataFrame, cuts: list[list[float]], sizes: dict[int, int]):
        self.rows, self.cuts, self.sizes = rows, cuts, sizes

    @classmethod
    def write(cls, feats: DataFrame, catalog: Catalog, path: str, dim_vectors: DataFrame | None = None) -> Layers:
        """Write the narrow feature rows of ``feats`` in layers below ``path``."""
        n = len(catalog.dimensions)
        narrow = _with_sources(feats, dim_vectors, catalog).select("doc_id", "fused")
        value = [F.nanvl(F.coalesce(F.get("fused", F.lit(d)), F.lit(0.0)), F.lit(0.0)) for d in range(n)]
        found = narrow.agg(*[F.percentile_approx(v, [1 - s for s in cls.SHARES], 10_000) for v in value]).first()
        cuts = [[(found[d] or [0.0] * len(cls.SHARES))[i] for d in range(n)] for i in range(len(cls.SHARES))]
        layer = F.lit(len(cuts))
        for i in reversed(range(len(cuts))):
            above = F.lit(False)
            for v, c in zip(value, cuts[i]):
                above = above | (v > F.lit(c))
            layer = F.when(above, F.lit(i)).otherwise(layer)
        narrow.withColumn("layer", layer).write.mode("error").partitionBy("layer").parquet(path)
        rows = feats.sparkSession.read.schema(narrow.withColumn("layer", layer).schema).parquet(path)
        sizes = {r["layer"]: r["count"] for r in rows.groupBy("layer").count().collect()}
        return cls(rows, cuts, sizes)

    def top(self, jds: DataFrame, catalog: Catalog, k: int,
            jd_block_bytes: int = JD_BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
        """((jd_id, doc_id, stage1, stage1_rank), (jd_id, layers, rows_read)): equal to ``top_candidates``."""
        jds = jds.select("jd_id", "weights")
        widths, done, report, kept, read = {"fused": len(catalog.dimensions)}, [], [], None, 0
        for i in range(len(self.cuts) + 1):
            read += self.sizes.get(i, 0)
            rows = self.rows.where(F.col("layer") == i).select("doc_id", "fused")
            # tasks pass on what reaches a JD's limit: of the layer at first, then the k-th best so far
            limited = jds if i else with_limits(rows, widths, jds, catalog, k)
            best = best_of_tasks(rows, widths, limited, catalog, k, jd_block_bytes)
            if kept is not None:
                best = best.unionByName(kept.select("jd_id", "doc_id", "stage1"))
            best = materialize(topk.topk_per_group(best, k, "jd_id", "stage1", "doc_id", "stage1_rank",
                                                   salts=topk.SALTS), "layer")
            if i == len(self.cuts):
                ready, left = jds.select("jd_id"), None
            else:
                sound = F.forall("weights", lambda w: F.coalesce(w >= 0, F.lit(False)))
                cut = F.array(*[F.lit(float(c)) for c in self.cuts[i]])
                most = F.aggregate(F.zip_with("weights", cut, lambda w, c: F.coalesce(w * c, F.lit(0.0))), F.lit(0.0),
                                   lambda s, x: s + x)
                bound = F.when(sound & (F.size("weights") == len(self.cuts[i])), most).otherwise(float("inf"))
                least = best.where(F.col("stage1_rank") == k).select(
                    F.col("jd_id").alias("_jd"), F.col("stage1").alias("least"), F.col("doc_id").alias("least_id"))
                state = materialize(jds.select("jd_id", "weights").join(
                    least, F.col("jd_id").eqNullSafe(F.col("_jd")), "left").select(
                    "jd_id", "weights", "least", "least_id", F.coalesce(F.col("least") > bound, F.lit(False)).alias("ready")),
                    "layer-jds")
                ready, left = state.where("ready").select("jd_id"), state.where("not ready").drop("ready")
            finished = ready.withColumnRenamed("jd_id", "_jd")
            done.append(best.join(finished, F.col("jd_id").eqNullSafe(F.col("_jd")), "left_semi"))
            report.append(ready.select("jd_id", F.lit(i + 1).alias("layers"), F.lit(read).cast("bigint").alias("rows_read")))
            if left is None or left.isEmpty():
                break
            jds, kept = left, best.join(left.select(F.col("jd_id").alias("_jd")),
                                        F.col("jd_id").eqNullSafe(F.col("_jd")), "left_semi")
        return (materialize(reduce(DataFrame.unionByName, done), "survivors"),
                reduce(DataFrame.unionByName, report))


def attach(survivors: DataFrame, feats: DataFrame, jds: DataFrame, dim_vectors: DataFrame | None,
           catalog: Catalog) -> DataFrame:
    """Bring scores, profile and JD weights back for the k x J survivors only."""
    if "mat" in jds.columns and "emb" in survivors.columns:
        feats, jds = feats.drop("emb"), jds.drop("mat")
    j = feats.join(survivors, "doc_id").join(jds, "jd_id")
    if "mat" not in jds.columns:
        return _with_sources(j, dim_vectors, catalog)
    j = j.withColumn("emb", vops.similarity(F.col("mat"), F.col("embedding"))).drop("mat")
    none = F.array_repeat(F.lit(0.0), len(catalog.dimensions))
    return j.withColumn("emb", F.coalesce("emb", none)).withColumn("fused", fusion.fused(
        F.col("emb"), F.col("bm25"), F.col("structured"), catalog))


def finish(survivors: DataFrame, catalog: Catalog) -> DataFrame:
    """Min-max pair scores per JD, blend, final score, rank and reason."""
    n = len(catalog.dimensions)
    s = rerank.minmax_arrays(survivors, ["jd_id"], "pair_raw", n, "ce")
    s = s.withColumn("blended", fusion.blend(F.col("fused"), F.col("ce"), catalog))
    s = s.withColumn("score", fusion.weighted_sum(F.col("weights"), F.col("blended"), n))
    s = s.withColumn("score_6", F.round("score", 6))
    s = topk.rank_rows(s, "jd_id", "score_6", "doc_id", "rank")
    cols = set(s.columns)

    def c(name, default):
        return F.col(name) if name in cols else default
    labels = explain.top_dims(F.col("blended"), catalog)
    s = s.withColumn("top_dims", labels).withColumn("reasoning", explain.reason(
        c("title", F.lit(None).cast("string")), c("years", F.lit(None).cast("double")),
        labels, c("open_to_work", F.lit(False)), c("response_rate", F.lit(None).cast("double"))))
    return s


def survivors(feats: DataFrame, jd_weights: DataFrame, catalog: Catalog,
              dim_vectors: DataFrame | None = None, k: int = 100,
              jd_block_bytes: int = JD_BLOCK_BYTES, layers: Layers | None = None) -> DataFrame:
    """Top-k by stage-1 per JD with every score column attached.

    ``layers`` (of the same features; dimension vectors shared by all JDs) reads no
    more of them than the threshold needs.
    """
    jds = materialize(jd_table(jd_weights, dim_vectors, catalog), "jds")
    if layers is not None and "mat" not in jds.columns:
        top = layers.top(jds, catalog, k, jd_block_bytes)[0]
    else:
        top = materialize(top_candidates(feats, jds, dim_vectors, catalog, k, jd_block_bytes), "survivors")
    return attach(top, feats, jds, dim_vectors, catalog)


def rank(feats: DataFrame, jd_weights: DataFrame, catalog: Catalog,
         dim_vectors: DataFrame | None = None, k: int = 100,
         scorer: Callable[[], object] | None = None, texts: DataFrame | None = None,
         jd_block_bytes: int = JD_BLOCK_BYTES, layers: Layers | None = None) -> DataFrame:
    """Ranked top-k per JD with scores and reasons (see module doc).

    ``scorer=None`` uses the built-in pair scores stored in ``feats``;
    otherwise ``texts`` (doc_id, text) supplies the survivors' text.
    """
    surv = survivors(feats, jd_weights, catalog, dim_vectors, k, jd_block_bytes, layers)
    if scorer is not None:
        surv = _model_pairs(materialize(surv, "attached"), texts, catalog, scorer)
    return finish(surv, catalog)


def _model_pairs(surv: DataFrame, texts: DataFrame, catalog: Catalog, scorer: Callable[[], object]) -> DataFrame:
    """Replace ``pair_raw`` with model scores for the (written) survivors.

    Survivors' texts are found by a join; the pairs of a survivor are made after
    that shuffle, in the task that scores them.
    """
    n = len(catalog.dimensions)
    ids = surv.select("doc_id").distinct()
    found = texts.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    with_text = surv.select("jd_id", "doc_id").join(found, "doc_id", "left")
    scored = rerank.score_pairs(with_text, scorer, catalog, ["jd_id", "doc_id"])
    packed = scored.groupBy("jd_id", "doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("ordinal", "pair_raw"))).alias("_pm"))
    arr = F.array(*[F.try_element_at(F.col("_pm"), F.lit(i)) for i in range(n)])
    return (surv.drop("pair_raw").join(packed, ["jd_id", "doc_id"], "left")
            .withColumn("pair_raw", arr).drop("_pm"))


def results(ranked: DataFrame, catalog: Catalog) -> DataFrame:
    """Nested result records (A14, K2) of a ranking, one row for each candidate of a JD.

    (jd_id, candidate_id, rank, final_score, reasoning, dimension_scores MAP<dim, STRUCT<source_score,
    embedding_score, bm25_score, structured_score, cross_encoder_score, confidence_score, final_score>>);
    row-local, so ``write_results_json`` writes them without a shuffle.
    """
    n = len(catalog.dimensions)
    sure = F.array(*[fusion.confidence(F.col("emb")[i], F.col("bm25")[i], F.col("structured")[i])["value"]
                     for i in range(n)])
    record = explain.result_record(catalog, F.col("emb"), F.col("bm25"), F.col("structured"), F.col("fused"),
                                   F.col("ce"), sure, F.col("blended"))
    return ranked.select("jd_id", F.col("doc_id").alias("candidate_id"), "rank", F.col("score").alias("final_score"),
                         "reasoning", record.alias("dimension_scores"))


def to_submission(ranked: DataFrame) -> DataFrame:
    """candidate_id, rank, score (six decimals, text), reasoning — per JD."""
    return ranked.select("jd_id", F.col("doc_id").alias("candidate_id"), "rank",
                         F.format_string("%.6f", F.col("score_6")).alias("score"), "reasoning")
