"""Stage 1 by limits: tasks pass on few rows, and none that belongs to the result is lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from critrank.catalog import probe_catalog
from critrank.plans import ranking

CAT = probe_catalog()
N = len(CAT.dimensions)
K = 5


def _feats(spark, rows, text_ids=False, size=4):
    rng = np.random.RandomState(3)
    data = []
    for i in range(rows):
        emb = np.round(rng.rand(N), 1 if i % 3 else 6).tolist()  # many ties
        vec = None if i % 7 == 0 else rng.randn(size).tolist()
        data.append((f"id{i % 500:05d}" if text_ids else i, emb, [0.5 * x for x in emb], [1.0 if x > 0.7 else 0.0 for x in emb], vec))
    kind = "string" if text_ids else "long"
    return spark.createDataFrame(data, f"doc_id {kind}, emb array<double>, bm25 array<double>, structured array<double>, embedding array<double>")


def _weights(spark, jds):
    rng = np.random.RandomState(4)
    w = [[0.0] * N, [1.0] + [0.0] * (N - 1), [-1.0] + [0.5] * (N - 1), [None] * N, [1.0]]
    w += [(rng.randint(0, 4, N) / 10.0).tolist() for _ in range(jds - len(w))]
    return spark.createDataFrame(list(enumerate(w)), "jd_id long, weights array<double>")


def _plain(feats, jds):
    """All scores, all sorted."""
    out, fusion = [], ranking._fusion(CAT)
    rows = feats.where("doc_id is not null").collect()
    for jd in jds.collect():
        scored = []
        for r in rows:
            s = 0.0
            for d in range(N):
                if "mat" in jds.columns:
                    e = 0.0
                    for i, x in enumerate((jd.mat or [None] * N)[d] or []):
                        e += (r.embedding[i] if r.embedding else 0.0) * x
                else:
                    e = r.emb[d]
                we, wb, ws = fusion[d]
                s += ((jd.weights[d] if d < len(jd.weights) else None) or 0.0) * (we * e + wb * r.bm25[d] + ws * r.structured[d])
            scored.append((-s, r.doc_id))
        out += [(jd.jd_id, i, n) for n, (_, i) in enumerate(sorted(scored)[:K], 1)]
    return sorted(out)


@pytest.mark.parametrize("text_ids", [False, True])
def test_top_candidates_with_ties_odd_weights_and_repeated_ids(spark, text_ids):
    feats, jds = _feats(spark, 600, text_ids), _weights(spark, 20)
    got = ranking.top_candidates(feats.repartition(3), jds, None, CAT, K).collect()
    assert sorted((r.jd_id, r.doc_id, r.stage1_rank) for r in got) == _plain(feats, jds)


def test_top_candidates_by_own_vectors(spark):
    rng = np.random.RandomState(5)
    mats = [(i, None if i == 3 else [None if d == 2 else rng.randn(4).tolist() for d in range(N)]) for i in range(12)]
    jds = _weights(spark, 12).join(spark.createDataFrame(mats, "jd_id long, mat array<array<double>>"), "jd_id")
    feats = _feats(spark, 300)
    got = ranking.top_candidates(feats.repartition(3), jds, None, CAT, K).collect()
    assert sorted((r.jd_id, r.doc_id, r.stage1_rank) for r in got) == _plain(feats, jds)


def test_tasks_pass_on_few_rows_beyond_the_result(spark):
    """Not k of each JD from each task: that grows with tasks times JDs."""
    jds = _weights(spark, 60)
    rows = ranking._with_sources(_feats(spark, 4000), None, CAT).select("doc_id", "fused").repartition(8)
    limited = ranking.with_limits(rows, {"fused": N}, jds, CAT, K)
    assert limited.where(F.col("least").isNull()).count() == 0
    passed = ranking.best_of_tasks(rows, {"fused": N}, limited, CAT, K).count()
    assert 60 * K <= passed < 2 * 60 * K


def test_a_jd_looks_into_few_leaves(monkeypatch):
    """Exact scores are for rows near a JD's limit only, not for all pairs."""
    import pyarrow as pa
    rng = np.random.RandomState(6)
    x, ids = rng.rand(20_000, N) ** 2, np.arange(20_000)
    w = pa.table({"jd_id": list(range(40)), "weights": rng.rand(40, N).tolist()})
    jds = ranking._JDs(w, N, ranking._fusion(CAT))
    kept, pairs, plain = ranking._Kept(jds, K), [], jds.scores
    monkeypatch.setattr(jds, "scores", lambda cols, jd, row: pairs.append(len(jd)) or plain(cols, jd, row))
    ranking._score_chunk(jds, kept, {"fused": x}, ids)
    jd, s, found = kept.take()
    assert sum(pairs) < 40 * 20_000 / 50
    for j in range(40):
        want = sorted(zip((-plain({"fused": x}, np.full(20_000, j), ids)).tolist(), ids.tolist()))[:K]
        assert [(-a, b) for a, b in zip(s[jd == j].tolist(), found[jd == j].tolist())] == want


def _own(rows, jds, size=16, k=K):
    """A chunk and JDs with vectors of their own; the last JD has no weight."""
    import pyarrow as pa
    rng = np.random.RandomState(7)
    w = rng.rand(jds, N)
    w[-1] = 0.0
    table = pa.table({"jd_id": list(range(jds)), "weights": w.tolist(), "mat": rng.randn(jds, N, size).tolist()})
    cols = {"bm25": rng.rand(rows, N) ** 2, "structured": rng.rand(rows, N) ** 2, "embedding": rng.randn(rows, size)}
    return ranking._JDs(table, N, ranking._fusion(CAT)), cols, rng.permutation(rows)


def test_own_vectors_score_few_pairs_and_pass_on_similarities(monkeypatch):
    """A JD without weight ties with every row: it took an exact score of each."""
    jds, cols, ids = _own(5001, 30)
    kept, pairs, plain = ranking._Kept(jds, K), [], jds.scores
    monkeypatch.setattr(jds, "scores", lambda cols, jd, row, *emb: pairs.append(np.bincount(jd, minlength=30)) or plain(
        cols, jd, row, *emb))
    ranking._score_chunk(jds, kept, cols, ids)
    jd, s, found, emb = kept.take()
    assert sum(pairs)[-1] == K and sum(pairs).sum() < 30 * 5001 / 20
    every = np.arange(5001)
    for j in range(30):
        sims = jds.similarities(cols, np.full(5001, j), every)
        want = sorted(zip((-plain(cols, np.full(5001, j), every, sims)).tolist(), ids.tolist(), sims.tolist()))[:K]
        assert [(-a, b, c) for a, b, c in zip(s[jd == j].tolist(), found[jd == j].tolist(), emb[jd == j].tolist())] == want


def test_survivors_bring_the_similarities_of_their_own_vectors(spark):
    """No survivor's row meets a JD's vectors again."""
    rng = np.random.RandomState(5)
    mats = [(i, None if i == 3 else [None if d == 2 else rng.randn(4).tolist() for d in range(N)]) for i in range(12)]
    jds = _weights(spark, 12).join(spark.createDataFrame(mats, "jd_id long, mat array<array<double>>"), "jd_id")
    feats = _feats(spark, 300)
    top = ranking.top_candidates(feats.repartition(3), jds, None, CAT, K)
    got = ranking.attach(top, feats, jds, None, CAT)
    assert "mat" not in got.columns
    want = ranking.attach(top.drop("emb"), feats.drop("emb"), jds, None, CAT)
    pick = lambda df: sorted(map(tuple, df.select("jd_id", "doc_id", "emb", "fused").collect()))
    assert pick(got) == pick(want) and len(pick(got)) == 12 * K


def test_layers_pass_on_few_rows(spark, tmp_path, monkeypatch):
    """Not k of each JD from each task of each layer."""
    jds, feats = _weights(spark, 60), _feats(spark, 4000).repartition(8)
    layers, passed = ranking.Layers.write(feats, CAT, str(tmp_path / "layers")), []
    plain = ranking.best_of_tasks

    def counted(rows, widths, some, *rest):
        found = plain(rows, widths, some, *rest)
        if "least" in some.columns or some.count() == 60:  # not the probes
            passed.append(found.count())
        return found

    monkeypatch.setattr(ranking, "best_of_tasks", counted)
    best, _ = layers.top(jds, CAT, K)
    full = ranking.top_candidates(feats, jds, None, CAT, K)
    cols = ["jd_id", "doc_id", "stage1", "stage1_rank"]
    assert sorted(map(tuple, best.select(cols).collect())) == sorted(map(tuple, full.select(cols).collect()))
    assert sum(passed) < 60 * K * 8
