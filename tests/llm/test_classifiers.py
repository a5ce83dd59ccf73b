import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from critrank.llm import language, linear, toxicity

from .conftest import prose


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def held(rows, modulus, at):
    return [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % modulus == at for r in rows]


def test_language_of_held_out_rows(tables):
    docs, _ = tables
    rows = language.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and [r.held_out for r in rows] == held(rows, 5, 0)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.99 and all(0 <= r.score <= 1 for r in out)


def test_language_of_odd_rows(spark, odd, none):
    taught = odd.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "fr").otherwise(F.col("lang")))
    rows = language.digest(taught).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id in (43, 44, 45, 50) or r.doc_id is None and r.score == 0)
    assert language.digest(none).collect() == []
    untaught = language.digest(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)}
    one = language.digest(odd.withColumn("lang", F.lit("xx"))).where("doc_id = 40").collect()
    assert {(r.lang_pred, r.score) for r in one} == {("xx", 1.0)}
    kept = language.predict(taught, language.train(taught), taught.columns)
    assert kept.columns == [c for c in odd.columns if c not in ("score", "lang_pred")] + ["lang_pred", "score"]


def test_number_signs_are_no_letters(spark, small):
    texts = ["\u00bd \u00b2", "\u2460", "\u0661\u0662 \u2167", "12 + _", "\u00aa", "a1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = language.predict(df, language.train(small), ["doc_id"]).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in got] == [True, True, True, True, False, False]


def test_every_language_is_learned_and_copies_of_an_id_are_defined(spark):
    rows = [(k, f"text of language number {k}", f"l{k:02}") for k in range(30)] + [(7, "another text", "l07"), (7, "third", "l08")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [language.train(d, per_language=5, sample_rows=10) for d in (df, df.repartition(5))]
    assert set(models[0].family.classes) == {language.family_of(f"l{k:02}") for k in range(30)}
    assert (models[0].family.w == models[1].family.w).all()


def test_a_clashing_text_column(spark, odd):
    clash = odd.selectExpr("doc_id", "text", "lang", "7 as _text")
    out = language.predict(clash, language.train(clash), clash.columns)
    assert out.columns == [*clash.columns, "lang_pred", "score"] and {r._text for r in out.collect()} == {7}


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(k, f"l{k % 3}") for k in range(900)], "doc_id long, lang string")
    rows = linear.labelled_ids(df, "lang", 7, 1).collect()
    assert len(rows) == 21 and len({r.doc_id for r in rows}) == 21


def test_svm_separates():
    g = np.random.default_rng(2)
    x = g.normal(size=(300, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.2, 1, -1).astype(np.float32)
    w, b = linear.train_svm(x, y, c=100, steps=500)
    assert np.mean(np.sign(x @ w + b) == y) > 0.97


def test_kernel_matches_its_definition():
    def brute(s, t, n, decay):
        return sum(decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
                   for i in itertools.combinations(range(len(s)), n) for j in itertools.combinations(range(len(t)), n)
                   if all(s[a] == t[b] for a, b in zip(i, j)))

    words = ["cat", "cart", "banana", "bandana", "été", "aaaa", "x"]
    codes, _ = toxicity._codes(words)
    for n, decay in ((2, 0.5), (3, 0.7), (4, 0.9)):
        for k, w in enumerate(words):
            got = toxicity.subsequence_kernel(codes, codes[k], n, decay)
            assert np.allclose(got, [brute(v, w, n, decay) for v in words], rtol=1e-4, atol=1e-6)


def test_pieces_and_sentences():
    assert toxicity.pieces("i.d.i.o.t!") == ["i.d.i.o.t", "idiot"] and toxicity.pieces("..") == []
    long = "".join(random.Random(1).choice("abcdef") for _ in range(200))
    assert all(any(long[i:i + 12] in p for p in toxicity.pieces(long)) for i in range(0, 188))
    assert toxicity.sentences("one two. i d i o t here") == [["one", "two."], list("idiot") + ["here"], ["idiot"]]


def test_toxic_documents(tables):
    docs, labels = tables
    rows = {r.doc_id: r for r in toxicity.digest(docs, labels).collect()}
    assert len(rows) == docs.count() and [r.held_out for r in rows.values()] == held(rows.values(), 4, 2)
    out = [(rows[r.doc_id], r.toxic) for r in labels.collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    assert np.mean([r.predicted for r, y in out if y]) > 0.7 and np.mean([r.predicted for r, y in out if not y]) < 0.1
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())


def test_gapped_and_inserted_insults():
    insults = ["idiot", "stupid", "worthless", "disgusting", "pathetic", "moron"]
    r, docs = random.Random(3), []
    for k in range(160):
        words = prose(k, 60).split()
        if k % 4 == 0:
            for w in r.sample(insults, 2):
                words.insert(r.randrange(60), w)
        docs.append((" ".join(words), int(k % 4 == 0)))
    model = toxicity.Model(docs)
    memory = toxicity.Memory(model.kernel)
    words = ["idi.ot", "s-t-u-p-i-d", "w o r t h l e s s", "disgu*sting", "PATHETIC!", "worthlesss", "patheetic", "morxon"]
    score = model.score([prose(999, 40), *(f"{prose(k, 9)} {w} {prose(k + 1, 5)}" for k, w in enumerate(words))], memory)
    assert score[0] < 0.1 and (score[1:6] >= 0.3).all() and score[1:].min() > 2 * score[0], score


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(None, 1), (40, None)], "doc_id long, toxic int")
    rows = toxicity.digest(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.digest(none, labels).collect() == []
    unlabelled = toxicity.digest(odd, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in unlabelled} == {(0.0, 0)}
    out = toxicity.score(odd, toxicity.Model([]), odd.columns)
    assert out.columns == [c for c in odd.columns if c != "score"] + ["score", "predicted"] and out.count() == odd.count()
