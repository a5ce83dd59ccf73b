"""Language ID: family first, then one language of the family.

A text becomes counts of hashed byte 1-, 2- and 3-grams (lower case, damped
and scaled to length one).  One-versus-one linear support vector machines vote
between families, then between the languages of the family that won.

Training reads a bounded sample: ``PER_LANGUAGE`` texts of each language,
``SAMPLE_ROWS`` in all, but one of each language at least, so every language is
learned.  Scoring reads every whole text.

Defined results: a null text or one without a letter (Unicode category L) is ``und``
with score 0; without any training row every text is; rows without a doc_id aren't
learned from; of rows with one doc_id and language, the one whose features sort first
is; extra columns and repeated rows make no difference.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, pack, unpack
from .linear import labelled_ids, remainder, train_svm

DIMENSIONS = 1 << 13
PER_LANGUAGE = 400
SAMPLE_ROWS = 2000
UNKNOWN = "und"
#: Language families; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "ky", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def has_letter(text: str) -> bool:
    """Whether any character is of Unicode category L (number signs such as ½ or ① aren't)."""
    return any(map(str.isalpha, text))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, f"family of {lang}")


def features(text: str) -> np.ndarray:
    """Hashed byte n-grams of a whole text, damped and scaled."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    one = b * np.uint32(0x9E3779B1)
    two = (b[:-1] << np.uint32(8) | b[1:]) * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)
    three = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    x = np.zeros(DIMENSIONS)
    for grams in (one, two, three):
        x += np.bincount(grams >> shift, minlength=DIMENSIONS)
    x = np.sqrt(x).astype(np.float32)
    return x / np.sqrt((x * x).sum())


class Duel:
    """One-versus-one machines between a few classes: votes, then margins."""

    def __init__(self, classes: list[str], x: np.ndarray, y: np.ndarray):
        self.classes = classes
        self.pairs = list(combinations(range(len(classes)), 2))
        w, b = [], []
        for i, j in self.pairs:
            side = (y == classes[i]).astype(np.float32) - (y == classes[j])
            weights, bias = train_svm(x, side)
            w.append(weights)
            b.append(bias)
        self.w = np.array(w, np.float32).reshape(len(w), x.shape[1])
        self.b = np.array(b, np.float32)

    def decide(self, x: np.ndarray) -> tuple[str, float]:
        if not self.pairs:
            return self.classes[0], 1.0
        margins = self.w @ x + self.b
        p = 1 / (1 + np.exp(-3 * margins.astype(float)))
        votes, sure = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        for (i, j), q in zip(self.pairs, p):
            votes[i if q >= 0.5 else j] += 1
            sure[i] += q
            sure[j] += 1 - q
        best = max(range(len(votes)), key=lambda k: (votes[k], sure[k], -k))
        return self.classes[best], float(sure[best] / (len(votes) - 1))


class Model:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        families = np.array([family_of(g) for g in langs])
        self.family = Duel(sorted(set(families)), x, families) if len(langs) else None
        self.within = {f: Duel(sorted(set(langs[families == f])), x, langs)
                       for f in sorted(set(families))}

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.family or text is None or not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        family, p = self.family.decide(x)
        lang, q = self.within[family].decide(x)
        return lang, p * q


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS,
          seed: int = 10) -> Model:
    """Fit a model on at most ``sample_rows`` of ``docs`` (doc_id, text, lang)."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang")
    ids = labelled_ids(rows, "lang", per_language, seed)
    few = ids.limit(sample_rows + 1).count() <= sample_rows
    if not few:  # very many languages: fewer of each
        ids = labelled_ids(rows, "lang", max(1, sample_rows // rows.select("lang").distinct().count()), seed)
    chosen = ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    if few:  # sample_rows ids at most; else one for each language, and Spark chooses the join
        chosen = F.broadcast(chosen)

    def vectors(batches):
        for batch in batches:
            batch = batch.filter(pa.array([has_letter(t) for t in batch.column("text").to_pylist()], pa.bool_()))
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(
                [pack(i := np.flatnonzero(x).astype(np.uint16), x[i]) for x in found], pa.binary())], names=["doc_id", "lang", "x"])

    kind = dict(rows.dtypes)["doc_id"]
    sample = (docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
              .join(chosen, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")
              .mapInArrow(vectors, f"doc_id {kind}, lang string, x binary")
              .groupBy("doc_id", "lang").agg(F.min("x").alias("x")).select("lang", "x").collect())
    sample.sort(key=lambda r: (r.lang, bytes(r.x)))  # the order of training doesn't depend on tasks
    x = np.zeros((len(sample), DIMENSIONS), np.float32)
    for n, row in enumerate(sample):
        index, value = unpack(bytes(row.x))
        x[n, index] = value
    return Model(x, np.array([r.lang for r in sample], object))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred and score of every row."""
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score")]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    text = free_name("_text", keep)

    def score(batches):
        for batch in batches:
            found = [model.predict(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col("text").alias(text)).mapInArrow(score, schema)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document; trained on the rows that aren't held out."""
    held = docs.select("doc_id", "text", "lang", (remainder(5) == 0).alias("held_out"))
    return predict(held, train(held.where("not held_out")), ["doc_id", "held_out"]).select(
        "doc_id", "held_out", "lang_pred", "score")
