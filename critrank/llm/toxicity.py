"""Toxicity: a subsequence string kernel, Nystroem landmarks and a linear SVM.

The kernel of two words is the gap-weighted count of common subsequences of
three characters (each costs ``DECAY`` to the power of the span it takes up in
either word), scaled so that a word has kernel 1 with itself.  An insult with a
gap, an inserted character or another ending keeps most of its kernel.  The
kernel of a sentence with a landmark is the largest of its words; letters set
apart by blanks are read as one word as well.  Sentences are mapped to the
landmarks' space (kernel values times the inverse root of the landmarks' own
kernel matrix) and scored by a linear SVM; a document has the score of its worst
sentence, made a probability by a sigmoid.

Training reads a bounded sample of labelled documents (``PER_LABEL`` of each
label).  Landmarks are words of its sentences that tell the labels apart.  Labels
belong to documents; of a toxic document, the sentences that the machine holds
for toxic (its worst at least) are the positive ones, in three rounds.

Defined results: a null or empty text scores like a sentence without words;
long tokens are read in overlapping pieces; without labels of both kinds every
score is the share of toxic labels; extra columns and repeated rows make no
difference.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import fit_sigmoid, labelled_ids, remainder, train_svm

LENGTH = 3
DECAY = 0.7
#: Landmarks: one bit of a word's filter each, so 64 at most.
LANDMARKS = 64
PER_LABEL = 1500
THRESHOLD = 0.3
PIECE = 24
#: Kernel values below this count as 0; unrelated words hardly reach it.
FLOOR = 0.5
#: The kernel is multiplied with itself, which sets exact words off from distant ones.
POWER = 2
#: Least evidence of a landmark (documents times log-odds): more than chance finds in a large vocabulary.
EVIDENCE = 16.0
#: Words that a task keeps kernel values of.
MEMORY = 500_000
_MARKS = ".,;:!?|\"'()[]{}<>*_~`-"
#: A sentence ends at a line's end or at a mark before a blank.
_SENTENCE = re.compile(r"\n|(?<=[.!?])\s")
_SPELLED = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")


def pieces(token: str) -> list[str]:
    """What is compared of a token: without marks at its ends, and without marks inside.

    Long ones are read in overlapping pieces.
    """
    word = token.strip(_MARKS)
    squeezed = "".join(c for c in word if c.isalnum())
    out = []
    for w in (word, squeezed) if squeezed != word else (word,):
        if len(w) <= PIECE:
            out.append(w)
        else:
            out.extend(w[i:i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2))
    return [w for w in out if len(w) >= LENGTH]


def sentences(text: str) -> list[list[str]]:
    """Tokens of each sentence of a lower-case text, and words spelled with blanks."""
    found = [s.split() for s in _SENTENCE.split(text)]
    spelled = ["".join(run.split()) for run in _SPELLED.findall(text)]
    return [s for s in [*found, spelled] if s]


def tokens(text: str) -> set[str]:
    """All tokens that ``sentences`` can yield."""
    found = set(text.split())
    if sum(len(w) == 1 for w in found) >= 2:
        found.update("".join(run.split()) for run in _SPELLED.findall(text))
    return found


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of character codes (1..255, padded with 0), and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    flat = np.where(flat < 256, flat, flat % 191 + 64).astype(np.uint8)
    out = np.zeros((len(words), PIECE), np.uint8)
    row = np.repeat(np.arange(len(words)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.maximum(flat, 1)
    return out, lengths


def subsequence_kernel(s: np.ndarray, t: np.ndarray, n: int = LENGTH, decay: float = DECAY) -> np.ndarray:
    """Kernel of each row of ``s`` with the same row of ``t``, or with the one word ``t``.

    Words are character codes, padded with 0.
    """
    rows = len(s)
    s = np.ascontiguousarray(s[:, :max(1, int((s > 0).sum(1).max(initial=1)))].T)
    t = t[t > 0][:, None] if t.ndim == 1 else np.ascontiguousarray(t[:, :max(1, int((t > 0).sum(1).max(initial=1)))].T)
    decay, square = np.float32(decay), np.float32(decay * decay)
    same = [[((a == b) & (a > 0)).astype(np.float32) * square for b in t] for a in s]
    # ends[i][j]: subsequences of the length so far that end at s[i] and t[j]
    ends = same
    for _ in range(n - 1):
        above = [np.zeros(rows, np.float32) for _ in t]  # all that end before s[i] and t[j], decayed
        then = []
        for i in range(len(s)):
            then.append([same[i][j] * above[j] for j in range(len(t))])
            line = np.zeros(rows, np.float32)
            for j in range(len(t)):
                carried = line * decay
                line = carried + ends[i][j]
                # above[j] takes what ends at s[i] before t[j]
                above[j] = above[j] * decay + carried / decay
        ends = then
    return np.sum([np.sum(row, axis=0) for row in ends], axis=0)


class Kernel:
    """Kernel values of words with a few landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks[:LANDMARKS]
        self.codes, self.lengths = _codes(self.landmarks)
        self.own = np.sqrt(np.maximum(subsequence_kernel(self.codes, self.codes), 1e-12))
        self.pairs = np.zeros(1 << 16, np.uint64)  # which landmarks have two characters near each other
        for k, code in enumerate(self.codes):
            for i in range(self.lengths[k]):
                for j in range(i + 1, min(i + 4, self.lengths[k])):
                    self.pairs[int(code[i]) << 8 | int(code[j])] |= np.uint64(1 << k)
        self.need = np.where(self.lengths >= 5, 5, 3)

    def values(self, words: list[str]) -> np.ndarray:
        """A row for each word: its kernel with each landmark, 0 below ``FLOOR``."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        for k, row in self.near(words).items():
            out[k] = row
        return out

    def near(self, words: list[str]) -> dict[int, np.ndarray]:
        """The rows of ``values`` that aren't all 0."""
        out: dict[int, np.ndarray] = {}
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for start in range(0, len(order), 20_000):  # words of like length together
            index = np.array(order[start:start + 20_000])
            codes, _ = _codes([words[k] for k in index])
            codes = codes[:, :max(1, int((codes > 0).sum(1).max()))]
            # a word with few near pairs of a landmark has next to no kernel with it
            least = [np.zeros(len(index), np.uint64) for _ in range(5)]
            wide = codes.astype(np.int64)
            for gap in (1, 2, 3, 4):
                for i in range(codes.shape[1] - gap):
                    hit = self.pairs[wide[:, i] << 8 | wide[:, i + gap]]
                    for k in (4, 3, 2, 1):
                        least[k] |= least[k - 1] & hit
                    least[0] |= hit
            near = np.zeros((len(index), len(self.codes)), bool)
            value = np.zeros((len(index), len(self.codes)), np.float32)
            for k in range(len(self.codes)):
                near[:, k] = least[self.need[k] - 1] >> np.uint64(k) & np.uint64(1)
            rows = np.flatnonzero(near.any(axis=1))
            if not len(rows):
                continue
            own = np.ones(len(index), np.float32)
            own[rows] = np.sqrt(np.maximum(subsequence_kernel(codes[rows], codes[rows]), 1e-12))
            for k, landmark in enumerate(self.codes):
                part = np.flatnonzero(near[:, k])
                if len(part):
                    value[part, k] = subsequence_kernel(codes[part], landmark) / (own[part] * self.own[k])
            value[value < FLOOR] = 0
            out |= {int(index[k]): value[k] ** POWER for k in np.flatnonzero(value.any(axis=1))}
        return out


def choose_landmarks(docs: list[tuple[str, int]]) -> list[str]:
    """Words that tell toxic from other documents, most evidence first, none near another."""
    seen = {0: Counter(), 1: Counter()}
    for text, toxic in docs:
        seen[toxic].update({w for t in tokens(text) for w in pieces(t) if len(w) > LENGTH})
    n = [max(1, sum(toxic == k for _, toxic in docs)) for k in (0, 1)]
    evidence = {w: c * np.log((c + 0.5) / n[1] / ((seen[0][w] + 0.5) / n[0])) for w, c in seen[1].items() if c >= 3}
    ranked = sorted((w for w, e in evidence.items() if e > EVIDENCE), key=lambda w: (-evidence[w], w))[:1000]
    chosen: list[str] = []
    if ranked:
        codes, _ = _codes(ranked)
        own = np.sqrt(np.maximum(subsequence_kernel(codes, codes), 1e-12))
        free = np.ones(len(ranked), bool)
        while free.any() and len(chosen) < LANDMARKS:
            k = int(np.argmax(free))
            chosen.append(ranked[k])
            free &= subsequence_kernel(codes, codes[k]) / (own * own[k]) < 0.6
            free[k] = False
    return chosen


class Model:
    """Fitted on (text, 0 or 1)."""

    def __init__(self, docs: list[tuple[str, int]]):
        self.rate = float(np.mean([y for _, y in docs])) if docs else 0.0
        self.kernel = None
        docs = [(t.lower(), y) for t, y in docs]
        if 0 < self.rate < 1 and (landmarks := choose_landmarks(docs)):
            self.kernel = Kernel(landmarks)
            self._fit(docs)

    def _fit(self, docs: list[tuple[str, int]]) -> None:
        among = self.kernel.values(self.kernel.landmarks)
        value, vector = np.linalg.eigh(((among + among.T) / 2).astype(np.float64))
        root = (vector / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
        memory = Memory(self.kernel)
        rows = []
        for k in range(0, len(docs), 300):  # some documents at a time bound the driver's memory
            part = [t for t, _ in docs[k:k + 300]]
            memory.learn(set().union(*map(tokens, part)))
            rows += map(memory.pooled, part)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        values = np.concatenate(rows)
        x = (values @ root).astype(np.float32)
        toxic = np.array([y for _, y in docs])
        y = np.where(toxic[owner] > 0, 1, -1).astype(np.float32)
        telling = values.any(axis=1)  # without any landmark, a sentence tells nothing about its document
        plain = np.flatnonzero(~telling)[:200]
        positive = (y > 0) & telling
        for _ in range(3):
            chosen = np.concatenate([np.flatnonzero(positive), np.flatnonzero((y < 0) & telling), plain])
            sign = np.where(positive[chosen], 1, -1).astype(np.float32)
            w, b = train_svm(x[chosen], sign, c=1000, steps=1500)
            margin = x @ w + b
            worst = np.full(len(rows), -np.inf)
            np.maximum.at(worst, owner, margin)
            positive = (y > 0) & telling & ((margin >= 0) | (margin >= worst[owner]))
        self.weights, self.bias = (root @ w).astype(np.float32), b
        self.sigmoid = fit_sigmoid(worst, np.where(toxic > 0, 1, -1), self.rate)

    def score(self, texts: list[str | None], memory: "Memory") -> np.ndarray:
        """The probability that each text is toxic."""
        if self.kernel is None:
            return np.full(len(texts), self.rate)
        low = [(t or "").lower() for t in texts]
        own = [tokens(t) for t in low]
        memory.learn(set().union(*own))
        margin = np.full(len(texts), self.bias)
        for k, found in enumerate(own):
            if not memory.values.keys().isdisjoint(found):
                margin[k] += (memory.pooled(low[k]) @ self.weights).max()
        a, b = self.sigmoid
        return 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))


class Memory:
    """Kernel values of the tokens that a task has met."""

    def __init__(self, kernel: Kernel | None):
        self.kernel, self.known, self.values = kernel, set(), {}

    def learn(self, found: set[str]) -> None:
        new = found - self.known
        if len(self.known) + len(new) > MEMORY:
            self.known, self.values, new = set(), {}, found
        words = sorted({w for t in new for w in pieces(t)})
        near = {words[k]: row for k, row in self.kernel.near(words).items()}
        if near:
            for t in new:
                if own := [near[w] for w in pieces(t) if w in near]:
                    self.values[t] = np.max(own, axis=0)
        self.known |= new

    def pooled(self, text: str) -> np.ndarray:
        """The kernel vector of each sentence: the largest values of its words."""
        out = [np.zeros(len(self.kernel.landmarks), np.float32)]
        for s in sentences(text):
            own = [v for t in s if (v := self.values.get(t)) is not None]
            if own:
                out.append(np.max(own, axis=0))
        return np.array(out)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, seed: int = 7) -> Model:
    """Fit on at most ``per_label`` documents of each label (docs: doc_id, text; labels: doc_id, toxic)."""
    ids = F.broadcast(labelled_ids(labels.where("toxic in (0, 1)").select("doc_id", "toxic").distinct(),
                                   "toxic", per_label, seed))
    rows = docs.select("doc_id", "text").join(ids, "doc_id").select("text", "toxic").limit(4 * per_label).collect()
    return Model(sorted(((r.text or "", int(r.toxic)) for r in rows), key=lambda r: (r[1], r[0])))


def score(docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` of ``docs`` with score and predicted of every row."""
    keep = [c for c in keep if c.lower() not in ("score", "predicted")]
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        memory = Memory(model.kernel)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                p = model.score(part.column("_text").to_pylist(), memory)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                    names=[*keep, "score", "predicted"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document; trained on the labels of rows that aren't held out."""
    held = docs.select("doc_id", "text", (remainder(4) == 2).alias("held_out"))
    model = train(held.where("not held_out"), labels.where(remainder(4) != 2))
    return score(held, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "score", "predicted")
