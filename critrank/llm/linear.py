"""Linear support vector machines and a bounded sample to train them on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Parts in which the rows of a label are ranked first.
PARTS = 32


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by accelerated gradient descent; ``y`` is +1 or -1, 0 for rows left out.

    Both classes carry the same weight, the bias is regularised with the
    weights, and ``x`` is never copied.  Returns (weights, bias).
    """
    n_pos, n_neg = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    cost = (c * np.where(y > 0, 0.5 / n_pos, np.where(y < 0, 0.5 / n_neg, 0))).astype(np.float32)
    # the step is one over a bound of the curvature
    scale = 1.0 + 2.0 * float((cost * (np.einsum("ij,ij->i", x, x) + 1)).sum())
    w, w0 = np.zeros(x.shape[1], np.float32), 0.0
    v, v0, t = w.copy(), 0.0, 1.0
    for _ in range(steps):
        pull = cost * y * np.maximum(0, 1 - y * (x @ v + np.float32(v0)))
        new, new0 = v - (v - 2 * (pull @ x)) / scale, v0 - (v0 - 2 * float(pull.sum())) / scale
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = (t - 1) / t_new
        v, v0 = new + ahead * (new - w), new0 + ahead * (new0 - w0)
        w, w0, t = new, new0, t_new
    return w, float(w0)


def fit_sigmoid(margin: np.ndarray, y: np.ndarray, rate: float, steps: int = 60) -> tuple[float, float]:
    """Platt's sigmoid p = 1 / (1 + exp(-(a*margin + b))) by Newton steps.

    ``rate``: the share of positive rows where the machine will be used.
    """
    n_pos, n_neg = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    weight = np.where(y > 0, rate / max(1, n_pos), (1 - rate) / max(1, n_neg)) * len(y)
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([(g * margin).sum() + 1e-3 * a, g.sum()])
        hessian = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()],
                            [(h * margin).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


def labelled_ids(rows: DataFrame, label: str, per_label: int, seed: int) -> DataFrame:
    """At most ``per_label`` ids of each label: the first by a seeded hash of doc_id.

    ``rows`` is narrow (doc_id, label).  Every task passes on ``per_label`` rows
    of a label at most, and a frequent label is first ranked in ``PARTS`` parts.
    """
    order = (F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    for groups in ((label, "_part"), (label,)):
        best = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
        rows = rows.withColumn("_at", best).where(F.col("_at") <= per_label).drop("_at")
    return rows.select("doc_id", label)


def remainder(modulus: int) -> F.Column:
    """crc32(doc_id as text) mod ``modulus``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus
