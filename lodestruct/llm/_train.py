"""What the trained scorers share: a bounded labelled sample, Adam, threshold calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out

#: Labelled rows of each class that a model is fitted on at most, and the longest text (in characters) among them.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 1500, 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels to fit on: per class the ``per_class`` labelled rows of least id hash, never a held-out one.

    An id with several labels has the greatest of them, and an id with several texts the one of least hash, so the rows
    that reach the driver are at most twice ``per_class`` and the same in every run. The bound makes the label side
    small enough to broadcast and the texts small enough for the driver.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit(label), "doc_id")
    picked = known.filter("y = 1").orderBy(order, "doc_id").limit(per_class).unionByName(known.filter("y = 0").orderBy(order, "doc_id").limit(per_class))
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.char_length("text") <= max_chars))
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    rows = sorted((r[0], r[2], r[1]) for r in found.select("doc_id", "text", "y").collect())
    return [r[2] for r in rows], np.array([r[1] for r in rows], np.float64)


class Adam:
    """Adam over named arrays; gradients may come for some rows of an array only."""

    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], rows: dict[str, np.ndarray] | None = None) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            at = (rows or {}).get(k, slice(None))
            self.m[k][at] = m = 0.9 * self.m[k][at] + 0.1 * g
            self.v[k][at] = v = 0.999 * self.v[k][at] + 0.001 * g * g
            self.params[k][at] -= self.rate * fix * m / (np.sqrt(v) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, np.float64)))


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """Where to cut so that class-balanced accuracy is greatest; the middle of the widest such gap."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], y[order]
    gain = np.cumsum(np.where(y == 0, 1 / max(1, (y == 0).sum()), -1 / max(1, (y == 1).sum())))[:-1]
    if not len(gain):
        return float(x[0]) if len(x) else 0.0
    width = np.where(gain >= gain.max() - 1e-9, np.diff(x), -1)
    at = int(width.argmax())
    return float((x[at] + x[at + 1]) / 2)


def split(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices to fit on and to calibrate on: every fourth row of the sample."""
    at = np.arange(n)
    return at[at % 4 != 3], at[at % 4 == 3]
