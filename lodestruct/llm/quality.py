"""Quality: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_bytes, batches, held_out, table, values
from ._train import Adam, best_threshold, labelled_sample, sigmoid, split

#: Words of a passage; passages encoded at once (bounds memory for one very long text).
PASSAGE, BLOCK = 64, 2048
EXTRA = 5
INPUTS, HIDDEN, GATE = 256 + EXTRA, 16, 8
EPOCHS, BATCH, RATE = 25, 64, 0.01
#: Score from which a document is accepted.
ACCEPT = 0.3


def passages(text: bytes) -> Iterator[np.ndarray]:
    """Blocks of rows, one for each passage of ``PASSAGE`` words: shares of its bytes, of words that repeat the word before, of different words, mean word length, lines per word, fill."""
    words = text.split()
    lines = text.count(b"\n") / max(1, len(words))
    for at in range(0, max(1, len(words)), PASSAGE * BLOCK):
        part = words[at : at + PASSAGE * BLOCK] or [b""]
        size = np.array([len(w) + 1 for w in part])
        ends = np.cumsum(size)
        n = -(-len(part) // PASSAGE)
        chars = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        stop = ends[np.minimum(np.arange(1, n + 1) * PASSAGE, len(part)) - 1]
        length = np.diff(np.r_[0, stop])
        owner = np.repeat(np.arange(n) * 256, length)
        x = np.zeros((n, INPUTS), np.float32)
        x[:, :256] = np.sqrt(np.bincount(owner + chars, minlength=256 * n).reshape(n, 256) / length[:, None])
        key = np.fromiter(map(hash, part), np.int64, len(part))
        same = np.r_[0, key[1:] == key[:-1]]
        start = np.arange(n) * PASSAGE
        count = np.diff(np.r_[start, len(part)])
        x[:, 256] = np.add.reduceat(same, start) / count
        order = np.lexsort((key, np.arange(len(part)) // PASSAGE))
        group = (np.arange(len(part)) // PASSAGE)[order]
        fresh = np.r_[1, (key[order][1:] != key[order][:-1]) | (group[1:] != group[:-1])]
        x[:, 257] = np.add.reduceat(fresh, start) / count
        x[:, 258] = length / count / 10
        x[:, 259] = min(lines, 1.0)
        x[:, 260] = count / PASSAGE
        yield x


@dataclass
class Model:
    """Encoder W, b; gated attention V, U, w; output v, c; ``cut`` is the logit that scores ACCEPT."""

    params: dict[str, np.ndarray]
    cut: float = 0.0
    constant: float | None = None

    def logit(self, text: bytes) -> float:
        p = self.params
        h = np.concatenate([np.tanh(x @ p["W"] + p["b"]) for x in passages(text)])
        a = (np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"]
        a = np.exp(a - a.max())
        return float((a @ h) / a.sum() @ p["v"] + p["c"][0])

    def score(self, text: bytes) -> float:
        if self.constant is not None:
            return self.constant
        return float(sigmoid(self.logit(text) - self.cut + np.log(ACCEPT / (1 - ACCEPT))))


def fit(texts: list[bytes], y: np.ndarray, seed: int = 1) -> Model:
    """Trains on three quarters of the sample and sets the cut on the rest; one class alone gives a constant."""
    if not len(y) or y.min() == y.max():
        return Model({}, constant=0.5 if not len(y) else float(y[0]))
    rng = np.random.default_rng(seed)
    bags = [np.concatenate(list(passages(t))) for t in texts]
    use, check = split(len(texts))
    if y[use].min() == y[use].max():
        use = check = np.arange(len(texts))
    p = {"W": rng.normal(0, 0.15, (INPUTS, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "v": rng.normal(0, 0.3, HIDDEN), "c": np.zeros(1)}
    opt = Adam(p, RATE)
    weight = np.where(y == 1, 0.5 / y[use].mean(), 0.5 / (1 - y[use].mean()))
    for _ in range(EPOCHS):
        order = rng.permutation(use)
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            opt.step(_gradients(p, [bags[i] for i in own], y[own], weight[own]))
    model = Model({k: v.astype(np.float32) for k, v in p.items()})
    model.cut = best_threshold(np.array([model.logit(texts[i]) for i in check]), y[check])
    return model


def _gradients(p: dict, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    x = np.concatenate(bags)
    start = np.cumsum([0] + [len(b) for b in bags])[:-1]
    of = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (t * s) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, start)[of])
    a = e / np.add.reduceat(e, start)[of]
    z = np.add.reduceat(a[:, None] * h, start)
    g = (sigmoid(z @ p["v"] + p["c"][0]) - y) * weight / len(bags)
    gz = g[:, None] * p["v"]
    ga = (gz[of] * h).sum(axis=1)
    ge = a * (ga - np.add.reduceat(a * ga, start)[of])
    gt, gs = ge[:, None] * p["w"] * s * (1 - t * t), ge[:, None] * p["w"] * t * s * (1 - s)
    gh = (a[:, None] * gz[of] + gt @ p["V"].T + gs @ p["U"].T) * (1 - h * h)
    return {"W": x.T @ gh + 1e-4 * p["W"], "b": gh.sum(axis=0), "V": h.T @ gt, "U": h.T @ gs, "w": ((t * s) * ge[:, None]).sum(axis=0), "v": z.T @ g + 1e-4 * p["v"], "c": np.array([g.sum()])}


def _score(model: Model):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in values(batch.column(1))], pa.float64())], names=["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, score) of every document: 0 to 1, at least ACCEPT where it is accepted.

    Every passage of the whole text is encoded, and gated attention weighs the passages. Fitted on a bounded sample of
    ``labels`` (see labelled_sample); only the text gives a score. A null text counts as empty, and an empty text is one
    empty passage. Without labels every score is 0.5, with labels of one class it is that class. Repeated rows stay;
    other columns are neither read nor returned; an empty table gives an empty result.
    """
    texts, y = labelled_sample(docs, labels, label)
    model = fit([t.encode() for t in texts], y)
    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", as_bytes(F.col("text")).alias("body")).mapInArrow(_score(model), f"doc_id {ids}, score double")


def _accept(model: Model, text: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            at = batch.schema.get_field_index(text)
            yield batch.filter(pa.array([model.score((t or "").encode()) >= ACCEPT for t in values(batch.column(at))], pa.bool_()))

    return run


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows of ``docs``, with all their columns, that quality_scores accepts; scored and filtered in one pass without a shuffle.

    Nulls, empty texts and missing labels are treated as there; without labels every row is accepted, as 0.5 is at least
    ACCEPT. Repeated rows are each kept or each dropped, and an empty table gives an empty result.
    """
    texts, y = labelled_sample(docs, labels, label)
    return docs.mapInArrow(_accept(fit([t.encode() for t in texts], y), "text"), docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
