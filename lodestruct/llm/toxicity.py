"""Toxicity: a convolutional text classifier trained in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batches, held_out, table, values
from ._train import Adam, best_threshold, labelled_sample, sigmoid, split

#: Hash buckets and size of the word embeddings; filter widths; filters of each width.
HASHED, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 8
#: Leading parts of a word that are embedded with it.
PREFIXES = (3, 4, 5, 6)
SLOTS = [(w, j) for w in WIDTHS for j in range(w)]
#: Words whose responses are kept in a task, and positions filtered at once; both bound memory.
CACHE, BLOCK = 300_000, 1 << 15
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Frequent function words by which the language of a text is guessed.
FUNCTION_WORDS = {
    "en": "the and of to in is that for with was on are it this",
    "de": "der die und das von ist ein eine nicht mit den sich für",
    "fr": "le la les de des et un une que pour est dans par",
    "es": "el la los de que y en un una por con para del se",
}
LANGUAGES = list(FUNCTION_WORDS)
_VOTES = {w: [w in FUNCTION_WORDS[k].split() for k in LANGUAGES] for k0 in LANGUAGES for w in FUNCTION_WORDS[k0].split()}
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def words_of(text: str) -> list[str]:
    return [w.strip(EDGE) for w in text.lower().split()]


def language(words: list[str]) -> int:
    """Index in LANGUAGES of the language with most function words; len(LANGUAGES) if there are none. From the words alone."""
    votes = [_VOTES[w] for w in words if w in _VOTES]
    if not votes:
        return len(LANGUAGES)
    return int(np.asarray(votes).sum(axis=0).argmax())


def features(word: str) -> list[int]:
    b = word.encode()
    return [zlib.crc32(b"=" + b) % HASHED] + [zlib.crc32(word[:n].encode(), n) % HASHED for n in PREFIXES]


@dataclass
class Model:
    """Embeddings E, filters W (one matrix for each place of each width), their bias, output v and c, a cut for each language."""

    params: dict[str, np.ndarray]
    cuts: np.ndarray
    constant: float | None = None
    cache: dict = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"params": self.params, "cuts": self.cuts, "constant": self.constant, "cache": {}, "table": None}

    def _ids(self, words: list[str]) -> np.ndarray:
        """Rows of ``table`` that hold the words' responses to all filters."""
        if self.table is None or len(self.cache) > CACHE:
            self.cache, self.table = {}, np.empty((CACHE + 2 * BLOCK, len(SLOTS) * FILTERS), np.float32)
        cache, start = self.cache, len(self.cache)
        ids = np.fromiter([cache.setdefault(w, len(cache)) for w in words], np.int64, len(words))
        if len(cache) > start:
            f = np.array([features(w) for w in islice(reversed(cache), len(cache) - start)][::-1])
            made = np.concatenate([self.params["E"][f[at : at + 8192]].sum(axis=1) for at in range(0, len(f), 8192)])
            self.table[start : len(cache)] = made @ self.params["W"].reshape(DIM, -1)
        return ids

    def pooled(self, words: list[str]) -> np.ndarray:
        """Greatest response of every filter over all places of the text; no words: no response."""
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        for at in range(0, len(words), BLOCK):
            ids = self._ids(words[at : at + BLOCK + max(WIDTHS) - 1])
            k = 0
            for i, w in enumerate(WIDTHS):
                n = len(ids) - w + 1
                if n > 0:
                    r = sum(self.table[ids[j : j + n], (k + j) * FILTERS : (k + j + 1) * FILTERS] for j in range(w))
                    best[i * FILTERS : (i + 1) * FILTERS] = np.maximum(best[i * FILTERS : (i + 1) * FILTERS], r.max(axis=0))
                k += w
        return np.maximum(best + self.params["b"], 0)

    def logit(self, words: list[str]) -> float:
        return float(self.pooled(words) @ self.params["v"] + self.params["c"][0])

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        words = words_of(text)
        return float(sigmoid(self.logit(words) - self.cuts[language(words)]))


def _start(texts: list[list[int]], y: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """First dimension: smoothed log odds of a bucket among the labels; the rest is random."""
    hit = np.zeros((2, HASHED))
    for buckets, label in zip(texts, y):
        hit[int(label), buckets] += 1
    prior, weight = y.mean(), 20.0
    odds = np.log((hit[1] + weight * prior) / (hit[0] + weight * (1 - prior)) * (1 - prior) / prior)
    E = rng.normal(0, 0.05, (HASHED, DIM))
    E[:, 0] = odds * 0.3
    W = rng.normal(0, 0.3, (DIM, len(SLOTS), FILTERS))
    W[0] += [[1.0 / w] for w, _ in SLOTS]
    n = len(WIDTHS) * FILTERS
    return {"E": E, "W": W, "b": np.full(n, -0.5), "v": np.full(n, 0.3) + rng.normal(0, 0.05, n), "c": np.array([-1.0])}


def fit(texts: list[str], y: np.ndarray, seed: int = 1) -> Model:
    """Trains on three quarters of the sample and sets each language's cut on the rest; one class alone gives a constant."""
    if not len(y) or y.min() == y.max():
        return Model({}, np.zeros(len(LANGUAGES) + 1), constant=0.5 if not len(y) else float(y[0]))
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    docs = [np.fromiter((index.setdefault(w, len(index)) for w in words_of(t)), np.int64) for t in texts]
    feats = np.array([features(w) for w in index] or [[0] * (1 + len(PREFIXES))])
    use, check = split(len(texts))
    if y[use].min() == y[use].max():
        use = check = np.arange(len(texts))
    p = _start([np.unique(feats[np.unique(docs[i])]) for i in use], y[use], rng)
    opt = Adam(p, RATE)
    weight = np.where(y == 1, 0.5 / y[use].mean(), 0.5 / (1 - y[use].mean()))
    for _ in range(EPOCHS):
        order = rng.permutation(use)
        for at in range(0, len(order), BATCH):
            _step(p, opt, [docs[i] for i in order[at : at + BATCH]], y[order[at : at + BATCH]], weight[order[at : at + BATCH]], feats)
    model = Model({k: v.astype(np.float32) for k, v in p.items()}, np.zeros(len(LANGUAGES) + 1))
    words = [words_of(texts[i]) for i in check]
    logits, lang = np.array([model.logit(w) for w in words]), np.array([language(w) for w in words])
    model.cuts[:] = common = best_threshold(logits, y[check])
    for k in range(len(model.cuts)):
        own = lang == k
        if min((y[check][own] == 1).sum(), (y[check][own] == 0).sum()) >= 10:
            model.cuts[k] = best_threshold(logits[own], y[check][own])
        else:
            model.cuts[k] = common
    return model


def _step(p: dict, opt: Adam, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, feats: np.ndarray) -> None:
    docs = [d if len(d) >= max(WIDTHS) else np.r_[d, np.zeros(max(WIDTHS) - len(d), np.int64)] for d in docs]
    seen, local = np.unique(np.concatenate(docs), return_inverse=True)
    emb = p["E"][feats[seen]].sum(axis=1)
    resp = (emb @ p["W"].reshape(DIM, -1)).astype(np.float32)
    cut = np.cumsum([len(d) for d in docs])[:-1]
    n, places = len(docs), np.zeros((len(docs), len(WIDTHS) * FILTERS, max(WIDTHS)), np.int64)
    top = np.zeros((n, len(WIDTHS) * FILTERS))
    for d, ids in enumerate(np.split(local, cut)):
        k = 0
        for i, w in enumerate(WIDTHS):
            m = len(ids) - w + 1
            r = sum(resp[ids[j : j + m], (k + j) * FILTERS : (k + j + 1) * FILTERS] for j in range(w))
            best = r.argmax(axis=0)
            own = slice(i * FILTERS, (i + 1) * FILTERS)
            top[d, own] = r[best, np.arange(FILTERS)]
            for j in range(w):
                places[d, own, j] = ids[best + j]
            k += w
    act = np.maximum(top + p["b"], 0)
    g = (sigmoid(act @ p["v"] + p["c"][0]) - y) * weight / n
    up = (g[:, None] * p["v"]) * (act > 0)
    gW, gemb = np.zeros_like(p["W"]), np.zeros_like(emb)
    k = 0
    for i, w in enumerate(WIDTHS):
        own = slice(i * FILTERS, (i + 1) * FILTERS)
        for j in range(w):
            at = places[:, own, j]
            gW[:, k] += np.einsum("nf,nfd->df", up[:, own], emb[at])
            np.add.at(gemb, at, up[:, own][..., None] * p["W"][:, k].T[None])
            k += 1
    hot = np.flatnonzero(np.abs(gemb).sum(axis=1))
    rows, inverse = np.unique(feats[seen[hot]], return_inverse=True)
    gE = np.zeros((len(rows), DIM))
    np.add.at(gE, inverse.reshape(-1), np.repeat(gemb[hot], feats.shape[1], axis=0))
    opt.step({"E": gE, "W": gW, "b": up.sum(axis=0), "v": act.T @ g, "c": np.array([g.sum()])}, {"E": rows})


def _score(model: Model):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in values(batch.column(1))], pa.float64())], names=["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, score) of every document: 0 to 1, at least 0.5 where the whole text passes its language's cut.

    Fitted on a bounded sample of ``labels`` (see labelled_sample); only the text gives a score, and its language is
    guessed from its words. Null texts count as empty; those and texts without words get the score of a text without
    any response. Without labels every score is 0.5, with labels of one class it is that class. Repeated rows stay;
    other columns are neither read nor returned; an empty table gives an empty result.
    """
    model = fit(*labelled_sample(docs, labels, label))
    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_score(model), f"doc_id {ids}, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
