"""Near copies at similarities around 0.8, against all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from lodestruct.llm import nearcopies


def shingle_set(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def roots(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def words(rng, n):
    return [f"w{k}" for k in rng.integers(0, 5000, n)]


def changed(rng, w, n):
    w = list(w)
    for at in rng.choice(len(w), n, replace=False):
        w[at] = f"new{rng.integers(1 << 40)}"
    return w


def planted():
    """Texts of 100, 300 and 1,000 words and copies with some words changed, so that their similarity is 0.75 to 0.97."""
    rng, rows = np.random.default_rng(5), []
    for n, change in ((100, 1), (100, 2), (300, 3), (300, 8), (1000, 5), (1000, 20), (1000, 30)):
        for _ in range(6):
            base = words(rng, n)
            rows += [" ".join(base), " ".join(changed(rng, base, change))]
    return rows


def check_classes(spark, rows, **how):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    marked, classes = nearcopies.near_copies(docs, **how)
    got = {r["doc_id"]: r["root"] for r in marked.join(classes, "node").collect()}
    want = roots([shingle_set(t) for t in rows])
    assert len(got) == len(rows)
    assert len(set(zip(want, (got[i] for i in range(len(rows)))))) == len(set(want)) == len(set(got.values()))


def test_stage_drops_near_copies(spark):
    rows = planted()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    want = roots([shingle_set(t) for t in rows])
    assert 0 < len(set(want)) < len(rows)
    assert got == sorted({r: k for k, r in reversed(list(enumerate(want)))}.values())


@pytest.mark.parametrize("bucket, block", [(32, 256), (1, 2), (2, 16)])
def test_classes(spark, bucket, block):
    rng = np.random.default_rng(7)
    rows = planted()[::3] + ["", None, " \n", "one", "ONE ", "a b c d", "a b c d e", None]
    base = words(rng, 120)
    rows += [" ".join(changed(rng, base, 1 + k % 3)) for k in range(40)] + [" ".join(base)]  # one large class
    rows += [" ".join(base[:60] + words(rng, 60)) for k in range(40)]  # a passage in common is no near copy
    check_classes(spark, rows, bucket=bucket, block=block)


def test_stage_keeps_a_row_of_each_class(spark):
    rng = np.random.default_rng(9)
    a, b, c, d = (" ".join(words(rng, 30)) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, c), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(None, a), (None, b), (1, c), (1, d)], key=repr)


def test_mixing_tells_rows_of_one_id_apart(spark):
    rng = np.random.default_rng(13)
    rows = [(None if k < 4 else 1, " ".join(words(rng, 20))) for k in range(8)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.mixing(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
