"""The block join against all products: ties, hostile magnitudes, several lengths, extra columns with names used inside."""

import numpy as np
import pytest

from lodestruct.llm import nearest


def brute(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.array(v, float).any()]
    out = {}
    for q, x in good:
        if q in queries:
            found = sorted((-float(np.cumsum(x * y)[-1]), i) for i, y in good if i != q and len(y) == len(x))[:k]
            out.setdefault(q, []).append([(n, i, -s) for n, (s, i) in enumerate(found, 1)])
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("band, column", [(16, 512), (1, 1), (2, 3)])
def test_grid(spark, band, column):
    rng = np.random.default_rng(8)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=6) * 10.0 ** rng.integers(-3, 4)]) for k in range(150)]
    rows += [(150 + k, rows[k][1]) for k in range(40)] + [(300 + k, [1.0, 2.0, 3.0]) for k in range(5)] + [(400, [1e200] * 6), (420, [-1e200] * 6), (None, [1.0] * 6), (440, [0.0] * 6), (460, None)]
    v = spark.createDataFrame([(i, x, 7, 0, "c") for i, x in rows], "vec_id long, embedding array<double>, row int, band int, side string")
    got = {}
    for r in nearest.nearest(v, v.filter("vec_id % 20 = 0"), k=7, rows=16, query_rows=4, band=band, column=column).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, {q for q in range(0, 500, 20)}, 7)
    assert set(got) == set(want)
    for q in want:
        assert sorted(got[q]) == want[q][0]


def test_fewer_candidates_than_asked(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in nearest.nearest(v, v.filter("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 20, 4.0), (0, 2, 3, 3.0), (20, 1, 0, 4.0), (20, 2, 3, 3.0)]
    alone = v.filter("vec_id = 0")
    assert nearest.nearest(alone, alone).count() == 0 and nearest.nearest(v, v.limit(0)).count() == 0


def test_many_equal_vectors(spark):
    """A third of all rows has one vector, one id repeats often: ties go to the smaller ids, whoever asks."""
    rng = np.random.default_rng(2)
    rows = [(k, [3.0, 3.0, 3.0]) for k in range(0, 200, 2)] + [(20, [3.0, 3.0, 3.0])] * 30 + [(k, [float(x) for x in rng.normal(size=3)]) for k in range(1, 200, 2)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(v, v.filter("vec_id in (0, 20, 41, 180)").dropDuplicates(["vec_id"]), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, x in {i: x for i, x in rows}.items():
        if q in got:
            want = sorted((-float(np.cumsum(np.array(x) * y)[-1]), i) for i, y in rows if i != q)[:5]
            assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]
    assert [i for _, i, _ in sorted(got[0])] == [2, 4, 6, 8, 10] and [i for _, i, _ in sorted(got[180])][:1] == [0]
