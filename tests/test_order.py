"""Running sums over any keys, and greedy packing of many sizes in one shard."""

import random

import pytest
from pyspark.sql import functions as F

from lodestruct.functions import order
from lodestruct.operators import sampling as G

KEYS = {
    "dense": list(range(500)),
    "sparse": [k << 20 for k in range(300)],
    "very sparse": [(k - 150) << 54 for k in range(300)],
    "negative": list(range(-70000, 70000, 331)),
    "skewed": [*range(1 << 40, (1 << 40) + 900), -(1 << 63), (1 << 63) - 1, 0],
}


@pytest.mark.parametrize("name", KEYS)
@pytest.mark.parametrize("exclusive", [True, False])
def test_running_sum(spark, name, exclusive):
    keys = KEYS[name][:]
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([(k, None if k % 7 == 0 else k % 5, "x") for k in keys], "k long, v long, n string")
    got = order.running_sum(df, "k", {"s": F.col("v"), "i": F.lit(1).cast("long")}, exclusive=exclusive)
    assert got.columns == ["k", "v", "n", "s", "i"]
    want, s, i = {}, 0, 0
    for k in sorted(keys):
        v = 0 if k % 7 == 0 else k % 5
        want[k] = (s, i) if exclusive else (s + v, i + 1)
        s, i = s + v, i + 1
    assert {r["k"]: (r["s"], r["i"]) for r in got.collect()} == want


def test_groups_and_nulls(spark):
    rows = [(g, k, g + k % 3) for g in range(4) for k in range(-3, 200000 if g == 2 else 10, 97 if g == 2 else 1)] + [(None, 5, 1), (1, None, 1)]
    got = order.dense_index(spark.createDataFrame(rows, "g long, k long, v long"), "k", "i", by=("g",)).collect()
    want = {(g, k): i for g in range(4) for i, k in enumerate(sorted(k for h, k, _ in rows if h == g and k is not None))}
    assert {(r["g"], r["k"]): r["i"] for r in got} == want
    assert order.dense_index(spark.createDataFrame([], "k long"), "k", "i").count() == 0


def greedy(sizes, budget):
    """(batch, id, ordinal) by walking over all that wait."""
    limits = [float("inf") if b is None else b for b in budget]
    bins = {}
    for i, a, e, b in sorted(sizes):
        bins.setdefault(b, []).append((i, a, e))
    out, batch = [], 0
    while any(bins.values()):
        left, n, added = limits[:], 0, True
        while added:
            added = False
            for b in sorted(bins):
                for x in bins[b]:
                    if x[1] <= left[0] and x[2] <= left[1] and left[2] >= 1:
                        left = [left[0] - x[1], left[1] - x[2], left[2] - 1]
                        bins[b].remove(x)
                        out.append((batch, x[0], n))
                        added, n = True, n + 1
                        break
        batch += 1
    return out


@pytest.mark.parametrize("budget", [(60, 90, 7), (60, None, 7), (None, 90, None), (60, 90, None)])
def test_packing_is_the_greedy_choice(spark, budget):
    rnd = random.Random(str(budget))
    sizes = [(k, rnd.randint(1, 40), rnd.randint(0, 60)) for k in range(400)]
    sizes = [(i, a, e, a // 8) for i, a, e in sizes]
    df = spark.createDataFrame([(*s, s[0] % 2) for s in sizes], "system_id long, num_atoms long, num_edges long, bin long, shard int")
    got = sorted((r["shard"], r["batch"], r["ordinal"], r["system_id"]) for r in G.pack_initial(df, budget).collect())
    assert got == sorted((sh, b, n, i) for sh in (0, 1) for b, i, n in greedy([s for s in sizes if s[0] % 2 == sh], budget))


def test_a_million_sizes_in_one_shard():
    rnd = random.Random(3)
    n = 1_000_000
    atoms, edges = [rnd.randint(1, 64) for _ in range(n)], [rnd.randint(0, 200) for _ in range(n)]
    by = {}
    for i in range(n):
        by.setdefault(atoms[i] // 8, []).append(i)
    bins = {b: G.Waiting(ids, [atoms[i] for i in ids], [edges[i] for i in ids]) for b, ids in by.items()}
    out = G.pack_sizes(bins, G._limits((4096, 12800, 128)))
    assert sorted(i for _, i, _ in out) == list(range(n))
    used = {}
    for batch, i, _ in out:
        u = used.setdefault(batch, [0, 0, 0])
        u[0], u[1], u[2] = u[0] + atoms[i], u[1] + edges[i], u[2] + 1
    assert all(a <= 4096 and e <= 12800 and k <= 128 for a, e, k in used.values())


def test_open_budgets(spark):
    df = spark.createDataFrame([(1, 5, 5, 0, 0)], "system_id long, num_atoms long, num_edges long, bin long, shard int")
    with pytest.raises(ValueError):
        G.pack_initial(df, (None, None, 4))
    with pytest.raises(Exception, match="exceeds the budget"):
        G.pack_initial(df, (4, None, None)).collect()
    used = spark.createDataFrame([(0, 1, 1, 1)], "shard int, num_atoms long, num_edges long, n long")
    assert G.refill(df, used, (None, 6, None)).count() == 1 and G.refill(df, used, (5, None, None)).count() == 0
