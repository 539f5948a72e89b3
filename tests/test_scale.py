"""The choice of a neighbour search by cost, meshes in blocks, losses in one aggregate, and sinks that lose nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestruct.operators import metrics as M
from lodestruct.operators import neighbors as N
from lodestruct.operators import pairs as E
from lodestruct.plans.common import folder
from lodestruct.sources import sinks
from lodestruct.structures import StructureSet


def box(spark, shapes, seed=1):
    """Systems of random atoms: id -> (edges of the cell, periodic axes, number of atoms)."""
    rng = np.random.default_rng(seed)
    s = [(k, [float(e[0]), 0.0, 0.0, 0.0, float(e[1]), 0.0, 0.0, 0.0, float(e[2])], list(p)) for k, (e, p, _) in shapes.items()]
    a = [(k, i, *map(float, rng.random(3) * e), float(i % 3 - 1)) for k, (e, _, n) in shapes.items() for i in range(n)]
    return StructureSet(spark.createDataFrame(s, "system_id long, cell array<double>, pbc array<boolean>"), spark.createDataFrame(a, "system_id long, atom_id long, x double, y double, z_pos double, q double"))


def test_each_system_takes_the_cheaper_search(spark):
    on, slab = (True, True, True), (True, True, False)
    ss = box(spark, {1: ((5, 5, 5), on, 40), 2: ((60, 60, 60), on, 600), 3: ((6, 6, 400), slab, 900), 4: ((9, 9, 9), on, 100), 5: ((200, 200, 200), on, 30), 6: ((50, 50, 50), (False,) * 3, 500)})
    cost = {r["system_id"]: r["grid"] < r["naive"] for r in N.search_costs(ss, 3.0).collect()}
    assert cost == {1: False, 2: True, 3: True, 4: False, 5: False, 6: True}
    keys = lambda df: sorted(map(tuple, df.select(*N.PAIR).collect()))
    got = N.neighbor_pairs(ss, 3.0)
    assert keys(got) == keys(N.neighbor_pairs(ss, 3.0, method="naive")) == keys(N.neighbor_pairs(ss, 3.0, method="grid"))
    # the estimate is of the distances that are computed: within a factor of two for dense and sparse systems alike
    for k, (edges, _, n) in {2: ((60, 60, 60), on, 600), 4: ((9, 9, 9), on, 100)}.items():
        row = N.search_costs(ss, 3.0).filter(F.col("system_id") == k).first()
        spec = N.grid_spec(ss.systems.filter(F.col("system_id") == k), 3.0).first()
        bins = N.bin_atoms(ss.atoms.filter(F.col("system_id") == k), N.grid_spec(ss.systems, 3.0)).groupBy("bx", "by", "bz").count().collect()
        have = {(r["bx"], r["by"], r["bz"]): r["count"] for r in bins}
        reach = range(-spec["reach"][0], spec["reach"][0] + 1)
        met = sum(c * have.get(tuple((b + o) % m for b, o, m in zip(at, (x, y, z), spec["n"])), 0) for at, c in have.items() for x in reach for y in reach for z in reach)
        assert 0.5 < (row["grid"] - N.REPEAT * n * len(reach) ** 3) / met < 2


def test_cutoffs_of_each_system(spark):
    ss = box(spark, {1: ((8, 8, 8), (True,) * 3, 30), 2: ((20, 20, 20), (True,) * 3, 300), 3: ((8, 8, 8), (False,) * 3, 20), 4: ((8, 8, 8), (True,) * 3, 20)})
    own = {1: 3.5, 2: 2.5, 3: 5.0, 4: None}
    mixed = ss.with_(systems=ss.systems.join(spark.createDataFrame(list(own.items()), "system_id long, rc double"), "system_id"))
    for method in (None, "naive", "grid"):
        got = sorted(map(tuple, N.neighbor_pairs(mixed, "rc", method=method).select(*N.PAIR).collect()))
        want = [tuple(r) for k, rc in own.items() if rc for r in N.neighbor_pairs(ss, rc, method="naive").filter(F.col("system_id") == k).select(*N.PAIR).collect()]
        assert got == sorted(want)


@pytest.mark.parametrize("dims, order", [((20, 9, 33), 4), ((8, 8, 8), 2), ((17, 16, 5), 1)])
def test_mesh_blocks_add_up(spark, monkeypatch, dims, order):
    ss = box(spark, {1: ((9, 7, 8), (True,) * 3, 200), 2: ((3, 3, 3), (True,) * 3, 5)})
    rows = lambda df: {tuple(r[:4]): r[4] for r in df.collect()}
    monkeypatch.setattr(E, "BLOCK", 100)
    want, back = rows(E.spread(ss, dims, order)), {tuple(r[:2]): r[2] for r in E.gather(E.spread(ss, dims, order), ss, dims, order).collect()}
    monkeypatch.setattr(E, "BLOCK", 4)
    mesh = E.spread(ss, dims, order)
    got = rows(mesh)
    assert len(got) == mesh.count() and got == pytest.approx(want)
    assert {tuple(r[:2]): r[2] for r in E.gather(mesh, ss, dims, order).collect()} == pytest.approx(back)


def test_losses_agree_with_the_single_ones(spark):
    rng = np.random.default_rng(2)
    e = [(k, float(rng.normal()), float(rng.normal()) if k % 5 else float("nan")) for k in range(20)]
    f = [(k, i, *map(float, rng.normal(size=6)), bool(i % 2)) for k in range(20) for i in range(k % 4)]
    s = [(k, *[[float(x) for x in rng.normal(size=9)] for _ in "ab"]) for k in range(20)]
    pred = {"e": spark.createDataFrame([(k, p) for k, p, _ in e], "system_id long, energy double"), "f": spark.createDataFrame([r[:5] for r in f], "system_id long, atom_id long, fx double, fy double, fz double"), "s": spark.createDataFrame([r[:2] for r in s], "system_id long, stress array<double>")}
    label = {"e": spark.createDataFrame([(k, t) for k, _, t in e], "system_id long, energy double"), "f": spark.createDataFrame([(*r[:2], *r[5:]) for r in f], "system_id long, atom_id long, fx double, fy double, fz double, m boolean"), "s": spark.createDataFrame([(r[0], r[2]) for r in s], "system_id long, stress array<double>")}
    sizes = spark.createDataFrame([(k, k % 4) for k in range(20)], "system_id long, num_atoms long")
    one = spark.range(20).select(F.col("id").alias("system_id"), F.lit(0).alias("batch_id"))
    own = M.Metric(["system_id"], ["energy"], lambda p, t: F.abs(p["energy"] - t["energy"]), lambda t: ~F.isnan(t["energy"]))
    losses = {
        "a": ("e", M.Loss("energy", "absolute", sizes=sizes, ignore_nonfinite=True), 1.0), "b": ("e", own, 2.0), "c": ("f", M.Loss("force", mask="m"), 0.5),
        "d": ("f", M.Loss("force", "absolute", balanced=False), 1.0), "e": ("f", M.Loss("force", "huber", delta=0.4), 1.0), "f": ("s", M.Loss("stress", "huber", delta=0.2), 1.0),
    }
    got = M.evaluate_losses(pred, label, losses, one).first()
    want = {
        "a": M.energy_mae(pred["e"], label["e"], sizes, True), "b": own(pred["e"], label["e"]), "c": M.force_mse(pred["f"], label["f"], mask="m"), "d": M.force_l2(pred["f"], label["f"], per_system=False),
        "e": M.force_huber(pred["f"], label["f"], 0.4), "f": M.stress_huber(pred["s"], label["s"], 0.2),
    }
    for n, df in want.items():
        assert got[n] == pytest.approx(df.first()["value"]) == got[f"{n}_all"], n
    assert got["total"] == pytest.approx(sum(w * got[n] for n, (_, _, w) in losses.items())) and (got["n_samples"], got["n_unbatched"]) == (20, 0)
    few = M.evaluate_losses(pred, label, losses, one.filter("system_id < 7")).first()
    assert few["n_unbatched"] == 13 and few["a_all"] == pytest.approx(got["a_all"]) and few["n_batches"] == 1
    none = M.evaluate_losses(pred, label, losses, one.limit(0)).first()
    assert none["total"] is None and none["n_batches"] == 0 and none["b_all"] == pytest.approx(got["b_all"])
    with pytest.raises(KeyError):
        M.evaluate_losses(pred, label, {"x": ("nothing", own, 1.0)}, one)


def test_sinks_lose_nothing(spark):
    row = lambda *ids: spark.createDataFrame([(i,) for i in ids], "system_id long")
    ids = lambda df: sorted(r["system_id"] for r in df.collect())
    sink = sinks.Sink(spark, folder(spark, "sink"))
    sink.write(row(1, 2), 0)
    sink.write(row(3), 1)
    sink.write(row(4, 5, 6), 1)  # replaces the batch
    assert ids(sink.read()) == [1, 2, 4, 5, 6] and len(sink) == 5 and ids(sink.read().filter("batch = 1")) == [4, 5, 6]
    # a writer that was lost when the old rows of batch 0 were gone and the new ones still aside
    sink._rename("batch=0", "_aside=0")
    assert len(sink) == 5 and ids(sink.read()) == [1, 2, 4, 5, 6]
    # one that was lost before: both are there, and the old rows count
    row(9).write.parquet(f"{sink.path}/_aside=1/rows=1")
    assert len(sink) == 5 and ids(sink.read()) == [1, 2, 4, 5, 6]
    held, read = sink._batches(), sink.read

    def late(batches=None):  # a batch arrives while the sink is being drained
        sink.read = read
        sink.write(row(7))
        return read(batches)

    sink.read = late
    assert ids(sink.drain(folder(spark, "drained"))) == [1, 2, 4, 5, 6] and set(held) == {0, 1}
    assert ids(sink.read()) == [7] and len(sink) == 1
    sink.zero()
    assert len(sink) == 0
