"""Cases that the tables do not hold."""

import math
import os

import pytest
from pyspark.sql import functions as F

from lodestruct.functions.special import bspline, erfc, huber, weight_at
from lodestruct.operators import metrics as M
from lodestruct.operators import monitors as H
from lodestruct.operators import neighbors as N
from lodestruct.operators import pairs as E
from lodestruct.operators import partition as P
from lodestruct.operators import sampling as G
from lodestruct.operators import structures as O
from lodestruct.plans.common import folder
from lodestruct.sources import sinks, store
from lodestruct.structures import StructureSet


def make(spark, cells, atoms, pbc=(True, True, True)):
    s = spark.createDataFrame([(k, [float(x) for x in c], list(pbc), 1.0) for k, c in cells.items()], "system_id long, cell array<double>, pbc array<boolean>, energy double")
    a = spark.createDataFrame([(s_, i, 1, float(x), float(y), float(z), 1.0) for s_, i, x, y, z in atoms], "system_id long, atom_id long, z int, x double, y double, z_pos double, q double")
    return StructureSet(s, a)


CUBE = [4, 0, 0, 0, 4, 0, 0, 0, 4]


def brute(cell, atoms, rc, images, pbc=(True, True, True)):
    out = set()
    rng = [range(-images, images + 1) if p else (0,) for p in pbc]
    for i, a in enumerate(atoms):
        for j, b in enumerate(atoms):
            for s in ((x, y, z) for x in rng[0] for y in rng[1] for z in rng[2]):
                if i == j and s == (0, 0, 0):
                    continue
                d = [a[k] - b[k] - sum(s[m] * cell[3 * m + k] for m in range(3)) for k in range(3)]
                if sum(x * x for x in d) < rc * rc:
                    out.add((i, j, *s))
    return out


@pytest.mark.parametrize("method", ["naive", "grid"])
@pytest.mark.parametrize("pbc", [(True, True, True), (True, False, True), (False, False, False)])
def test_skew_cell_and_atoms_outside(spark, method, pbc):
    cell = [5, 0, 0, 1.5, 4, 0, -0.7, 0.9, 3]
    atoms = [(0.1, 0.2, 0.3), (4.9, 3.5, 2.7), (-6.2, 1.0, 9.0), (2.5, 2.5, 1.1)]
    ss = make(spark, {7: cell}, [(7, i, *p) for i, p in enumerate(atoms)], pbc)
    got = {tuple(r) for r in N.neighbor_pairs(ss, 3.3, method=method).select("i", "j", "sx", "sy", "sz").collect()}
    assert got == brute(cell, atoms, 3.3, 6, pbc)


def test_cell_smaller_than_cutoff(spark):
    ss = make(spark, {1: CUBE}, [(1, 0, 0, 0, 0)])
    for method in ("naive", "grid"):
        assert N.neighbor_pairs(ss, 4.1, method=method).count() == 6
        assert N.neighbor_pairs(ss, 4.1, half=True, method=method).count() == 3


def test_strict_search_rejects_coincident_atoms(spark):
    ss = make(spark, {1: CUBE}, [(1, 0, 0, 0, 0), (1, 1, 0, 0, 0)])
    assert N.neighbor_pairs(ss, 1.0).count() == 2
    with pytest.raises(Exception, match="coincide"):
        N.neighbor_pairs(ss, 1.0, strict=True).collect()


def test_matrix_overflow_is_an_error(spark):
    ss = make(spark, {1: CUBE}, [(1, 0, 0, 0, 0)])
    with pytest.raises(Exception, match="more than 2 neighbours"):
        N.to_matrix(N.neighbor_pairs(ss, 4.1), ss.atoms, 2).collect()


def test_empty_sets(spark):
    ss = O.empty_like(make(spark, {1: CUBE}, [(1, 0, 0, 0, 0)]))
    assert N.neighbor_pairs(ss, 1.0).count() == 0
    assert O.sizes(ss).count() == 0 and O.nest(ss).count() == 0 and O.validate(ss).count() == 0


def test_store(spark):
    path = folder(spark, "test-store")
    ss = make(spark, {5: CUBE, 6: CUBE, 9: CUBE}, [(5, 0, 0, 0, 0), (9, 0, 1, 1, 1), (9, 1, 2, 2, 2)])
    ss = ss.with_(edges=N.neighbor_pairs(ss, 2.0, with_geometry=False))
    store.write_structures(ss, path)
    with pytest.raises(FileExistsError):
        store.write_structures(ss, path)
    store.delete_structures(spark, path, spark.createDataFrame([(6,)], "system_id long"))
    got = store.read_structures(spark, path, index=True)
    assert [r[0] for r in got.systems.orderBy("system_id").select("system_id").collect()] == [0, 1]
    assert got.atoms.filter("system_id = 1").count() == 2 and got.edges.count() == 2
    assert store.field_levels(spark, path)["energy"] == "systems"
    with pytest.raises(ValueError):
        store.add_custom(spark, path, "more", spark.createDataFrame([(5, 1.0)], "system_id long, more double"), "systems")
    store.delete_structures(spark, path, got.systems.selectExpr("CASE WHEN system_id = 0 THEN 5L ELSE 9L END AS system_id"))
    store.compact(spark, path)
    assert store.read_structures(spark, path).systems.count() == 0
    store.append_structures(ss, path)
    assert store.read_structures(spark, path).systems.count() == 3
    with pytest.raises(KeyError):
        store.read_structures(spark, path, fields=["nothing"])


def test_sinks(spark):
    rows = spark.createDataFrame([(1, 3), (2, 4), (3, 9)], "system_id long, num_atoms long")
    sink = sinks.BoundedSink(spark, folder(spark, "bounded"), 5, 8)
    with pytest.raises(OverflowError):
        sink.write(rows)
    sink.write(rows.filter("system_id < 3"))
    assert len(sink) == 2 and not sink.is_full()
    sink.zero()
    assert len(sink) == 0


def test_put_and_key_errors(spark):
    ss = make(spark, {1: CUBE, 2: CUBE}, [(1, 0, 0, 0, 0)])
    with pytest.raises(ValueError):
        O.add_key(ss, "energy", ss.systems, "systems")
    with pytest.raises(Exception, match="do not match"):
        O.add_key(ss, "new", spark.createDataFrame([(1, 1.0), (3, 1.0)], "system_id long, new double"), "systems").systems.collect()
    new, slots = O.put(ss, ss, ss.systems.filter("system_id = 1"), ss.systems.filter("system_id = 2"))
    assert slots.collect()[0][:] == (1, 2) and new.atoms.count() == 2


def test_sampling_errors(spark):
    s = spark.createDataFrame([(i,) for i in range(4)], "system_id long")
    mixed = G.mix([s, s.limit(0), s])
    with pytest.raises(ValueError):
        G.weighted_sample(mixed, {0: 1.0, 1: 1.0}, 4)
    with pytest.raises(ValueError):
        G.weighted_sample(mixed, {0: -1.0, 2: 1.0}, 4)
    with pytest.raises(ValueError):
        G.weighted_sample(mixed, {0: 1.0}, 9, replacement=False)
    assert G.weighted_sample(mixed, {0: 1.0}, 9, shuffle=False).count() == 9
    with pytest.raises(ValueError):
        G.mix([s, s.withColumn("extra", F.lit(1))])
    assert G.mix([s, s.withColumn("extra", F.lit(1))], strict=False).columns.count("extra") == 0
    assert [r["batch_id"] for r in G.mixed_batches(mixed, 2, {0: 1, 2: 1}, "max_size").groupBy("batch_id").count().orderBy("batch_id").collect()] == [0, 1, 2, 3]
    big = spark.createDataFrame([(1, 50, 0, 0, 0)], "system_id long, num_atoms long, num_edges long, bin long, shard long")
    with pytest.raises(Exception, match="exceeds the budget"):
        G.pack_initial(big, (10, 10, 10)).collect()
    with pytest.raises(Exception, match="too large"):
        G.size_bins(big.drop("bin"), 10).collect()


def test_greedy_packing_keeps_budgets_and_rows(spark):
    rows = [(i, 3 + i * 7 % 11, i % 5, (3 + i * 7 % 11) // 4, i % 2) for i in range(60)]
    sizes = spark.createDataFrame(rows, "system_id long, num_atoms long, num_edges long, bin long, shard long")
    got = G.pack_initial(sizes, (30, 12, 4)).join(sizes.drop("shard"), "system_id")
    assert got.count() == 60 and got.select("system_id").distinct().count() == 60
    worst = got.groupBy("shard", "batch").agg(F.sum("num_atoms").alias("a"), F.sum("num_edges").alias("e"), F.count("*").alias("n")).agg(F.max("a"), F.max("e"), F.max("n")).first()
    assert worst[0] <= 30 and worst[1] <= 12 and worst[2] <= 4


def test_single_stage_has_no_deviation(spark):
    e = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "b", "2024-01-01 00:00:02")], "system_id long, stage string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert H.stage_timing(e).collect()[0][:] == ("a->b", 1, 2.0, 0.0, 2.0, 2.0, 2.0)


def test_metrics_of_nothing_are_zero(spark):
    none = spark.createDataFrame([], "system_id long, energy double")
    assert M.energy_mse(none, none).first()["value"] == 0
    f = spark.createDataFrame([], "system_id long, atom_id long, fx double, fy double, fz double")
    assert M.force_mse(f, f).first()["value"] == 0


def test_own_metric(spark):
    t = spark.createDataFrame([(1, 2.0), (2, None)], "system_id long, energy double")
    p = spark.createDataFrame([(1, 2.5), (2, 9.0)], "system_id long, energy double")
    mine = M.Metric(["system_id"], ["energy"], lambda a, b: F.abs(a["energy"] - b["energy"]), lambda b: b["energy"].isNotNull())
    assert mine(p, t).first()["value"] == 0.5


def test_scalar_functions(spark):
    d = spark.createDataFrame([(x,) for x in (-1.5, 0.0, 0.3, 2.0, 3.7)], "x double")
    for v, e, b, h in d.select("x", erfc("x"), bspline(F.col("x"), 4), huber(F.col("x"), 0.5)).collect():
        assert abs(e - math.erfc(v)) < 2e-7
        assert h == pytest.approx(0.5 * v * v if abs(v) <= 0.5 else 0.5 * (abs(v) - 0.25))
        assert (b > 0) == (0 < v < 4)
    total = spark.range(4).select(F.sum(bspline(F.col("id") + 0.3, 4))).first()[0]
    assert total == pytest.approx(1.0)
    with pytest.raises(ValueError):
        weight_at(F.lit(0), "cosine", start=0.0, end=1.0, steps=0)


def test_forces_are_the_slope_of_the_energy(spark):
    step = 1e-5
    def energy(x):
        ss = make(spark, {1: [30, 0, 0, 0, 30, 0, 0, 0, 30]}, [(1, 0, 0, 0, 0), (1, 1, x, 1.0, 0.5)])
        return E.lj(N.neighbor_pairs(ss, 6.0), 0.2, 2.0, switch=(2.0, 5.0)).first()["energy"]
    ss = make(spark, {1: [30, 0, 0, 0, 30, 0, 0, 0, 30]}, [(1, 0, 0, 0, 0), (1, 1, 2.6, 1.0, 0.5)])
    f = E.lj(N.neighbor_pairs(ss, 6.0), 0.2, 2.0, "forces", switch=(2.0, 5.0)).filter("atom_id = 1").first()["fx"]
    assert f == pytest.approx(-(energy(2.6 + step) - energy(2.6 - step)) / (2 * step), rel=1e-4)


def test_half_and_full_lists_agree(spark):
    ss = make(spark, {1: CUBE}, [(1, 0, 0.5, 0, 0), (1, 1, 2.0, 1.0, 3.0)])
    for out in ("energy", "forces", "atom_energy"):
        key = ["atom_id"] if out != "energy" else []
        full, half = (sorted(tuple(round(v, 9) for v in r[1:]) for r in E.lj(N.neighbor_pairs(ss, 5.0, half=h), 0.2, 1.0, out, half=h).orderBy("system_id", *key).collect()) for h in (False, True))
        assert full == half


def test_best_grid():
    assert P.best_grid(8, (1.0, 1.0, 1.0)) == (2, 2, 2) and P.best_grid(4, (100.0, 1.0, 1.0)) == (4, 1, 1)


def test_each_system_by_its_own_size(spark):
    """A large system among small ones: both ways at once, the same pairs as by brute force, charges carried along."""
    import random

    rnd = random.Random(4)
    cells = {1: [9, 0, 0, 1, 8, 0, 0, 0, 7], **{k: CUBE for k in range(2, 12)}}
    places = {1: [tuple(rnd.uniform(-2, 10) for _ in range(3)) for _ in range(104)], **{k: [tuple(rnd.uniform(0, 4) for _ in range(3)) for _ in range(k % 4)] for k in range(2, 12)}}
    ss = make(spark, cells, [(k, i, *p) for k, ps in places.items() for i, p in enumerate(ps)])
    ss = ss.with_(atoms=ss.atoms.withColumn("q", F.col("atom_id") * 0.5))
    got = {}
    for r in N.neighbor_pairs(ss, 2.2, carry=["q"]).collect():
        got.setdefault(r["system_id"], set()).add((r["i"], r["j"], r["sx"], r["sy"], r["sz"]))
        assert (r["i_q"], r["j_q"]) == (r["i"] * 0.5, r["j"] * 0.5)
    for k, ps in places.items():
        assert got.get(k, set()) == brute(cells[k], ps, 2.2, 2)
    half = N.neighbor_pairs(ss, 2.2, half=True, carry=["q"])
    assert half.count() * 2 == N.mirror(half).count() == sum(map(len, got.values()))
    assert N.mirror(half).filter("i_q <> i * 0.5 or j_q <> j * 0.5").count() == 0
    assert N.order_pairs(N.neighbor_pairs(ss, 2.2)).limit(1).collect()[0]["system_id"] == 1


def test_bounded_sink_loses_nothing(spark):
    sized = lambda *rows: spark.createDataFrame(list(rows), "system_id long, num_atoms long, num_edges long")
    sink = sinks.BoundedSink(spark, folder(spark, "bounded"), 3, 8, 10)
    sink.write(sized((1, 3, 1), (2, 6, 9)), 0)
    sink.write(sized((1, 3, 1), (2, 6, 9)), 0)  # again
    assert sorted(r["system_id"] for r in sink.read().collect()) == [1, 2] and not sink.is_full()
    sink.write(sized((3, 8, 10)))
    assert sink.is_full() and sink.room() == {"systems": 0, "num_atoms": 0, "num_edges": 0}
    for bad in (sized((4, 1, 1)), sized((4, 9, 1)), sized((4, 1, 11))):
        with pytest.raises(OverflowError):
            sink.write(bad)
    assert len(sink) == 3
    plain = sinks.Sink(spark, folder(spark, "plain"), capacity=3)
    plain.write(sized((1, 1, 1), (2, 1, 1)), 0)
    plain.write(sized((1, 1, 1), (2, 1, 1)), 0)
    plain.write(sized((3, 1, 1)), 7)
    with pytest.raises(OverflowError):
        plain.write(sized((4, 1, 1)))
    assert len(plain) == 3


def test_store_versions_appear_whole(spark):
    """A reader of an older version is not disturbed, and a version that exists is not written again."""
    ss, path = make(spark, {1: CUBE, 2: CUBE}, [(1, 0, 0, 0, 0), (2, 0, 1, 1, 1)]), folder(spark, "versions")
    store.write_structures(ss, path)
    old = store.read_structures(spark, path)
    store.append_structures(ss, path)
    store.delete_structures(spark, path, spark.createDataFrame([(1,)], "system_id long"))
    store.compact(spark, path)
    assert old.systems.count() == 2 and store.read_structures(spark, path).systems.count() == 3
    assert store._versions(spark, path) == [0, 1, 2, 3]
    with pytest.raises(FileExistsError):
        store._publish(spark, path, 3, [], [])
    with pytest.raises(FileExistsError):
        store.write_structures(ss, path)


def test_reciprocal_forces_are_slopes_of_the_energy(spark):
    cell, atoms = [5, 0, 0, 0.5, 6, 0, 0, 0, 4], [(0.3, 0.2, 0.1, 1.0), (2.1, 3.0, 1.7, -2.0), (4.0, 1.0, 3.1, 0.7)]
    step, sets = 1e-4, {}
    for k, d in enumerate((0, step, -step)):
        sets[k + 1] = [(x + (d if i == 0 else 0), y, z, q) for i, (x, y, z, q) in enumerate(atoms)]
    s = spark.createDataFrame([(k, [float(c) for c in cell], [True] * 3) for k in sets], "system_id long, cell array<double>, pbc array<boolean>")
    a = spark.createDataFrame([(k, i, *map(float, p)) for k, ps in sets.items() for i, p in enumerate(ps)], "system_id long, atom_id long, x double, y double, z_pos double, q double")
    ss = StructureSet(s, a)
    e = {r["system_id"]: r["energy"] for r in E.ewald_recip(ss, 0.4, k_cutoff=4.0).collect()}
    f = E.ewald_recip(ss, 0.4, k_cutoff=4.0, out="forces").filter("system_id = 1 and atom_id = 0").collect()[0]
    assert f["fx"] == pytest.approx(-(e[2] - e[3]) / (2 * step), rel=1e-5)
    grown = {k: 1 + d for k, d in ((1, 0), (2, step), (3, -step))}
    s = spark.createDataFrame([(k, [c * g for c in map(float, cell)], [True] * 3) for k, g in grown.items()], "system_id long, cell array<double>, pbc array<boolean>")
    a = spark.createDataFrame([(k, i, x * g, y * g, z * g, q) for k, g in grown.items() for i, (x, y, z, q) in enumerate(atoms)], "system_id long, atom_id long, x double, y double, z_pos double, q double")
    e = {r["system_id"]: r["energy"] for r in E.ewald_recip(StructureSet(s, a), 0.4, bounds=(4, 4, 4)).collect()}
    w = E.ewald_recip(StructureSet(s, a), 0.4, bounds=(4, 4, 4), out="virial").filter("system_id = 1").collect()[0]["virial"]
    assert w[0] + w[4] + w[8] == pytest.approx(-(e[2] - e[3]) / (2 * step), rel=1e-5)


def test_packing_into_batches_by_hand(spark):
    """Round after round over the bins, the first system of each that fits, until a round adds none."""
    rows = [(k, (k * 7) % 13 + 1, (k * 5) % 9, k % 2) for k in range(60)]
    sizes = G.size_bins(spark.createDataFrame(rows, "system_id long, num_atoms long, num_edges long, shard long"), 100, width=4)
    got = sorted(tuple(r) for r in G.pack_initial(sizes, (30, 25, 5)).collect())
    want = []
    for shard in (0, 1):
        left = sorted((a // 4, k, a, e) for k, a, e, s in rows if s == shard)
        batch = 0
        while left:
            taken = []
            while True:
                n = len(taken)
                for b in sorted({x[0] for x in left}):
                    fit = next((x for x in left if x[0] == b and sum(y[2] for y in taken) + x[2] <= 30 and sum(y[3] for y in taken) + x[3] <= 25 and len(taken) < 5), None)
                    if fit:
                        left.remove(fit)
                        taken.append(fit)
                if len(taken) == n:
                    break
            want += [(shard, batch, x[1], i) for i, x in enumerate(taken)]
            batch += 1
    assert got == sorted(want)


def test_dispersion_forces_are_slopes_of_the_energy(spark):
    """Forces and the trace of the virial against energies of moved atoms and grown cells, images and the switch included."""
    cell, atoms, step = [6, 0, 0, 0.5, 7, 0, 0, 0, 8], [(0.3, 0.2, 0.1, 1), (2.1, 1.4, 1.7, 2), (4.0, 5.0, 3.1, 1), (1.0, 3.2, 0.4, 2)], 1e-4
    moved = {k: [(x + (d if i == 1 else 0), y, z, e) for i, (x, y, z, e) in enumerate(atoms)] for k, d in ((1, 0), (2, step), (3, -step))}
    grown = {k: 1 + d for k, d in ((4, step), (5, -step))}
    moved |= {k: [(x * g, y * g, z * g, e) for x, y, z, e in atoms] for k, g in grown.items()}
    s = spark.createDataFrame([(k, [c * grown.get(k, 1.0) for c in map(float, cell)], [True] * 3) for k in moved], "system_id long, cell array<double>, pbc array<boolean>")
    a = spark.createDataFrame([(k, i, *map(float, p[:3]), p[3]) for k, ps in moved.items() for i, p in enumerate(ps)], "system_id long, atom_id long, x double, y double, z_pos double, z int")
    elements = spark.createDataFrame([(1, 0.8, 2.0), (2, 1.1, 2.6)], "z int, rcov double, r4r2 double")
    grid = spark.createDataFrame([(i, j, ci, cj, (i + j) * (5.0 + 3 * ci + 3 * cj)) for i in (1, 2) for j in (1, 2) for ci in (0.0, 1.0, 2.0) for cj in (0.0, 1.0, 2.0)], "zi int, zj int, cni double, cnj double, c6 double")
    p = N.neighbor_pairs(StructureSet(s, a), 5.5)
    d3 = lambda out: E.dispersion_d3(p, a, elements, grid, a2=2.0, switch=(3.0, 5.4), out=out)
    e = {r["system_id"]: r["energy"] for r in d3("energy").collect()}
    f = {r["atom_id"]: r for r in d3("forces").filter("system_id = 1").collect()}
    assert abs(f[1]["fx"]) > 1e-3 and f[1]["fx"] == pytest.approx(-(e[2] - e[3]) / (2 * step), rel=1e-5)
    assert sum(r["fy"] for r in f.values()) == pytest.approx(0, abs=1e-12)
    w = d3("virial").filter("system_id = 1").collect()[0]["virial"]
    assert w[0] + w[4] + w[8] == pytest.approx(-(e[4] - e[5]) / (2 * step), rel=1e-5)
    per_atom = {r["system_id"]: r["e"] for r in d3("atom_energy").groupBy("system_id").agg(F.sum("energy").alias("e")).collect()}
    assert per_atom == pytest.approx(e)


def test_inflight_replaces_what_has_converged(spark):
    """Two micro-batches: converged systems leave, others of the pool take their room, none is admitted twice, a repeated batch changes nothing."""
    from lodestruct.streaming import monitors as SM

    frame = lambda rows: spark.createDataFrame(rows, "system_id long, shard long, fmax double")
    sizes = spark.createDataFrame([(k, 4, 0) for k in range(1, 13)], "system_id long, num_atoms long, num_edges long")
    pool = G.size_bins(sizes.filter("system_id > 3").withColumn("shard", F.col("system_id") % 2), 100)
    graduated, admitted = (sinks.Sink(spark, folder(spark, n)) for n in ("graduated", "admitted"))
    source, marks = folder(spark, "inflight"), folder(spark, "marks")
    frame([(1, 0, 0.5), (2, 0, 0.01), (3, 1, 0.02)]).coalesce(1).write.parquet(source)
    schema = "system_id long, shard long, fmax double"

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = SM.inflight(stream, pool, graduated, admitted, {"fmax": (F.col("fmax"), "max", 0.05)}, (12, 10, 3), sizes).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r[0] for r in graduated.read().select("system_id").collect()), sorted((r["shard"], r["system_id"]) for r in admitted.read().collect())

    # shard 0 keeps one system and has room for two, shard 1 is empty and has room for three
    assert go() == ([2, 3], [(0, 4), (0, 6), (1, 5), (1, 7), (1, 9)])
    frame([(1, 0, 0.04), (4, 0, 0.3), (6, 0, 0.2), (5, 1, 0.01), (7, 1, 0.6), (9, 1, 0.7)]).coalesce(1).write.mode("append").parquet(source)
    after = ([1, 2, 3, 5], [(0, 4), (0, 6), (0, 8), (1, 5), (1, 7), (1, 9), (1, 11)])
    assert go() == after
    for name in ("1", ".1.crc"):  # as if the driver had been lost before the second batch was marked as done
        os.remove(os.path.join(marks.removeprefix("file:"), "commits", name))
    assert go() == after
