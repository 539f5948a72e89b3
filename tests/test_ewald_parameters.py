"""Ewald sums with parameters of each system."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from lodestruct.operators import pairs as E
from lodestruct.structures import StructureSet


@pytest.fixture(scope="module")
def crystal(spark):
    """Rock salt of edge 4 (two orientations of a primitive cell are one system each), a skew cell, one charged atom, and a system without atoms."""
    cells = {1: (4.0, 0, 0, 0, 4.0, 0, 0, 0, 4.0), 2: (5.0, 0, 0, 1.0, 6.0, 0, 0.5, -0.7, 7.0), 3: (6.0, 0, 0, 0, 5.0, 0, 0, 0, 7.0), 4: (3.0, 0, 0, 0, 3.0, 0, 0, 0, 3.0)}
    at = [(1, 2.0 * a, 2.0 * b, 2.0 * c, (-1.0) ** (a + b + c)) for a, b, c in itertools.product((0, 1), repeat=3)]
    at += [(2, 0.3, 0.1, 0.2, 1.0), (2, 2.0, 3.0, 1.5, -2.0), (2, 4.4, 1.0, 6.0, 1.0), (3, 1.0, 1.0, 1.0, 1.0)]
    systems = spark.createDataFrame([(k, [float(x) for x in c], [True] * 3) for k, c in cells.items()], "system_id long, cell array<double>, pbc array<boolean>")
    rows, n = [], {}
    for s, x, y, z, q in at:
        rows.append((s, n.setdefault(s, 0), x, y, z, q))
        n[s] += 1
    return StructureSet(systems, spark.createDataFrame(rows, "system_id long, atom_id long, x double, y double, z_pos double, q double"))


def energies(df):
    return {r["system_id"]: r["energy"] for r in df.collect()}


def test_energy_does_not_depend_on_parameters(crystal):
    want = energies(E.ewald(crystal, None, E.ewald_parameters(crystal, 1e-8)))
    assert set(want) == {1, 2, 3}
    # Madelung constant of rock salt: four pairs of ions at a distance of 2
    assert abs(want[1] - 4 * -1.7475645946 / 2.0) < 1e-5
    # one charge with its background: -2.837297 / (2 L) for a cube
    for eps, alpha in ((1e-8, 0.5), (1e-8, 0.9), (1e-9, None)):
        got = energies(E.ewald(crystal, None, E.ewald_parameters(crystal, eps, alpha)))
        assert all(abs(got[s] - want[s]) < 1e-5 for s in want), (eps, alpha)


def test_parameters_of_each_system(crystal):
    mixed = crystal.with_(systems=crystal.systems.withColumn("own", F.when(F.col("system_id") == 2, 0.6)))
    p = {r["system_id"]: r for r in E.ewald_parameters(mixed, 1e-8, "own").collect()}
    assert abs(p[2]["alpha"] - 0.6) < 1e-12 and abs(p[2]["r_cutoff"] - math.sqrt(-math.log(1e-8)) / 0.6) < 1e-9 and abs(p[1]["alpha"] - 0.6) > 0.01
    want, got = energies(E.ewald(crystal, None, E.ewald_parameters(crystal, 1e-8))), energies(E.ewald(mixed, None, E.ewald_parameters(mixed, 1e-8, "own")))
    assert all(abs(got[s] - want[s]) < 1e-5 for s in want)
    half = energies(E.ewald(mixed, None, E.ewald_parameters(mixed, 1e-8, "own"), half=True))
    assert all(abs(got[s] - half[s]) < 1e-9 for s in want)


def test_large_systems_by_structure_factors(crystal, monkeypatch):
    own = E.ewald_parameters(crystal, 1e-8)
    want = energies(E.ewald_recip(crystal, own))
    rows = lambda out: {tuple(r[: 2 if out == "forces" else 1]): r[2:] if out == "forces" else tuple(r[1]) for r in E.ewald_recip(crystal, own, out=out).collect()}
    others = {out: rows(out) for out in ("forces", "virial")}
    monkeypatch.setattr(E, "FEW", 4)
    for out, have in others.items():
        again = rows(out)
        assert set(again) == set(have) and all(again[k] == pytest.approx(have[k], abs=1e-9) for k in have)
    for few in (0, 4):  # all, or all but the small ones
        monkeypatch.setattr(E, "FEW", few)
        assert energies(E.ewald_recip(crystal, own)) == pytest.approx(want)
        assert energies(E.ewald_recip(crystal, 0.5, bounds=(2, 3, 1))) == pytest.approx(_bounded(crystal, monkeypatch))


def _bounded(crystal, monkeypatch):
    before = E.FEW
    monkeypatch.setattr(E, "FEW", 512)
    found = energies(E.ewald_recip(crystal, 0.5, bounds=(2, 3, 1)))
    monkeypatch.setattr(E, "FEW", before)
    return found


def test_forces_and_virial_by_system(crystal):
    own = E.ewald_parameters(crystal, 1e-8)
    moved, h = [], 1e-4
    for sign in (1, -1):
        step = crystal.with_(atoms=crystal.atoms.withColumn("x", F.col("x") + F.when(F.col("atom_id") == 0, sign * h).otherwise(0.0)))
        moved.append(energies(E.ewald_recip(step, own)))
    f = {r["system_id"]: r["fx"] for r in E.ewald_recip(crystal, own, out="forces").filter("atom_id = 0").collect()}
    assert all(abs(f[s] + (moved[0][s] - moved[1][s]) / (2 * h)) < 1e-5 for s in f)
    assert E.ewald_recip(crystal, own, out="virial").count() == 3
    with pytest.raises(ValueError):
        E.ewald(crystal, None, 0.4, k_cutoff=2.0)
