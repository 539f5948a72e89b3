"""Pairs of small systems come from a row each, and are those of the joins."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestruct.operators import neighbors as N
from lodestruct.operators import small
from lodestruct.structures import StructureSet

ATOMS = "system_id long, atom_id long, x double, y double, z_pos double, q double, z int"


def _structures(spark):
    rng = random.Random(5)
    cells = [[9.0, 0, 0, 0, 5.0, 0, 0, 0, 4.0], [6.0, 0, 0, 2.0, 5.0, 0, 1.0, -1.5, 4.0], [1.5, 0, 0, 0, 1.5, 0, 0, 0, 1.5], [30.0, 0, 0, 0, 30.0, 0, 0, 0, 30.0], None, [6.0, 0, 0, 0, 6.0, 0, 0, 0, 6.0]]
    systems = [(k, cell and [float(x) for x in cell], pbc) for k, (cell, pbc) in enumerate(zip(cells, [[True] * 3, [True, False, True], [True] * 3, [False] * 3, [True] * 3, None]))]
    systems.append((6, systems[5][1], [True, None, True]))
    atoms = [(k, a, *[rng.uniform(-12, 12) for _ in range(3)], rng.uniform(-1, 1), rng.randrange(1, 9)) for k in range(7) for a in range(1 + 3 * k % 10)]
    atoms += [(0, 50, None, 1.0, 1.0, 1.0, 1), (0, 51, float("nan"), 1.0, 1.0, 1.0, 1), (1, 0, 0.5, 0.5, 0.5, None, None), (1, None, 0.6, 0.5, 0.5, 1.0, 2), (None, 0, 0.0, 0.0, 0.0, 1.0, 1)]
    return StructureSet(spark.createDataFrame(systems, "system_id long, cell array<double>, pbc array<boolean>"), spark.createDataFrame(atoms, ATOMS))


def _rows(df):
    return sorted((tuple(r) for r in df.select(*N.PAIR, *N.GEOMETRY, "i_q", "j_q", "i_z", "j_z").collect()), key=repr)


def test_same_pairs_as_the_joins(spark):
    ss = _structures(spark)
    targets = ss.atoms.filter("z > 4").select("system_id", "atom_id")
    for method, half, aim in (("naive", False, None), ("grid", False, None), ("naive", True, None), ("grid", True, targets)):
        want = _rows(N._joined(ss, 3.3, half, ("q", "z"), method, aim))
        got = N.neighbor_pairs(ss, 3.3, half=half, method=method, targets=aim, carry=("q", "z"))
        assert got.dtypes == N._joined(ss, 3.3, half, ("q", "z"), method, aim).dtypes
        assert _rows(got) == want and want


def test_no_row_for_every_image_is_planned(spark):
    ss = _structures(spark)
    for method in (None, "grid"):
        plan = N.neighbor_pairs(ss, 3.3, method=method)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan


def test_cut_slices(spark, monkeypatch):
    monkeypatch.setattr(small, "STEP", 3)
    got = [(o.tolist(), p.tolist()) for o, p in small._slices(np.array([2, 0, 5, 1]))]
    assert got == [([0, 0, 2], [0, 1, 0]), ([2, 2, 2], [1, 2, 3]), ([2, 3], [4, 0])]


def test_a_large_system_among_small_ones(spark, monkeypatch):
    ss = _structures(spark)
    monkeypatch.setattr(N, "SMALL", 5)
    got = N.neighbor_pairs(ss, 3.3, carry=("q", "z"))
    assert _rows(got.withColumns({c: F.round(c, 9) for c in ("dx", "dy", "dz", "r")})) == _rows(N._joined(ss, 3.3, False, ("q", "z"), "naive", None).withColumns({c: F.round(c, 9) for c in ("dx", "dy", "dz", "r")}))
