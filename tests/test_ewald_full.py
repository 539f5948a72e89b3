"""The reciprocal sum over all vectors that count, against brute force on a wider box."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from lodestruct.plans import registry
from lodestruct.sources import views


def test_ewald_full(spark, sf, tmp_path):
    few = [r[0] for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().orderBy("l_orderkey").limit(6).collect()]
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        spark.read.parquet(f"{sf}/{name}.parquet").filter(F.col(key).isin(few)).write.parquet(f"{tmp_path}/{name}.parquet")
    d = str(tmp_path)
    q = registry.queries()
    recip = {r["system_id"]: r["energy"] for r in q["ewald_recip_full"](spark, d).collect()}
    total = {r["system_id"]: r["energy"] for r in q["ewald_energy_full"](spark, d).collect()}
    real = {r["system_id"]: r["energy"] for r in q["ewald_real"](spark, d).collect()}
    by = {}
    for r in views.atoms(spark, d).collect():
        by.setdefault(r["system_id"], []).append((r["q"], r["x"], r["y"], r["z_pos"]))
    vectors = np.array([v for v in itertools.product(range(-26, 27), range(-6, 7), range(-5, 6)) if any(v)])
    k = 2 * np.pi * vectors / np.array(views.CELL)
    k2, volume, alpha = (k * k).sum(axis=1), np.prod(views.CELL), 0.35
    assert set(recip) == set(by) and any(recip.values())
    for s, atoms in by.items():
        a = np.array(atoms, float)
        factor = (a[:, 0] * np.exp(1j * (k @ a[:, 1:].T))).sum(axis=1)
        want = (2 * np.pi / volume * np.exp(-k2 / (4 * alpha**2)) / k2 * abs(factor) ** 2).sum()
        assert abs(recip[s] - want) < 1e-5
        self_energy = -alpha / np.sqrt(np.pi) * (a[:, 0] ** 2).sum() - np.pi / (2 * alpha**2 * volume) * a[:, 0].sum() ** 2
        assert abs(total[s] - (real.get(s, 0) + want + self_energy)) < 2e-5
    found = q["k_vectors_full"](spark, d).groupBy("system_id").count().collect()
    assert {r["count"] for r in found} == {(43 * 9 * 7 - 1) // 2}
    one = q["structure_factor_full"](spark, d).filter("h = 21 and k = -4 and l = 3").collect()
    assert {r["system_id"] for r in one} == set(by)
    for r in one:
        a = np.array(by[r["system_id"]], float)
        want = (a[:, 0] * np.exp(2j * np.pi * (a[:, 1:] / np.array(views.CELL)) @ np.array([21, -4, 3]))).sum()
        assert abs(complex(r["re"], r["im"]) - want) < 2e-6
