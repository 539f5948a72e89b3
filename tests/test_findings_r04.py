"""Cases of the review of round 4."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestruct.operators import neighbors as N
from lodestruct.operators import pairs as E
from lodestruct.operators import small
from lodestruct.plans import registry
from lodestruct.structures import StructureSet


def _total(rows):
    total = 0.0
    for quantity, price in rows:
        total += price / 1000 * quantity
    return total


def test_voigt_adds_by_atom_id_whatever_comes_first(spark, sf, tmp_path):
    rng, found = random.Random(1), None
    while not found:  # lines whose sum is a half that is rounded up in one order and down in another
        rows = [(float(rng.randrange(1, 51)), rng.randrange(90_000, 10_000_000) / 100) for _ in range(4)]
        cents = sum(round(p * 100) * int(q) for q, p in rows)
        rows.append((1.0, (200_150_000 - cents % 100_000) / 100))
        ways = {round(_total(w)): w for w in itertools.permutations(rows)}
        found = list(ways.values()) if len(ways) == 2 else None
    orders, lines = (spark.read.parquet(f"{sf}/{t}.parquet").limit(1) for t in ("orders", "lineitem"))
    orders.crossJoin(spark.range(2).withColumnRenamed("id", "k")).withColumn("o_orderkey", F.col("k")).drop("k").write.parquet(f"{tmp_path}/orders.parquet")
    # written in an order that rounds to another number than that of the line numbers does
    numbered = [(k, found[k].index(line) + 1, *line) for k in (0, 1) for line in found[1 - k]]
    made = spark.createDataFrame(numbered, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double").coalesce(1)
    made.crossJoin(lines.drop("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["system_id"]: r["stress"] for r in registry.queries()["voigt"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == dict(c.execute(registry.oracle_sql()["voigt"]).fetchall())
    assert [int(got[k].split(",")[0]) for k in (0, 1)] == [round(_total(found[k])) for k in (0, 1)]


def _dispersed(spark):
    """Systems of several cells, one without; atoms without a place or an id, and of elements that a table lacks."""
    rng = random.Random(3)
    cells = [[9.0, 0, 0, 0, 5.0, 0, 0, 0, 4.0], [6.0, 0, 0, 2.0, 5.0, 0, 1.0, -1.5, 4.0], [1.5, 0, 0, 0, 1.5, 0, 0, 0, 1.5], None, [30.0, 0, 0, 0, 30.0, 0, 0, 0, 30.0]]
    systems = [(k, cell and [float(x) for x in cell], [k != 4] * 3) for k, cell in enumerate(cells)]
    atoms = [(k, a, *[rng.uniform(-6, 6) for _ in range(3)], rng.randrange(1, 5)) for k in range(5) for a in range(2 + 3 * k)]
    atoms += [(0, 50, None, 1.0, 1.0, 1), (0, 51, 1.0, 1.0, 1.0, None), (1, None, 0.5, 0.5, 0.5, 1), (1, 60, 0.7, 0.5, 0.5, 9), (1, 61, 0.7, 0.5, 0.5, 1)]
    ss = StructureSet(spark.createDataFrame(systems, "system_id long, cell array<double>, pbc array<boolean>"), spark.createDataFrame(atoms, "system_id long, atom_id long, x double, y double, z_pos double, z int"))
    elements = spark.createDataFrame([(z, 0.7 + 0.1 * z, 2.0 + 0.1 * z) for z in (1, 2, 3)], "z int, rcov double, r4r2 double")
    points = [(i, j, ci, cj, (i + j) * (2.0 + ci + 2 * cj)) for i in range(1, 5) for j in range(1, 5) for ci in (0.0, 1.5, 2.5)[:i] for cj in (0.0, 1.5, 2.5)[:j] if {i, j} != {1, 3}]
    return ss, elements, spark.createDataFrame(points, "zi int, zj int, cni double, cnj double, c6 double")


@pytest.mark.parametrize("out, keys", [("energy", 1), ("atom_energy", 2), ("forces", 2), ("virial", 1)])
def test_dispersion_in_a_row_each(spark, monkeypatch, out, keys):
    ss, elements, grid = _dispersed(spark)
    by_pairs = E.dispersion_d3(N.neighbor_pairs(ss, 3.3, carry=("z",)), ss.atoms, elements, grid, a2=2.0, switch=(2.0, 3.2), out=out)
    flat = lambda df: {tuple(r[:keys]): [x for v in r[keys:] for x in (v if isinstance(v, list) else [v])] for r in df.collect()}
    want = flat(by_pairs)
    assert want and set(map(type, next(iter(want.values())))) == {float}
    for step, few in ((small.STEP, 512), (4, 512), (small.STEP, 5)):  # pairs kept, found again for each step, and larger systems by pairs
        monkeypatch.setattr(small, "STEP", step)
        monkeypatch.setattr(E, "FEW", few)
        found = E.dispersion(ss, 3.3, elements, grid, a2=2.0, switch=(2.0, 3.2), out=out)
        assert found.dtypes == by_pairs.dtypes
        got = flat(found)
        assert set(got) == set(want)
        for k, v in want.items():
            assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-12), k


@pytest.mark.parametrize("name", ["dispersion_forces", "dispersion_virial", "dispersion_d3"])
def test_dispersion_queries_join_no_pairs(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("MapInArrow") == 1  # systems with their atoms, and nothing after


def _vectors(df):
    rows = sorted(map(tuple, df.collect()), key=repr)
    return [r[:4] for r in rows], [x for r in rows for x in r[4:]]


def test_vectors_of_shared_cells_pass_no_python(spark, sf, monkeypatch):
    cube, skew, flat = [4.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 4.0], [5.0, 0.0, 0.0, 1.0, 6.0, 0.0, 0.5, -1.0, 4.0], [4.0, 0.0, 0.0, 0.0, 4.0, 0.0, 4.0, 0.0, 0.0]
    rows = [(1, cube, 4.0), (2, skew, 4.0), (3, cube, 4.0), (4, None, 4.0), (5, cube, None), (6, flat, 4.0), (7, skew, 2.5), (None, cube, 4.0), (9, [None, *cube[1:]], 4.0), (10, cube, 0.1)]
    s = spark.createDataFrame(rows, "system_id long, cell array<double>, reach double")
    ways = [{"k_cutoff": "reach"}, {"k_cutoff": 3.0, "digits": 9}, {"bounds": (2, 1, 0)}]
    shared = [E.k_vectors(s, **w) for w in ways]
    for name, value in (("SHARED", 3), ("CELLS", 0)):
        with monkeypatch.context() as m:
            m.setattr(small, name, value)
            for got, way in zip(shared, ways):
                want = E.k_vectors(s, **way)
                assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString() and "MapInArrow" in want._jdf.queryExecution().optimizedPlan().toString()
                assert got.dtypes == want.dtypes
                (keys, values), (wanted, numbers) = _vectors(got), _vectors(want)
                assert keys == wanted and keys and values == numbers
    plan = registry.queries()["k_vectors_full"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "REPARTITION" in registry.queries()["k_vectors_full"](spark, sf)._jdf.queryExecution().executedPlan().toString()
