"""Cases of the review of round 3."""

import pytest
from pyspark.sql import functions as F

from lodestruct.operators import pairs as E
from lodestruct.plans import registry
from lodestruct.structures import StructureSet


def odd(spark):
    """Systems whose atoms lack a place or a charge, or lie outside the cell; one system has no cell, one no atom with a charge."""
    skew, cube = [5.0, 0.0, 0.0, 1.0, 6.0, 0.0, 0.5, -1.0, 4.0], [4.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 4.0]
    s = spark.createDataFrame([(1, skew), (2, cube), (3, None), (4, cube), (5, cube)], "system_id long, cell array<double>")
    a = [(1, 0, 0.1, 0.2, 0.3, 1.0, 2.0), (1, 1, -7.5, 9.25, 3.0, -1.0, 1.0), (1, 2, 2.0, 2.0, 2.0, None, 3.0), (1, 3, None, 1.0, 1.0, 1.0, 1.0), (2, 0, 1.0, 2.0, 3.0, 1.0, 1.0), (2, 1, 1.0, 2.0, 3.0, -0.5, 1.0)]
    a += [(3, 0, 1.0, 1.0, 1.0, 1.0, 1.0), (4, 0, 1.5, 0.0, 0.0, None, 1.0), (9, 0, 1.5, 0.0, 0.0, 1.0, 1.0)]
    return StructureSet(s, spark.createDataFrame(a, "system_id long, atom_id int, x double, y double, z_pos double, q double, mass double"))


def close(got, want, keys):
    table = lambda df: {tuple(r[:keys]): tuple(r[keys:]) for r in df.collect()}
    a, b = table(got), table(want)
    assert got.columns == want.columns and set(a) == set(b)
    for k in a:
        assert [x is None for x in a[k]] == [x is None for x in b[k]], k
        assert [x or 0.0 for x in a[k]] == pytest.approx([x or 0.0 for x in b[k]], abs=1e-9), k


@pytest.mark.parametrize("dims, order", [((5, 4, 6), 4), ((3, 2, 7), 3), ((8, 8, 8), 1)])
def test_mesh_in_a_row_each(spark, monkeypatch, dims, order):
    ss, channels = odd(spark), ("q", "mass")
    made, back = E.spread(ss, dims, order, channels), E.through_mesh(ss, dims, order, channels, gradient=True)
    for df in (made, back):
        assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()  # no row for each atom and point
    monkeypatch.setattr(E, "FEW", 0)
    mesh = E.spread(ss, dims, order, channels)
    close(made, mesh, 4)
    close(back, E.gather(mesh, ss, dims, order, channels, gradient=True), 2)


def test_mesh_queries_shuffle_no_points(spark, sf):
    for name in ("mesh_gather", "mesh_gather_gradient", "mesh_spread"):
        assert "Generate" not in registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_factors_in_a_row_each(spark, monkeypatch):
    ss = odd(spark)
    few = E.structure_factors(ss, bounds=(2, 1, 3))
    assert "Join" in few._jdf.queryExecution().executedPlan().toString() and "Generate" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(E, "FEW", 0)
    close(few, E.structure_factors(ss, bounds=(2, 1, 3)), 4)
    # as many tasks as an exchange has, whatever the size of the file
    made = E.k_vectors(ss.systems.coalesce(1), 4.0, digits=9)
    assert made.rdd.getNumPartitions() >= 4
    assert made.groupBy("system_id").count().count() == 4


def test_voigt_rounds_halves_to_even(spark, sf, tmp_path):
    row = spark.read.parquet(f"{sf}/orders.parquet").limit(1)
    row.withColumn("o_orderkey", F.lit(1).cast("long")).write.parquet(f"{tmp_path}/orders.parquet")
    item = spark.read.parquet(f"{sf}/lineitem.parquet").limit(1).drop("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    four = spark.createDataFrame([(1, 1, 41.0, 82106.89), (1, 2, 19.0, 76942.08), (1, 3, 21.0, 66374.13), (1, 4, 9.0, 18040.14)], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double")
    four.crossJoin(item).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.queries()["voigt"](spark, str(tmp_path)).collect()
    assert [r["stress"].split(",")[0] for r in found] == ["6384"]  # the sum is 6384.5
