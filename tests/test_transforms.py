"""Chains of steps of samples and of batches."""

import pytest
from pyspark.sql import functions as F

from lodestruct.operators import transforms as T
from lodestruct.structures import FORCE, StructureSet


@pytest.fixture
def small(spark):
    systems = spark.createDataFrame([(1, 10.0), (2, 30.0), (3, None), (4, 5.0), (5, 7.0)], "system_id long, energy double")
    atoms = spark.createDataFrame(
        [(1, 0, 3.0, 4.0, 0.0), (1, 1, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 5.0), (3, 0, None, 1.0, 1.0), (4, 0, 0.0, 0.0, 0.0), (5, 0, 1.0, 1.0, 1.0)],
        "system_id long, atom_id long, fx double, fy double, fz double",
    )
    edges = spark.createDataFrame([(1, 0, 1), (5, 0, 0)], "system_id long, i long, j long")
    return StructureSet(systems, atoms, edges)


@pytest.fixture
def batched(spark, small):
    return T.with_batches(small, spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, None)], "system_id long, batch_id long"))


def plus(n):
    return lambda ss: ss.with_(systems=ss.systems.withColumn("energy", F.col("energy") + n))


def times(n):
    return lambda ss: ss.with_(systems=ss.systems.withColumn("energy", F.col("energy") * n))


def energies(ss):
    return dict(ss.systems.select("system_id", "energy").collect())


def test_order_and_identity(small):
    assert T.Transforms()(small) is small and small.transform() is small
    assert energies(small.transform(plus(1), times(2)))[1] == 22.0
    assert energies(small.transform(times(2), plus(1)))[1] == 21.0
    assert energies(T.Transforms([T.Transforms([plus(1)]), times(2)])(small))[4] == 12.0


def test_kinds():
    sample, batch = T.sample_step(plus(1)), T.batch_step(plus(1))
    assert T.Transforms().kind == T.Transforms([plus(1)]).kind == T.Transforms([plus(1), sample]).kind == "sample"
    assert T.Transforms([plus(1), batch]).kind == "batch"
    assert T.Transforms([T.Transforms([plus(1)]), batch]).kind == "batch"  # a chain without marks takes the others' kind
    with pytest.raises(TypeError, match="step 0 is of samples, step 2 of batches"):
        T.Transforms([sample, plus(1), batch])
    with pytest.raises(TypeError, match="do not mix"):
        T.Transforms([T.Transforms([batch]), sample])
    with pytest.raises(TypeError, match="step 1 cannot be called"):
        T.Transforms([sample, 3])
    with pytest.raises(TypeError, match="unknown kind"):
        T.Transforms([T.Step(plus(1), "other")])


def test_steps_that_fail_tell_their_number(small, batched):
    with pytest.raises(RuntimeError, match="step 1 failed") as e:
        small.transform(plus(1), lambda ss: ss.with_(systems=ss.systems.select("no_such")))
    assert e.value.__cause__ is not None
    with pytest.raises(RuntimeError, match="step 0 failed: a step gives a StructureSet"):
        small.transform(lambda ss: ss.systems)
    with pytest.raises(RuntimeError, match="lost batch_id"):
        batched.transform(T.batch_step(lambda ss: ss.with_(systems=ss.systems.drop("batch_id"))))
    with pytest.raises(ValueError, match="batch_id"):
        small.transform(T.less_batch_mean("energy"))


def test_batches_keep_only_what_is_in_one(batched):
    assert sorted(energies(batched)) == [1, 2, 3, 4]
    assert batched.atoms.count() == 5 and [r.system_id for r in batched.edges.collect()] == [1]


def test_batch_steps(batched):
    out = batched.transform(T.less_batch_mean("energy"), T.over_batch_rms(*FORCE))
    assert energies(out) == {1: -10.0, 2: 10.0, 3: None, 4: 0.0}
    root = (50 / 3) ** 0.5  # three whole vectors in batch 0; the root of batch 1 is 0
    got = {(r.system_id, r.atom_id): (r.fx, r.fy, r.fz) for r in out.atoms.collect()}
    assert got[1, 0] == pytest.approx((3 / root, 4 / root, 0)) and got[2, 0] == pytest.approx((0, 0, 5 / root))
    assert got[3, 0] == (None, pytest.approx(1 / root), pytest.approx(1 / root)) and got[4, 0] == (0, 0, 0)
    assert out.atoms.columns == batched.atoms.columns


def test_empty(spark, batched):
    none = batched.map(lambda df: df.limit(0))
    out = none.transform(T.less_batch_mean("energy"), T.over_batch_rms(*FORCE))
    assert out.systems.count() == out.atoms.count() == 0
