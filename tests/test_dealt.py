"""What a task holds does not grow by exchanges whose tasks are put together."""

from pyspark.sql import functions as F

from lodestruct.functions.order import running_sum
from lodestruct.operators import structures as O
from lodestruct.structures import StructureSet

DEALT = "REPARTITION_BY_NUM"


def test_running_sums_are_dealt_by_number(spark):
    rows = spark.createDataFrame([(g, k, k % 7) for g in range(3) for k in range(0, 400_000, 1_111)], "g int, k long, v long")
    got = running_sum(rows, "k", {"s": F.col("v")}, by=("g",))
    assert DEALT in got._jdf.queryExecution().executedPlan().toString()
    want, total = {}, 0
    for k in range(0, 400_000, 1_111):
        want[k], total = total, total + k % 7
    assert {(r["g"], r["k"]): r["s"] for r in got.collect()} == {(g, k): s for g in range(3) for k, s in want.items()}


def test_concatenated_sets_are_dealt_by_number(spark):
    one = lambda n: StructureSet(spark.range(n).selectExpr("id * 3 AS system_id"), spark.range(2 * n).selectExpr("(id div 2) * 3 AS system_id", "id % 2 AS atom_id"))
    got = O.concat_all([one(4), one(3)]).atoms
    assert DEALT in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(s, a) for s in range(7) for a in range(2)]


def test_a_store_round_trip_keeps_its_view_once(spark, sf, monkeypatch):
    from lodestruct.plans import data

    kept, levels = [], []
    real = StructureSet.persist
    monkeypatch.setattr(StructureSet, "persist", lambda ss: kept.append(1) or levels.append(real(ss)) or levels[-1])
    assert data.store_round_trip(spark, sf).count() > 0
    assert kept == [1] and not levels[0].atoms.is_cached
