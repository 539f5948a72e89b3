"""Streams with nulls, late records, silent systems and a restart, against the batch operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestruct.operators import monitors as H
from lodestruct.plans.common import folder
from lodestruct.streaming import monitors as S

SCHEMA = "system_id long, ts timestamp, step long, stage string, energy double"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


class Run:
    """Batches given one after another to a stream that stops and starts again from its checkpoint before each."""

    def __init__(self, spark, make):
        self.spark, self.make = spark, make
        self.source, self.out, self.marks = (folder(spark, n) for n in ("source", "out", "marks"))

    def feed(self, rows):
        self.spark.createDataFrame([(s, None if t is None else at(t), k, g, e) for s, t, k, g, e in rows], SCHEMA).coalesce(1).write.mode("append").parquet(self.source)
        stream = self.spark.readStream.schema(SCHEMA).parquet(self.source)
        q = self.make(stream).writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.marks).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, self.spark.read.parquet(self.out).collect()), key=repr)


def test_drift_with_nulls_and_a_restart(spark):
    run = Run(spark, lambda s: S.energy_drift_stream(s, "10 minutes"))
    rows = [(1, 5, 2, "b", 4.0), (1, None, 0, "x", 1.0), (1, 1, 1, "a", 2.0), (2, 3, None, "a", 7.0), (2, 4, 1, None, None), (2, 6, 1 << 60, "c", 9.5), (None, 2, 1, "n", 3.0), (3, 1, 1, "a", None), (3, 2, 2, "b", 5.0)]
    assert run.feed(rows[:4]) == []
    run.feed(rows[4:])
    assert run.feed([(1, 2, 5, "late, but in time", 3.5), (1, 300, 9, "end", 8.0)]) and run.feed([(9, 900, 0, "end", 0.0)])
    got = run.feed([(9, 901, 0, "end", 0.0)])
    want = [(1, 1, 0.0), (1, 2, 2.0), (1, 5, 1.5), (1, 9, 6.0), (2, None, 0.0), (2, 1, None), (2, 1 << 60, 2.5), (None, 1, 0.0), (3, 1, None), (3, 2, None)]
    assert got == sorted(want, key=repr)


def test_stages_and_first_record(spark):
    rows = [(1, 3, 3, "c", 1.0), (1, 1, 1, "a", 9.0), (1, 2, 2, None, 2.0), (2, 1, 1, "a", 0.5)]
    run = Run(spark, lambda s: S.stage_timing_stream(s, "1 minute"))
    run.feed(rows)
    run.feed([(9, 500, 0, "end", 0.0)])
    assert run.feed([(9, 501, 0, "end", 0.0)]) == [(1, "->c", 60.0), (1, "a->", 60.0)]
    run = Run(spark, lambda s: S.first_converged_stream(s, F.col("energy") <= 5, "1 minute"))
    run.feed(rows)
    run.feed([(9, 500, 0, "end", 10.0), (8, 500, 0, "end", 1.0)])
    assert [r for r in run.feed([(9, 501, 0, "end", 0.0)]) if r[0] < 8] == [(1, 2, 2.0), (2, 1, 0.5)]


def test_silent_systems_are_forgotten(spark):
    run = Run(spark, lambda s: S.energy_drift_stream(s, "1 minute", ttl_ms=60 * 60 * 1000))
    run.feed([(1, 1, 1, "a", 1.0), (2, 1, 1, "a", 1.0), (2, 59, 2, "b", 2.0)])
    run.feed([(9, 90, 0, "end", 0.0)])  # 1 has been silent for its time, 2 has not
    run.feed([(9, 91, 0, "end", 0.0)])
    run.feed([(1, 95, 2, "b", 5.0), (2, 95, 3, "c", 5.0)])
    run.feed([(9, 200, 0, "end", 0.0)])
    got = [r for r in run.feed([(9, 201, 0, "end", 0.0)]) if r[0] != 9]
    assert got == [(1, 1, 0.0), (1, 2, 0.0), (2, 1, 0.0), (2, 2, 1.0), (2, 3, 4.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_the_batch_operator(spark, seed):
    import random

    rnd = random.Random(seed)
    rows = [(s, t, t, f"g{rnd.randint(0, 2)}", rnd.choice([None, 1.0, 2.5, 9.0])) for s in range(6) for t in rnd.sample(range(120), 20)]
    rnd.shuffle(rows)
    run = Run(spark, lambda s: S.energy_drift_stream(s, "200 minutes"))
    for k in range(0, len(rows), 40):
        run.feed(rows[k : k + 40])
    run.feed([(99, 1000, 0, "end", 0.0)])
    got = [r for r in run.feed([(99, 1001, 0, "end", 0.0)]) if r[0] != 99]
    traj = spark.createDataFrame([(s, t, e) for s, t, _, _, e in rows], "system_id long, step long, energy double")
    assert got == sorted(map(tuple, H.drift(traj).collect()), key=repr)
