"""Monitors as streaming queries over records with an event time.

Records may arrive late and in any order. They wait in their system's state until the watermark has passed them, and are
then taken in order of time, so the results are those of the batch operators; records later than the delay are dropped
by Spark. A system that is silent for ``ttl_ms`` of event time is forgotten, which bounds the state.

A record without a time has no place in the order and is left out. Null values stay null: a null step or energy gives a null
in the result, and a null first energy makes every drift of its system null, as in the batch operator. Records without a
system are one system. Records of equal time are taken in order of their values, nulls first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.monitors import converged, observables
from ..operators.sampling import refill
from ..sources.sinks import Sink

#: One step of a monitor: what it knows of a system (None at first) and the next record (time in microseconds, values) give the new knowledge and an output row or None.
Step = Callable[[tuple | None, tuple], tuple[tuple, tuple | None]]
DAY_MS = 24 * 3600 * 1000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Of each system: a list of the records that wait, a value for what the monitor knows, and one timer at a time.

    The timer stands at the first waiting record, or, when none waits, where the system has been silent for too long. An
    arriving record is appended without reading the others; they are read when the watermark has passed the timer.
    """

    def __init__(self, values: T.StructType, step: Step, known: str, names: Sequence[str], ttl_ms: int) -> None:
        self.values, self.step, self.schema, self.names, self.ttl_ms = values, step, known, list(names), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("us", T.LongType()), *self.values]))
        self.known = handle.getValueState("known", self.schema)
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int, sooner: bool = False) -> None:
        old = self.timer.get()[0] if self.timer.exists() else None
        if old == at or sooner and old is not None and old <= at and self.waits:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.waits, first = self.waiting.exists(), None
        for f in rows:
            columns = [f["us"].tolist()]
            for c in self.values.names:
                columns.append([None if gone else v for v, gone in zip(f[c].tolist(), f[f"{c}_null"].tolist())])
            records = list(zip(*columns))
            self.waiting.appendList(records)
            first = min([first or records[0][0], *columns[0]])
        if first is not None:
            self._wake(max(timerValues.getCurrentWatermarkInMs() + 1, -(-first // 1000)), sooner=True)
        yield self._frame([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        records = sorted(self.waiting.get(), key=lambda r: [(v is not None, v if v is not None else 0) for v in r]) if self.waiting.exists() else []
        ready = [tuple(r) for r in records if r[0] <= mark * 1000]
        later = [tuple(r) for r in records[len(ready) :]]
        known, out = (tuple(self.known.get()) if self.known.exists() else None), []
        if not records:
            self.known.clear()  # silent for too long
        for record in ready:
            known, row = self.step(known, record)
            if row is not None:
                out.append((key[0], *row))
        if ready:
            self.known.update(known)
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if records:
            self._wake(max(mark + 1, -(-later[0][0] // 1000) if later else ready[-1][0] // 1000 + self.ttl_ms))
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.names, dtype=object)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, values: Sequence[str], step: Step, known: str, schema: str, delay: str, ttl_ms: int = 7 * DAY_MS) -> DataFrame:
    """Rows (system_id, ...) of ``schema`` that ``step`` gives for each system's records (system_id, ts, values) in order of ts, then of values.

    ``known`` is the schema of what a step knows. The state lies in Spark's RocksDB store, which this sets for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kinds = T.StructType([T.StructField(c, stream.schema[c].dataType) for c in values])
    names = ["system_id", *[c.strip().split()[0] for c in schema.split(",")][1:]]
    nothing = {c: F.lit("" if isinstance(stream.schema[c].dataType, T.StringType) else 0).cast(stream.schema[c].dataType) for c in values}
    flat = [x for c in values for x in (F.coalesce(c, nothing[c]).alias(c), F.col(c).isNull().alias(f"{c}_null"))]
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).filter("ts is not null").withWatermark("ts", delay).select("system_id", "ts", F.unix_micros("ts").alias("us"), *flat)
    return timed.groupBy("system_id").transformWithStateInPandas(InOrder(kinds, step, known, names, ttl_ms), schema, "append", "eventTime")


def energy_drift_stream(stream: DataFrame, delay: str, **how) -> DataFrame:
    """(system_id, step, drift) of a stream of (system_id, ts, step, energy): distance from the energy of the system's first record."""
    def step(known: tuple | None, record: tuple) -> tuple[tuple, tuple]:
        _, at, energy = record
        known = known or (True, energy)
        return known, (at, None if energy is None or known[1] is None else abs(energy - known[1]))

    typed = stream.withColumns({"energy": F.col("energy").cast("double"), "step": F.col("step").cast("long")})
    return in_order(typed, ["step", "energy"], step, "seen boolean, energy double", "system_id long, step long, drift double", delay, **how)


def first_converged_stream(stream: DataFrame, reached: Column, delay: str, **how) -> DataFrame:
    """(system_id, step, energy) of the first record of each system where ``reached`` holds."""
    def step(known: tuple | None, record: tuple) -> tuple[tuple, tuple | None]:
        return (True,), None if known else (record[1], record[2])

    typed = stream.filter(reached).withColumns({"energy": F.col("energy").cast("double"), "step": F.col("step").cast("long")})
    return in_order(typed, ["step", "energy"], step, "seen boolean", "system_id long, step long, energy double", delay, **how)


def stage_timing_stream(stream: DataFrame, delay: str, **how) -> DataFrame:
    """(system_id, transition, seconds) of each step from one stage to the next; a null stage leaves its side of the transition empty."""
    def step(known: tuple | None, record: tuple) -> tuple[tuple, tuple | None]:
        us, stage = record
        return (us, stage), (f"{known[1] or ''}->{stage or ''}", (us - known[0]) / 1e6) if known else None

    return in_order(stream, ["stage"], step, "us long, stage string", "system_id long, transition string, seconds double", delay, **how)


def log_stream(systems: DataFrame, path: str, checkpoint: str, every: int = 1):
    """Starts a query that appends every ``every``-th step of a stream to Parquet; stop or await what it returns."""
    return systems.filter(F.col("step") % every == 0).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def sink_batches(stream: DataFrame, sink: Sink, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """A writer that puts each micro-batch into a sink; the batch id makes a repeated batch replace itself."""
    return stream.writeStream.foreachBatch(lambda df, batch_id: sink.write(transform(df), batch_id))


def inflight(stream: DataFrame, pool: DataFrame, graduated: Sink, admitted: Sink, criteria: dict, budget: tuple[int, int, int], sizes: DataFrame):
    """A writer for the replacement flow: of each micro-batch of (system_id, shard, ...) the converged systems go to ``graduated``, and systems of ``pool``, neither running nor admitted before, fill what the rest leaves of the budget."""
    def step(df: DataFrame, batch_id: int) -> None:
        done = converged(df, criteria).filter("converged").select("system_id")
        graduated.write(done, batch_id)
        running = df.select("system_id", "shard").distinct().join(done, "system_id", "left_anti").join(sizes, "system_id")
        used = running.groupBy("shard").agg(F.sum("num_atoms").alias("num_atoms"), F.sum("num_edges").alias("num_edges"), F.count("*").alias("n"))
        free = pool.join(df.select("system_id").distinct(), "system_id", "left_anti")
        if len(admitted):
            # a batch that is run again chooses as it did before, so what it wrote itself does not count
            free = free.join(admitted.read().filter(F.col("batch") != batch_id).select("system_id"), "system_id", "left_anti")
        admitted.write(refill(free, used, budget), batch_id)

    return stream.writeStream.foreachBatch(step)


__all__ = ["energy_drift_stream", "first_converged_stream", "in_order", "inflight", "log_stream", "observables", "sink_batches", "stage_timing_stream"]
