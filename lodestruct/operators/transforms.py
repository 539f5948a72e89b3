"""Chains of steps over structures: steps of each system alone, before batching, or steps of whole batches.

A sample step's result for a system depends on that system only. A batch step's may depend on the other systems of its
batch, so it needs ``batch_id`` on the systems. One chain holds steps of one kind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..structures import StructureSet

SAMPLE, BATCH = "sample", "batch"
BATCH_KEY = "batch_id"


@dataclass(frozen=True)
class Step:
    """A function from structures to structures, and whether it is of samples or of batches."""

    fn: Callable[[StructureSet], StructureSet]
    kind: str

    def __call__(self, ss: StructureSet) -> StructureSet:
        return self.fn(ss)


def sample_step(fn: Callable[[StructureSet], StructureSet]) -> Step:
    return Step(fn, SAMPLE)


def batch_step(fn: Callable[[StructureSet], StructureSet]) -> Step:
    return Step(fn, BATCH)


class Transforms:
    """Steps applied from left to right as one lazy plan; none leaves the structures as they are.

    A plain function takes the kind of the marked steps; without any marked step the chain is of samples. Steps of both
    kinds, or one that cannot be called, are a TypeError when the chain is made. A step that fails while the plan is
    built, gives no StructureSet or loses the key that later steps need is a RuntimeError that tells its number; what
    fails in the rows shows when the plan runs. Chains are steps too, so they nest.
    """

    def __init__(self, steps: Iterable[Callable[[StructureSet], StructureSet]] = ()) -> None:
        self.steps = tuple(steps)
        marked: dict[str, int] = {}
        for n, step in enumerate(self.steps):
            if not callable(step):
                raise TypeError(f"step {n} cannot be called: {step!r}")
            if kind := step.marked if isinstance(step, Transforms) else getattr(step, "kind", None):
                if kind not in (SAMPLE, BATCH):
                    raise TypeError(f"step {n} is of an unknown kind, {kind!r}")
                marked.setdefault(kind, n)
        if len(marked) > 1:
            raise TypeError(f"steps of samples and of batches do not mix: step {marked[SAMPLE]} is of samples, step {marked[BATCH]} of batches")
        self.marked = next(iter(marked), None)
        self.kind = self.marked or SAMPLE

    def __call__(self, ss: StructureSet) -> StructureSet:
        needed = ("system_id", BATCH_KEY) if self.kind == BATCH else ("system_id",)
        if missing := [c for c in needed if c not in ss.systems.columns]:
            raise ValueError(f"steps of kind {self.kind} need {', '.join(missing)} on the systems")
        for n, step in enumerate(self.steps):
            try:
                ss = step(ss)
                if not isinstance(ss, StructureSet):
                    raise TypeError(f"a step gives a StructureSet, not {type(ss).__name__}")
                if missing := [c for c in needed if c not in ss.systems.columns]:
                    raise ValueError(f"the systems have lost {', '.join(missing)}")
            except Exception as e:
                raise RuntimeError(f"step {n} failed: {e}") from e
        return ss


def with_batches(ss: StructureSet, assigned: DataFrame) -> StructureSet:
    """The systems that ``assigned`` (system_id, batch_id; each system once) puts into a batch, with their batch, and their atoms and edges.

    ``assigned`` is joined with each level, and lazily: an order that is dear to make is better written or persisted first.
    """
    keys = assigned.filter(F.col(BATCH_KEY).isNotNull()).select("system_id", BATCH_KEY)
    others = {k: df.join(keys, "system_id", "left_semi") for k, df in ss.levels().items() if k != "systems"}
    return ss.with_(systems=ss.systems.drop(BATCH_KEY).join(keys, "system_id"), **others)


def less_batch_mean(column: str) -> Step:
    """A systems' column less its batch's mean; nulls stay null and are in no mean. A window holds one batch."""
    own = F.avg(column).over(W.partitionBy(BATCH_KEY))
    return batch_step(lambda ss: ss.with_(systems=ss.systems.withColumn(column, F.col(column) - own)))


def over_batch_rms(*columns: str) -> Step:
    """Atoms' vectors over the root of the mean square norm of their batch's vectors; vectors with a null component are in no mean, and where the root is 0 nothing changes.

    Squares are added up by system first, so only one row a system meets its batch.
    """

    def scale(ss: StructureSet) -> StructureSet:
        square = sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0]))
        by_system = ss.atoms.groupBy("system_id").agg(F.sum(square).alias("_sum"), F.count(square).alias("_n"))
        own = W.partitionBy(BATCH_KEY)
        rms = F.sqrt(F.sum("_sum").over(own) / F.sum("_n").over(own))
        roots = ss.systems.select("system_id", BATCH_KEY).join(by_system, "system_id").select("system_id", rms.alias("_rms"))
        scaled = {c: F.when(F.col("_rms") > 0, F.col(c) / F.col("_rms")).otherwise(F.col(c)) for c in columns}
        return ss.with_(atoms=ss.atoms.join(roots, "system_id", "left").withColumns(scaled).select(ss.atoms.columns))

    return batch_step(scale)
