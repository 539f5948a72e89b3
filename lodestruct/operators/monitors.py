"""Monitors over trajectories (system_id, step, ...), in batch form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm, vec
from ..structures import FORCE, VELOCITY, StructureSet
from .metrics import finite
from .segments import KB

def micros(ts: Column) -> Column:
    """Microseconds of a timestamp, with or without a time zone."""
    return F.unix_micros(ts.cast("timestamp"))


REDUCERS = {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum, "norm": lambda c: F.sqrt(F.sum(c * c))}


def observables(systems: DataFrame, atoms: DataFrame, every: int = 1, extra: dict[str, Column] | None = None) -> DataFrame:
    """(step, system_id, energy, fmax, temperature, extra...) of every ``every``-th step.

    ``systems`` (system_id, step, energy, ...), ``atoms`` (system_id, step, forces, velocities, mass, ...); extra scalars are
    aggregates over atoms.
    """
    due = F.col("step") % every == 0
    a = atoms.filter(due).groupBy("system_id", "step").agg(
        F.max(norm(vec(FORCE))).alias("fmax"), F.sum(0.5 * F.col("mass") * dot(vec(VELOCITY), vec(VELOCITY))).alias("_ke"), F.count("*").alias("_n"), *[e.alias(n) for n, e in (extra or {}).items()]
    )
    keep = [c for c in ("status",) if c in systems.columns]
    return systems.filter(due).join(a, ["system_id", "step"], "left").select("step", "system_id", *keep, "energy", "fmax", F.coalesce(F.try_divide(2 * F.col("_ke"), 3 * F.col("_n") * KB), F.lit(0.0)).alias("temperature"), *(extra or {}))


def drift(traj: DataFrame, metric: str = "absolute", sizes: DataFrame | None = None) -> DataFrame:
    """(system_id, step, drift): distance of the energy from the system's first record; per_atom_per_step divides by atoms and by max(step, 1)."""
    first = F.first("energy").over(W.partitionBy("system_id").orderBy("step"))
    t = traj.select("system_id", "step", F.abs(F.col("energy") - first).alias("drift"))
    if metric == "absolute":
        return t
    if metric != "per_atom_per_step":
        raise ValueError(f"no such metric: {metric}")
    n = sizes.select("system_id", "num_atoms")
    return t.join(n, "system_id").select("system_id", "step", (F.col("drift") / (F.col("num_atoms") * F.greatest("step", F.lit(1)))).alias("drift"))


def energy_drift(traj: DataFrame, threshold: float, metric: str = "absolute", sizes: DataFrame | None = None) -> DataFrame:
    """(step, max_drift, alarm): over the systems recorded at a step."""
    d = drift(traj, metric, sizes).groupBy("step").agg(F.max("drift").alias("max_drift"))
    return d.withColumn("alarm", F.col("max_drift") > threshold)


def converged(df: DataFrame, criteria: dict[str, tuple[Column, str, float]], keys: tuple[str, ...] = ("system_id",)) -> DataFrame:
    """(keys, converged): every criterion (expression, reducer, limit) is at most its limit; reducers are min, max, mean, sum, norm."""
    agg = df.groupBy(*keys).agg(*[REDUCERS[how](e).alias(f"_{n}") for n, (e, how, _) in criteria.items()])
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_{n}") <= limit, F.lit(False)) for n, (_, _, limit) in criteria.items()])
    return agg.select(*keys, ok.alias("converged"))


def set_status(systems: DataFrame, done: DataFrame, source: int, target: int) -> DataFrame:
    """Converged systems of status ``source`` get ``target``."""
    j = systems.join(done.filter("converged").select("system_id", F.lit(True).alias("_done")), "system_id", "left")
    return j.withColumn("status", F.when((F.col("status") == source) & F.col("_done"), target).otherwise(F.col("status"))).select(systems.columns)


def find_nonfinite(ss: StructureSet, atom_columns: tuple[str, ...] = FORCE, system_columns: tuple[str, ...] = ("energy",)) -> DataFrame:
    """(system_id, column, n): how many values of a system are NaN or infinite; nulls are absent values, not such."""
    def bad(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        hit = lambda c: F.col(c).isNotNull() & ~finite(F.col(c))
        found = df.select("system_id", F.explode(F.array(*[F.when(hit(c), F.lit(c)) for c in columns])).alias("column"))
        return found.filter("column is not null").groupBy("system_id", "column").agg(F.count("*").alias("n"))

    return bad(ss.atoms, atom_columns).unionByName(bad(ss.systems, system_columns))


def snapshots(traj: DataFrame, every: int) -> DataFrame:
    return traj.filter(F.col("step") % every == 0)


def first_converged(traj: DataFrame, reached: Column) -> DataFrame:
    """The record of each system at the first step where ``reached`` holds."""
    return traj.filter(reached).withColumn("_k", F.row_number().over(W.partitionBy("system_id").orderBy("step"))).filter("_k = 1").drop("_k")


def stage_timing(events: DataFrame, keys: tuple[str, ...] = ("system_id",)) -> DataFrame:
    """(transition, n, mean, std, min, max, total) of the seconds from one stage to the next; std is that of a sample, 0 for one."""
    w = W.partitionBy(*keys).orderBy("ts")
    e = events.select(*keys, "stage", "ts", F.lag("stage").over(w).alias("prev"), (micros(F.col("ts")) - micros(F.lag("ts").over(w))).alias("us")).filter("prev is not null")
    s = F.col("us") / 1e6
    return e.groupBy(F.concat_ws("->", "prev", "stage").alias("transition")).agg(
        F.count("*").alias("n"), F.avg(s).alias("mean"), F.coalesce(F.nanvl(F.stddev_samp(s), F.lit(0.0)), F.lit(0.0)).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"), F.sum(s).alias("total")
    )


def status_counts(df: DataFrame, exit_status: int | str) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"))


def graduation(df: DataFrame, exit_status: int | str) -> DataFrame:
    """(active, graduated, active_fraction, graduated_fraction); fractions of nothing are 0."""
    gone = F.coalesce(F.sum((F.col("status") == exit_status).cast("int")), F.lit(0))
    n = F.greatest(F.count("*"), F.lit(1))
    return df.agg((F.count("*") - gone).alias("active"), gone.alias("graduated"), ((F.count("*") - gone) / n).alias("active_fraction"), (gone / n).alias("graduated_fraction"))


def scalars(systems: DataFrame, atoms: DataFrame | None = None) -> DataFrame:
    """(step, mean_energy, n[, max_force, temperature]) over all systems recorded at a step."""
    s = systems.groupBy("step").agg(F.avg("energy").alias("mean_energy"), F.count("*").alias("n"))
    if atoms is None:
        return s
    a = atoms.groupBy("step").agg(F.max(norm(vec(FORCE))).alias("max_force"), (2 * F.sum(0.5 * F.col("mass") * dot(vec(VELOCITY), vec(VELOCITY))) / (3 * F.count("*") * KB)).alias("temperature"))
    return s.join(a, "step", "left")


def progress(traj: DataFrame, total_steps: int) -> DataFrame:
    """(step, fraction, rate): how far a run is, and steps a second since its first record."""
    t = traj.groupBy("step").agg(F.max("ts").alias("ts"))
    last = t.agg(F.max("step").alias("step"), F.min("step").alias("first"), ((micros(F.max("ts")) - micros(F.min("ts"))) / 1e6).alias("s"))
    return last.select("step", F.least(F.col("step") / total_steps, F.lit(1.0)).alias("fraction"), F.coalesce(F.try_divide(F.col("step") - F.col("first"), F.col("s")), F.lit(0.0)).alias("rate"))


def recent(df: DataFrame, n: int, name: str = "name") -> DataFrame:
    """The last ``n`` points of each metric."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(name).orderBy(F.col("step").desc()))).filter(F.col("_k") <= n).drop("_k")


def flatten_scalars(df: DataFrame, column: str, keys: tuple[str, ...] = ("step",)) -> DataFrame:
    """(keys, name, value) of a scalar, a map or a struct of any depth; names of nested ones are joined by a slash, entries that are not numbers go."""
    from pyspark.sql import types as T

    def walk(d: DataFrame, kind: T.DataType) -> DataFrame:
        if isinstance(kind, T.MapType):
            e = d.select(*keys, F.col("name").alias("_p"), F.explode("value").alias("_k", "value"))
            return walk(e.select(*keys, F.concat_ws("/", "_p", F.col("_k").cast("string")).alias("name"), "value"), kind.valueType)
        if isinstance(kind, T.StructType):
            return reduce(lambda a, b: a.unionByName(b), [walk(d.select(*keys, F.concat_ws("/", "name", F.lit(f.name)).alias("name"), F.col("value")[f.name].alias("value")), f.dataType) for f in kind])
        return d.select(*keys, "name", F.col("value").try_cast("double").alias("value")).filter("value is not null")

    return walk(df.select(*keys, F.lit(None).cast("string").alias("name"), F.col(column).alias("value")), df.schema[column].dataType)
