"""Aggregates over the rows of a segment, and their way back to the rows.

Segments need no order. ``of`` (a table with every key) adds the segments without rows: 0 for sums, means and counts,
null for extremes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cell_volume, dot, norm, outer, row_times, vec
from ..structures import VELOCITY, StructureSet

#: Fixed value: Boltzmann's constant in eV/K.
KB = 8.617333262e-5


def per_system(df: DataFrame, exprs: dict[str, Column], key: str = "system_id", of: DataFrame | None = None, empty: float | None = 0) -> DataFrame:
    """One row per key with the named aggregates, all in one pass."""
    out = df.groupBy(key).agg(*[c.alias(n) for n, c in exprs.items()])
    if of is None:
        return out
    out = of.select(key).distinct().join(out, key, "left")
    return out if empty is None else out.withColumns({n: F.coalesce(n, F.lit(empty)) for n in exprs})


def per_system_in_order(df: DataFrame, exprs: dict[str, Column], order: str, key: str = "system_id", of: DataFrame | None = None, empty: float | None = 0) -> DataFrame:
    """``per_system`` with the rows of a key taken one after the other by ``order``, which is unique in its key and not null.

    Sums of doubles depend on the order in which rows come, and after an exchange that is another one in each run; where a
    sum is then rounded, its last bit decides a half.
    """
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.select(key, order, *[c.over(w).alias(n) for n, c in exprs.items()])
    return per_system(rows, {n: F.max_by(n, order) for n in exprs}, key, of, empty)


# What the functions below aggregate, by name; several of them go into one pass with ``per_system``.


def sums(columns: Sequence[str]) -> dict[str, Column]:
    return {f"sum_{c}": F.sum(c) for c in columns}


def component_sum(columns: Sequence[str]) -> dict[str, Column]:
    return {"component_sum": F.sum(sum(vec(columns[1:]), F.col(columns[0])))}


def dots(a: Sequence[str], b: Sequence[str]) -> dict[str, Column]:
    """Sums of a.b (twice, as dot and xy), a.a and b.b."""
    x, y = vec(a), vec(b)
    return {"dot": F.sum(dot(x, y)), "xy": F.sum(dot(x, y)), "xx": F.sum(dot(x, x)), "yy": F.sum(dot(y, y))}


def max_norm(columns: Sequence[str]) -> dict[str, Column]:
    return {"max_norm": F.max(norm(vec(columns)))}


def extremes(columns: Sequence[str]) -> dict[str, Column]:
    return {f"max_{c}": F.max(c) for c in columns} | {f"min_{c}": F.min(c) for c in columns}


def means(columns: Sequence[str]) -> dict[str, Column]:
    return {f"mean_{c}": F.avg(c) for c in columns}


def rms_norm(columns: Sequence[str]) -> dict[str, Column]:
    return {"rms_norm": F.sqrt(F.avg(dot(vec(columns), vec(columns))))}


def counts() -> dict[str, Column]:
    return {"n": F.count("*")}


def _only(found: dict[str, Column], *names: str) -> dict[str, Column]:
    return {n: found[n] for n in names}


def seg_sum(df, columns: Sequence[str], key="system_id", of=None):
    return per_system(df, sums(columns), key, of)


def seg_component_sum(df, columns: Sequence[str], key="system_id", of=None):
    return per_system(df, component_sum(columns), key, of)


def seg_dot(df, a: Sequence[str], b: Sequence[str], key="system_id", of=None):
    return per_system(df, _only(dots(a, b), "dot"), key, of)


def seg_inner_products(df, a: Sequence[str], b: Sequence[str], key="system_id", of=None):
    """Sums of a.b, a.a and b.b."""
    return per_system(df, _only(dots(a, b), "xy", "xx", "yy"), key, of)


def seg_max_norm(df, columns: Sequence[str], key="system_id", of=None):
    return per_system(df, max_norm(columns), key, of)


def seg_max(df, columns: Sequence[str], key="system_id", of=None):
    return per_system(df, _only(extremes(columns), *[f"max_{c}" for c in columns]), key, of, empty=None)


def seg_min(df, columns: Sequence[str], key="system_id", of=None):
    return per_system(df, _only(extremes(columns), *[f"min_{c}" for c in columns]), key, of, empty=None)


def seg_mean(df, columns: Sequence[str], key="system_id", of=None):
    return per_system(df, means(columns), key, of)


def seg_rms_norm(df, columns: Sequence[str], key="system_id", of=None):
    return per_system(df, rms_norm(columns), key, of)


def seg_count(df, key="system_id", of=None):
    return per_system(df, counts(), key, of)


def seg_broadcast(df: DataFrame, values: DataFrame, columns: Sequence[str], key: str = "system_id") -> DataFrame:
    """Each row with its segment's values."""
    return df.join(values.select(key, *columns), key)


def _with(df: DataFrame, values: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    return df.join(values.select(key, *[F.col(n).alias(f"_s_{n}") for n in names]), key)


def seg_add(df, values, column: str, by: str, key="system_id"):
    """column + by[segment]."""
    return _with(df, values, [by], key).withColumn(column, F.col(column) + F.col(f"_s_{by}")).select(df.columns)


def seg_mul(df, values, column: str, by: str, key="system_id"):
    return _with(df, values, [by], key).withColumn(column, F.col(column) * F.col(f"_s_{by}")).select(df.columns)


def seg_axpy(df, values, x: str, y: str, a: str, key="system_id"):
    """y := y + a[segment] x."""
    return _with(df, values, [a], key).withColumn(y, F.col(y) + F.col(f"_s_{a}") * F.col(x)).select(df.columns)


def seg_axpby(df, values, x: str, y: str, a: str, b: str, out: str, key="system_id"):
    """out := a[segment] x + b[segment] y."""
    return _with(df, values, dict.fromkeys((a, b)), key).withColumn(out, F.col(f"_s_{a}") * F.col(x) + F.col(f"_s_{b}") * F.col(y)).select(*df.columns, out)


def seg_matvec(df, matrices, columns: Sequence[str], matrix: str, out: Sequence[str], key="system_id"):
    """out := transpose(M[segment]) v; M is an array of nine."""
    j = _with(df, matrices, [matrix], key)
    return j.withColumns(dict(zip(out, row_times(vec(columns), [F.col(f"_s_{matrix}")[k] for k in range(9)])))).drop(f"_s_{matrix}")


# ---- thermodynamic sums


def kinetic_energy(ss: StructureSet) -> DataFrame:
    return per_system(ss.atoms, {"ke": F.sum(0.5 * F.col("mass") * dot(vec(VELOCITY), vec(VELOCITY)))}, of=ss.systems, empty=0.0)


def temperature(ss: StructureSet, kb: float = KB) -> DataFrame:
    """2 KE / (3 n kb), 0 for systems without atoms."""
    t = per_system(ss.atoms, {"ke": F.sum(0.5 * F.col("mass") * dot(vec(VELOCITY), vec(VELOCITY))), "n": F.count("*")}, of=ss.systems)
    return t.select("system_id", "ke", F.coalesce(F.try_divide(2 * F.col("ke"), 3 * F.col("n") * kb), F.lit(0.0)).alias("temperature"))


def remove_com(ss: StructureSet) -> StructureSet:
    """Velocities without the mean of their system, weighted by mass."""
    m = per_system(ss.atoms, {f"_c{v}": F.try_divide(F.sum(F.col("mass") * F.col(v)), F.sum("mass")) for v in VELOCITY})
    a = ss.atoms.join(m, "system_id").withColumns({v: F.col(v) - F.coalesce(f"_c{v}", F.lit(0.0)) for v in VELOCITY})
    return ss.with_(atoms=a.select(ss.atoms.columns))


def pressure(ss: StructureSet, virial: DataFrame | None = None) -> DataFrame:
    """(system_id, tensor of nine, pressure): sum of m v v plus the virial (system_id, virial), over the volume; a third of the trace."""
    t = per_system(ss.atoms, {f"k{n}": F.sum(F.col("mass") * p) for n, p in enumerate(outer(vec(VELOCITY), vec(VELOCITY)))}, of=ss.systems, empty=0.0)
    t = t.join(ss.systems.select("system_id", cell_volume(F.col("cell")).alias("v")), "system_id")
    if virial is not None:
        t = t.join(virial.select("system_id", "virial"), "system_id", "left")
    w = [F.coalesce(F.col("virial")[k], F.lit(0.0)) if virial is not None else F.lit(0.0) for k in range(9)]
    p = [(F.col(f"k{k}") + w[k]) / F.col("v") for k in range(9)]
    return t.select("system_id", F.array(*p).alias("tensor"), ((p[0] + p[4] + p[8]) / 3).alias("pressure"))


def reduce_snapshots(df: DataFrame, how: str) -> DataFrame:
    """(step, name, value) over all writers' (step, name, value): sum, mean, min or max."""
    fn = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[how]
    return df.groupBy("step", "name").agg(fn("value").alias("value"))
