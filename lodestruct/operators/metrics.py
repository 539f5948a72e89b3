"""Losses as aggregates over predictions joined with labels.

Energies are (system_id, energy), forces (system_id, atom_id, fx, fy, fz), stresses (system_id, stress of nine).
Each metric is one row: value, weight (what the value was divided by).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import huber
from ..functions.vectors import dot
from ..structures import FORCE


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def ratio(total: Column, weight: Column) -> Column:
    """Denominators below one count as one, so nothing at all gives 0."""
    return F.coalesce(total, F.lit(0.0)) / F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(1.0))


@dataclass(frozen=True)
class Metric:
    """A loss of one's own: columns to join, key, what counts, its residual, its weight."""

    keys: Sequence[str]
    columns: Sequence[str]
    residual: Callable[[dict[str, Column], dict[str, Column]], Column]
    mask: Callable[[dict[str, Column]], Column] = lambda label: F.lit(True)
    weight: Column | None = None

    def rows(self, pred: DataFrame, label: DataFrame) -> DataFrame:
        j = joined(pred, label, self.keys, self.columns)
        p, t = {c: F.col(f"p_{c}") for c in self.columns}, {c: F.col(f"t_{c}") for c in self.columns}
        w = F.lit(1.0) if self.weight is None else self.weight
        return j.filter(self.mask(t)).select(*self.keys, (self.residual(p, t) * w).alias("_v"), w.alias("_w"))

    def __call__(self, pred: DataFrame, label: DataFrame) -> DataFrame:
        return self.rows(pred, label).agg(ratio(F.sum("_v"), F.sum("_w")).alias("value"), F.sum("_w").alias("weight"))


@dataclass(frozen=True)
class Loss:
    """A standard loss as rows that add up: energy, force or stress; kind "square", "absolute" (of forces: the length), "huber".

    ``sizes`` makes energies per atom, weighted by atoms; ``balanced`` forces are means of systems, each counted once; ``mask``
    names a column of the force labels; ``ignore_nonfinite`` leaves labels out that are null, NaN or infinite.
    """

    component: str
    kind: str = "square"
    delta: float = 0.01
    sizes: DataFrame | None = None
    balanced: bool = True
    mask: str | None = None
    ignore_nonfinite: bool = False

    def _of(self, residual: Column) -> Column:
        return {"square": lambda: residual * residual, "absolute": lambda: F.abs(residual), "huber": lambda: huber(residual, self.delta)}[self.kind]()

    def rows(self, pred: DataFrame, label: DataFrame) -> DataFrame:
        """(system_id, _v, _w): the loss is the sum of _v over the sum of _w."""
        if self.component not in ("energy", "force", "stress") or self.kind not in ("square", "absolute", "huber"):
            raise ValueError(f"no such loss: {self.component}, {self.kind}")
        if self.component == "force":
            return self._forces(pred, label)
        j = joined(pred, label, ["system_id"], [self.component])
        p, t = F.col(f"p_{self.component}"), F.col(f"t_{self.component}")
        if self.component == "stress":
            j = j.filter(F.forall(t, finite)) if self.ignore_nonfinite else j
            return j.select("system_id", (F.aggregate(F.zip_with(p, t, lambda a, b: self._of(a - b)), F.lit(0.0), lambda a, b: a + b) / 9).alias("_v"), F.lit(1.0).alias("_w"))
        j, n = (j.filter(finite(t)) if self.ignore_nonfinite else j), F.lit(1.0)
        if self.sizes is not None:
            j, n = j.join(self.sizes.select("system_id", "num_atoms"), "system_id").filter("num_atoms > 0"), F.col("num_atoms").cast("double")
        return j.select("system_id", (n * self._of((p - t) / n)).alias("_v"), n.alias("_w"))

    def _forces(self, pred: DataFrame, label: DataFrame) -> DataFrame:
        j = joined(pred, label, ["system_id", "atom_id"], FORCE)
        if self.mask is not None:
            j = j.join(label.select("system_id", "atom_id", F.col(self.mask).alias("_mask")), ["system_id", "atom_id"]).filter("_mask")
        if self.ignore_nonfinite:
            j = j.filter(reduce(lambda a, b: a & b, [finite(F.col(f"t_{c}")) for c in FORCE]))
        d = [F.col(f"p_{c}") - F.col(f"t_{c}") for c in FORCE]
        v = F.sqrt(dot(d, d)) if self.kind == "absolute" else reduce(lambda a, b: a + b, [self._of(x) for x in d])
        g = j.groupBy("system_id").agg(F.sum(v).alias("_v"), (F.count("*") * (1.0 if self.kind == "absolute" else 3.0)).alias("_w"))
        return g.select("system_id", (F.col("_v") / F.col("_w")).alias("_v"), F.lit(1.0).alias("_w")) if self.balanced else g


def joined(pred: DataFrame, label: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    p = pred.select(*keys, *[F.col(c).alias(f"p_{c}") for c in columns])
    return p.join(label.select(*keys, *[F.col(c).alias(f"t_{c}") for c in columns]), list(keys))


def _energy(pred, label, loss: Callable[[Column], Column], sizes: DataFrame | None, ignore_nonfinite: bool) -> DataFrame:
    """With ``sizes`` (system_id, num_atoms) residuals are per atom and weighted by the number of atoms."""
    j = joined(pred, label, ["system_id"], ["energy"])
    if ignore_nonfinite:
        j = j.filter(finite(F.col("t_energy")))
    r, w = F.col("p_energy") - F.col("t_energy"), F.lit(1.0)
    if sizes is not None:
        j = j.join(sizes.select("system_id", "num_atoms"), "system_id").filter("num_atoms > 0")
        r, w = r / F.col("num_atoms"), F.col("num_atoms").cast("double")
    return j.agg(F.coalesce(F.try_divide(F.sum(w * loss(r)), F.sum(w)), F.lit(0.0)).alias("value"), F.coalesce(F.sum(w), F.lit(0.0)).alias("weight"))


def energy_mse(pred, label, sizes=None, ignore_nonfinite=False):
    return _energy(pred, label, lambda r: r * r, sizes, ignore_nonfinite)


def energy_mae(pred, label, sizes=None, ignore_nonfinite=False):
    return _energy(pred, label, F.abs, sizes, ignore_nonfinite)


def energy_huber(pred, label, delta=0.01, sizes=None, ignore_nonfinite=False):
    return _energy(pred, label, lambda r: huber(r, delta), sizes, ignore_nonfinite)


def _force(pred, label, loss: Callable[[list[Column]], Column], per_atom: float, per_system: bool, ignore_nonfinite: bool, mask: str | None) -> DataFrame:
    """``loss`` is summed over atoms and divided by ``per_atom`` for each; balanced: means of systems, then their mean."""
    j = joined(pred, label, ["system_id", "atom_id"], FORCE)
    if mask is not None:
        j = j.join(label.select("system_id", "atom_id", F.col(mask).alias("_mask")), ["system_id", "atom_id"]).filter("_mask")
    if ignore_nonfinite:
        j = j.filter(reduce(lambda a, b: a & b, [finite(F.col(f"t_{c}")) for c in FORCE]))
    v = loss([F.col(f"p_{c}") - F.col(f"t_{c}") for c in FORCE])
    if not per_system:
        return j.agg(ratio(F.sum(v), F.count("*") * per_atom).alias("value"), (F.count("*") * per_atom).alias("weight"))
    s = j.groupBy("system_id").agg(ratio(F.sum(v), F.count("*") * per_atom).alias("m"))
    return s.agg(ratio(F.sum("m"), F.count("*")).alias("value"), F.count("*").cast("double").alias("weight"))


def force_mse(pred, label, per_system=True, ignore_nonfinite=False, mask=None):
    return _force(pred, label, lambda d: dot(d, d), 3.0, per_system, ignore_nonfinite, mask)


def force_huber(pred, label, delta=0.01, per_system=True, ignore_nonfinite=False, mask=None):
    return _force(pred, label, lambda d: huber(d[0], delta) + huber(d[1], delta) + huber(d[2], delta), 3.0, per_system, ignore_nonfinite, mask)


def force_l2(pred, label, per_system=True, ignore_nonfinite=False, mask=None):
    return _force(pred, label, lambda d: F.sqrt(dot(d, d)), 1.0, per_system, ignore_nonfinite, mask)


def _stress(pred, label, loss: Callable[[Column], Column], ignore_nonfinite: bool) -> DataFrame:
    j = joined(pred, label, ["system_id"], ["stress"])
    if ignore_nonfinite:
        j = j.filter(F.forall("t_stress", finite))
    each = F.aggregate(F.zip_with("p_stress", "t_stress", lambda p, t: loss(p - t)), F.lit(0.0), lambda a, b: a + b) / 9
    return j.agg(ratio(F.sum(each), F.count("*")).alias("value"), F.count("*").cast("double").alias("weight"))


def stress_mse(pred, label, ignore_nonfinite=False):
    """Mean square over the nine components."""
    return _stress(pred, label, lambda r: r * r, ignore_nonfinite)


def stress_huber(pred, label, delta=0.01, ignore_nonfinite=False):
    return _stress(pred, label, lambda r: huber(r, delta), ignore_nonfinite)


def compose_metrics(parts: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """(name, unweighted, weight, weighted) of each metric, and their weighted sum as ``total``."""
    rows = [m.select(F.lit(n).alias("name"), F.col("value").alias("unweighted"), F.lit(float(w)).alias("weight"), (F.col("value") * w).alias("weighted")) for n, (m, w) in parts.items()]
    each = reduce(lambda a, b: a.unionByName(b), rows)
    total = each.agg(F.lit("total").alias("name"), F.lit(None).cast("double").alias("unweighted"), F.lit(None).cast("double").alias("weight"), F.sum("weighted").alias("weighted"))
    return each.unionByName(total)


def _components(pred: dict[str, DataFrame], label: dict[str, DataFrame], sizes: DataFrame) -> dict[str, DataFrame]:
    """Of each component (system_id, value): energy, square error per atom; force, mean square over a system's atoms and axes; stress, mean square of the nine."""
    out = {}
    if "energy" in pred:
        e = joined(pred["energy"], label["energy"], ["system_id"], ["energy"]).join(sizes.select("system_id", "num_atoms"), "system_id").filter("num_atoms > 0")
        out["energy"] = e.select("system_id", (((F.col("p_energy") - F.col("t_energy")) / F.col("num_atoms")) ** 2).alias("value"))
    if "force" in pred:
        f = joined(pred["force"], label["force"], ["system_id", "atom_id"], FORCE)
        d = [F.col(f"p_{c}") - F.col(f"t_{c}") for c in FORCE]
        out["force"] = f.groupBy("system_id").agg((F.sum(dot(d, d)) / (3 * F.count("*"))).alias("value"))
    if "stress" in pred:
        s = joined(pred["stress"], label["stress"], ["system_id"], ["stress"])
        out["stress"] = s.select("system_id", (F.aggregate(F.zip_with("p_stress", "t_stress", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda x, y: x + y) / 9).alias("value"))
    return out


def evaluate(pred: dict[str, DataFrame] | DataFrame, label: dict[str, DataFrame] | DataFrame, sizes: DataFrame, batches: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Validation summary: one row with the mean over batches of the weighted total and of each component, the mean over systems, and counts.

    ``pred`` and ``label`` name the tables of their components: energy (square error per atom), force (square error,
    balanced by system), stress (square error); a table alone is that of energies. Those in ``weights`` take part, all
    with weight 1 if it is empty. Batches (system_id, batch_id) are a level of their own: a mean of batch values is not a
    mean over all rows. A system that lacks a component adds nothing to it. ``per_sample`` is the mean over systems of the sum of components, without weights.
    """
    pred, label = ({"energy": x} if isinstance(x, DataFrame) else x for x in (pred, label))
    missing = [n for n in weights if n not in pred or n not in label]
    if missing:
        raise KeyError(", ".join(missing))
    parts = _components({n: pred[n] for n in (weights or pred)}, label, sizes)
    unknown = [n for n in (weights or pred) if n not in parts]
    if unknown:
        raise KeyError(", ".join(unknown))
    rows = reduce(lambda x, y: x.unionByName(y), [df.select("system_id", F.lit(n).alias("name"), "value") for n, df in parts.items()])
    s = rows.groupBy("system_id").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in parts]).join(batches, "system_id")
    plain = reduce(lambda x, y: x + y, [F.coalesce(F.col(n), F.lit(0.0)) for n in parts])
    b = s.withColumn("_total", plain).groupBy("batch_id").agg(*[F.avg(n).alias(n) for n in parts], F.sum("_total").alias("_sum"), F.count("*").alias("n"))
    by_batch = reduce(lambda x, y: x + y, [F.coalesce(F.col(n), F.lit(0.0)) * float(weights.get(n, 1.0)) for n in parts])
    return b.agg(F.avg(by_batch).alias("total"), *[F.avg(n).alias(n) for n in parts], (F.sum("_sum") / F.sum("n")).alias("per_sample"), F.count("*").alias("n_batches"), F.sum("n").alias("n_samples"))


def evaluate_losses(pred: dict[str, DataFrame], label: dict[str, DataFrame], losses: dict[str, tuple[str, Metric | Loss, float]], batches: DataFrame) -> DataFrame:
    """Validation summary by any losses: one row with the mean over batches of each one and of their weighted sum, ``total``.

    ``losses`` gives to each name the table it is of (a key of ``pred`` and ``label``), a ``Loss`` or a ``Metric`` of one's own
    with system_id among its keys, and its weight; a table can have several. Each loss of a batch is the sum of its rows
    over the sum of their weights, so all of them come from one aggregate over (system_id, batch_id), whatever the losses.
    A batch without rows of a loss leaves its mean and adds nothing to the total. ``<name>_all`` is the same over all rows
    at once. Systems without a batch are counted in ``n_unbatched`` and are in ``<name>_all`` only; n_samples counts systems
    that have any row.
    """
    missing = [c for c, _, _ in losses.values() if c not in pred or c not in label]
    if missing or not losses:
        raise KeyError(", ".join(missing) or "no losses")
    parts = [m.rows(pred[c], label[c]).groupBy("system_id").agg(F.sum("_v").alias("_v"), F.sum("_w").alias("_w")).withColumn("_name", F.lit(n)) for n, (c, m, _) in losses.items()]
    rows = reduce(lambda x, y: x.unionByName(y), parts).join(batches.select("system_id", "batch_id"), "system_id", "left")
    of = lambda c, n: F.sum(F.when(F.col("_name") == n, F.col(c)))
    s = rows.groupBy("system_id", "batch_id").agg(*[of(c, n).alias(f"{c}{k}") for k, n in enumerate(losses) for c in ("_v", "_w")])
    sums = [F.sum(f"{c}{k}").alias(f"{c}{k}") for k in range(len(losses)) for c in ("_v", "_w")]
    b = s.groupBy("batch_id").agg(*sums, F.count("*").alias("_n"))
    here = F.col("batch_id").isNotNull()
    value = [F.when(here, F.try_divide(f"_v{k}", f"_w{k}")) for k in range(len(losses))]
    total = reduce(lambda x, y: x + y, [F.coalesce(v, F.lit(0.0)) * float(w) for v, (_, _, w) in zip(value, losses.values())])
    return b.agg(
        F.avg(F.when(here, total)).alias("total"), *[F.avg(v).alias(n) for v, n in zip(value, losses)], *[F.try_divide(F.sum(f"_v{k}"), F.sum(f"_w{k}")).alias(f"{n}_all") for k, n in enumerate(losses)],
        F.count("batch_id").alias("n_batches"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_samples"), F.coalesce(F.sum(F.when(~here, F.col("_n"))), F.lit(0)).alias("n_unbatched"),
    )


def check_pairing(pred: DataFrame, label: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(problem, detail): missing columns, differing types, keys without a partner; none if the tables match."""
    spark, rows = pred.sparkSession, []
    for c in columns:
        for side, df in (("prediction", pred), ("label", label)):
            if c not in df.columns:
                rows.append((f"no {c} in the {side}", c))
        if c in pred.columns and c in label.columns and pred.schema[c].dataType != label.schema[c].dataType:
            rows.append((f"types of {c} differ", f"{pred.schema[c].dataType.simpleString()} {label.schema[c].dataType.simpleString()}"))
    out = spark.createDataFrame(rows, "problem string, detail string")
    key = F.concat_ws(",", *keys)
    for problem, a, b in (("prediction without label", pred, label), ("label without prediction", label, pred)):
        out = out.unionByName(a.select(*keys).join(b.select(*keys), list(keys), "left_anti").select(F.lit(problem).alias("problem"), key.alias("detail")))
    return out
