"""Losses and monitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.special import weight_at
from ..operators import metrics as M
from ..operators import monitors as H
from ..operators import sampling as G
from ..operators import structures as O
from ..sources import sinks, views
from ..streaming import monitors as S
from .common import BASE, folder, r, rounded
from .registry import query

# Predictions: an energy off by a tenth of a percent of odd systems, forces off by a hundredth of the quantity.
_E = "e AS (SELECT system_id, energy, CASE WHEN system_id % 2 = 1 THEN energy * 1.001e0 ELSE energy + 0.5e0 END AS pred FROM systems), n AS (SELECT system_id, count(*) AS n FROM atoms GROUP BY ALL)"
_R = "res AS (SELECT a.system_id, a.atom_id, 0.01e0 * (x - 25) AS dx, 0.002e0 * y AS dy, 0.003e0 * z_pos AS dz FROM atoms a)"


def _energies(spark, d):
    label = views.systems(spark, d).select("system_id", "energy")
    return label.withColumn("energy", F.when(F.col("system_id") % 2 == 1, F.col("energy") * 1.001).otherwise(F.col("energy") + 0.5)), label


def _forces(spark, d):
    a = views.atoms(spark, d)
    label = a.select("system_id", "atom_id", "fx", "fy", "fz", "category")
    return a.select("system_id", "atom_id", (F.col("fx") + 0.01 * (F.col("x") - 25)).alias("fx"), (F.col("fy") + 0.002 * F.col("y")).alias("fy"), (F.col("fz") + 0.003 * F.col("z_pos")).alias("fz")), label


def _sizes(spark, d):
    return O.sizes(views.structures(spark, d))


def _value(df, digits=6):
    return df.select(r("value", digits).alias("value"), r("weight", digits).alias("weight"))


def _huber(x: str, delta: str = "0.01e0") -> str:
    return f"(CASE WHEN abs({x}) <= {delta} THEN 0.5e0 * ({x}) * ({x}) ELSE {delta} * (abs({x}) - 0.5e0 * {delta}) END)"


@query(f"{BASE}, {_E} SELECT round(avg((pred - energy) ** 2), 4) AS value, round(count(*), 4) AS weight FROM e")
def energy_mse(spark, d):
    return _value(M.energy_mse(*_energies(spark, d)), 4)


@query(f"{BASE}, {_E} SELECT round(sum(n * abs((pred - energy) / n)) / sum(n), 6) AS value, round(sum(n), 6)::DOUBLE AS weight FROM e JOIN n USING (system_id)")
def energy_mae(spark, d):
    """Per atom."""
    return _value(M.energy_mae(*_energies(spark, d), sizes=_sizes(spark, d)))


@query(f"{BASE}, {_E} SELECT round(avg({_huber('pred - energy')}), 6) AS value, round(count(*), 6) AS weight FROM e WHERE system_id % 7 <> 0")
def energy_huber(spark, d):
    """Labels that are not finite are left out."""
    pred, label = _energies(spark, d)
    holes = label.withColumn("energy", F.when(F.col("system_id") % 7 == 0, float("nan")).otherwise(F.col("energy")))
    return _value(M.energy_huber(pred, holes, ignore_nonfinite=True))


@query(f"{BASE}, {_R}, s AS (SELECT system_id, sum(dx * dx + dy * dy + dz * dz) / (3 * count(*)) AS m FROM res GROUP BY ALL) SELECT round(avg(m), 7) AS value, round(count(*), 7) AS weight FROM s")
def force_mse_balanced(spark, d):
    return _value(M.force_mse(*_forces(spark, d)), 7)


@query(f"{BASE}, {_R} SELECT round(sum({_huber('dx')} + {_huber('dy')} + {_huber('dz')}) / (3 * count(*)), 7) AS value, round(3 * count(*), 7) AS weight FROM res")
def force_huber(spark, d):
    return _value(M.force_huber(*_forces(spark, d), per_system=False), 7)


@query(f"{BASE}, {_R}, s AS (SELECT system_id, avg(sqrt(dx * dx + dy * dy + dz * dz)) AS m FROM res JOIN atoms USING (system_id, atom_id) WHERE category = 1 GROUP BY ALL) SELECT round(avg(m), 7) AS value, round(count(*), 7) AS weight FROM s")
def force_l2(spark, d):
    """Atoms of one category only."""
    pred, label = _forces(spark, d)
    return _value(M.force_l2(pred, label.withColumn("use", F.col("category") == 1), mask="use"), 7)


def _stresses(spark, d):
    """Labels from the cell, predictions off by what each system's energy and key say."""
    s = views.systems(spark, d)
    off = F.col("energy") / 1e7 + (F.col("system_id") % 5) * 0.004
    return s.select("system_id", F.transform("cell", lambda c: c * 1.0 + off).alias("stress")), s.select("system_id", F.col("cell").alias("stress"))


_OFF = "(energy / 1e7 + (system_id % 5) * 0.004e0)"


@query(f"{BASE} SELECT round(avg({_OFF} ** 2), 9) AS value, round(count(*), 7) AS weight FROM systems")
def stress_mse(spark, d):
    return _value(M.stress_mse(*_stresses(spark, d)), 9)


@query(f"{BASE} SELECT round(avg({_huber(_OFF)}), 9) AS value, round(count(*), 7) AS weight FROM systems")
def stress_huber(spark, d):
    return _value(M.stress_huber(*_stresses(spark, d)), 9)


@query(f"""{BASE}, {_E}, {_R}, m AS (SELECT 'energy' AS name, avg(abs(pred - energy)) AS unweighted, 2.0e0 AS weight FROM e UNION ALL SELECT 'force', avg(m), 10.0e0 FROM (SELECT sum(dx * dx + dy * dy + dz * dz) / (3 * count(*)) AS m FROM res GROUP BY system_id)),
w AS (SELECT *, unweighted * weight AS weighted FROM m UNION ALL SELECT 'total', NULL, NULL, sum(unweighted * weight) FROM m) SELECT name, round(unweighted, 6) AS unweighted, weight, round(weighted, 6) AS weighted FROM w""")
def compose_metrics(spark, d):
    parts = {"energy": (M.energy_mae(*_energies(spark, d)), 2.0), "force": (M.force_mse(*_forces(spark, d)), 10.0)}
    return rounded(M.compose_metrics(parts), "unweighted", "weighted")


@query("""SELECT user_id AS system_id, step, round(1 + 2 * least(step / 40.0e0, 1), 9) AS linear, round(1 + 2 * 0.5e0 * (1 - cos(least(step / 40.0e0, 1) * pi())), 9) AS cosine, CASE WHEN step >= 30 THEN 0.1e0 WHEN step >= 10 THEN 0.5e0 ELSE 1.0e0 END AS piecewise
FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS step FROM events)""")
def weight_schedules(spark, d):
    t, step = views.trajectory(spark, d), F.col("step")
    p = {"start": 1.0, "end": 3.0, "steps": 40}
    return t.select("system_id", "step", r(weight_at(step, "linear", **p), 9).alias("linear"), r(weight_at(step, "cosine", **p), 9).alias("cosine"), weight_at(step, "piecewise", boundaries=[10, 30], values=[1.0, 0.5, 0.1]).alias("piecewise"))


@query(f"""{BASE}, {_E}, s AS (SELECT system_id // 64 AS batch_id, ((pred - energy) / n) ** 2 AS v FROM e JOIN n USING (system_id)), b AS (SELECT batch_id, avg(v) AS v, count(*) AS c FROM s GROUP BY ALL)
SELECT round(3 * avg(v), 4) AS total, round(avg(v), 4) AS energy, round(sum(v * c) / sum(c), 4) AS per_sample, count(*) AS n_batches, sum(c)::BIGINT AS n_samples FROM b""")
def evaluate(spark, d):
    pred, label = _energies(spark, d)
    batches = label.select("system_id", F.expr("system_id div 64").alias("batch_id"))
    return rounded(M.evaluate(pred, label, _sizes(spark, d), batches, {"energy": 3.0}), "total", "energy", "per_sample", digits=4)


@query(f"""{BASE}, {_E}, {_R}, f AS (SELECT system_id, sum(dx * dx + dy * dy + dz * dz) / (3 * count(*)) AS v FROM res GROUP BY ALL),
s AS (SELECT system_id, system_id // 64 AS batch_id, ((pred - e.energy) / n) ** 2 AS energy, coalesce(f.v, 0) AS f0, f.v AS force, {_OFF.replace('energy', 'e.energy').replace('system_id', 'e.system_id')} ** 2 AS stress FROM e LEFT JOIN n USING (system_id) LEFT JOIN f USING (system_id)),
b AS (SELECT batch_id, avg(energy) AS e, avg(force) AS f, avg(stress) AS t, sum(coalesce(energy, 0) + f0 + stress) AS w, count(*) AS c FROM s GROUP BY ALL)
SELECT round(avg(2 * coalesce(e, 0) + 10 * coalesce(f, 0) + 0.5e0 * t), 4) AS total, round(avg(e), 4) AS energy, round(avg(f), 4) AS force, round(avg(t), 9) AS stress, round(sum(w) / sum(c), 4) AS per_sample, count(*) AS n_batches, sum(c)::BIGINT AS n_samples FROM b""")
def evaluate_all(spark, d):
    """Energy, force and stress together."""
    (pe, le), (pf, lf), (ps, ls) = _energies(spark, d), _forces(spark, d), _stresses(spark, d)
    batches = le.select("system_id", F.expr("system_id div 64").alias("batch_id"))
    out = M.evaluate({"energy": pe, "force": pf, "stress": ps}, {"energy": le, "force": lf, "stress": ls}, _sizes(spark, d), batches, {"energy": 2.0, "force": 10.0, "stress": 0.5})
    return rounded(rounded(out, "total", "energy", "force", "per_sample", digits=4), "stress", digits=9)


@query(f"""{BASE}, {_E}, {_R}, es AS (SELECT system_id, abs(pred - energy) AS mae, n::DOUBLE AS n, abs(pred - energy) / (1 + abs(energy)) AS own FROM e JOIN n USING (system_id)),
fs AS (SELECT system_id, sum(dx * dx + dy * dy + dz * dz) / (3 * count(*)) AS mse, sum(sqrt(dx * dx + dy * dy + dz * dz)) AS l2, count(*)::DOUBLE AS c FROM res GROUP BY ALL),
s AS (SELECT CASE WHEN e.system_id % 10 <> 3 THEN e.system_id // 64 END AS batch_id, mae, n, own, pred, energy, mse, l2, c FROM e LEFT JOIN es USING (system_id) LEFT JOIN fs USING (system_id)),
o AS (SELECT *, abs(pred - energy) / (1 + abs(energy)) AS rel FROM s),
b AS (SELECT batch_id, sum(mae) AS a, sum(n) AS an, sum(mse) AS f, count(mse) AS fn, sum(l2) AS l, sum(c) AS ln, sum(rel) AS o, count(*) AS k FROM o GROUP BY ALL)
SELECT round(avg(CASE WHEN batch_id IS NOT NULL THEN 2 * coalesce(a / an, 0) + 10 * coalesce(f / fn, 0) + 0.5e0 * coalesce(l / ln, 0) + 4 * o / k END), 4) AS total, round(avg(CASE WHEN batch_id IS NOT NULL THEN a / an END), 4) AS energy,
  round(avg(CASE WHEN batch_id IS NOT NULL THEN f / fn END), 6) AS force, round(avg(CASE WHEN batch_id IS NOT NULL THEN l / ln END), 6) AS length, round(avg(CASE WHEN batch_id IS NOT NULL THEN o / k END), 6) AS own,
  round(sum(a) / sum(an), 4) AS energy_all, round(sum(f) / sum(fn), 6) AS force_all, round(sum(l) / sum(ln), 6) AS length_all, round(sum(o) / sum(k), 6) AS own_all,
  count(batch_id) AS n_batches, sum(k)::BIGINT AS n_samples, coalesce(sum(CASE WHEN batch_id IS NULL THEN k END), 0)::BIGINT AS n_unbatched FROM b""")
def evaluate_losses(spark, d):
    """Absolute error per atom, two losses of forces and a metric of one's own; a tenth of the systems has no batch."""
    (pe, le), (pf, lf) = _energies(spark, d), _forces(spark, d)
    own = M.Metric(["system_id"], ["energy"], lambda p, t: F.abs(p["energy"] - t["energy"]) / (1 + F.abs(t["energy"])))
    losses = {"energy": ("energy", M.Loss("energy", "absolute", sizes=_sizes(spark, d)), 2.0), "force": ("force", M.Loss("force"), 10.0), "length": ("force", M.Loss("force", "absolute", balanced=False), 0.5), "own": ("energy", own, 4.0)}
    batches = le.filter("system_id % 10 <> 3").select("system_id", F.expr("system_id div 64").alias("batch_id"))
    out = M.evaluate_losses({"energy": pe, "force": pf}, {"energy": le, "force": lf}, losses, batches)
    return rounded(rounded(out, "total", "energy", "energy_all", digits=4), "force", "length", "own", "force_all", "length_all", "own_all")


@query("SELECT 'prediction without label' AS problem, o_orderkey::VARCHAR AS detail FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT 'label without prediction', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0 UNION ALL SELECT 'types of energy differ', 'double float'")
def check_pairing(spark, d):
    pred, label = _energies(spark, d)
    a = pred.filter("not (system_id % 13 = 0 and system_id % 11 <> 0)")
    return M.check_pairing(a, label.filter("system_id % 11 <> 0").withColumn("energy", F.col("energy").cast("float")), ["system_id"], ["energy"])


# ---- monitors


def _log(spark, d):
    """Systems and atoms as a log of steps: each order's step is its key modulo ten."""
    ss = views.structures(spark, d)
    step = (F.col("system_id") % 10).alias("step")
    return ss.systems.select("*", step), ss.atoms.select("*", step)


@query(f"""{BASE}, o AS (SELECT system_id % 10 AS step, system_id, energy, max(sqrt(fx * fx + fy * fy + fz * fz)) AS fmax, sum(0.5e0 * mass * (vx * vx + vy * vy + vz * vz)) AS ke, count(atom_id) AS n FROM systems LEFT JOIN atoms USING (system_id) GROUP BY ALL)
SELECT step, system_id, energy, round(fmax, 6) AS fmax, round(CASE WHEN n = 0 THEN 0 ELSE 2 * ke / (3 * n * {H.KB!r}) END, 3) AS temperature FROM o WHERE step % 2 = 0""")
def observables(spark, d):
    return rounded(rounded(H.observables(*_log(spark, d), every=2), "fmax"), "temperature", digits=3)


_DRIFT = f"{BASE}, t AS (SELECT system_id, step, abs(energy - first_value(energy) OVER (PARTITION BY system_id ORDER BY step)) AS drift FROM trajectory)"


@query(f"{_DRIFT} SELECT step, round(max(drift), 6) AS max_drift, max(drift) > 100 AS alarm FROM t GROUP BY ALL")
def energy_drift(spark, d):
    return rounded(H.energy_drift(views.trajectory(spark, d), 100.0), "max_drift")


@query(f"{_DRIFT} SELECT system_id, step, round(drift / (3 * greatest(step, 1)), 6) AS drift FROM t")
def drift_per_atom(spark, d):
    t = views.trajectory(spark, d)
    return rounded(H.drift(t, "per_atom_per_step", t.select("system_id", F.lit(3).alias("num_atoms")).distinct()), "drift")


@query(f"{BASE} SELECT system_id, max(sqrt(fx * fx + fy * fy + fz * fz)) <= 60 AND min(x) <= 20 AND sqrt(sum(vx * vx)) <= 4 AS converged FROM atoms GROUP BY ALL")
def converged(spark, d):
    a = views.atoms(spark, d)
    force = F.sqrt(F.col("fx") ** 2 + F.col("fy") ** 2 + F.col("fz") ** 2)
    return H.converged(a, {"fmax": (force, "max", 60.0), "low": (F.col("x"), "min", 20.0), "v": (F.col("vx"), "norm", 4.0)})


@query(f"{BASE} SELECT s.system_id, CASE WHEN (SELECT count(*) FROM atoms a WHERE a.system_id = s.system_id AND x > 40) = 0 AND s.system_id IN (SELECT system_id FROM atoms) THEN 9 ELSE 1 END AS status FROM systems s")
def set_status(spark, d):
    ss = views.structures(spark, d)
    return H.set_status(ss.systems.select("system_id", F.lit(1).alias("status")), H.converged(ss.atoms, {"x": (F.col("x"), "max", 40.0)}), 1, 9)


@query(f"{BASE} SELECT system_id, 'fx' AS \"column\", count(*) AS n FROM atoms WHERE x = 7 GROUP BY ALL UNION ALL SELECT system_id, 'energy', 1 FROM systems WHERE system_id % 100 = 0")
def find_nonfinite(spark, d):
    ss = views.structures(spark, d)
    bad = ss.with_(atoms=ss.atoms.withColumn("fx", F.when(F.col("x") == 7, float("nan")).otherwise(F.col("fx"))), systems=ss.systems.withColumn("energy", F.when(F.col("system_id") % 100 == 0, float("inf")).otherwise(F.col("energy"))))
    return H.find_nonfinite(bad)


@query(f"{BASE} SELECT system_id, step, energy FROM trajectory WHERE step % 7 = 0")
def snapshots(spark, d):
    return H.snapshots(views.trajectory(spark, d), 7).select("system_id", "step", "energy")


_FIRST = f"{BASE} SELECT system_id, step, energy FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY step) AS k FROM trajectory WHERE energy <= 5) WHERE k = 1"


@query(_FIRST)
def first_converged(spark, d):
    return H.first_converged(views.trajectory(spark, d), F.col("energy") <= 5).select("system_id", "step", "energy")


_STAGE = f"{BASE}, g AS (SELECT system_id, lag(stage) OVER w || '->' || stage AS transition, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS s FROM trajectory WINDOW w AS (PARTITION BY system_id ORDER BY ts))"


@query(f"{_STAGE} SELECT transition, count(*) AS n, round(avg(s), 6) AS mean, round(coalesce(stddev_samp(s), 0), 4) AS std, round(min(s), 6) AS min, round(max(s), 6) AS max, round(sum(s), 6) AS total FROM g WHERE transition IS NOT NULL GROUP BY ALL")
def stage_timing(spark, d):
    return rounded(rounded(H.stage_timing(views.trajectory(spark, d)), "std", digits=4), "mean", "min", "max", "total")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(spark, d):
    return H.status_counts(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderstatus").alias("status")), "F")


@query("SELECT count(*) FILTER (o_orderstatus <> 'F') AS active, count(*) FILTER (o_orderstatus = 'F') AS graduated, round(avg((o_orderstatus <> 'F')::INT), 9) AS active_fraction, round(avg((o_orderstatus = 'F')::INT), 9) AS graduated_fraction FROM orders")
def graduation(spark, d):
    df = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderstatus").alias("status"))
    return rounded(H.graduation(df, "F"), "active_fraction", "graduated_fraction", digits=9)


@query(f"""{BASE}, a AS (SELECT system_id % 10 AS step, max(sqrt(fx * fx + fy * fy + fz * fz)) AS f, 2 * sum(0.5e0 * mass * (vx * vx + vy * vy + vz * vz)) / (3 * count(*) * {H.KB!r}) AS t FROM atoms GROUP BY ALL), s AS (SELECT system_id % 10 AS step, avg(energy) AS e, count(*) AS n FROM systems GROUP BY ALL)
SELECT step, round(e, 3) AS mean_energy, n, round(f, 6) AS max_force, round(t, 3) AS temperature FROM s LEFT JOIN a USING (step)""")
def step_scalars(spark, d):
    return rounded(rounded(H.scalars(*_log(spark, d)), "mean_energy", "temperature", digits=3), "max_force")


@query(f"{BASE} SELECT max(step) AS step, round(least(max(step) / 200.0e0, 1), 9) AS fraction, round((max(step) - min(step)) / ((max(m) - min(m)) / 1e6), 9) AS rate FROM (SELECT step, max(epoch_us(ts)) AS m FROM trajectory GROUP BY ALL)")
def progress(spark, d):
    return rounded(H.progress(views.trajectory(spark, d), 200), "fraction", "rate", digits=9)


@query(f"{BASE} SELECT system_id, step, energy FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY step DESC) AS k FROM trajectory) WHERE k <= 3")
def recent(spark, d):
    return H.recent(views.trajectory(spark, d), 3, "system_id").select("system_id", "step", "energy")


@query(f"{BASE} SELECT system_id, step, name, value FROM (SELECT system_id, step, unnest(['loss/energy', 'loss/step']) AS name, unnest([energy, step]) AS value FROM trajectory)")
def flatten_scalars(spark, d):
    t = views.trajectory(spark, d).select("system_id", "step", F.struct(F.create_map(F.lit("energy"), F.col("energy"), F.lit("step"), F.col("step").cast("double")).alias("loss"), F.lit("text").alias("note")).alias("s"))
    return H.flatten_scalars(t, "s", ("system_id", "step")).filter("value is not null")


# ---- the same monitors as streams, run over what is there


_SLICES = 4


def _streamed(spark, d, make):
    """The events as they might arrive, up to a slice late and in no order inside one; read as a stream to its end. Returns what the stream wrote.

    Files of a slice are written by all tasks, and a slice is a micro-batch. A last record, of no system and far ahead,
    lets the watermark pass all others.
    """
    source, out, sorted_ = folder(spark, "stream"), folder(spark, "streamed"), folder(spark, "arrivals")
    t = views.trajectory(spark, d).withColumns({"step": F.col("step").cast("long"), "ts": F.col("ts").cast("timestamp")}).withColumn("us", F.unix_micros("ts"))
    first, last = t.agg(F.min("us"), F.max("us")).first()
    width = (last - first) // _SLICES + 1
    late = F.pmod(F.xxhash64("system_id", "us"), F.lit(width))
    t.withColumn("slice", F.floor((F.col("us") - first + late) / width)).drop("us").write.partitionBy("slice").parquet(sorted_)
    arrivals = spark.read.parquet(sorted_)
    for k in range(_SLICES + 1):
        arrivals.filter(F.col("slice") == k).drop("slice").repartition(2, "system_id", "step").write.mode("append").parquet(source)
    end = spark.range(1).select(F.lit(-1).cast("long").alias("system_id"), F.lit(0).cast("long").alias("step"), F.timestamp_micros(F.lit(last + 10 * width)).alias("ts"), F.lit("end").alias("stage"), F.lit(0.0).alias("energy"))
    end.select(*[F.col(f.name).cast(f.dataType) for f in arrivals.drop("slice").schema]).write.mode("append").parquet(source)
    stream = spark.readStream.schema(arrivals.drop("slice").schema).option("maxFilesPerTrigger", 2).parquet(source)
    q = make(stream, f"{2 * width // 1000 + 1} milliseconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark, "progress")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@query(f"{_DRIFT} SELECT system_id, step, round(drift, 6) AS drift FROM t")
def stream_energy_drift(spark, d):
    return rounded(_streamed(spark, d, S.energy_drift_stream), "drift")


@query(_FIRST)
def stream_first_converged(spark, d):
    return _streamed(spark, d, lambda s, delay: S.first_converged_stream(s, F.col("energy") <= 5, delay))


@query(f"{_STAGE} SELECT system_id, transition, round(s, 6) AS seconds FROM g WHERE transition IS NOT NULL")
def stream_stage_timing(spark, d):
    return rounded(_streamed(spark, d, S.stage_timing_stream), "seconds")


@query(f"""{BASE}, run AS (SELECT system_id, system_id % 8 AS shard, system_id % 2 AS part, max(energy) AS top FROM trajectory GROUP BY ALL),
done AS (SELECT system_id, part FROM run WHERE top <= 5),
room AS (SELECT part, shard, 40 - count(*) AS room FROM run WHERE top > 5 GROUP BY ALL),
pool AS (SELECT o_orderkey AS system_id, o_orderkey % 8 AS shard FROM orders),
both_rooms AS (SELECT shard, part, coalesce(room, 40) AS room FROM (SELECT shard, unnest([1, 0]) AS part FROM (SELECT DISTINCT shard FROM pool)) LEFT JOIN room USING (shard, part)),
first_ AS (SELECT shard, system_id FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY system_id) AS k FROM pool WHERE system_id NOT IN (SELECT system_id FROM run WHERE part = 1)) JOIN both_rooms USING (shard) WHERE part = 1 AND k <= room),
second_ AS (SELECT shard, system_id FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY system_id) AS k FROM pool WHERE system_id NOT IN (SELECT system_id FROM run WHERE part = 0) AND system_id NOT IN (SELECT system_id FROM first_)) JOIN both_rooms USING (shard) WHERE part = 0 AND k <= room)
SELECT 'graduated' AS what, part + 0 AS batch, NULL::BIGINT AS shard, system_id FROM (SELECT system_id, 1 - part AS part FROM done) UNION ALL SELECT 'admitted', 0, shard, system_id FROM first_ UNION ALL SELECT 'admitted', 1, shard, system_id FROM second_""")
def stream_inflight(spark, d):
    """The replacement flow over two micro-batches, odd systems and then even ones: what has converged leaves, and what waits fills a shard up to 40 systems."""
    source, marks = folder(spark, "flow"), folder(spark, "marks")
    t = views.trajectory(spark, d).groupBy("system_id").agg(F.max("energy").alias("fmax")).withColumn("shard", F.col("system_id") % 8)
    for odd in (1, 0):
        t.filter(F.col("system_id") % 2 == odd).select(F.col("system_id").cast("long"), F.col("shard").cast("long"), "fmax").coalesce(1).write.mode("append").parquet(source)
    waiting = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("system_id"))
    sizes = waiting.unionByName(t.select(F.col("system_id").cast("long"))).distinct().select("system_id", F.lit(1).cast("long").alias("num_atoms"), F.lit(0).cast("long").alias("num_edges"))
    pool = G.size_bins(sizes.join(waiting, "system_id", "left_semi").withColumn("shard", F.col("system_id") % 8), 10)
    graduated, admitted = sinks.Sink(spark, folder(spark, "graduated")), sinks.Sink(spark, folder(spark, "admitted"))
    stream = spark.readStream.schema("system_id long, shard long, fmax double").option("maxFilesPerTrigger", 1).parquet(source)
    q = S.inflight(stream, pool, graduated, admitted, {"fmax": (F.col("fmax"), "max", 5.0)}, (None, 1, 40), sizes)
    q.option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    gone = graduated.read().select(F.lit("graduated").alias("what"), "batch", F.lit(None).cast("long").alias("shard"), "system_id")
    return gone.unionByName(admitted.read().select(F.lit("admitted").alias("what"), "batch", "shard", "system_id"))
