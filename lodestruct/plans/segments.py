"""Segmented aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments as S
from ..sources import views
from ..structures import FORCE, POSITION, VELOCITY
from .common import BASE, A, B, C, r, rounded
from .registry import query

_LEFT = "FROM systems s LEFT JOIN atoms USING (system_id) GROUP BY s.system_id"


@query(f"""{BASE} SELECT s.system_id, round(coalesce(sum(fx), 0), 9) AS sum_fx, round(coalesce(sum(x + y + z_pos), 0), 9) AS component_sum, round(coalesce(sum(fx * vx + fy * vy + fz * vz), 0), 9) AS dot,
  round(coalesce(sum(fx * fx + fy * fy + fz * fz), 0), 3) AS xx, round(coalesce(sum(vx * vx + vy * vy + vz * vz), 0), 9) AS yy, round(coalesce(max(sqrt(fx * fx + fy * fy + fz * fz)), 0), 9) AS max_norm,
  max(x) AS max_x, min(x) AS min_x, round(coalesce(avg(fx), 0), 9) AS mean_fx, round(coalesce(sqrt(avg(vx * vx + vy * vy + vz * vz)), 0), 9) AS rms_norm, count(atom_id) AS n {_LEFT}""")
def seg_stats(spark, d):
    ss = views.structures(spark, d)
    a, s = ss.atoms, ss.systems
    zero = S.per_system(a, S.sums(["fx"]) | S.component_sum(POSITION) | S.dots(FORCE, VELOCITY) | S.max_norm(FORCE) | S.means(["fx"]) | S.rms_norm(VELOCITY) | S.counts() | S.extremes(["x"]), of=s, empty=None)
    out = zero.drop("xy").na.fill(0, [c for c in zero.columns if c not in ("xy", "max_x", "min_x")])
    return rounded(rounded(out, "sum_fx", "component_sum", "dot", "yy", "max_norm", "mean_fx", "rms_norm", digits=9), "xx", digits=3)


@query(f"""{BASE} SELECT s.system_id, round(coalesce(sum(fx), 0), 9) AS sum_fx, round(coalesce(sum(fx * vx + fy * vy + fz * vz), 0), 9) AS xy, round(coalesce(sum(x + y + z_pos), 0), 9) AS component_sum, max(y) AS max_y, min(y) AS min_y, round(coalesce(avg(y), 0), 9) AS mean_y {_LEFT}""")
def seg_each(spark, d):
    """The same aggregates by their own functions, joined."""
    ss = views.structures(spark, d)
    a, s = ss.atoms, ss.systems
    parts = [S.seg_sum(a, ["fx"], of=s), S.seg_inner_products(a, FORCE, VELOCITY, of=s).select("system_id", "xy"), S.seg_component_sum(a, POSITION, of=s), S.seg_max(a, ["y"], of=s), S.seg_min(a, ["y"], of=s), S.seg_mean(a, ["y"], of=s)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "system_id")
    return rounded(out, "sum_fx", "xy", "component_sum", "mean_y", digits=9)


_COM = ", m AS (SELECT system_id, sum(mass * vx) / sum(mass) AS cx, sum(mass * vy) / sum(mass) AS cy, sum(mass * vz) / sum(mass) AS cz FROM atoms GROUP BY system_id)"


@query(f"{BASE}{_COM} SELECT system_id, atom_id, round(vx - cx, 9) AS vx, round(vy - cy, 9) AS vy, round(vz - cz, 9) AS vz FROM atoms JOIN m USING (system_id)")
def seg_center(spark, d):
    return rounded(S.remove_com(views.structures(spark, d)).atoms.select("system_id", "atom_id", *VELOCITY), *VELOCITY, digits=9)


@query(f"{BASE}, m AS (SELECT system_id, avg(x) AS m FROM atoms GROUP BY ALL) SELECT system_id, atom_id, round((x + m) * m, 6) AS x FROM atoms JOIN m USING (system_id)")
def seg_broadcast(spark, d):
    a = views.atoms(spark, d)
    m = S.per_system(a, {"m": F.avg("x")})
    return rounded(S.seg_mul(S.seg_add(a.select("system_id", "atom_id", "x"), m, "x", "m"), m, "x", "m"), "x")


@query(f"{BASE} SELECT a.system_id, atom_id, round(energy * x + 2 * y, 4) AS u, round(y + energy * x, 4) AS y FROM atoms a JOIN systems USING (system_id)")
def seg_axpby(spark, d):
    ss = views.structures(spark, d)
    v = ss.systems.select("system_id", "energy", F.lit(2.0).alias("two"))
    out = S.seg_axpby(ss.atoms.select("system_id", "atom_id", "x", "y"), v, "x", "y", "energy", "two", "u")
    return rounded(S.seg_axpy(out, v, "x", "y", "energy").select("system_id", "atom_id", "u", "y"), "u", "y", digits=4)


@query(f"{BASE} SELECT system_id, atom_id, x + 4 * y + 7 * z_pos AS ox, 2 * x + 5 * y + 8 * z_pos AS oy, 3 * x + 6 * y + 9 * z_pos AS oz FROM atoms JOIN systems USING (system_id)")
def seg_matvec(spark, d):
    ss = views.structures(spark, d)
    m = ss.systems.select("system_id", F.array(*[F.lit(float(k)) for k in range(1, 10)]).alias("m"))
    return S.seg_matvec(ss.atoms.select("system_id", "atom_id", *POSITION), m, POSITION, "m", ("ox", "oy", "oz")).select("system_id", "atom_id", "ox", "oy", "oz")


@query(f"""{BASE}, k AS (SELECT s.system_id, coalesce(sum(0.5e0 * mass * (vx * vx + vy * vy + vz * vz)), 0) AS ke, count(atom_id) AS n {_LEFT})
SELECT system_id, round(ke, 6) AS ke, round(CASE WHEN n = 0 THEN 0 ELSE 2 * ke / (3 * n * {S.KB!r}) END, 3) AS temperature FROM k""")
def seg_temperature(spark, d):
    return rounded(rounded(S.temperature(views.structures(spark, d)), "ke"), "temperature", digits=3)


@query(f"{BASE} SELECT s.system_id, round(coalesce(sum(mass * vx * vy), 0) / {A * B * C}, 9) AS pxy, round(coalesce(sum(mass * (vx * vx + vy * vy + vz * vz)), 0) / {A * B * C} / 3, 9) AS pressure {_LEFT}")
def seg_pressure(spark, d):
    return S.pressure(views.structures(spark, d)).select("system_id", r(F.col("tensor")[1], 9).alias("pxy"), r("pressure", 9).alias("pressure"))


@query("SELECT extract(hour FROM ts)::INT AS step, event_type AS name, round(max(value), 6) AS value FROM events GROUP BY ALL")
def reduce_snapshots(spark, d):
    e = views.trajectory(spark, d).select(F.hour("ts").alias("step"), F.col("stage").alias("name"), F.col("energy").alias("value"))
    return rounded(S.reduce_snapshots(e, "max"), "value")
