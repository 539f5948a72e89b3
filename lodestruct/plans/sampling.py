"""Mixing, sampling and batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as G
from ..operators import structures as O
from ..operators import transforms as T
from ..sources import views
from ..structures import FORCE, POSITION
from .common import BASE, A, B, C, rounded
from .registry import query

NAMES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_MIX = f"""{BASE}, mixed AS (SELECT system_id, energy, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], dataset)::INT - 1 AS dataset_id,
  row_number() OVER (PARTITION BY dataset ORDER BY system_id) - 1 AS local_index, row_number() OVER (ORDER BY dataset, system_id) - 1 AS global_index FROM systems)"""


def _mixed(spark, d):
    s = views.systems(spark, d)
    return G.mix([s.filter(F.col("dataset") == n) for n in NAMES])


@query(f"{_MIX} SELECT system_id, dataset_id, local_index, global_index FROM mixed")
def mix_datasets(spark, d):
    return _mixed(spark, d).select("system_id", "dataset_id", "local_index", "global_index")


@query(f"{_MIX}, w AS (SELECT c_custkey AS ordinal, c_custkey * 31 % (SELECT count(*) FROM orders) AS g FROM customer) SELECT ordinal, dataset_id, local_index FROM w JOIN mixed ON global_index = CASE WHEN ordinal % 2 = 0 THEN g ELSE (SELECT count(*) FROM orders) - 1 - g END")
def mix_locate(spark, d):
    mixed = _mixed(spark, d)
    g = F.col("c_custkey") * 31 % mixed.count()
    wanted = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("ordinal"), F.when(F.col("c_custkey") % 2 == 0, g).otherwise(-1 - g).alias("global_index"))
    return G.locate(mixed, wanted)


@query("""SELECT dataset_id, (f + (rank <= 1000 - sum(f) OVER ())::INT)::BIGINT AS quota FROM (SELECT *, row_number() OVER (ORDER BY s - f DESC, dataset_id) AS rank FROM (
  SELECT dataset_id, s, floor(s) AS f FROM (SELECT (row_number() OVER (ORDER BY p) - 1)::INT AS dataset_id, n * 1000.0e0 / sum(n) OVER () AS s FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY o_orderpriority))))""")
def allocate(spark, d):
    n = _mixed(spark, d).groupBy("dataset_id").agg(F.count("*").cast("double").alias("weight"))
    return G.allocate(n, 1000)


@query(f"{_MIX}, q AS (SELECT unnest([0, 1, 2]) AS dataset_id, unnest([100, 50, 50]) AS quota), k AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY md5('3-0-' || dataset_id || '-' || local_index), local_index) AS k FROM mixed) SELECT dataset_id, local_index FROM k JOIN q USING (dataset_id) WHERE k <= quota")
def weighted_sample(spark, d):
    """Without replacement."""
    return G.weighted_sample(_mixed(spark, d), {0: 2.0, 1: 1.0, 2: 1.0}, 200, replacement=False, seed=3).select("dataset_id", "local_index")


_U = "(('0x' || substr(md5('5-0-{0}-' || draw), 1, 12))::UBIGINT)::DOUBLE / 281474976710656.0e0"


@query(f"{_MIX}, n AS (SELECT dataset_id, count(*) AS n FROM mixed GROUP BY ALL), dr AS (SELECT draw, {_U.format('dataset')} AS u, {_U.format('row')} AS v FROM (SELECT unnest(range(0, 5000)) AS draw)), p AS (SELECT draw, v, CASE WHEN u < 0.5 THEN 0 WHEN u < 0.75 THEN 1 ELSE 2 END AS dataset_id FROM dr) SELECT draw, dataset_id::INT AS dataset_id, floor(v * n)::BIGINT AS local_index FROM p JOIN n USING (dataset_id)")
def weighted_draws(spark, d):
    """With replacement, shuffled."""
    return G.weighted_sample(_mixed(spark, d), {0: 2.0, 1: 1.0, 2: 1.0}, 5000, seed=5)


@query(f"""{_MIX}, k AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY md5('0-0-' || dataset_id || '-' || local_index), local_index) - 1 AS r, count(*) OVER (PARTITION BY dataset_id) AS n FROM mixed),
b AS (SELECT min(n // 4) AS batches FROM k) SELECT r // 4 AS batch_id, dataset_id, local_index FROM k, b WHERE r // 4 < batches""")
def mixed_batches(spark, d):
    return G.mixed_batches(_mixed(spark, d), 20)


_SH = "s AS (SELECT o_orderkey AS system_id, row_number() OVER (ORDER BY md5('1-2-' || o_orderkey), o_orderkey) - 1 AS position FROM orders)"


@query(f"WITH {_SH} SELECT system_id, position FROM s")
def shuffle_epoch(spark, d):
    return G.shuffle(views.systems(spark, d).select("system_id"), 1, 2)


@query(f"WITH {_SH}, a AS (SELECT * FROM s UNION ALL SELECT system_id, position + (SELECT count(*) FROM orders) FROM s WHERE position < (19 - (SELECT count(*) FROM orders) % 19) % 19) SELECT system_id, position, position % 19 AS reader, position // 19 AS turn FROM a")
def shard_epoch(spark, d):
    """All 19 readers get as many rows: some of the head come again."""
    return G.shard(G.shuffle(views.systems(spark, d).select("system_id"), 1, 2), 19)


@query(f"WITH {_SH} SELECT system_id, position, position // 64 AS batch_id FROM s WHERE position // 64 < (SELECT count(*) FROM orders) // 64")
def plain_batches(spark, d):
    return G.batches(G.shuffle(views.systems(spark, d).select("system_id"), 1, 2), 64, drop_last=True)


@query(f"""{BASE}, n AS (SELECT *, sqrt(fx * fx + fy * fy + fz * fz) AS n FROM atoms) SELECT system_id, atom_id,
  round(x + 60 - {A} * floor((x + 60) / {A}), 6) AS x, round(y - 20 - {B} * floor((y - 20) / {B}), 6) AS y, round(z_pos - {C} * floor(z_pos / {C}), 6) AS z_pos,
  round(CASE WHEN n > 30 THEN fx * 30 / n ELSE fx END, 6) AS fx, round(CASE WHEN n > 30 THEN fy * 30 / n ELSE fy END, 6) AS fy, round(CASE WHEN n > 30 THEN fz * 30 / n ELSE fz END, 6) AS fz FROM n""")
def transform_samples(spark, d):
    """Atoms moved away, wrapped into their cells, and their forces clamped, as one chain."""
    away = T.sample_step(lambda ss: ss.with_(atoms=ss.atoms.withColumns({"x": F.col("x") + 60, "y": F.col("y") - 20})))
    chain = T.Transforms([away, O.wrap_positions, lambda ss: ss.with_(atoms=O.clamp_norm(ss.atoms, FORCE, 30.0))])
    return rounded(chain(views.structures(spark, d)).atoms.select("system_id", "atom_id", *POSITION, *FORCE), *POSITION, *FORCE)


@query(f"""{BASE}, {_SH}, b AS (SELECT system_id, position // 64 AS batch_id FROM s),
m AS (SELECT batch_id, avg(energy) AS mean FROM systems JOIN b USING (system_id) GROUP BY ALL),
g AS (SELECT batch_id, sqrt(avg(fx * fx + fy * fy + fz * fz)) AS rms FROM atoms JOIN b USING (system_id) GROUP BY ALL),
f AS (SELECT system_id, max(sqrt(fx * fx + fy * fy + fz * fz)) AS top FROM atoms GROUP BY ALL)
SELECT system_id, batch_id, round(energy - mean, 8) AS energy, round(top / rms, 6) AS top FROM systems JOIN b USING (system_id) JOIN m USING (batch_id) LEFT JOIN g USING (batch_id) LEFT JOIN f USING (system_id)""")
def transform_batches(spark, d):
    """Energies less their batch's mean and forces over their batch's root mean square; of each system the longest force that results."""
    ss = views.structures(spark, d)
    batched = T.with_batches(ss, G.batches(G.shuffle(ss.systems.select("system_id"), 1, 2), 64))
    out = batched.transform(T.less_batch_mean("energy"), T.over_batch_rms(*FORCE))
    top = out.atoms.groupBy("system_id").agg(F.max(F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy") + F.col("fz") * F.col("fz"))).alias("top"))
    found = out.systems.select("system_id", "batch_id", "energy").join(top, "system_id", "left")
    return rounded(rounded(found, "energy", digits=8), "top")  # cents over 64 have eight decimals: fewer would round at ties


@query(f"{BASE} SELECT s.system_id, count(atom_id) AS num_atoms, count(atom_id) // 4 AS bin FROM systems s LEFT JOIN atoms USING (system_id) GROUP BY ALL")
def size_bins(spark, d):
    return G.size_bins(O.sizes(views.structures(spark, d)), 100, width=4).select("system_id", "num_atoms", "bin")


def _sharded(spark, d):
    return G.size_bins(O.sizes(views.structures(spark, d)), 100, width=4).withColumn("shard", F.floor(F.col("system_id") / 500))


@query()
def pack_initial(spark, d):
    return G.pack_initial(_sharded(spark, d), (64, 1000, 12))


@query()
def refill_budget(spark, d):
    pool = _sharded(spark, d)
    used = pool.groupBy("shard").agg(F.lit(20).alias("num_atoms"), F.lit(0).alias("num_edges"), F.lit(3).alias("n"))
    return G.refill(pool, used, (64, 1000, 12))
