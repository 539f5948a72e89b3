"""Neighbour joins and partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbors as N
from ..operators import partition as P
from ..sources import views
from .common import BASE, A, B, C, pairs_sql, r, rounded
from .registry import query

PAIR_SQL = "system_id, i, j, sx, sy, sz, dx, dy, dz, round(r, 9) AS r"
GRID = (3, 1, 1)


def _pairs(spark, d, rc, mixed=False, **o):
    return N.neighbor_pairs(views.structures(spark, d, mixed), rc, **o)


@query(f"{BASE}, {pairs_sql(3.7)} SELECT {PAIR_SQL} FROM pairs")
def neighbor_pairs_naive(spark, d):
    return rounded(_pairs(spark, d, 3.7, method="naive"), "dx", "dy", "dz", "r", digits=9)


@query(f"{BASE}, {pairs_sql(8.3, open_z='NOT s.pbc_z')} SELECT {PAIR_SQL} FROM pairs")
def neighbor_pairs_grid_mixed(spark, d):
    return rounded(_pairs(spark, d, 8.3, True, method="grid"), "dx", "dy", "dz", "r", digits=9)


@query(f"{BASE}, {pairs_sql(9.5)} SELECT {PAIR_SQL} FROM pairs WHERE i = j")
def neighbor_self_images(spark, d):
    return rounded(_pairs(spark, d, 9.5, method="grid").filter("i = j"), "dx", "dy", "dz", "r", digits=9)


@query(f"{BASE}, {pairs_sql(3.7, images=0)} SELECT {PAIR_SQL} FROM pairs")
def neighbor_pairs_open(spark, d):
    return rounded(_pairs(spark, d, 3.7, pbc=False), "dx", "dy", "dz", "r", digits=9)


@query(f"{BASE}, {pairs_sql(8.3)} SELECT system_id, i AS atom_id, count(*) AS n_neighbors FROM pairs GROUP BY ALL")
def neighbor_count_grid(spark, d):
    return _pairs(spark, d, 8.3, method="grid").groupBy("system_id", F.col("i").alias("atom_id")).agg(F.count("*").alias("n_neighbors"))


@query(f"{BASE}, {pairs_sql(9.5, half=True)} SELECT {PAIR_SQL} FROM pairs")
def neighbor_pairs_half(spark, d):
    return rounded(_pairs(spark, d, 9.5, half=True), "dx", "dy", "dz", "r", digits=9)


@query(f"{BASE}, {pairs_sql(8.3)} SELECT system_id, i, j, sx, sy, sz, r < 3.7 AS in1, true AS in2 FROM pairs")
def neighbor_pairs_dual(spark, d):
    return N.neighbor_pairs_dual(views.structures(spark, d), 3.7, 8.3).select(*N.PAIR, "in1", "in2")


@query(f"{BASE}, {pairs_sql(8.3)} SELECT {PAIR_SQL} FROM pairs WHERE i = 0")
def neighbor_pairs_targets(spark, d):
    ss = views.structures(spark, d)
    return rounded(N.neighbor_pairs(ss, 8.3, targets=ss.atoms.filter("atom_id = 0")), "dx", "dy", "dz", "r", digits=9)


@query(f"{BASE}, {pairs_sql(3.7, half=True)} SELECT system_id, i, j, sx, sy, sz FROM pairs UNION ALL SELECT system_id, j, i, -sx, -sy, -sz FROM pairs")
def neighbor_mirror(spark, d):
    return N.mirror(_pairs(spark, d, 3.7, half=True)).select(*N.PAIR)


@query(f"""{BASE}, {pairs_sql(3.7)}, l AS (SELECT system_id, i AS atom_id, count(*)::INT AS n, string_agg(j, ',' ORDER BY j, sx, sy, sz) AS ids FROM pairs GROUP BY ALL)
SELECT system_id, atom_id, coalesce(n, 0) AS n, rtrim(coalesce(ids || ',', '') || repeat('-1,', 64 - coalesce(n, 0)), ',') AS neighbors FROM atoms LEFT JOIN l USING (system_id, atom_id)""")
def neighbor_matrix(spark, d):
    ss = views.structures(spark, d)
    return N.to_matrix(N.neighbor_pairs(ss, 3.7), ss.atoms, 64).select("system_id", "atom_id", "n", F.array_join("neighbors", ",").alias("neighbors"))


@query(f"{BASE}, {pairs_sql(3.7)} SELECT system_id, i, j, sx, sy, sz FROM pairs")
def neighbor_matrix_to_coo(spark, d):
    ss = views.structures(spark, d)
    return N.to_coo(N.to_matrix(N.neighbor_pairs(ss, 3.7), ss.atoms, 64))


@query(f"""{BASE}, {pairs_sql(3.7)}, n AS (SELECT system_id, i AS atom_id, count(*) AS n FROM pairs GROUP BY ALL)
SELECT system_id, atom_id, (sum(coalesce(n, 0)) OVER w - coalesce(n, 0))::BIGINT AS start, (sum(coalesce(n, 0)) OVER w)::BIGINT AS stop FROM atoms LEFT JOIN n USING (system_id, atom_id)
WINDOW w AS (PARTITION BY system_id ORDER BY atom_id)""")
def neighbor_csr(spark, d):
    ss = views.structures(spark, d)
    return N.to_csr(N.neighbor_pairs(ss, 3.7), ss.atoms)


@query(f"{BASE}, {pairs_sql(3.7)} SELECT system_id, i, j, sx, sy, sz FROM pairs ORDER BY ALL")
def order_pairs(spark, d):
    return N.order_pairs(_pairs(spark, d, 3.7).select(*N.PAIR))


@query(f"{BASE}, {pairs_sql(3.7)} SELECT system_id, i, j, sx, sy, sz, row_number() OVER (PARTITION BY system_id, i ORDER BY j, sx, sy, sz) - 1 AS rank FROM pairs")
def neighbor_rank(spark, d):
    return N.neighbor_rank(_pairs(spark, d, 3.7)).select(*N.PAIR, "rank")


@query(f"{BASE} SELECT system_id, floor({A} / 3.7)::INT AS nx, floor({B} / 3.7)::INT AS ny, floor({C} / 3.7)::INT AS nz, ceil(3.7 / {A} * floor({A} / 3.7))::INT AS mx FROM systems")
def neighbor_grid_spec(spark, d):
    s = N.grid_spec(views.systems(spark, d), 3.7)
    return s.select("system_id", *[F.col("n")[k].alias(f"n{a}") for k, a in enumerate("xyz")], F.col("reach")[0].alias("mx"))


@query(f"""{BASE}, b AS (SELECT system_id, floor(x / {A} * 13)::INT AS wx, floor(y / {B} * 2)::INT AS wy, floor(z_pos / {C} * 2)::INT AS wz FROM atoms),
c AS (SELECT system_id, ((wx % 13) + 13) % 13 AS bx, ((wy % 2) + 2) % 2 AS "by", ((wz % 2) + 2) % 2 AS bz, count(*) AS n_atoms FROM b GROUP BY ALL)
SELECT *, (sum(n_atoms) OVER (PARTITION BY system_id ORDER BY bx, "by", bz) - n_atoms)::BIGINT AS start FROM c""")
def neighbor_bin_counts(spark, d):
    ss = views.structures(spark, d)
    return N.bin_counts(N.bin_atoms(ss.atoms, N.grid_spec(ss.systems, 3.7)))


@query(f"{BASE} SELECT system_id, sx::INT AS sx, sy::INT AS sy, sz::INT AS sz FROM systems, (SELECT unnest(range(-1, 2)) AS sx), (SELECT unnest(range(-1, 2)) AS sy), (SELECT unnest(range(-2, 3)) AS sz)")
def neighbor_image_shifts(spark, d):
    return N.image_shifts(views.systems(spark, d), 9.5)


@query(f"{BASE}, n AS (SELECT system_id, count(*) AS n FROM atoms GROUP BY ALL) SELECT system_id, round(coalesce(n, 0) / {A * B * C}, 9) AS density, (greatest(1, ceil(coalesce(n, 0) / {A * B * C} * (4.0e0 / 3 * pi() * 8.3e0 ** 3) / 16)) * 16)::INT AS estimate FROM systems LEFT JOIN n USING (system_id)")
def neighbor_estimate(spark, d):
    return N.density(views.structures(spark, d)).select("system_id", r("density", 9).alias("density"), N.estimate_max_neighbors(F.col("density"), 8.3).alias("estimate"))


@query(f"{BASE} SELECT s.system_id, coalesce(max(x) - min(x), 0) + 7.4 AS lx, coalesce(max(y) - min(y), 0) + 7.4 AS ly, coalesce(max(z_pos) - min(z_pos), 0) + 7.4 AS lz FROM systems s LEFT JOIN atoms USING (system_id) GROUP BY ALL")
def neighbor_synthesize_cell(spark, d):
    ss = views.structures(spark, d)
    ss = ss.with_(systems=ss.systems.withColumn("cell", F.lit(None).cast("array<double>")))
    return N.synthesize_cell(ss, 3.7).systems.select("system_id", *[F.col("cell")[4 * k].alias(f"l{a}") for k, a in enumerate("xyz")])


_MOVED = "CASE WHEN z = 1 AND q > 0 THEN 0.6e0 ELSE 0.1e0 END"


def _moved(ss):
    return ss.with_(atoms=ss.atoms.withColumn("x", F.col("x") + F.when((F.col("z") == 1) & (F.col("q") > 0), 0.6).otherwise(0.1)))


@query(f"{BASE}, m AS (SELECT system_id, bool_or({_MOVED} > 0.5) AS f FROM atoms GROUP BY ALL) SELECT system_id, coalesce(f, false) AS rebuild FROM systems LEFT JOIN m USING (system_id)")
def neighbor_needs_rebuild(spark, d):
    ss = views.structures(spark, d)
    return N.needs_rebuild(ss.atoms, _moved(ss), 0.5)


@query(f"{BASE} SELECT system_id, bool_or(floor(x / {A} * 13) <> floor((x + {_MOVED}) / {A} * 13)) AS rebuild FROM atoms GROUP BY ALL")
def neighbor_bins_changed(spark, d):
    ss = views.structures(spark, d)
    spec = N.grid_spec(ss.systems, 3.7)
    return N.bins_changed(N.bin_atoms(ss.atoms, spec), N.bin_atoms(_moved(ss).atoms, spec))


@query(f"{BASE}, {pairs_sql(3.7)}, far AS (SELECT system_id, bool_or(z = 1 AND q > 0) AS hot FROM atoms GROUP BY ALL) SELECT system_id, i, j, sx, sy, sz FROM pairs JOIN far USING (system_id)")
def neighbor_refresh(spark, d):
    """Pairs of unmoved positions: cached ones and found ones together are all of them."""
    ss = views.structures(spark, d)
    cached = N.neighbor_pairs(ss, 3.7)
    return N.refresh_pairs(cached, ss, N.needs_rebuild(ss.atoms, _moved(ss), 0.5), 3.0, 0.7).select(*N.PAIR)


@query(f"{BASE} SELECT system_id, atom_id, (((floor(x / {A} * 3)::INT % 3) + 3) % 3)::INT AS part FROM atoms")
def partition_spatial(spark, d):
    return P.spatial_partition(views.structures(spark, d), 3, GRID, place=True).select("system_id", "atom_id", "part")


@query("SELECT o_orderkey AS index, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::INT AS part FROM orders")
def partition_index(spark, d):
    from ..functions.order import dense_index

    rows = dense_index(views.systems(spark, d).select("system_id"), "system_id", "index")
    return P.index_partition(rows, 7).select(F.col("system_id").alias("index"), "part")


_HALO = f"""f AS (SELECT system_id, atom_id, x / {A} - floor(x / {A}) AS f FROM atoms),
p AS (SELECT system_id, atom_id, floor(f * 3)::INT AS owner, dom FROM f, (SELECT unnest(range(0, 3)) AS dom), (SELECT unnest(range(-1, 2)) AS img)
  WHERE f + img >= dom / 3.0e0 - 4.3e0 / {A} AND f + img <= (dom + 1) / 3.0e0 + 4.3e0 / {A})"""


@query(f"{BASE}, {_HALO} SELECT DISTINCT system_id, atom_id, owner, dom::INT AS domain, owner = dom AS owned FROM p")
def partition_halo(spark, d):
    return P.with_halo(views.structures(spark, d), 4.3, GRID).select("system_id", "atom_id", "owner", "domain", "owned")


@query(f"{BASE}, {_HALO}, u AS (SELECT DISTINCT * FROM p) SELECT system_id, atom_id, owner, count(*)::DOUBLE AS copies FROM u GROUP BY ALL")
def partition_reduce(spark, d):
    return P.reduce_to_owner(P.with_halo(views.structures(spark, d), 4.3, GRID).withColumn("copies", F.lit(1.0)), ["copies"])


@query(f"""{BASE}, f AS (SELECT *, x / {A} - floor(x / {A}) AS f, (((floor((x + 2) / {A} * 3)::INT % 3) + 3) % 3) AS prev FROM atoms), o AS (SELECT *, f - (prev + 0.5e0) / 3 AS off FROM f)
SELECT system_id, atom_id, (CASE WHEN abs(off - round(off)) <= 0.5e0 / 3 + 1.5e0 / {A} THEN prev ELSE floor(f * 3) END)::INT AS part FROM o""")
def partition_sticky(spark, d):
    ss = views.structures(spark, d)
    ahead = ss.with_(atoms=ss.atoms.withColumn("x", F.col("x") + 2))
    return P.sticky_partition(P.spatial_partition(ahead, 3, GRID), ss, 1.5, GRID).select("system_id", "atom_id", F.col("part").cast("int").alias("part"))
