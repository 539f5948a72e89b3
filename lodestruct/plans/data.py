"""The dataset itself: storage, selection, collation, reshaping, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.order import dense_index
from ..functions.vectors import one_hot as one_hot_column
from ..functions.vectors import voigt_to_matrix
from ..operators import neighbors as N
from ..operators import sampling as G
from ..operators import segments as S
from ..operators import structures as O
from ..sources import datasource, sinks, store, views
from ..structures import FORCE, POSITION, VELOCITY, StructureSet
from .common import BASE, A, B, C, folder, pairs_sql, r, rounded
from .registry import query

_NUM = "n AS (SELECT s.system_id, count(atom_id) AS num_atoms FROM systems s LEFT JOIN atoms USING (system_id) GROUP BY ALL)"


@query(f"{BASE}, {_NUM} SELECT system_id, num_atoms, 0::BIGINT AS num_edges FROM n")
def sizes(spark, d):
    return O.sizes(views.structures(spark, d))


@query(f"""{BASE}, {_NUM} SELECT system_id, row_number() OVER (ORDER BY system_id) - 1 AS graph_idx, (sum(num_atoms) OVER (ORDER BY system_id) - num_atoms)::BIGINT AS atom_start, (sum(num_atoms) OVER (ORDER BY system_id))::BIGINT AS atom_stop FROM n""")
def pointers(spark, d):
    return O.pointers(views.structures(spark, d)).select("system_id", "graph_idx", "atom_start", "atom_stop")


@query(f"""{BASE}, {_NUM}, p AS (SELECT system_id, row_number() OVER (ORDER BY system_id) - 1 AS graph_idx, sum(num_atoms) OVER (ORDER BY system_id) - num_atoms AS start FROM n)
SELECT system_id, atom_id, graph_idx, (start + atom_id)::BIGINT AS global_atom FROM atoms JOIN p USING (system_id)""")
def collate(spark, d):
    return O.collate(views.structures(spark, d)).atoms.select("system_id", "atom_id", "graph_idx", "global_atom")


@query(f"""{BASE}, {pairs_sql(3.7)}, n AS (SELECT a.system_id, a.atom_id, count(p.j) AS n FROM atoms a LEFT JOIN pairs p ON p.system_id = a.system_id AND p.i = a.atom_id GROUP BY ALL)
SELECT system_id, atom_id, (sum(n) OVER w - n)::BIGINT AS start, (sum(n) OVER w)::BIGINT AS stop FROM n WINDOW w AS (ORDER BY system_id, atom_id)""")
def edge_pointers(spark, d):
    ss = views.structures(spark, d)
    return O.edge_pointers(ss.with_(edges=N.neighbor_pairs(ss, 3.7)))


_SEL = "k AS (SELECT system_id, row_number() OVER (ORDER BY system_id) - 1 AS new_id FROM systems WHERE dataset = '1-URGENT')"


@query(f"{BASE}, {_SEL} SELECT new_id AS system_id, atom_id, x FROM atoms JOIN k USING (system_id)")
def index_select(spark, d):
    ss = views.structures(spark, d)
    return O.index_select(ss, ss.systems.filter("dataset = '1-URGENT'")).atoms.select("system_id", "atom_id", "x")


@query(f"{BASE}, k AS (SELECT system_id, row_number() OVER (ORDER BY system_id) - 1 AS new_id FROM systems WHERE dataset <> '1-URGENT') SELECT new_id AS system_id, count(*) AS n FROM atoms JOIN k USING (system_id) GROUP BY ALL")
def trim(spark, d):
    ss = views.structures(spark, d)
    return O.trim(ss, ss.systems.filter("dataset = '1-URGENT'")).atoms.groupBy("system_id").agg(F.count("*").alias("n"))


@query(f"""{BASE}, w AS (SELECT c_custkey AS ordinal, (c_custkey * 7919) % (SELECT max(o_orderkey) + 1 FROM orders) AS system_id FROM customer)
SELECT ordinal, energy, count(atom_id) AS n FROM w JOIN systems USING (system_id) LEFT JOIN atoms USING (system_id) GROUP BY ALL""")
def take(spark, d):
    ss = views.structures(spark, d)
    top = ss.systems.agg(F.max("system_id") + 1).first()[0]
    wanted = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("ordinal"), (F.col("c_custkey") * 7919 % top).alias("system_id"))
    got = O.take(ss, wanted)
    n = got.atoms.groupBy("system_id").agg(F.count("*").alias("n"))
    return got.systems.join(n, "system_id", "left").select(F.col("system_id").alias("ordinal"), "energy", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"{BASE} SELECT s.system_id, coalesce(string_agg(z || ':' || x::INT, ',' ORDER BY atom_id), '') AS listed FROM systems s LEFT JOIN atoms USING (system_id) GROUP BY ALL")
def nest(spark, d):
    nested = O.nest(views.structures(spark, d))
    return nested.select("system_id", F.array_join(F.transform("atoms", lambda a: F.concat_ws(":", a["z"].cast("string"), a["x"].cast("int").cast("string"))), ",").alias("listed"))


@query(f"{BASE} SELECT system_id, atom_id, z, x, y, z_pos FROM atoms")
def nest_round_trip(spark, d):
    ss = views.structures(spark, d)
    return O.unnest(O.nest(ss.with_(atoms=ss.atoms.select("system_id", "atom_id", "z", *POSITION)))).atoms.select("system_id", "atom_id", "z", *POSITION)


_CAT = """u AS (SELECT 0 AS part, system_id, energy, 0.0e0 AS charge FROM systems WHERE dataset = '1-URGENT' UNION ALL SELECT 1, system_id, energy, 2.0e0 FROM systems WHERE dataset = '2-HIGH')"""


@query(f"{BASE}, {_CAT} SELECT row_number() OVER (ORDER BY part, system_id) - 1 AS system_id, energy, charge FROM u")
def concat(spark, d):
    """The second side alone has a charge; the first one's are filled."""
    ss = views.structures(spark, d)
    a, b = (O.select_systems(ss, ss.systems.filter(F.col("dataset") == p)) for p in ("1-URGENT", "2-HIGH"))
    return O.concat(a, b.with_(systems=b.systems.withColumn("charge", F.lit(2.0)))).systems.select("system_id", "energy", "charge")


@query(f"{BASE}, u AS (SELECT dataset, system_id, row_number() OVER (ORDER BY dataset, system_id) - 1 AS new_id FROM systems) SELECT new_id AS system_id, count(*) AS n FROM atoms JOIN u USING (system_id) GROUP BY ALL")
def concat_all(spark, d):
    ss = views.structures(spark, d)
    names = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return O.concat_all([O.select_systems(ss, ss.systems.filter(F.col("dataset") == p)) for p in names]).atoms.groupBy("system_id").agg(F.count("*").alias("n"))


@query(f"""{BASE}, m AS (SELECT system_id, row_number() OVER (ORDER BY system_id) AS k FROM systems WHERE dataset = '1-URGENT'), f AS (SELECT system_id AS slot, row_number() OVER (ORDER BY system_id) AS k FROM systems WHERE dataset = '5-LOW')
SELECT s.system_id, coalesce(t.energy, s.energy) AS energy FROM systems s LEFT JOIN f ON f.slot = s.system_id LEFT JOIN m USING (k) LEFT JOIN systems t ON t.system_id = m.system_id""")
def put(spark, d):
    ss = views.structures(spark, d)
    return O.put(ss, ss, ss.systems.filter("dataset = '1-URGENT'"), ss.systems.filter("dataset = '5-LOW'"))[0].systems.select("system_id", "energy")


@query(f"{BASE}, a AS (SELECT system_id, max(x) AS top FROM atoms GROUP BY ALL) SELECT system_id, coalesce(top, energy) AS energy FROM systems LEFT JOIN a USING (system_id)")
def update_at(spark, d):
    ss = views.structures(spark, d)
    new = ss.atoms.groupBy("system_id").agg(F.max("x").alias("energy"))
    return O.update_at(ss.systems, new, "energy").select("system_id", "energy")


@query(f"{BASE} SELECT system_id, energy, round(energy / 2, 6) AS half FROM systems")
def add_key(spark, d):
    ss = views.structures(spark, d)
    return rounded(O.add_key(ss, "half", ss.systems.select("system_id", (F.col("energy") / 2).alias("half")), "systems").systems.select("system_id", "energy", "half"), "half")


@query(f"{BASE} SELECT system_id, unnest(range(0, 9))::INT AS position, unnest([{A}e0, 0, 0, 0, {B}e0, 0, 0, 0, {C}e0]) AS cell FROM systems")
def to_segmented(spark, d):
    return O.to_segmented(views.systems(spark, d), "cell")


@query(f"""{BASE}, bad AS (SELECT system_id, atom_id FROM atoms WHERE NOT (atom_id = 0 AND system_id % 10 = 0)), n AS (SELECT system_id, count(*) AS n, min(atom_id) AS lo, max(atom_id) AS hi FROM bad GROUP BY ALL)
SELECT system_id, 'atom ids are not 0..n-1' AS problem, lo || ',' || hi || ',' || n AS detail FROM n WHERE lo <> 0 OR hi <> n - 1""")
def validate(spark, d):
    ss = views.structures(spark, d)
    return O.validate(ss.with_(atoms=ss.atoms.filter("not (atom_id = 0 and system_id % 10 = 0)")))


@query(f"{BASE} SELECT system_id, atom_id, CASE WHEN z = 3 THEN 6.0e0 ELSE mass END AS mass, 0 AS category, 0.0e0 AS vx FROM atoms")
def fill_defaults(spark, d):
    ss = views.structures(spark, d)
    masses = spark.range(1, 9).selectExpr("CAST(id AS INT) AS z", "2.0D * id AS mass")
    gaps = ss.with_(atoms=ss.atoms.withColumn("mass", F.when(F.col("z") != 3, F.col("mass"))).drop("category", *VELOCITY))
    return O.fill_defaults(gaps, masses).atoms.select("system_id", "atom_id", "mass", "category", "vx")


@query(f"{BASE} SELECT system_id, atom_id, CASE z WHEN 2 THEN 0 WHEN 5 THEN 1 WHEN 7 THEN 2 ELSE -1 END AS z_index, repeat('0', z - 1) || '1' || repeat('0', 8 - z) AS hot FROM atoms")
def one_hot(spark, d):
    a = O.z_index(views.atoms(spark, d), (2, 5, 7))
    return a.select("system_id", "atom_id", F.coalesce("z_index", F.lit(-1)).alias("z_index"), F.array_join(one_hot_column(F.col("z") - 1, 8).cast("array<string>"), "").alias("hot"))


@query(f"""{BASE}, s AS (SELECT s.system_id, coalesce(sum(fx * x), 0)::BIGINT AS a, coalesce(sum(fy * y * 100), 0)::BIGINT AS b, coalesce(sum(fz * z_pos * 100), 0)::BIGINT AS c, count(atom_id) AS n FROM systems s LEFT JOIN atoms USING (system_id) GROUP BY ALL)
SELECT system_id, a || ',' || n || ',' || (n + 1) || ',' || n || ',' || b || ',' || (n + 2) || ',' || (n + 1) || ',' || (n + 2) || ',' || c AS stress FROM s""")
def voigt(spark, d):
    """A stress of six made from each system's atoms, as three by three."""
    ss = views.structures(spark, d)
    # added by atom id, as in SQL: a sum near a half is rounded by its last bit
    x = S.per_system_in_order(ss.atoms, {"a": F.sum(F.col("fx") * F.col("x")), "b": F.sum(F.col("fy") * F.col("y") * 100), "c": F.sum(F.col("fz") * F.col("z_pos") * 100), "n": F.count("*")}, "atom_id", of=ss.systems)
    # halves to the even side, as a cast to an integer does in SQL
    six = F.array(*[F.rint(F.col(c)).cast("long") for c in "abc"], F.col("n") + 2, F.col("n") + 1, F.col("n"))
    return x.select("system_id", F.array_join(voigt_to_matrix(six).cast("array<string>"), ",").alias("stress"))


_FP = "l AS (SELECT s.system_id, coalesce(string_agg(printf('%d,%.6f,%.6f,%.6f', z, x, y, z_pos), ';' ORDER BY z, x, y, z_pos), '') AS t FROM systems s LEFT JOIN atoms USING (system_id) GROUP BY ALL)"


@query(f"{BASE}, {_FP} SELECT min(system_id) AS system_id, count(*) AS n FROM l GROUP BY t")
def dedup_fingerprint(spark, d):
    """Classes of systems with the same atoms; all cells are equal here."""
    f = O.fingerprint(views.structures(spark, d))
    return f.groupBy("fingerprint").agg(F.min("system_id").alias("system_id"), F.count("*").alias("n")).select("system_id", "n")


@query(f"{BASE} SELECT system_id, atom_id, round(x + 60 - {A} * floor((x + 60) / {A}), 6) AS x, round(y - 20 - {B} * floor((y - 20) / {B}), 6) AS y, CASE WHEN pbc_z THEN z_pos ELSE z_pos + 0.0 END AS z_pos FROM atoms JOIN systems USING (system_id)")
def wrap_positions(spark, d):
    ss = views.structures(spark, d, mixed_pbc=True)
    away = ss.with_(atoms=ss.atoms.withColumns({"x": F.col("x") + 60, "y": F.col("y") - 20}))
    return rounded(O.wrap_positions(away).atoms.select("system_id", "atom_id", *POSITION), *POSITION)


@query(f"{BASE} SELECT system_id, atom_id, round(x / {A}, 9) AS fa, round(y / {B}, 9) AS fb, round(z_pos / {C}, 9) AS fc FROM atoms")
def fractional(spark, d):
    return rounded(O.fractional(views.structures(spark, d)).select("system_id", "atom_id", "fa", "fb", "fc"), "fa", "fb", "fc", digits=9)


@query(f"{BASE}, n AS (SELECT *, sqrt(fx * fx + fy * fy + fz * fz) AS n FROM atoms) SELECT system_id, atom_id, round(CASE WHEN n > 30 THEN fx * 30 / n ELSE fx END, 9) AS fx, round(CASE WHEN n > 30 THEN fy * 30 / n ELSE fy END, 9) AS fy FROM n")
def clamp_norm(spark, d):
    return rounded(O.clamp_norm(views.atoms(spark, d), FORCE, 30.0).select("system_id", "atom_id", "fx", "fy"), "fx", "fy", digits=9)


@query(f"{BASE} SELECT system_id, atom_id, CASE WHEN category = 1 THEN x ELSE x + 1 END AS x, CASE WHEN category = 1 THEN 0 ELSE vx END AS vx FROM atoms")
def freeze(spark, d):
    ss = views.structures(spark, d)
    moved = ss.with_(atoms=ss.atoms.withColumn("x", F.col("x") + 1))
    return O.freeze(moved, ss.atoms, [1]).atoms.select("system_id", "atom_id", "x", "vx")


@query(f"{BASE} SELECT system_id, atom_id, round(fx - 0.1e0 * x, 9) AS fx FROM atoms")
def add_bias(spark, d):
    def spring(ss: StructureSet):
        e = ss.atoms.groupBy("system_id").agg(F.sum(0.05 * F.col("x") * F.col("x")).alias("energy"))
        return e, ss.atoms.select("system_id", "atom_id", (-0.1 * F.col("x")).alias("fx"), F.lit(0.0).alias("fy"), F.lit(0.0).alias("fz"))

    return rounded(O.add_bias(views.structures(spark, d), spring).atoms.select("system_id", "atom_id", "fx"), "fx", digits=9)


@query(f"{BASE} SELECT system_id, atom_id, round(x * 1.01e0, 6) AS x, round(y + 0.02e0 * x, 6) AS y, z_pos FROM atoms")
def apply_strain(spark, d):
    e = F.array(*[F.lit(v) for v in (0.01, 0.02, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)])
    return rounded(O.apply_strain(views.structures(spark, d), e).atoms.select("system_id", "atom_id", *POSITION), "x", "y")


@query(f"""{BASE}, {_NUM}, c AS (SELECT *, sum(num_atoms) OVER (ORDER BY system_id) AS cum FROM n) SELECT system_id, num_atoms FROM c WHERE cum <= 20000""")
def admit_capacity(spark, d):
    return G.admit(O.sizes(views.structures(spark, d)), {"num_atoms": 20000}).select("system_id", "num_atoms")


_PARTS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(f"""{BASE}, k AS (SELECT system_id, dataset, row_number() OVER (ORDER BY dataset <> '1-URGENT', dataset, system_id) - 1 AS id FROM systems WHERE dataset <> '1-URGENT' OR system_id % 3 <> 0)
SELECT id AS system_id, energy, count(atom_id) AS n FROM k JOIN systems USING (system_id) LEFT JOIN atoms USING (system_id) GROUP BY ALL""")
def store_round_trip(spark, d):
    """Write one part, delete a third of it, append the four others, compact, read."""
    # five parts are selected from it, so the view's atoms are numbered and dealt by system once, not for each part
    ss, path = views.structures(spark, d).persist(), folder(spark, "store")
    part = lambda n: O.select_systems(ss, ss.systems.filter(F.col("dataset") == n))
    try:
        store.write_structures(part(_PARTS[0]), path)
        store.delete_structures(spark, path, ss.systems.filter("dataset = '1-URGENT' and system_id % 3 = 0"))
        for n in _PARTS[1:]:
            store.append_structures(part(n), path)
        store.compact(spark, path)
    finally:
        ss.unpersist()
    got = store.read_structures(spark, path)
    n = got.atoms.groupBy("system_id").agg(F.count("*").alias("n"))
    return got.systems.join(n, "system_id", "left").select("system_id", "energy", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"{BASE} SELECT s.system_id, energy, round(energy * 2, 6) AS twice FROM systems s")
def store_add_custom(spark, d):
    ss, path = views.structures(spark, d), folder(spark, "store")
    store.write_structures(ss, path)
    store.add_custom(spark, path, "twice", ss.systems.select("system_id", (F.col("energy") * 2).alias("twice")), "systems")
    return rounded(store.read_structures(spark, path, fields=["energy", "twice"]).systems.select("system_id", "energy", "twice"), "twice")


@query(f"{BASE} SELECT s.o AS ordinal, a.atom_id, a.z, a.x FROM (SELECT system_id, row_number() OVER (ORDER BY system_id DESC) - 1 AS o FROM systems WHERE energy >= 300000) s JOIN atoms a USING (system_id)")
def store_take(spark, d):
    """Systems of high energy, in falling order of id, from a dataset that many files hold: only those that can have them are read."""
    ss, path = views.structures(spark, d), folder(spark, "store")
    store.write_structures(ss, path)
    wanted = ss.systems.filter("energy >= 300000").select("system_id", (-F.col("system_id")).alias("back"))
    got = store.take(spark, path, dense_index(wanted, "back", "ordinal").select("ordinal", "system_id"), fields=["z", "x"])
    return got.atoms.select(F.col("system_id").alias("ordinal"), "atom_id", "z", "x")


@query(f"{BASE} SELECT a.system_id, a.atom_id, a.z, a.x, round(a.x / 2, 6) AS half FROM atoms a JOIN systems s USING (system_id) WHERE a.system_id >= 100 AND dataset <> '5-LOW'")
def store_source(spark, d):
    """Written and read through the data source: a level's rows, a late column, deletions, a filter on ids that chooses files."""
    datasource.register(spark)
    ss, path = views.structures(spark, d), folder(spark, "source")
    ss.systems.write.format("structures").mode("append").option("level", "systems").save(path)
    ss.atoms.select("system_id", "atom_id", "z", "x").write.format("structures").mode("append").save(path)
    store.delete_structures(spark, path, ss.systems.filter("dataset = '5-LOW'"))
    store.add_custom(spark, path, "half", store.read_structures(spark, path, fields=["x"]).atoms.withColumn("half", F.col("x") / 2), "atoms")
    return rounded(spark.read.format("structures").option("columns", "system_id,atom_id,z,x,half").load(path).filter("system_id >= 100"), "half")


@query(f"{BASE} SELECT system_id, energy, count(*) AS n, round(sum(x), 6) AS sx FROM atoms JOIN systems USING (system_id) GROUP BY ALL")
def normalise_records(spark, d):
    """Nested records of other names, as a parser would give them."""
    nested = O.nest(views.structures(spark, d)).filter("size(atoms) > 0")
    recs = nested.select("system_id", F.col("energy").alias("E"), F.transform("atoms", lambda a: a["z"]).alias("numbers"), F.transform("atoms", lambda a: F.array(a["x"], a["y"], a["z_pos"])).alias("pos"), F.create_map(F.lit("tag"), F.lit("x")).alias("info"))
    ss = store.normalise_records(recs, {"numbers": "numbers", "positions": "pos", "energy": "E", "forces": "absent", "info": "info"})
    n = ss.atoms.groupBy("system_id").agg(F.count("*").alias("n"), r(F.sum("x")).alias("sx"))
    return ss.systems.select("system_id", "energy").join(n, "system_id")


@query(f"{BASE} SELECT system_id, step, energy FROM trajectory")
def log_csv(spark, d):
    path = folder(spark, "log")
    sinks.write_log_csv(views.trajectory(spark, d).select("system_id", "step", "energy"), path)
    return spark.read.option("header", True).schema("system_id long, step long, energy double").csv(path)


@query(f"{BASE} SELECT system_id, energy FROM systems")
def sink_drain(spark, d):
    """A batch for each part, all of them written twice at full capacity, then drained."""
    s, path = views.systems(spark, d).select("system_id", "energy", "dataset"), folder(spark, "sink")
    sink = sinks.Sink(spark, path, capacity=s.count())
    for k, part in [*enumerate(_PARTS), *enumerate(_PARTS)]:
        sink.write(s.filter(F.col("dataset") == part).select("system_id", "energy"), k)
    return sink.drain(folder(spark, "drained"))


@query(f"{BASE}, {_NUM} SELECT dataset, count(*) AS n, sum(num_atoms)::BIGINT AS num_atoms FROM n JOIN systems USING (system_id) GROUP BY ALL")
def sink_bounded(spark, d):
    """All systems into a sink that has just room for them."""
    ss = views.structures(spark, d)
    sized = O.sizes(ss).join(ss.systems.select("system_id", "dataset"), "system_id")
    limit = sized.agg(F.count("*"), F.max("num_atoms")).first()
    sink = sinks.BoundedSink(spark, folder(spark, "bounded"), limit[0], limit[1], max_edges=0)
    for part in _PARTS:
        sink.write(sized.filter(F.col("dataset") == part))
    return sink.read().groupBy("dataset").agg(F.count("*").alias("n"), F.sum("num_atoms").alias("num_atoms"))


@query(f"{BASE}, {_NUM} SELECT system_id, num_atoms, energy FROM n JOIN systems USING (system_id)")
def persisted(spark, d):
    """Served from what the executors keep."""
    ss = views.structures(spark, d).persist()
    n = ss.atoms.groupBy("system_id").agg(F.count("*").alias("n"))
    return ss.systems.join(n, "system_id", "left").select("system_id", F.coalesce("n", F.lit(0)).alias("num_atoms"), "energy")


@query(f"{BASE} SELECT 'systems' AS level, 0::BIGINT AS n, (SELECT count(*) FROM systems) AS of_n UNION ALL SELECT 'atoms', 0, (SELECT count(*) FROM atoms)")
def empty_like(spark, d):
    """The same columns without rows, beside the rows that there were."""
    ss = views.structures(spark, d)
    none = O.empty_like(ss)
    rows = [none.levels()[k].select(F.lit(k).alias("level"), F.lit(1).alias("n"), F.lit(0).alias("of")).unionByName(df.select(F.lit(k).alias("level"), F.lit(0).alias("n"), F.lit(1).alias("of"))) for k, df in ss.levels().items()]
    return rows[0].unionByName(rows[1]).groupBy("level").agg(F.sum("n").alias("n"), F.sum("of").alias("of_n"))


@query(f"{BASE}, {_NUM} SELECT system_id, num_atoms, 0::BIGINT AS num_edges FROM n")
def drop_edges(spark, d):
    ss = views.structures(spark, d)
    return O.sizes(O.drop_edges(ss.with_(edges=N.neighbor_pairs(ss, 3.7))))
