"""Selection, collation and reshaping of structure sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order import dense_index, running_sum, tasks
from ..functions.vectors import cell_inverse, elements, norm, row_times, to_cartesian, to_fractional, vec
from ..structures import FORCE, KEYS, POSITION, VELOCITY, StructureSet, without


def sizes(ss: StructureSet) -> DataFrame:
    """(system_id, num_atoms, num_edges), 0 for systems without any."""
    out = ss.systems.select("system_id").join(ss.atoms.groupBy("system_id").agg(F.count("*").alias("num_atoms")), "system_id", "left")
    if ss.edges is None:
        out = out.withColumn("num_edges", F.lit(0).cast("long"))
    else:
        out = out.join(ss.edges.groupBy("system_id").agg(F.count("*").alias("num_edges")), "system_id", "left")
    return out.select("system_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("num_atoms", "num_edges")])


def pointers(ss: StructureSet) -> DataFrame:
    """(system_id, graph_idx, atom_start, atom_stop, edge_start, edge_stop): where each system's rows lie once all are laid end to end."""
    n = running_sum(sizes(ss), "system_id", {"graph_idx": F.lit(1).cast("long"), "atom_start": F.col("num_atoms"), "edge_start": F.col("num_edges")})
    return n.select("system_id", "graph_idx", "atom_start", (F.col("atom_start") + F.col("num_atoms")).alias("atom_stop"), "edge_start", (F.col("edge_start") + F.col("num_edges")).alias("edge_stop"))


def edge_pointers(ss: StructureSet) -> DataFrame:
    """(system_id, atom_id, start, stop) of each atom's edges among all edges; empty for atoms without any."""
    from .neighbors import to_csr

    base = pointers(ss).select("system_id", "edge_start")
    return to_csr(ss.edges, ss.atoms).join(base, "system_id").select("system_id", "atom_id", (F.col("start") + F.col("edge_start")).alias("start"), (F.col("stop") + F.col("edge_start")).alias("stop"))


def collate(ss: StructureSet) -> StructureSet:
    """Adds graph_idx to systems and atoms, global_atom to atoms, global ends gi and gj to edges."""
    p = pointers(ss).select("system_id", "graph_idx", "atom_start")
    atoms = ss.atoms.join(p, "system_id").withColumn("global_atom", F.col("atom_start") + F.col("atom_id")).drop("atom_start")
    edges = ss.edges and ss.edges.join(p, "system_id").withColumns({"gi": F.col("atom_start") + F.col("i"), "gj": F.col("atom_start") + F.col("j")}).drop("atom_start", "graph_idx")
    return StructureSet(ss.systems.join(p.drop("atom_start"), "system_id"), atoms, edges)


def rekey(ss: StructureSet) -> StructureSet:
    """Systems numbered 0, 1, 2, ... in order of their ids."""
    ids = dense_index(ss.systems.select("system_id"), "system_id", "_new")
    return ss.map(lambda df: df.join(ids, "system_id").withColumn("system_id", F.col("_new")).select(df.columns))


def select_systems(ss: StructureSet, ids: DataFrame) -> StructureSet:
    return ss.map(lambda df: df.join(ids.select("system_id"), "system_id", "left_semi"))


def index_select(ss: StructureSet, ids: DataFrame) -> StructureSet:
    """The systems named in ``ids``, numbered anew in order."""
    return rekey(select_systems(ss, ids))


def trim(ss: StructureSet, gone: DataFrame) -> StructureSet:
    """All systems but those named in ``gone``, numbered anew in order."""
    return rekey(ss.map(lambda df: df.join(gone.select("system_id"), "system_id", "left_anti")))


def take(ss: StructureSet, wanted: DataFrame) -> StructureSet:
    """Systems by ``wanted`` (ordinal, system_id): order and repeats are kept, and ``ordinal`` becomes the system_id of what is returned; unknown ids are left out."""
    w = wanted.select(F.col("ordinal").cast("long").alias("_ordinal"), "system_id")
    got = ss.map(lambda df: df.join(w, "system_id").withColumn("system_id", F.col("_ordinal")).select(df.columns))
    return got.with_(systems=got.systems.orderBy("system_id"))


def nest(ss: StructureSet) -> DataFrame:
    """One row per system with its atoms and edges as ordered arrays, empty where there are none."""
    out = ss.systems
    for name, df in (("atoms", ss.atoms), ("edges", ss.edges)):
        if df is not None:
            keys = [k for k in KEYS[name] if k != "system_id"]
            item = F.struct(*keys, *without(df, ("system_id", *keys)))
            packed = df.groupBy("system_id").agg(F.array_sort(F.collect_list(item)).alias(name))
            out = out.join(packed, "system_id", "left").withColumn(name, F.coalesce(name, F.array().cast(packed.schema[name].dataType)))
    return out


def unnest(df: DataFrame) -> StructureSet:
    levels = {n: df.select("system_id", F.inline(n)) for n in ("atoms", "edges") if n in df.columns}
    return StructureSet(df.drop(*levels), **levels)


def _fill(df: DataFrame, columns: Sequence[str], fill: float | None) -> DataFrame:
    keys = {"system_id", "atom_id", "i", "j"}
    return df if fill is None else df.withColumns({c: F.coalesce(c, F.lit(fill).cast(df.schema[c].dataType)) for c in columns if c not in keys and isinstance(df.schema[c].dataType, T.NumericType)})


def concat(a: StructureSet, b: StructureSet, fill: float | None = 0) -> StructureSet:
    """Systems of ``b`` after those of ``a``, numbered 0, 1, 2, ...; columns that one side lacks are filled (nulls if ``fill`` is None), a level that one lacks has no rows for it."""
    return concat_all([a, b], fill)


def concat_all(sets: Sequence[StructureSet], fill: float | None = 0) -> StructureSet:
    """All sets under one numbering, those of a set after those before it; each level is one union with the number of its set."""
    tagged = {}
    for level in KEYS:
        parts = [getattr(s, level).withColumn("_set", F.lit(k)) for k, s in enumerate(sets) if getattr(s, level) is not None]
        if parts:
            common = set.intersection(*[set(p.columns) for p in parts])
            all_ = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
            tagged[level] = _fill(all_, [c for c in all_.columns if c not in common], fill)
    ids = dense_index(tagged["systems"].select("_set", "system_id"), "system_id", "_local", by=("_set",))
    n = ids.groupBy("_set").agg(F.count("*").alias("n"))
    base = n.select("_set", F.coalesce(F.sum("n").over(W.orderBy("_set").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row for each set
    ids = ids.join(F.broadcast(base), "_set").select("_set", "system_id", (F.col("_base") + F.col("_local")).alias("_new"))
    # dealt by a number that is not lowered afterwards, so what a task sorts for the join stays small
    return StructureSet(**{level: df.repartition(tasks(df), "_set", "system_id").join(ids, ["_set", "system_id"]).withColumn("system_id", F.col("_new")).select([c for c in df.columns if c != "_set"]) for level, df in tagged.items()})


def add_key(ss: StructureSet, key: str, df: DataFrame, level: str, overwrite: bool = False) -> StructureSet:
    """A column from ``df`` (the level's key and ``key``); an error if it exists and may not be overwritten, or if the keys differ."""
    own, keys = getattr(ss, level), list(KEYS[level])
    if key in own.columns and not overwrite:
        raise ValueError(f"{level} already has {key}")
    new = df.select(*keys, F.col(key).alias("_new"), F.lit(True).alias("_in"))
    j = own.drop(key).withColumn("_own", F.lit(True)).join(new, keys, "full_outer")
    bad = F.col("_own").isNull() | F.col("_in").isNull()
    j = j.withColumn(key, F.when(bad, F.raise_error(F.lit(f"rows of {key} do not match those of {level}"))).otherwise(F.col("_new")))
    return ss.with_(**{level: j.drop("_new", "_in", "_own")})


def update_at(df: DataFrame, updates: DataFrame, key: str, on: Sequence[str] = ("system_id",)) -> DataFrame:
    """``key`` replaced where ``updates`` has a row; a null there replaces too."""
    new = updates.select(*on, F.col(key).alias("_new"), F.lit(True).alias("_hit"))
    return df.join(new, list(on), "left").withColumn(key, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(key))).select(df.columns)


def put(dest: StructureSet, src: StructureSet, mask: DataFrame, free: DataFrame) -> tuple[StructureSet, DataFrame]:
    """Systems of ``src`` named in ``mask`` go into the slots (system ids of ``dest``) named in ``free``, both in ascending order, as far as slots go.

    Returns the new ``dest`` and (system_id, slot) of what was put.
    """
    m = dense_index(mask.select("system_id").join(src.systems.select("system_id"), "system_id", "left_semi").distinct(), "system_id", "_k")
    f = dense_index(free.select(F.col("system_id").alias("slot")).distinct(), "slot", "_k")
    pairs = m.join(f, "_k").select("system_id", "slot")

    def merged(level: str) -> DataFrame:
        d, s = getattr(dest, level), getattr(src, level)
        moved = s.join(pairs, "system_id").withColumn("system_id", F.col("slot")).drop("slot")
        return d.join(pairs.select(F.col("slot").alias("system_id")), "system_id", "left_anti").unionByName(moved, allowMissingColumns=True)

    return StructureSet(**{k: merged(k) for k in dest.levels() if getattr(src, k) is not None}), pairs


def empty_like(ss: StructureSet) -> StructureSet:
    return ss.map(lambda df: df.limit(0))


def to_segmented(df: DataFrame, key: str) -> DataFrame:
    """An array column as rows (system_id, position, key)."""
    return df.select("system_id", F.posexplode(key).alias("position", key))


def drop_edges(ss: StructureSet) -> StructureSet:
    return ss.with_(edges=None)


def validate(ss: StructureSet) -> DataFrame:
    """(system_id, problem, detail), one row per violation; none for a consistent set."""
    def bad(df: DataFrame, problem: str, detail: Column) -> DataFrame:
        return df.select(F.col("system_id").cast("long").alias("system_id"), F.lit(problem).alias("problem"), detail.cast("string").alias("detail"))

    found = []
    for name, df in ss.levels().items():
        keys = list(KEYS[name])
        found.append(bad(df.groupBy(*keys).count().filter("count > 1"), f"repeated key in {name}", F.concat_ws(",", *keys)))
        if name != "systems":
            found.append(bad(df.join(ss.systems, "system_id", "left_anti"), f"{name} without a system", F.concat_ws(",", *keys)))
    n = ss.atoms.groupBy("system_id").agg(F.count("*").alias("n"), F.min("atom_id").alias("lo"), F.max("atom_id").alias("hi"))
    found.append(bad(n.filter("lo <> 0 or hi <> n - 1"), "atom ids are not 0..n-1", F.concat_ws(",", "lo", "hi", "n")))
    for column, want in (("num_atoms", ss.atoms), ("num_edges", ss.edges)):
        if column in ss.systems.columns and want is not None:
            has = ss.systems.select("system_id", column).join(want.groupBy("system_id").agg(F.count("*").alias("n")), "system_id", "left")
            found.append(bad(has.filter(F.col(column) != F.coalesce("n", F.lit(0))), f"{column} differs from the rows", F.col(column)))
    if ss.edges is not None:
        e = ss.edges.join(n.select("system_id", "n"), "system_id", "left")
        out = ~F.col("i").between(0, F.coalesce("n", F.lit(0)) - 1) | ~F.col("j").between(0, F.coalesce("n", F.lit(0)) - 1)
        found.append(bad(e.filter(out), "edge end out of range", F.concat_ws(",", "i", "j")))
    kinds = {df.schema[c].dataType.simpleString() for df in ss.levels().values() for c in df.columns if isinstance(df.schema[c].dataType, T.FractionalType)}
    if len(kinds) > 1:
        found.append(ss.systems.sparkSession.createDataFrame([(None, "more than one floating-point type", ",".join(sorted(kinds)))], "system_id long, problem string, detail string"))
    return reduce(lambda x, y: x.unionByName(y), found)


def fill_defaults(ss: StructureSet, masses: DataFrame) -> StructureSet:
    """Missing masses from ``masses`` (z, mass; a row per element, so it is broadcast), category 0, velocities 0."""
    a = ss.atoms
    table = F.broadcast(masses.select("z", F.col("mass").alias("_mass")))
    a = a.join(table, "z", "left").withColumn("mass", F.coalesce(F.col("mass"), F.col("_mass")) if "mass" in ss.atoms.columns else F.col("_mass")).drop("_mass")
    defaults = {"category": F.lit(0), **{v: F.lit(0.0) for v in VELOCITY}}
    return ss.with_(atoms=a.withColumns({c: F.coalesce(F.col(c), d) if c in a.columns else d for c, d in defaults.items()}))


def z_index(df: DataFrame, elements_: Sequence[int]) -> DataFrame:
    """``z_index``: place of each atom's element in a list; null for others."""
    return df.withColumn("z_index", F.nullif(F.array_position(F.array(*[F.lit(e) for e in elements_]), F.col("z")), F.lit(0)) - 1)


def fingerprint(ss: StructureSet, decimals: int = 6) -> DataFrame:
    """(system_id, fingerprint): SHA-256 over the atoms in order of element and position, the cell and the periodic axes; independent of the order of atoms."""
    def fixed(c: Column) -> Column:
        return F.format_string(f"%.{decimals}f", F.round(c, decimals) + F.lit(0.0))

    item = F.struct("z", *[(F.round(c, decimals) + F.lit(0.0)).alias(c) for c in POSITION])
    listed = ss.atoms.groupBy("system_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    text = F.concat_ws(";", F.transform("l", lambda a: F.concat_ws(",", a["z"].cast("string"), *[fixed(a[c]) for c in POSITION])))
    s = ss.systems.select("system_id", "cell", "pbc").join(listed, "system_id", "left")
    cell, pbc = F.concat_ws(",", F.transform("cell", fixed)), F.concat_ws(",", F.transform("pbc", lambda b: b.cast("string")))
    return s.select("system_id", F.sha2(F.concat_ws("|", text, cell, pbc), 256).alias("fingerprint"))


def dedup(ss: StructureSet, decimals: int = 6) -> StructureSet:
    """Of systems with equal fingerprints only the one of least id; ids stay."""
    kept = fingerprint(ss, decimals).groupBy("fingerprint").agg(F.min("system_id").alias("system_id"))
    return select_systems(ss, kept)


def _with_cell(ss: StructureSet) -> DataFrame:
    cells = ss.systems.select("system_id", F.col("cell").alias("_cell"), F.col("pbc").alias("_pbc"), cell_inverse(F.col("cell")).alias("_inv"))
    return ss.atoms.join(cells, "system_id")


def wrap_positions(ss: StructureSet) -> StructureSet:
    """Positions moved into the cell along periodic axes."""
    a = _with_cell(ss)
    f = to_fractional(vec(POSITION), elements(F.col("_inv")))
    f = [F.when(F.col("_pbc")[k], f[k] - F.floor(f[k])).otherwise(f[k]) for k in range(3)]
    return ss.with_(atoms=a.withColumns(dict(zip(POSITION, to_cartesian(f, elements(F.col("_cell")))))).select(ss.atoms.columns))


def fractional(ss: StructureSet, names: Sequence[str] = ("fa", "fb", "fc")) -> DataFrame:
    a = _with_cell(ss)
    return a.withColumns(dict(zip(names, to_fractional(vec(POSITION), elements(F.col("_inv")))))).drop("_cell", "_pbc", "_inv")


def apply_strain(ss: StructureSet, strain: Column) -> StructureSet:
    """Cell and positions times (1 + strain): ``strain`` is an array of nine over the columns of systems; fractional positions stay."""
    m = [F.col("_strain")[k] + (1.0 if k % 4 == 0 else 0.0) for k in range(9)]
    s = ss.systems.withColumn("_strain", strain)
    cell = elements(F.col("cell"))
    new = F.array(*[x for r in range(3) for x in row_times(cell[3 * r : 3 * r + 3], m)])
    a = ss.atoms.join(s.select("system_id", "_strain"), "system_id").withColumns(dict(zip(POSITION, row_times(vec(POSITION), m))))
    return ss.with_(systems=s.withColumn("cell", new).select(ss.systems.columns), atoms=a.select(ss.atoms.columns))


def clamp_norm(df: DataFrame, columns: Sequence[str], limit: float) -> DataFrame:
    """Vectors longer than ``limit`` shortened to it, directions kept."""
    d = df.withColumn("_n", norm(vec(columns)))
    return d.withColumns({c: F.when(F.col("_n") > limit, F.col(c) * limit / F.col("_n")).otherwise(F.col(c)) for c in columns}).drop("_n")


def freeze(ss: StructureSet, ref: DataFrame, categories: Sequence[int]) -> StructureSet:
    """Atoms of some categories back at their positions in ``ref``, without velocities and forces."""
    keys = ["system_id", "atom_id"]
    a = ss.atoms.join(ref.select(*keys, *[F.col(c).alias(f"_{c}") for c in POSITION]), keys, "left")
    hit = F.col("category").isin(*categories) & F.col(f"_{POSITION[0]}").isNotNull()
    still = {c: F.when(hit, 0.0).otherwise(F.col(c)) for c in (*VELOCITY, *FORCE) if c in ss.atoms.columns}
    return ss.with_(atoms=a.withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in POSITION} | still).select(ss.atoms.columns))


def add_bias(ss: StructureSet, bias: Callable[[StructureSet], tuple[DataFrame, DataFrame]]) -> StructureSet:
    """Adds what ``bias`` gives: (system_id, energy) and (system_id, atom_id, fx, fy, fz); missing rows add nothing."""
    e, f = bias(ss)
    keys = ["system_id", "atom_id"]
    s = ss.systems.join(e.select("system_id", F.col("energy").alias("_e")), "system_id", "left").withColumn("energy", F.col("energy") + F.coalesce("_e", F.lit(0.0))).select(ss.systems.columns)
    a = ss.atoms.join(f.select(*keys, *[F.col(c).alias(f"_{c}") for c in FORCE]), keys, "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0.0)) for c in FORCE}).select(ss.atoms.columns)
    return ss.with_(systems=s, atoms=a)




