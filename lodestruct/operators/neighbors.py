"""Distance self-joins: all pairs of atoms of a system within a cutoff, with periodic images.

Pair convention: r_ij = r_i - r_j - shift @ cell and |r_ij| < cutoff. An atom is not its own neighbour without a
shift, but its images are. Pairs never cross systems.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order import running_sum
from ..functions.vectors import cell_inverse, cell_volume, column_norms, dot, elements, minimum_image, norm, row_times, to_fractional, vec
from ..structures import POSITION, StructureSet
from . import small

#: Systems of up to so many atoms are searched in a row each; what a row that is repeated for a bin costs, in distances.
SMALL, REPEAT = 512, 4.0
#: Bins of a system at most, whatever its volume.
MAX_BINS = 1 << 20
GEOMETRY = ("dx", "dy", "dz", "r")
PAIR = ("system_id", "i", "j", "sx", "sy", "sz")


def _length(cutoff: float | str) -> Column:
    """A cutoff that is a number, or a column of systems."""
    return F.col(cutoff) if isinstance(cutoff, str) else F.lit(float(cutoff))


def _own(cutoff: float | str) -> list[str]:
    return [cutoff] if isinstance(cutoff, str) else []


def synthesize_cell(ss: StructureSet, cutoff: float) -> StructureSet:
    """Systems without a cell (null) get the box around their atoms, widened by the cutoff and open along all axes."""
    box = ss.atoms.groupBy("system_id").agg(*[F.max(c).alias(f"_hi{k}") for k, c in enumerate(POSITION)], *[F.min(c).alias(f"_lo{k}") for k, c in enumerate(POSITION)])
    edge = [F.coalesce(F.col(f"_hi{k}") - F.col(f"_lo{k}"), F.lit(0.0)) + 2 * cutoff for k in range(3)]
    zero, no = F.lit(0.0), F.lit(False)
    made = F.array(edge[0], zero, zero, zero, edge[1], zero, zero, zero, edge[2])
    s = ss.systems.join(box, "system_id", "left").withColumns({"pbc": F.when(F.col("cell").isNull(), F.array(no, no, no)).otherwise(F.col("pbc")), "cell": F.coalesce("cell", made)})
    return ss.with_(systems=s.select(ss.systems.columns))


def grid_spec(systems: DataFrame, cutoff: float | str, max_bins: int = MAX_BINS) -> DataFrame:
    """Bins along each axis and how many of them a search must reach: (system_id, cell, pbc, inv, n, reach), and the cutoff if it is a column.

    Bins are at least a cutoff wide between lattice planes; all three counts are halved together until their product is at most
    ``max_bins``. One row per system, closed form.
    """
    s = systems.select("system_id", "cell", F.coalesce("pbc", F.array(*[F.lit(False)] * 3)).alias("pbc"), cell_inverse(F.col("cell")).alias("inv"), *_own(cutoff))
    slant, cut = column_norms(elements(F.col("inv"))), _length(cutoff)
    n = [F.greatest(F.lit(1.0), F.floor(1 / (w * cut)).cast("double")) for w in slant]
    # enough halvings of every count to bring the product under the limit
    halvings = F.greatest(F.lit(0.0), F.ceil((F.log2(n[0] * n[1] * n[2]) - math.log2(max_bins)) / 3).cast("double"))
    n = [F.greatest(F.lit(1), F.floor(c / F.pow(F.lit(2.0), halvings)).cast("int")) for c in n]
    s = s.withColumn("n", F.array(*n))
    return s.withColumn("reach", F.array(*[F.ceil(w * cut * F.col("n")[k]).cast("int") for k, w in enumerate(column_norms(elements(F.col("inv"))))]))


def bin_atoms(atoms: DataFrame, spec: DataFrame) -> DataFrame:
    """Atoms with their bin (bx, by, bz; inside the cell along periodic axes) and the cell it was taken from (wx, wy, wz)."""
    a = atoms.join(spec, "system_id")
    f = to_fractional(vec(POSITION), elements(F.col("inv")))
    for k, axis in enumerate("xyz"):
        whole = F.floor(f[k] * F.col("n")[k]).cast("int")
        n, periodic = F.col("n")[k], F.col("pbc")[k]
        a = a.withColumns({f"b{axis}": F.when(periodic, F.pmod(whole, n)).otherwise(whole), f"w{axis}": F.when(periodic, F.floor(whole / n).cast("int")).otherwise(F.lit(0))})
    return a


def bin_counts(binned: DataFrame) -> DataFrame:
    """Atoms of each occupied bin and the number of atoms in the system's bins before it; a bin beyond 2^20 along an axis is an error."""
    c = binned.groupBy("system_id", "bx", "by", "bz").agg(F.count("*").alias("n_atoms"))
    far = F.greatest(*[F.abs(b) for b in ("bx", "by", "bz")]) >= MAX_BINS
    place = reduce(lambda at, b: at * (2 * MAX_BINS) + F.col(b).cast("long") + MAX_BINS, ("bx", "by", "bz"), F.lit(0).cast("long"))
    c = c.withColumn("_place", F.when(far, F.raise_error(F.lit("a bin is too far from the origin")).cast("long")).otherwise(place))
    return running_sum(c, "_place", {"start": F.col("n_atoms")}, by=("system_id",)).drop("_place")


def image_shifts(systems: DataFrame, cutoff: float) -> DataFrame:
    """(system_id, sx, sy, sz): images that can hold a neighbour of an atom inside the cell; 0 along open axes."""
    spec = grid_spec(systems, cutoff)
    reach = [F.when(F.col("pbc")[k], F.ceil(w * cutoff).cast("int")).otherwise(F.lit(0)) for k, w in enumerate(column_norms(elements(F.col("inv"))))]
    out = spec.select("system_id", *[r.alias(f"m{a}") for a, r in zip("xyz", reach)])
    for a in "xyz":
        out = out.withColumn(f"s{a}", F.explode(F.sequence(-F.col(f"m{a}"), F.col(f"m{a}"))))
    return out.select("system_id", "sx", "sy", "sz")


def _ends(carry: Sequence[str], end: str) -> list[Column]:
    """Position and carried columns of one end of a pair, named for it."""
    return [F.col(c).alias(f"{end}_{c}") for c in dict.fromkeys((*POSITION, *carry))]


def _finish(pairs: DataFrame, cutoff: float | str, half: bool, carry: Sequence[str]) -> DataFrame:
    """From both positions, the shift and the cell: distances, the cutoff, and one of each two directions if asked."""
    lattice = row_times([F.col(s) for s in ("sx", "sy", "sz")], elements(F.col("cell")))
    d = [F.col(f"i_{c}") - F.col(f"j_{c}") - s for c, s in zip(POSITION, lattice)]
    p = pairs.withColumns(dict(zip(("dx", "dy", "dz"), d)))
    p = p.withColumn("r2", dot(vec(("dx", "dy", "dz")), vec(("dx", "dy", "dz")))).filter(F.col("r2") < _length(cutoff) * _length(cutoff))
    home = (F.col("sx") == 0) & (F.col("sy") == 0) & (F.col("sz") == 0)
    ahead = (F.col("sx") > 0) | ((F.col("sx") == 0) & ((F.col("sy") > 0) | ((F.col("sy") == 0) & (F.col("sz") > 0))))
    p = p.filter((F.col("i") < F.col("j")) | ((F.col("i") == F.col("j")) & ahead) if half else ~((F.col("i") == F.col("j")) & home))
    return p.select(*PAIR, "dx", "dy", "dz", F.sqrt("r2").alias("r"), *[f"{end}_{c}" for c in carry for end in "ij"])


def _naive(ss: StructureSet, cutoff: float | str, half: bool, left: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Each two atoms of a system meet once on its key; the images that can be near follow from their fractional distance, so no others are made."""
    spec = grid_spec(ss.systems, cutoff).select("system_id", "cell", "pbc", "inv", *_own(cutoff), F.array(*[w * _length(cutoff) for w in column_norms(elements(F.col("inv")))]).alias("slack"))
    i = left.select("system_id", F.col("atom_id").alias("i"), *_ends(carry, "i"))
    j = ss.atoms.select("system_id", F.col("atom_id").alias("j"), *_ends(carry, "j"))
    p = i.join(j, "system_id").join(spec, "system_id")
    f = to_fractional([F.col(f"i_{c}") - F.col(f"j_{c}") for c in POSITION], elements(F.col("inv")))
    # named before they are used more than once, so generated code stays small enough to be compiled
    p = p.withColumns({f"f{a}": x for a, x in zip("xyz", f)})
    p = p.withColumns({f"lo{a}": F.ceil(F.col(f"f{a}") - F.col("slack")[k]).cast("int") for k, a in enumerate("xyz")} | {f"hi{a}": F.floor(F.col(f"f{a}") + F.col("slack")[k]).cast("int") for k, a in enumerate("xyz")})
    none = F.array().cast("array<int>")
    for k, a in enumerate("xyz"):
        # along an open axis a pair further apart than the cutoff between lattice planes has no image either
        fits = F.when(F.col("pbc")[k], F.col(f"lo{a}") <= F.col(f"hi{a}")).otherwise(F.abs(F.col(f"f{a}")) < F.col("slack")[k] + 1e-12)
        p = p.withColumn(f"s{a}", F.when(fits, F.when(F.col("pbc")[k], F.sequence(f"lo{a}", f"hi{a}")).otherwise(F.array(F.lit(0)))).otherwise(none))
    p = p.filter((F.size("sx") > 0) & (F.size("sy") > 0) & (F.size("sz") > 0))
    for a in "xyz":
        p = p.withColumn(f"s{a}", F.explode(f"s{a}"))
    return _finish(p, cutoff, half, carry)


def _grid(ss: StructureSet, cutoff: float | str, half: bool, left: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Atoms meet on (system, bin): one side, narrowed to key and position, is repeated for the bins around its own; the cell in which such a bin lies is the image."""
    spec = grid_spec(ss.systems, cutoff)
    side = ("system_id", "atom_id", *dict.fromkeys((*POSITION, *carry)))
    j = bin_atoms(ss.atoms.select(*side), spec).select("system_id", F.col("atom_id").alias("j"), *_ends(carry, "j"), "bx", "by", "bz", *[F.col(f"w{a}").alias(f"jw{a}") for a in "xyz"])
    i = bin_atoms(left.select(*side), spec)
    for k, a in enumerate("xyz"):
        i = i.withColumn("o", F.explode(F.sequence(-F.col("reach")[k], F.col("reach")[k])))
        at, n = F.col(f"b{a}") + F.col("o"), F.col("n")[k]
        i = i.withColumns({f"b{a}": F.when(F.col("pbc")[k], F.pmod(at, n)).otherwise(at), f"m{a}": F.when(F.col("pbc")[k], F.floor(at / n).cast("int") + F.col(f"w{a}")).otherwise(F.lit(0))})
    i = i.select("system_id", F.col("atom_id").alias("i"), *_ends(carry, "i"), "cell", *_own(cutoff), "bx", "by", "bz", "mx", "my", "mz")
    p = i.join(j, ["system_id", "bx", "by", "bz"])
    return _finish(p.withColumns({f"s{a}": F.col(f"m{a}") - F.col(f"jw{a}") for a in "xyz"}), cutoff, half, carry)


def search_costs(ss: StructureSet, cutoff: float | str, sizes: DataFrame | None = None) -> DataFrame:
    """(system_id, naive, grid): distances that either search is expected to compute for a system, from its number of atoms, cell, cutoff and periodic axes.

    The naive join looks at each two atoms and at the images that the cutoff reaches. Bins repeat each atom for the bins
    within reach, which costs REPEAT distances each, and compare it with what lies there. Systems without atoms have no row.
    """
    n = ss.atoms.groupBy("system_id").agg(F.count("*").alias("_size")) if sizes is None else sizes
    s = grid_spec(ss.systems, cutoff).join(n, "system_id")
    wide = [2 * w * _length(cutoff) for w in column_norms(elements(F.col("inv")))]
    images = reduce(lambda x, y: x * y, [F.when(F.col("pbc")[k], w).otherwise(F.least(w, F.lit(1.0))) for k, w in enumerate(wide)])
    around = reduce(lambda x, y: x * y, [2.0 * F.col("reach")[k] + 1 for k in range(3)])
    # along an open axis no more bins are looked into than there are
    inside = reduce(lambda x, y: x * y, [F.when(F.col("pbc")[k], (2.0 * F.col("reach")[k] + 1) / F.col("n")[k]).otherwise(F.least((2.0 * F.col("reach")[k] + 1) / F.col("n")[k], F.lit(1.0))) for k in range(3)])
    size = F.col("_size").cast("double")
    return s.select("system_id", (size * size * (1 + images)).alias("naive"), (REPEAT * size * around + size * size * inside).alias("grid"))


def _in_rows(ss: StructureSet, cutoff: float | str, half: bool, carry: Sequence[str], binned: bool, targets: DataFrame | None) -> tuple[DataFrame | None, StructureSet | None]:
    """Pairs of systems of few atoms, and the systems that are left; None where there are none."""
    if not isinstance(ss.atoms.schema["atom_id"].dataType, T.IntegralType):
        return None, ss
    few, many = small.split_by_size(ss, SMALL)
    aim = None
    if targets is not None:
        aim, own = "_aim", targets.select("system_id", "atom_id", F.lit(True).alias("_aim")).distinct()
        few = few.with_(atoms=few.atoms.join(own, ["system_id", "atom_id"], "left"))
    return small.pairs(few, grid_spec(few.systems, cutoff), _length(cutoff), half, carry, binned, aim), many


def _joined(ss: StructureSet, cutoff: float | str, half: bool, carry: Sequence[str], method: str | None, targets: DataFrame | None) -> DataFrame:
    """Pairs by joins: of all atoms of a system, or of those in neighbouring bins."""
    ways = {"naive": _naive, "grid": _grid}
    of = {method: ss.atoms}
    if method is None:
        binned = search_costs(ss, cutoff).select("system_id", (F.col("grid") < F.col("naive")).alias("_bins"))
        some, every = binned.agg(F.bool_or("_bins"), F.bool_and("_bins")).first()
        of = {"naive": ss.atoms}
        if some:
            # a join, not a window: the counts are summed before they are dealt, and a large system's atoms can be split
            of = {"grid": ss.atoms} if every else {m: ss.atoms.join(binned.filter(c).select("system_id"), "system_id", "left_semi") for m, c in (("naive", ~F.col("_bins")), ("grid", F.col("_bins")))}

    def aimed(side: DataFrame) -> DataFrame:
        return side if targets is None else side.join(targets.select("system_id", "atom_id").distinct(), ["system_id", "atom_id"], "left_semi")

    return reduce(lambda x, y: x.unionByName(y), [ways[m](ss.with_(atoms=side), cutoff, half, aimed(side), carry) for m, side in of.items()])


def neighbor_pairs(ss: StructureSet, cutoff: float | str, pbc: bool = True, half: bool = False, method: str | None = None, targets: DataFrame | None = None, with_geometry: bool = True, strict: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """All pairs within ``cutoff``: (system_id, i, j, sx, sy, sz) and, with geometry, dx, dy, dz, r.

    Systems of up to SMALL atoms are searched in a row each, without a row for each two atoms or bin. For the others
    method "naive" joins all atoms of a system, "grid" bins them (and the small ones' atoms in their row); by default
    ``search_costs`` decides for each system.
    ``targets`` (system_id, atom_id) restricts i. ``strict`` raises where an active pair has distance 0. ``half``
    keeps one direction: i < j, or a positive shift for an atom and its own image. Columns of atoms named in ``carry``
    come along as i_<name> and j_<name>, which spares a join for them later. A cutoff that is a string names a column of
    systems: each system has its own; one that is null or not positive has no pairs.
    """
    if isinstance(cutoff, str):
        ss = ss.with_(systems=ss.systems.filter(F.col(cutoff) > 0))
    elif cutoff <= 0:
        raise ValueError("cutoff must be positive")
    if not pbc:
        ss = ss.with_(systems=ss.systems.withColumn("pbc", F.array(*[F.lit(False)] * 3)))
    if method not in (None, "naive", "grid"):
        raise ValueError(f"no such method: {method}")
    found, ss = _in_rows(ss, cutoff, half, carry, method == "grid", targets)
    if ss is not None:
        many = _joined(ss, cutoff, half, carry, method, targets)
        found = many if found is None else found.unionByName(many)
    pairs = found
    if strict:
        pairs = pairs.withColumn("r", F.when(F.col("r") == 0, F.raise_error(F.lit("two atoms of a pair coincide"))).otherwise(F.col("r")))
    return pairs if with_geometry else pairs.drop(*GEOMETRY)


def neighbor_pairs_dual(ss: StructureSet, rc1: float, rc2: float, **options) -> DataFrame:
    """Pairs within the greater cutoff with a flag for each: in1, in2."""
    if rc2 < rc1:
        raise ValueError("the second cutoff must not be smaller")
    return neighbor_pairs(ss, rc2, **options).withColumns({"in1": F.col("r") < rc1, "in2": F.lit(True)})


def mirror(pairs: DataFrame) -> DataFrame:
    """A half list with the other direction of each pair added."""
    other = {c: f"{'j' if c[0] == 'i' else 'i'}{c[1:]}" for c in pairs.columns if c in "ij" or c[:2] in ("i_", "j_")}
    flip = {**{c: F.col(o) for c, o in other.items()}, **{c: -F.col(c) for c in ("sx", "sy", "sz", "dx", "dy", "dz") if c in pairs.columns}}
    return pairs.unionByName(pairs.select(*[flip.get(c, F.col(c)).alias(c) for c in pairs.columns]))


def order_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(*PAIR)


def neighbor_rank(pairs: DataFrame) -> DataFrame:
    """0, 1, ... for the neighbours of each atom, by j and shift."""
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("system_id", "i").orderBy("j", "sx", "sy", "sz")) - 1)


def to_matrix(pairs: DataFrame, atoms: DataFrame, k: int, fill: int = -1) -> DataFrame:
    """(system_id, atom_id, n, neighbors, shifts): lists of width ``k`` in order of j and shift, filled up; more than ``k`` neighbours are an error."""
    item = F.struct("j", "sx", "sy", "sz")
    rows = pairs.groupBy("system_id", F.col("i").alias("atom_id")).agg(F.array_sort(F.collect_list(item)).alias("l"))
    m = atoms.select("system_id", "atom_id").join(rows, ["system_id", "atom_id"], "left")
    size = F.coalesce(F.size("l"), F.lit(0))
    m = m.withColumn("n", F.when(F.col("l").isNull(), 0).when(size > k, F.raise_error(F.concat(F.lit(f"more than {k} neighbours: "), size.cast("string")))).otherwise(size).cast("int"))
    ids = F.coalesce(F.transform("l", lambda x: x["j"].cast("long")), F.array().cast("array<long>"))
    shifts = F.coalesce(F.transform("l", lambda x: F.array(x["sx"], x["sy"], x["sz"])), F.array().cast("array<array<int>>"))
    return m.select("system_id", "atom_id", "n", F.concat(ids, F.array_repeat(F.lit(fill).cast("long"), k - F.col("n"))).alias("neighbors"), F.concat(shifts, F.array_repeat(F.array(*[F.lit(0)] * 3), k - F.col("n"))).alias("shifts"))


def to_coo(matrix: DataFrame) -> DataFrame:
    """Pairs (system_id, i, j, sx, sy, sz) of a matrix, without its fill."""
    zipped = F.arrays_zip(F.slice("neighbors", F.lit(1), F.col("n")).alias("j"), F.slice("shifts", F.lit(1), F.col("n")).alias("s"))
    m = matrix.select("system_id", F.col("atom_id").alias("i"), F.explode(zipped).alias("p"))
    return m.select("system_id", "i", F.col("p")["0"].alias("j") if "0" in m.schema["p"].dataType.names else F.col("p.j"), *[(F.col("p")[m.schema["p"].dataType.names[1]])[k].alias(f"s{a}") for k, a in enumerate("xyz")])


def to_csr(pairs: DataFrame, atoms: DataFrame) -> DataFrame:
    """(system_id, atom_id, start, stop) of every atom in the system's pairs ordered by i, j and shift; empty for atoms without pairs."""
    n = pairs.groupBy("system_id", F.col("i").alias("atom_id")).agg(F.count("*").alias("n"))
    a = atoms.select("system_id", "atom_id").join(n, ["system_id", "atom_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return running_sum(a, "atom_id", {"stop": F.col("n")}, exclusive=False, by=("system_id",)).select("system_id", "atom_id", (F.col("stop") - F.col("n")).alias("start"), "stop")


def estimate_max_neighbors(density: Column, cutoff: float) -> Column:
    """Density times the volume of the cutoff sphere, at least 16, rounded up to a multiple of 16."""
    return (F.greatest(F.lit(1), F.ceil(density * (4 / 3 * math.pi * cutoff**3) / 16)) * 16).cast("int")


def density(ss: StructureSet) -> DataFrame:
    n = ss.atoms.groupBy("system_id").agg(F.count("*").alias("n"))
    return ss.systems.select("system_id", cell_volume(F.col("cell")).alias("v")).join(n, "system_id", "left").select("system_id", (F.coalesce("n", F.lit(0)) / F.col("v")).alias("density"))


def max_neighbors(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("system_id", "i").count().groupBy("system_id").agg(F.max("count").alias("max_neighbors"))


def needs_rebuild(ref: DataFrame, cur: StructureSet, skin: float) -> DataFrame:
    """(system_id, rebuild): whether an atom has moved more than ``skin`` since ``ref``, to its nearest image along periodic axes. Systems without atoms need none."""
    a = ref.select("system_id", "atom_id", *[F.col(c).alias(f"_{c}") for c in POSITION]).join(cur.atoms.select("system_id", "atom_id", *POSITION), ["system_id", "atom_id"]).join(cur.systems.select("system_id", "cell", "pbc"), "system_id")
    d = minimum_image([F.col(c) - F.col(f"_{c}") for c in POSITION], elements(F.col("cell")), elements(cell_inverse(F.col("cell"))), F.col("pbc"))
    moved = a.groupBy("system_id").agg(F.bool_or(norm(d) > skin).alias("rebuild"))
    return cur.systems.select("system_id").join(moved, "system_id", "left").select("system_id", F.coalesce("rebuild", F.lit(False)).alias("rebuild"))


def bins_changed(ref_bins: DataFrame, cur_bins: DataFrame) -> DataFrame:
    """(system_id, rebuild): whether an atom lies in another bin than before."""
    keys, bins = ["system_id", "atom_id"], ("bx", "by", "bz")
    a = ref_bins.select(*keys, *[F.col(c).alias(f"_{c}") for c in bins]).join(cur_bins.select(*keys, *bins), keys)
    return a.groupBy("system_id").agg(F.bool_or(reduce(lambda x, y: x | y, [F.col(c) != F.col(f"_{c}") for c in bins])).alias("rebuild"))


def refresh_pairs(cached: DataFrame, ss: StructureSet, flags: DataFrame, cutoff: float, skin: float, **options) -> DataFrame:
    """Pairs within ``cutoff + skin``: found again for flagged systems, taken from ``cached`` for the rest."""
    hot = flags.filter("rebuild").select("system_id")
    again = ss.map(lambda df: df.join(hot, "system_id", "left_semi"))
    return cached.join(hot, "system_id", "left_anti").unionByName(neighbor_pairs(again, cutoff + skin, **options))
